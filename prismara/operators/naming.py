"""Names of clusters and of images without a folder.

Inputs are long tables: ``members(cluster_id, image_id, ord)`` and
``scores(image_id, tag, tag_idx, category, score)``. Ties go to the tag that comes
first in the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismara.functions.text import safe_name, spoken
from prismara.plans.adjacent import with_rank
from prismara.schema import CHARACTER, GENERIC_TAGS, NAMELESS_TAGS, RATING
from prismara.session import materialize


def _named_scores(members: DataFrame, scores: DataFrame) -> DataFrame:
    usable = scores.where((F.col("category") != RATING) & ~F.col("tag").isin(*NAMELESS_TAGS))
    return members.join(usable, "image_id")


def cluster_tfidf(members: DataFrame, scores: DataFrame) -> DataFrame:
    """``cluster_id, tag, tag_idx, category, avg_score, df, tfidf``.

    The average is over all members, those without scores included; scores below 0.1
    don't count; idf = ln(1 + clusters / clusters with the tag).
    """
    sizes = members.groupBy("cluster_id").agg(F.countDistinct("image_id").alias("members"))
    total = members.agg(F.countDistinct("cluster_id").alias("clusters"))
    summed = _named_scores(members, scores).where("score >= 0.1").groupBy("cluster_id", "tag", "tag_idx", "category").agg(F.sum("score").alias("s"))
    averaged = summed.join(sizes, "cluster_id").withColumn("avg_score", F.col("s") / F.col("members"))
    df = averaged.groupBy("tag").agg(F.count("*").alias("df"))
    out = averaged.join(df, "tag").crossJoin(F.broadcast(total))  # one row
    return out.select("cluster_id", "tag", "tag_idx", "category", "avg_score", "df", (F.col("avg_score") * F.log1p(F.col("clusters") / F.col("df"))).alias("tfidf"))


def cluster_characters(members: DataFrame, scores: DataFrame, above: float = 0.15) -> DataFrame:
    """``cluster_id, characters``: each cluster's characters in the order they are first seen."""
    seen = _named_scores(members, scores).where((F.col("category") == CHARACTER) & (F.col("score") > above))
    first = seen.groupBy("cluster_id", "tag").agg(F.min(F.struct("ord", "tag_idx")).alias("at"))
    return first.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "tag"))), lambda s: s["tag"]).alias("characters"))


def _distinct_parts(first: Column, rest: Column, most: int = 4) -> Column:
    """Parts in order without repeats: all of ``first``, then ``rest`` until there are ``most``."""
    start = F.array_distinct(first)
    return F.aggregate(rest, start, lambda acc, x: F.when((F.size(acc) >= most) | F.array_contains(acc, x), acc).otherwise(F.array_append(acc, x)))


def base_names(members: DataFrame, scores: DataFrame, tfidf: DataFrame | None = None) -> DataFrame:
    """``cluster_id, base_name``: up to two characters, then the most telling tags until there are four parts."""
    tfidf = (cluster_tfidf(members, scores) if tfidf is None else tfidf).where(F.col("category") != CHARACTER)
    ranked = tfidf.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("tfidf"), "tag_idx", "tag")))
    telling = ranked.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda s: spoken(s["tag"])).alias("telling"))
    none = F.array().cast("array<string>")
    joined = members.select("cluster_id").distinct().join(cluster_characters(members, scores), "cluster_id", "left").join(telling, "cluster_id", "left")
    characters = F.transform(F.slice(F.coalesce("characters", none), 1, 2), spoken)
    parts = _distinct_parts(characters, F.coalesce("telling", none))
    name = F.when(F.size(parts) > 0, F.substring(safe_name(F.array_join(parts, " ")), 1, 60)).otherwise(F.format_string("group_%03d", F.col("cluster_id") + 1))
    return joined.select("cluster_id", name.alias("base_name"))


def cluster_names(members: DataFrame, scores: DataFrame) -> DataFrame:
    """``cluster_id, name``: base names; equal ones get a tag that sets the cluster apart, else a number.

    A tag sets a cluster apart if it isn't in the name and its average in every
    cluster of that name is at most half this cluster's TF-IDF score.
    """
    # Both are used several times, so they are written once.
    members, scores = materialize(members.select("cluster_id", "image_id", "ord"), "members"), materialize(scores.select("image_id", "tag", "tag_idx", "category", "score"), "scores")
    tfidf = materialize(cluster_tfidf(members, scores), "tfidf")
    base = materialize(base_names(members, scores, tfidf), "base")
    ordered = Window.partitionBy("base_name").orderBy("cluster_id")
    shared = base.withColumn("k", F.row_number().over(ordered)).withColumn("same", F.count("*").over(Window.partitionBy("base_name")))
    own = shared.where("same > 1").join(tfidf, "cluster_id").withColumn("clean", spoken(F.col("tag"))).where(~F.contains("base_name", "clean"))
    # Of each name and tag the two greatest averages tell the greatest of the others, so no cluster meets all others of its name.
    averages = shared.where("same > 1").select("cluster_id", "base_name").join(tfidf.select("cluster_id", "tag", "avg_score"), "cluster_id")
    top = averages.groupBy("base_name", "tag").agg(F.max(F.struct("avg_score", "cluster_id")).alias("top"))
    second = averages.join(top, ["base_name", "tag"]).where("cluster_id <> top.cluster_id").groupBy("base_name", "tag").agg(F.max("avg_score").alias("second"))
    theirs = F.when(F.col("top.cluster_id") == F.col("cluster_id"), F.col("second")).otherwise(F.col("top.avg_score"))
    clash = own.join(top, ["base_name", "tag"]).join(second, ["base_name", "tag"], "left").where(theirs > F.col("tfidf") * 0.5).select("cluster_id", "tag")
    apart = own.join(clash, ["cluster_id", "tag"], "left_anti")
    extra = apart.groupBy("cluster_id").agg(F.min_by("clean", F.struct((-F.col("tfidf")).alias("t"), "tag_idx", "tag")).alias("extra"))
    joined = shared.join(extra, "cluster_id", "left")
    name = F.when(F.col("same") == 1, F.col("base_name")).when(F.col("extra").isNotNull(), F.substring(safe_name(F.concat_ws(" ", "base_name", "extra")), 1, 60)).otherwise(F.concat_ws("_", "base_name", F.col("k").cast("string")))
    return joined.select("cluster_id", name.alias("name"))


def fallback_names(images: DataFrame, scores: DataFrame) -> DataFrame:
    """``image_id, name`` of each of ``images(image_id)``: its two best tags above 0.35, generic ones at a tenth; else ``Other``."""
    usable = scores.where((F.col("category") != RATING) & (F.col("score") > 0.35))
    weighed = usable.withColumn("w", F.when(F.col("tag").isin(*GENERIC_TAGS), F.col("score") * 0.1).otherwise(F.col("score")))
    ranked = weighed.withColumn("r", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("w"), "tag_idx", "tag"))).where("r <= 2")
    named = ranked.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda s: spoken(s["tag"])).alias("parts"))
    name = F.when(F.col("parts").isNull(), F.lit("Other")).otherwise(F.substring(safe_name(F.array_join("parts", " ")), 1, 40))
    return images.select("image_id").join(named, "image_id", "left").select("image_id", name.alias("name"))


def folder_path(*levels: Column) -> Column:
    """Levels that aren't empty, joined by slashes."""
    return F.concat_ws("/", *[F.nullif(x, F.lit("")) for x in levels])


def top_tags(scores: DataFrame, n: int = 30) -> DataFrame:
    """``image_id, tags``: the set of an image's ``n`` best tags."""
    ranked = scores.withColumn("r", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "tag_idx", "tag"))).where(F.col("r") <= n)
    return ranked.groupBy("image_id").agg(F.collect_set("tag").alias("tags"))


def sampled_members(members: DataFrame, most: int = 10) -> DataFrame:
    """Members at every step-th place, the first ``most`` of them; step = max(1, members // most)."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    placed = with_rank(members, ["cluster_id"], ["ord", "image_id"]).withColumn("at", F.col("rank") - 1).join(sizes, "cluster_id")
    step = F.greatest(F.lit(1), F.floor(F.col("n") / most))
    return placed.where((F.col("at") % step == 0) & (F.col("at") / step < most)).drop("at", "rank")


def coherence(members: DataFrame, scores: DataFrame) -> DataFrame:
    """``cluster_id, overlap``: average intersection over union of sampled members' tags; 1 without a pair.

    At most ten members a cluster are compared, so pairs are at most 45 a cluster.
    """
    chosen = sampled_members(members).join(top_tags(scores), "image_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    a = chosen.select("cluster_id", F.col("ord").alias("i"), F.col("tags").alias("s"))
    b = chosen.select("cluster_id", F.col("ord").alias("j"), F.col("tags").alias("t"))
    pairs = a.join(b, "cluster_id").where("i < j").withColumn("u", F.size(F.array_union("s", "t"))).where("u > 0")
    found = pairs.groupBy("cluster_id").agg(F.avg(F.size(F.array_intersect("s", "t")) / F.col("u")).alias("overlap"))
    return members.select("cluster_id").distinct().join(found, "cluster_id", "left").select("cluster_id", F.coalesce("overlap", F.lit(1.0)).alias("overlap"))


def refine(members: DataFrame, scores: DataFrame, least: float = 0.25) -> DataFrame:
    """``cluster_id, part, image_id``: clusters of more than three whose overlap is low, split by their nearest sampled member.

    A sampled member with tags is its own part's; others go to the most similar sample
    by intersection over union (ties: the first). A cluster without any tag stays whole.
    """
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    tags = top_tags(scores)
    # A cluster without a tag has no pair with a union, so its overlap is 1 and it stays.
    loose = coherence(members, scores).where(F.col("overlap") < least).join(sizes.where("n > 3"), "cluster_id").select("cluster_id")
    none = F.array().cast("array<string>")
    anchors = sampled_members(members).join(loose, "cluster_id", "left_semi").join(tags, "image_id", "left").select("cluster_id", F.col("ord").alias("anchor"), F.coalesce("tags", none).alias("t"))
    rows = members.join(loose, "cluster_id", "left_semi").join(tags, "image_id", "left").withColumn("s", F.coalesce("tags", none))
    union = F.size(F.array_union("s", "t"))
    score = F.when((F.col("ord") == F.col("anchor")) & (F.size("t") > 0), F.lit(2.0)).otherwise(F.coalesce(F.size(F.array_intersect("s", "t")) / F.nullif(union, F.lit(0)), F.lit(0.0)))
    split = rows.join(anchors, "cluster_id").groupBy("cluster_id", "image_id", "ord").agg(F.max_by("anchor", F.struct(score.alias("v"), (-F.col("anchor")).alias("p"))).alias("part"))
    whole = members.join(loose, "cluster_id", "left_anti").select("cluster_id", F.lit(0).cast("long").alias("part"), "image_id")
    return split.select("cluster_id", F.col("part").cast("long"), "image_id").unionByName(whole)
