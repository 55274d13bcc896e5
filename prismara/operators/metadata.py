"""Folder metadata, samples, placement plans and run counters."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from prismara.functions.text import basename, extension, safe_name, stem
from prismara.operators.tags import holds_any
from prismara.schema import CHARACTER, MATURE_METADATA, RATING, RATINGS


def seeded(key: Column, seed: int = 42) -> Column:
    """A stable pseudo-random number of a key (64 bits of its MD5 with the seed)."""
    return F.substring(F.md5(F.concat_ws("#", F.lit(str(seed)), key.cast("string"))), 1, 16)


def folder_sample(assigned: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` images of each folder, drawn by a seeded hash of ``path``; 0 means all."""
    if most <= 0:
        return assigned
    rank = F.row_number().over(Window.partitionBy("folder").orderBy(seeded(F.col("path"), seed), "path"))
    return assigned.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def image_metadata(scores: DataFrame, tags_per_image: int = 30) -> DataFrame:
    """One row per image with scores: ``image_id``, rating, tag lists, all scores and ``has_mature``.

    The best ``tags_per_image`` tags above 0.07 that are no ratings; a tag with a
    mature substring is mature whatever its category, then characters, then general.
    """
    rated = scores.groupBy("image_id").agg(F.struct(*[F.round(F.coalesce(F.max(F.when(F.col("tag") == r, F.col("score"))), F.lit(0.0)), 3).alias(r) for r in RATINGS]).alias("rating"))
    content = scores.where((F.col("category") != RATING) & (F.col("score") > 0.07))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "tag_idx", "tag"))
    kind = F.when(holds_any(F.col("tag"), MATURE_METADATA), "mature").when(F.col("category") == CHARACTER, "character").otherwise("general")
    best = content.withColumn("r", rank).where(F.col("r") <= tags_per_image).withColumn("kind", kind).withColumn("score", F.round("score", 3))
    listed = best.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("r", "tag", "kind", "score"))).alias("t"))

    def of(k: str) -> Column:
        return F.coalesce(F.transform(F.filter("t", lambda s: s["kind"] == k), lambda s: s["tag"]), F.array().cast("array<string>")).alias(f"{k}_tags")

    scored = F.coalesce(F.map_from_entries(F.transform("t", lambda s: F.struct(s["tag"], s["score"]))), F.create_map().cast("map<string,double>")).alias("all_scores")
    return rated.join(listed, "image_id", "left").select("image_id", "rating", of("general"), of("character"), of("mature"), scored, F.coalesce(F.exists("t", lambda s: s["kind"] == "mature"), F.lit(False)).alias("has_mature"))


def folder_metadata(assigned: DataFrame, scores: DataFrame, per_folder: int = 0, tags_per_image: int = 30, seed: int = 42) -> DataFrame:
    """``folder, total_images, sampled, images, has_mature``: a folder's document; of at most ``per_folder`` images, 0 for all.

    ``assigned(image_id, folder, path)``; an empty folder is ``root``. Images are keyed
    by file name, or by their whole path where names clash in the sample. A document holds
    its whole folder by default; ``image_rows`` and ``write_image_rows`` suit folders that
    are too large for one row.
    """
    rows = image_rows(assigned, scores, per_folder, tags_per_image, seed)
    totals = assigned.groupBy(F.coalesce(F.nullif("folder", F.lit("")), F.lit("root")).alias("folder")).agg(F.count("*").alias("total_images"))
    entry = F.struct("rating", "general_tags", "character_tags", "mature_tags", "all_scores", "error")
    made = rows.groupBy("folder").agg(F.count("*").alias("sampled"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("name").alias("key"), F.to_json(entry).alias("value"))))).alias("images"), F.bool_or("has_mature").alias("has_mature"))
    return totals.join(made, "folder").select("folder", "total_images", "sampled", "images", "has_mature")


def image_rows(assigned: DataFrame, scores: DataFrame, per_folder: int = 0, tags_per_image: int = 30, seed: int = 42) -> DataFrame:
    """One row per sampled image with its folder, its name there, and its metadata or ``error``."""
    named = assigned.select("image_id", F.coalesce(F.nullif("folder", F.lit("")), F.lit("root")).alias("folder"), "path")
    sample = folder_sample(named, per_folder, seed).withColumn("base", basename(F.col("path")))
    clashes = F.count("*").over(Window.partitionBy("folder", "base"))
    keyed = sample.withColumn("name", F.when(clashes > 1, F.col("path")).otherwise(F.col("base")))
    joined = keyed.join(image_metadata(scores, tags_per_image), "image_id", "left")
    return joined.select("folder", "name", "image_id", "rating", "general_tags", "character_tags", "mature_tags", "all_scores", F.when(F.col("rating").isNull(), F.lit("no tags found")).alias("error"), F.coalesce("has_mature", F.lit(False)).alias("has_mature"))


def write_metadata(documents: DataFrame, path: str) -> None:
    """Each folder's document as JSON text, partitioned by folder."""
    body = F.to_json(F.struct("folder", "total_images", "sampled", F.transform_values("images", lambda _, v: F.from_json(v, "struct<rating:struct<explicit:double,questionable:double,sensitive:double,general:double>,general_tags:array<string>,character_tags:array<string>,mature_tags:array<string>,all_scores:map<string,double>,error:string>")).alias("images")), {"pretty": "true"})
    documents.select(F.col("folder").alias("to_folder"), body.alias("value")).write.mode("overwrite").partitionBy("to_folder").text(path)


def write_image_rows(rows: DataFrame, path: str) -> None:
    """One line of JSON per image below its folder, for folders of any size; nothing is gathered."""
    entry = F.to_json(F.struct("name", "rating", "general_tags", "character_tags", "mature_tags", "all_scores", "error"))
    rows.select(F.col("folder").alias("to_folder"), entry.alias("value")).write.mode("overwrite").partitionBy("to_folder").text(path)


def placement_plan(assigned: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``path, target``: where each file goes; clashing names get ``_1``, ``_2``, ...

    ``assigned(path, folder, ord)``. The first of equal names keeps it. A suffixed name
    that a real file has, or that ``existing(target)`` holds, is passed over: free
    numbers are found per name by counting the taken ones, in a bounded number of rounds.
    """
    rows = assigned.select("path", F.coalesce("folder", F.lit("")).alias("folder"), "ord").withColumn("name", basename(F.col("path")))
    rows = rows.withColumn("stem", stem(F.col("path"))).withColumn("ext", extension(F.col("path"))).withColumn("dir", F.when(F.col("folder") != "", safe_name(F.col("folder"))).otherwise(F.lit("")))
    taken = rows.select("dir", "name").distinct()
    if existing is not None:
        held = existing.select(F.regexp_extract("target", r"(?s)^(?:(.*)/)?[^/]*$", 1).alias("dir"), basename(F.col("target")).alias("name"))
        taken, busy = taken.unionByName(held).distinct(), held.withColumn("busy", F.lit(1)).distinct()
    else:
        busy = taken.where("false").withColumn("busy", F.lit(1))
    ranked = rows.join(busy, ["dir", "name"], "left").withColumn("k", F.row_number().over(Window.partitionBy("dir", "name").orderBy("ord")) - 1 + F.coalesce("busy", F.lit(0)))
    keep = ranked.where("k = 0").select("path", "dir", F.col("name").alias("final"))
    again = ranked.where("k > 0").select("path", "dir", "name", "stem", "ext", "k")
    # Numbers of a name that are taken already, as stem_number.ext of some other name.
    numbered = taken.withColumn("base", F.regexp_extract("name", r"(?s)^(.*)_[1-9][0-9]*(\.[^.]*)?$", 1)).withColumn("no", F.regexp_extract("name", r"(?s)_([1-9][0-9]*)(\.[^.]*)?$", 1).try_cast("int")).withColumn("e", extension(F.col("name")))
    # The k-th free number is k plus the taken numbers u_1 < u_2 < ... with u_i - (i - 1) <= k: one sort of both, no list per row.
    same = Window.partitionBy("dir", "stem", "ext")
    used = numbered.where("no IS NOT NULL").select("dir", F.col("base").alias("stem"), F.col("e").alias("ext"), "no").distinct()
    used = used.withColumn("at", F.col("no") - F.row_number().over(same.orderBy("no")) + 1)
    asked = again.join(used.select("dir", "stem", "ext").distinct(), ["dir", "stem", "ext"], "left_semi")
    both = asked.select("dir", "stem", "ext", "path", F.col("k").alias("at"), F.lit(1).alias("asks")).unionByName(used.select("dir", "stem", "ext", F.lit(None).cast("string").alias("path"), "at", F.lit(0).alias("asks")))
    below = F.sum(1 - F.col("asks")).over(same.orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0))
    shifted = both.withColumn("below", below).where("asks = 1").select("path", "dir", "stem", "ext", (F.col("at") + F.col("below")).alias("number"))
    free = again.join(used.select("dir", "stem", "ext").distinct(), ["dir", "stem", "ext"], "left_anti").select("path", "dir", "stem", "ext", F.col("k").alias("number"))
    joined, number = shifted.unionByName(free), F.col("number")
    moved = joined.select("path", "dir", F.concat("stem", F.lit("_"), number.cast("string"), "ext").alias("final"))
    return keep.unionByName(moved).select("path", F.concat_ws("/", F.nullif("dir", F.lit("")), "final").alias("target"))


def place(plan: DataFrame, root: str, move: bool = False) -> None:
    """Copies or moves files as planned; only on request, as it touches files."""

    def run(rows: Iterator) -> None:
        for row in rows:
            target = os.path.join(root, row["target"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            (shutil.move if move else shutil.copy2)(row["path"], target)

    plan.foreachPartition(run)


def counted(rows: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """``rows`` with counters that an action fills as it passes: ``total`` and one per condition."""
    observation = Observation()
    return rows.observe(observation, F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()]), observation


def run_counters(outcome: DataFrame) -> DataFrame:
    """``total, saved, filtered, duplicates, failed`` of ``outcome(status)``, in one row; they add up."""
    return outcome.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("saved", "filtered", "duplicates", "failed")])
