"""Driver queries of the collection operators, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismara.functions import text as tx
from prismara.functions.vectors import l2_normalize, norm, pooled_feature
from prismara.operators import classify, dedup, fusion, metadata, naming, search, tags, training, ward
from prismara.plans.pipeline import SortPlan, run
from prismara.schema import BLOCKED_TAGS, GENERIC_TAGS, IMAGE_EXTENSIONS, MATURE_ADMISSION, MATURE_METADATA, NAMELESS_TAGS, TAG_GROUPS
from prismara.session import table
from prismara.sources import features, listing, training_json, vocab

WIDTH = {"siglip": 1152}
POSITIVE = [("cat", 1.0, 1), ("dog", 1.5, 2), ("red car", 1.0, 3), ("tree", 0.5, 4)]
NEGATIVE = [("table", 1.0, 5), ("text", 2.0, 6), ("frame", 1.0, 7)]
MIN_CONF, SIMILAR = 0.05, 0.3


def _vectors(spark: SparkSession, d: str, ids: list[int]) -> dict[int, list[float]]:
    """A few label vectors, which stand for embedded texts."""
    rows = table(spark, d, "embeddings").where(F.col("vec_id").isin(*ids)).select("vec_id", "embedding").collect()
    return {r["vec_id"]: [float(x) for x in r["embedding"]] for r in rows}


def _labels(spark: SparkSession, d: str, spec: list[tuple[str, float, int]]) -> list:
    held = _vectors(spark, d, [i for _, _, i in spec])
    return [(t, w, held[i]) for t, w, i in spec]


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id >= 10")


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    return vocab.current_metadata(table(spark, d, "image_metadata"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return vocab.scores_with_ratings(_metadata(spark, d), table(spark, d, "tag_vocab"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Images clustered by folder: ids of folders by name, members in the order of their ids."""
    images = _metadata(spark, d).where("folder IS NOT NULL").select("image_id", "folder")
    names = images.select("folder").distinct()
    numbered = names.withColumn("cluster_id", F.row_number().over(Window.orderBy("folder")) - 1)  # folders, not images
    return images.join(numbered, "folder").select("cluster_id", "image_id", F.col("image_id").alias("ord"))


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return _metadata(spark, d).select("image_id", "folder", F.concat_ws("/", F.lit("/library"), "folder", "file_name").alias("path"))


def l2_normalize_q(spark, d):
    e = table(spark, d, "embeddings").withColumn("u", l2_normalize(F.col("embedding")))
    return e.select("vec_id", F.round(norm(F.col("embedding")), 6).alias("length"), F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", -1), 6).alias("last"))


def cosine_topk(spark, d):
    best = search.top_k(_items(spark, d), "vec_id", "embedding", _vectors(spark, d, [0])[0], 20)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))
    return ranked.select("rank", "vec_id", F.round("score", 6).alias("score"), tx.result_name(F.col("rank"), F.col("score"), F.lit("x.png")).alias("name"))


def feature_search(spark, d):
    """The images most similar to that of the smallest usable siglip id, by the latest vector of each path."""
    parsed = features.parse_cache(table(spark, d, "feat_cache"))
    ok = parsed.where((F.col("model") == "siglip") & (F.size("vec") == WIDTH["siglip"]) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0))
    query = ok.select(F.min_by("vec", "feat_id").alias("v")).first()["v"]
    found = search.search(ok.drop("ckey", "cached_at"), query, "a harbour, at dawn!")
    return found.select("rank", "path", F.round("score", 6).alias("score"), "target")


def safe_names(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.safe_name(F.col("source")).alias("folder"), tx.safe_name(F.col("text")).alias("name"))


def title_case(spark, d):
    return table(spark, d, "tag_vocab").where("name IS NOT NULL").select("tag_idx", tx.spoken(F.col("name")).alias("title"))


def tag_spec(spark, d):
    spec = table(spark, d, "documents").select("doc_id", F.explode(tx.parse_tag_spec(F.col("text"))).alias("s"))
    return spec.select("doc_id", "s.*")


def prompt_ensemble(spark, d):
    return table(spark, d, "tag_vocab").select("tag_idx", F.explode(tx.prompt_ensemble(F.col("name"))).alias("prompt")).where("prompt IS NOT NULL")


def image_paths(spark, d):
    p = F.col("path")
    rows = listing.images_only(listing.latest_listing(table(spark, d, "image_listing")))
    return rows.select("path", "mtime", "length", F.lower(tx.extension(p)).alias("ext"), tx.basename(p).alias("base"), tx.stem(p).alias("stem"), tx.dirname(p).alias("dir"))


def scan_order(spark, d):
    rows = listing.latest_listing(table(spark, d, "image_listing")).select("path", "image_id")
    return listing.with_order(rows).select("path", "ord")


def cache_keys(spark, d):
    return features.parse_cache(table(spark, d, "feat_cache").select("feat_id", "ckey")).select("feat_id", "model", "path", "mtime", "adapter")


def latest_features(spark, d):
    return features.latest_features(features.parse_cache(table(spark, d, "feat_cache").select("feat_id", "ckey")), "siglip").select("path", "feat_id", "mtime")


def feature_misses(spark, d):
    listed = listing.latest_listing(table(spark, d, "image_listing")).select("path", "mtime")
    return features.misses(listed, features.parse_cache(table(spark, d, "feat_cache").select("ckey")), "siglip").select("path", "mtime")


def dual_vote(spark, d):
    e = F.col("embedding")
    p1, p2 = classify.prediction(F.slice(e, 1, 2), ["ai", "hum"]), classify.prediction(F.slice(e, 3, 2), ["artificial", "real"])
    rows = table(spark, d, "embeddings").select("vec_id", p1.alias("p"), p2.alias("q"))
    return rows.select("vec_id", F.col("p.label").alias("label1"), F.round("p.confidence", 6).alias("conf1"), classify.dual_vote(F.col("p.label"), F.col("q.label")).alias("vote"))


def zero_shot_positive(spark, d):
    out = classify.zero_shot(_items(spark, d), "embedding", _labels(spark, d, POSITIVE), [], _vectors(spark, d, [0])[0], MIN_CONF)
    return out.select("vec_id", "passed", "label", F.round("margin", 6).alias("margin"))


def zero_shot_negative(spark, d):
    out = classify.zero_shot(_items(spark, d), "embedding", _labels(spark, d, POSITIVE), _labels(spark, d, NEGATIVE), _vectors(spark, d, [0])[0], MIN_CONF)
    return out.select("vec_id", "passed", "label", F.round("margin", 6).alias("margin"))


def content_then_style(spark, d):
    anchor = _vectors(spark, d, [0])[0]
    content = classify.zero_shot(_items(spark, d), "embedding", _labels(spark, d, POSITIVE[:2]), [], anchor, 0.0, "c_").where("c_passed")
    style = classify.zero_shot(content, "embedding", _labels(spark, d, POSITIVE[2:]), _labels(spark, d, NEGATIVE[:1]), anchor, 0.0, "s_").where("s_passed")
    return style.select("vec_id", naming.folder_path(F.col("c_label"), F.col("s_label")).alias("folder"))


def semantic_assign(spark, d):
    held = _vectors(spark, d, [1, 2, 3, 4])
    return classify.assign(_items(spark, d), "embedding", [(t, held[i]) for t, _, i in POSITIVE]).select("vec_id", "description")


def tag_embeddings(spark, d):
    made = classify.tag_embeddings(table(spark, d, "embeddings").select(F.col("label").cast("string").alias("tag"), F.col("embedding").alias("vec")))
    return made.select("tag", F.posexplode("vec").alias("pos", "x")).select("tag", "pos", F.round("x", 6).alias("x"))


def tag_scores(spark, d):
    return _scores(spark, d).select("image_id", "tag", "category", "score")


def explicit_dominant(spark, d):
    return tags.explicit_dominant(_scores(spark, d))


def tag_admission(spark, d):
    return tags.admit(_scores(spark, d)).select("image_id", "tag", "score")


def group_vector(spark, d):
    return tags.group_vector(_scores(spark, d)).select("image_id", F.posexplode("groups").alias("pos", "x")).select("image_id", "pos", F.round("x", 6).alias("x"))


def character_vector(spark, d):
    made = tags.character_vector(_scores(spark, d)).select("image_id", F.posexplode("characters").alias("slot", "x"))
    return made.where("x <> 0").select("image_id", "slot", F.round("x", 6).alias("x"))


def pooled(spark, d):
    e = F.col("embedding")
    tokens = F.array(*[F.slice(e, 1 + 16 * i, 16) for i in range(4)])
    made = table(spark, d, "embeddings").select("vec_id", F.posexplode(pooled_feature(tokens)).alias("pos", "x"))
    return made.select("vec_id", "pos", F.round("x", 6).alias("x"))


def fused(spark, d):
    e = F.col("embedding")
    rows = table(spark, d, "embeddings").select("vec_id", F.slice(e, 1, 32).alias("v"), F.slice(e, 33, 32).alias("i"), F.when(F.col("label") % 2 == 0, e).alias("s"))
    made = fusion.fused(rows, "v", "i", "s").select("vec_id", F.posexplode("fused").alias("pos", "x"))
    return made.select("vec_id", "pos", F.round("x", 6).alias("x"))


def adapter_forward(spark, d):
    layers = fusion.random_adapter((64, 32, 16, 24))
    made = fusion.adapt(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", layers)
    return made.select("vec_id", F.size("adapted").alias("width"), F.round(norm(F.col("adapted")), 5).alias("length"))


def similar_pairs(spark, d):
    return dedup.similar_pairs(_items(spark, d), "vec_id", "embedding", SIMILAR).select("a", "b", F.round("score", 6).alias("score"))


def greedy_dedup(spark, d):
    return dedup.dedup(_items(spark, d).select("vec_id", "embedding"), "vec_id", "embedding", SIMILAR).select("vec_id")


def _items32(spark, d):
    return _items(spark, d).select("vec_id", F.slice("embedding", 1, 32).alias("v"))


def distance_stats(spark, d):
    return ward.distance_stats(_items32(spark, d), "vec_id", "v").select("n", *[F.round(c, 6).alias(c) for c in ("min", "mean", "median")])


def distance_percentile(spark, d):
    return ward.distance_percentile(_items32(spark, d), "vec_id", "v", 35).select(F.round("threshold", 6).alias("threshold"))


def ward_clusters(spark, d):
    return ward.ward_clusters(_items32(spark, d), "vec_id", "v", 35)


def cluster_tfidf(spark, d):
    made = naming.cluster_tfidf(_members(spark, d), _scores(spark, d))
    return made.select("cluster_id", "tag", "df", F.round("avg_score", 9).alias("avg_score"), F.round("tfidf", 9).alias("tfidf"))


def cluster_names(spark, d):
    return naming.cluster_names(_members(spark, d), _scores(spark, d))


def fallback_names(spark, d):
    return naming.fallback_names(_metadata(spark, d), _scores(spark, d))


def tag_coherence(spark, d):
    return naming.coherence(_members(spark, d), _scores(spark, d)).select("cluster_id", F.round("overlap", 6).alias("overlap"))


def cluster_refinement(spark, d):
    return naming.refine(_members(spark, d), _scores(spark, d))


def folder_paths(spark, d):
    return table(spark, d, "documents").select("doc_id", naming.folder_path(F.col("source"), F.col("lang")).alias("folder"))


def image_metadata(spark, d):
    made = metadata.image_metadata(_scores(spark, d))
    return made.select("image_id", F.col("rating.explicit").alias("explicit"), *[F.array_join(f"{k}_tags", ",").alias(k) for k in ("general", "character", "mature")], F.size("all_scores").alias("n_scores"))


def folder_metadata(spark, d):
    made = metadata.folder_metadata(_assigned(spark, d), _scores(spark, d))
    entry = "struct<rating:struct<explicit:double>,general_tags:array<string>,all_scores:map<string,double>,error:string>"
    image = F.explode(F.transform(F.map_entries("images"), lambda e: F.struct(e["key"].alias("name"), F.from_json(e["value"], entry).alias("v"))))
    rows = made.select("folder", "total_images", "sampled", "has_mature", image.alias("e"))
    return rows.select("folder", "total_images", "sampled", "has_mature", "e.name", F.col("e.v.rating.explicit").alias("explicit"), F.array_join("e.v.general_tags", ",").alias("general"), F.size("e.v.all_scores").alias("n_scores"), "e.v.error")


def folder_sample(spark, d):
    return metadata.folder_sample(_assigned(spark, d).where("folder IS NOT NULL"), 5).select("folder", "path")


def placement_plan(spark, d):
    return metadata.placement_plan(listing.latest_listing(table(spark, d, "image_listing")).select("path", F.concat_ws("_", F.lit("by"), F.substring("folder", 1, 4)).alias("folder"), F.col("image_id").alias("ord")))


def run_counters(spark, d):
    status = F.when(F.col("label") == 0, "failed").when(F.col("label") < 3, "filtered").when(F.col("label") == 3, "duplicates").otherwise("saved")
    return metadata.run_counters(table(spark, d, "embeddings").select(status.alias("status")))


def training_pairs(spark, d):
    files = table(spark, d, "training_files").select("path", "body").unionByName(table(spark, d, "metadata_files").select("path", "body"))
    return training_json.training_pairs(files, table(spark, d, "image_listing"))


def descriptions(spark, d):
    return training.descriptions(table(spark, d, "documents").select(F.col("text").alias("description")))


def train_val_split(spark, d):
    return training.train_val_split(table(spark, d, "documents").select("doc_id"), "doc_id")


def fingerprint(spark, d):
    return spark.createDataFrame([(training.fingerprint(table(spark, d, "documents"), "image_path", "text"),)], "fingerprint string")


def _loss_rows(spark, d):
    e = table(spark, d, "embeddings")
    target = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("target"))
    return e.join(target, "vec_id").select("vec_id", training.combined_loss(F.col("embedding"), F.col("target")).alias("loss"))


def combined_loss(spark, d):
    return _loss_rows(spark, d).select("vec_id", F.round("loss", 6).alias("loss"))


def batch_means(spark, d):
    batched = training.with_batch(_loss_rows(spark, d).withColumn("ord", F.col("vec_id") + 1), "ord", 32)
    return training.mean_of_batches(batched, "batch", "loss").select(F.round("loss", 6).alias("loss"))


def one_cycle(spark, d):
    return training.one_cycle(spark, 1000).select("step", F.round("lr", 12).alias("lr"))


def early_stopping(spark, d):
    log = table(spark, d, "events").select("user_id", "event_id", "value")
    made = training.early_stopping(log, "event_id", "value", group=["user_id"])
    return made.select("user_id", "event_id", "improved", "waited", "stopped")


def ema_fold(spark, d):
    ordered = table(spark, d, "events").where("value IS NOT NULL").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda s: s["value"]).alias("v"))
    return ordered.select("user_id", F.round(training.ema(F.col("v"), 0.9), 6).alias("ema"))


def _pipeline_images(spark, d):
    e = F.col("embedding")
    rows = table(spark, d, "embeddings").where("vec_id >= 10")
    l1, l2 = classify.prediction(F.slice(e, 1, 2), ["ai", "hum"]), classify.prediction(F.slice(e, 3, 2), ["artificial", "real"])
    return rows.select(F.col("vec_id").alias("image_id"), e.alias("vec"), l1["label"].alias("label1"), l2["label"].alias("label2"))


def sort_semantic(spark, d):
    held = _vectors(spark, d, [0, 1, 2, 3, 4])
    plan = SortPlan(vote=True, anchor=held[0], content=(_labels(spark, d, POSITIVE), _labels(spark, d, NEGATIVE[:1])), descriptions=[("animals", held[1]), ("things", held[3])])
    return run(plan, _pipeline_images(spark, d))


def sort_visual(spark, d):
    return run(SortPlan(dedup_threshold=SIMILAR, sensitivity=20.0), _pipeline_images(spark, d))


QUERIES = {
    "l2_normalize": l2_normalize_q, "cosine_topk": cosine_topk, "feature_search": feature_search, "safe_names": safe_names, "title_case": title_case, "tag_spec": tag_spec,
    "prompt_ensemble": prompt_ensemble, "image_paths": image_paths, "scan_order": scan_order, "cache_keys": cache_keys, "latest_features": latest_features, "feature_misses": feature_misses,
    "dual_vote": dual_vote, "zero_shot_positive": zero_shot_positive, "zero_shot_negative": zero_shot_negative, "content_then_style": content_then_style, "semantic_assign": semantic_assign,
    "tag_embeddings": tag_embeddings, "tag_scores": tag_scores, "explicit_dominant": explicit_dominant, "tag_admission": tag_admission, "group_vector": group_vector, "character_vector": character_vector,
    "pooled_feature": pooled, "fused_feature": fused, "adapter_forward": adapter_forward, "similar_pairs": similar_pairs, "greedy_dedup": greedy_dedup, "distance_stats": distance_stats,
    "distance_percentile": distance_percentile, "ward_clusters": ward_clusters, "cluster_tfidf": cluster_tfidf, "cluster_names": cluster_names, "fallback_names": fallback_names,
    "tag_coherence": tag_coherence, "cluster_refinement": cluster_refinement, "folder_paths": folder_paths, "image_metadata": image_metadata, "folder_metadata": folder_metadata,
    "folder_sample": folder_sample, "placement_plan": placement_plan, "run_counters": run_counters, "training_pairs": training_pairs, "descriptions": descriptions,
    "train_val_split": train_val_split, "fingerprint": fingerprint, "combined_loss": combined_loss, "batch_means": batch_means, "one_cycle": one_cycle, "early_stopping": early_stopping,
    "ema_fold": ema_fold, "sort_semantic": sort_semantic, "sort_visual": sort_visual,
}


def _q(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_inner_product({v}, {v})), 1e-12))"


def _cos(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b}) / (greatest(sqrt(list_inner_product({a}, {a})), 1e-12) * greatest(sqrt(list_inner_product({b}, {b})), 1e-12))"


def _title(s: str) -> str:
    return f"array_to_string(list_transform(range(1, length({s}) + 1), lambda i: CASE WHEN i > 1 AND regexp_matches(substr({s}, i - 1, 1), '\\p{{L}}') THEN lower(substr({s}, i, 1)) ELSE upper(substr({s}, i, 1)) END), '')"


def _safe(s: str) -> str:
    return f"CASE WHEN {s} IS NOT NULL THEN coalesce(nullif(trim(regexp_replace({s}, '[^\\p{{L}}\\p{{N}} _\\-/\\\\]', '', 'g')), ''), 'other') END"


_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), it AS (SELECT * FROM e WHERE vec_id >= 10)"
_EXT = r"regexp_extract(regexp_extract(path, '(?s)([^/]*)$', 1), '(?s)[^.].*?(\.[^.]*)$', 1)"
_LISTING = "ls AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY coalesce(mtime, -1) DESC, coalesce(listed_at, TIMESTAMP '0001-01-01') DESC, coalesce(length, -1) DESC) AS rn FROM image_listing WHERE path IS NOT NULL) WHERE rn = 1)"
_KEYS = r"""k AS (SELECT feat_id, vec, regexp_extract(ckey, '^([^_]*)_', 1) AS model,
 CASE WHEN ckey LIKE 'dinov2ms\_%' ESCAPE '\' THEN regexp_extract(ckey, '(?s)^dinov2ms_(.*)_([^_]*)_(True|False)$', 1) ELSE regexp_extract(ckey, '(?s)^siglip_(.*)_([^_]*)$', 1) END AS path,
 TRY_CAST(CASE WHEN ckey LIKE 'dinov2ms\_%' ESCAPE '\' THEN regexp_extract(ckey, '(?s)^dinov2ms_(.*)_([^_]*)_(True|False)$', 2) ELSE regexp_extract(ckey, '(?s)^siglip_(.*)_([^_]*)$', 2) END AS DOUBLE) AS mtime,
 CASE WHEN ckey LIKE 'dinov2ms\_%' ESCAPE '\' THEN regexp_extract(ckey, '(?s)^dinov2ms_(.*)_([^_]*)_(True|False)$', 3) = 'True' END AS adapter FROM feat_cache)"""
_MD = "md AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY coalesce(written_at, TIMESTAMP '0001-01-01') DESC) AS rn FROM image_metadata WHERE image_id IS NOT NULL) WHERE rn = 1)"
_SC = (
    _MD
    + """, vo AS (SELECT name AS tag, min(tag_idx) AS tag_idx, arg_min(coalesce(category, -1), tag_idx) AS category FROM tag_vocab WHERE name IS NOT NULL GROUP BY name),
lg AS (SELECT image_id, unnest(map_entries(all_scores)) AS x FROM md),
sc AS (SELECT image_id, x.key AS tag, coalesce(tag_idx, 2147483647) AS tag_idx, coalesce(category, -1) AS category, x.value AS score FROM lg LEFT JOIN vo ON vo.tag = x.key WHERE x.value IS NOT NULL AND x.key NOT IN ('explicit', 'questionable', 'sensitive', 'general')
 UNION ALL SELECT image_id, unnest(['explicit', 'questionable', 'sensitive', 'general']), 2147483646, 9, unnest([rating.explicit, rating.questionable, rating.sensitive, rating.general]) FROM md WHERE rating IS NOT NULL)"""
)
_DOM = "dom AS (SELECT image_id, e > greatest(g, s, q) AS explicit_dominant FROM (SELECT image_id, coalesce(max(score) FILTER (tag = 'explicit'), 0) AS e, coalesce(max(score) FILTER (tag = 'general'), 0) AS g, coalesce(max(score) FILTER (tag = 'sensitive'), 0) AS s, coalesce(max(score) FILTER (tag = 'questionable'), 0) AS q FROM sc WHERE tag IN ('explicit', 'questionable', 'sensitive', 'general') AND score IS NOT NULL GROUP BY image_id))"
_MEM = "mem AS (SELECT dense_rank() OVER (ORDER BY folder) - 1 AS cluster_id, image_id FROM md WHERE folder IS NOT NULL)"
_TFIDF = f"""ns AS (SELECT cluster_id, sc.* FROM mem JOIN sc USING (image_id) WHERE category <> 9 AND score >= 0.1 AND tag NOT IN ({_q(NAMELESS_TAGS)})),
sz AS (SELECT cluster_id, count(DISTINCT image_id) AS members FROM mem GROUP BY 1),
av AS (SELECT cluster_id, tag, sum(score) / any_value(members) AS avg_score FROM ns JOIN sz USING (cluster_id) GROUP BY 1, 2),
df AS (SELECT tag, count(*) AS df FROM av GROUP BY 1)"""


def _margins(spec, name: str) -> str:
    values = ", ".join(f"({i}, '{t}', {w}::DOUBLE, {v})" for i, (t, w, v) in enumerate(spec))
    return f"{name} AS (SELECT it.vec_id, s.pos, s.tag, (list_inner_product(it.e, l.e) - list_inner_product(it.e, a.e)) * s.w AS m FROM it, (VALUES {values}) s(pos, tag, w, v) JOIN e l ON l.vec_id = s.v JOIN e a ON a.vec_id = 0)"


_POS = "ps AS (SELECT vec_id, max(m) AS best, count(*) FILTER (m >= {c}) AS n, coalesce(string_agg(tag, '_' ORDER BY m DESC, pos) FILTER (m >= {c}), '') AS label FROM {t} GROUP BY vec_id)"
_ASSIGNED = "ass AS (SELECT image_id, folder, concat_ws('/', '/library', folder, file_name) AS path FROM md)"
_RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, tag_idx, tag) AS r FROM sc WHERE category <> 9 AND score > 0.07)"
_MATURE = "regexp_matches(lower(tag), '" + "|".join(MATURE_METADATA) + "')"
_PAIRS32 = f"v AS (SELECT vec_id, {_unit('s')} AS u FROM (SELECT vec_id, (embedding::DOUBLE[])[1:32] AS s FROM embeddings WHERE vec_id >= 10)), dd AS (SELECT sqrt(greatest(list_inner_product(a.u, a.u) + list_inner_product(b.u, b.u) - 2 * list_inner_product(a.u, b.u), 0)) AS x FROM v a JOIN v b ON a.vec_id < b.vec_id)"
_LOSS = f"""l AS (SELECT p.vec_id, {_unit('p.e')} AS u, {_unit('t.e')} AS w, p.e AS e FROM e p JOIN e t ON t.vec_id = p.vec_id + 1),
lo AS (SELECT vec_id, 0.7 * (1 - list_inner_product(u, w)) + 0.3 * (list_inner_product(u, u) + list_inner_product(w, w) - 2 * list_inner_product(u, w)) / len(e) + 0.001 * list_inner_product(e, e) / len(e) AS loss FROM l)"""
_GROUPS = " UNION ALL ".join(f"SELECT image_id, {i} AS pos, " + (f"greatest(coalesce(max(score) FILTER (tag IN ({_q(t)})), 0), 0)" if t else f"greatest(0, 1 - greatest(coalesce(max(score) FILTER (tag IN ({_q(TAG_GROUPS['nude'])})), 0), 0))") + " AS x FROM sc GROUP BY image_id" for i, t in enumerate(TAG_GROUPS.values()))

_SAMPLE = "pl AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY image_id) - 1 AS px, count(*) OVER (PARTITION BY cluster_id) AS n FROM mem), sm AS (SELECT cluster_id, image_id FROM pl WHERE px % greatest(1, n // 10) = 0 AND px // greatest(1, n // 10) < 10), r AS (SELECT image_id, tag, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, tag_idx, tag) AS r FROM sc WHERE score IS NOT NULL), t AS (SELECT image_id, list(DISTINCT tag) AS tags FROM r WHERE r <= 30 GROUP BY 1), s AS (SELECT cluster_id, image_id, coalesce(tags, []) AS tags FROM sm LEFT JOIN t USING (image_id)), p AS (SELECT a.cluster_id, len(list_intersect(a.tags, b.tags)) AS i, len(list_distinct(list_concat(a.tags, b.tags))) AS u FROM s a JOIN s b ON a.cluster_id = b.cluster_id AND a.image_id < b.image_id), o AS (SELECT cluster_id, avg(i / u) AS overlap FROM p WHERE u > 0 GROUP BY 1)"
_FULL_TFIDF = f"""{_TFIDF}, tf AS (SELECT cluster_id, tag, any_value(x.tag_idx) AS tag_idx, any_value(x.category) AS category, any_value(avg_score) AS avg_score, any_value(avg_score * ln(1 + (SELECT count(DISTINCT cluster_id) FROM mem) / df)) AS tfidf FROM av JOIN df USING (tag) JOIN (SELECT tag, min(tag_idx) AS tag_idx, min(category) AS category FROM sc GROUP BY tag) x USING (tag) GROUP BY 1, 2)"""
#: Tags as titles.
_SPOKEN = f"sp AS (SELECT tag, {_title('n')} AS clean FROM (SELECT DISTINCT tag, replace(tag, '_', ' ') AS n FROM sc))"

ORACLES = {
    "l2_normalize": f"WITH {_E} SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS length, round(({_unit('e')})[1], 6) AS first, round(({_unit('e')})[-1], 6) AS last FROM e",
    "cosine_topk": f"WITH {_E}, s AS (SELECT it.vec_id, {_cos('it.e', 'q.e')} AS score FROM it, e q WHERE q.vec_id = 0 ORDER BY score DESC, it.vec_id LIMIT 20), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s) SELECT rank, vec_id, round(score, 6) AS score, printf('%03d_%.2f.png', rank, score) AS name FROM r",
    "feature_search": f"WITH {_KEYS}, u AS (SELECT feat_id, path, mtime, vec::DOUBLE[] AS v FROM k WHERE model = 'siglip' AND len(vec) = 1152 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0), q AS (SELECT arg_min(v, feat_id) AS v FROM u), la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY coalesce(mtime, -1) DESC, feat_id) AS rn FROM u WHERE path IS NOT NULL) WHERE rn = 1), s AS (SELECT path, {_cos('la.v', 'q.v')} AS score FROM la, q ORDER BY score DESC, path LIMIT 20), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS rank FROM s) SELECT rank, path, round(score, 6) AS score, 'AI_Search_Results/a harbour at dawn/' || printf('%03d_%.2f', rank, score) || {_EXT} AS target FROM r",
    "safe_names": f"SELECT doc_id, {_safe('source')} AS folder, {_safe('text')} AS name FROM documents",
    "title_case": f"SELECT tag_idx, {_title('n')} AS title FROM (SELECT tag_idx, replace(name, '_', ' ') AS n FROM tag_vocab WHERE name IS NOT NULL)",
    "tag_spec": r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: regexp_replace(x, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS x FROM s),
p AS (SELECT doc_id, pos, CASE WHEN contains(x, ':') THEN regexp_extract(x, '(?s)^(.*):([^:]*)$', 1) ELSE x END AS name, CASE WHEN contains(x, ':') THEN regexp_extract(x, '(?s)^(.*):([^:]*)$', 2) END AS w FROM u)
SELECT doc_id, pos, CASE WHEN name LIKE '-%' THEN 'negative' ELSE 'positive' END AS polarity, CASE WHEN name LIKE '-%' THEN regexp_replace(substr(name, 2), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') ELSE name END AS tag, coalesce(CASE WHEN regexp_matches(w, '^\s*[+-]?[0-9]+(\.[0-9]*)?\s*$') THEN TRY_CAST(trim(w) AS DOUBLE) END, 1.0) AS weight FROM p""",
    "prompt_ensemble": "SELECT tag_idx, unnest(['a photo of ' || name, 'an image of ' || name, 'a picture of ' || name, name]) AS prompt FROM tag_vocab WHERE name IS NOT NULL",
    "image_paths": rf"WITH {_LISTING} SELECT path, mtime, length, lower({_EXT}) AS ext, regexp_extract(path, '(?s)([^/]*)$', 1) AS base, substr(regexp_extract(path, '(?s)([^/]*)$', 1), 1, length(regexp_extract(path, '(?s)([^/]*)$', 1)) - length({_EXT})) AS stem, CASE WHEN path LIKE '/%' AND regexp_extract(path, '(?s)^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(path, '(?s)^(.*)/[^/]*$', 1) END AS dir FROM ls WHERE lower({_EXT}) IN ({_q(IMAGE_EXTENSIONS)})",
    "scan_order": f"WITH {_LISTING} SELECT path, row_number() OVER (ORDER BY path) AS ord FROM ls",
    "cache_keys": f"WITH {_KEYS} SELECT feat_id, model, path, mtime, adapter FROM k",
    "latest_features": f"WITH {_KEYS} SELECT path, feat_id, mtime FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY coalesce(mtime, -1) DESC, feat_id) AS rn FROM k WHERE model = 'siglip' AND path IS NOT NULL) WHERE rn = 1",
    "feature_misses": f"WITH {_LISTING}, {_KEYS} SELECT path, mtime FROM ls WHERE NOT EXISTS (SELECT 1 FROM k WHERE model = 'siglip' AND k.path = ls.path AND k.mtime = ls.mtime)",
    "dual_vote": f"WITH {_E} SELECT vec_id, CASE WHEN e[1] >= e[2] THEN 'ai' ELSE 'hum' END AS label1, round(1 / (1 + exp(-abs(e[1] - e[2]))), 6) AS conf1, CASE WHEN e[1] >= e[2] AND e[3] >= e[4] THEN 'ai' ELSE 'hum' END AS vote FROM e",
    "zero_shot_positive": f"WITH {_E}, {_margins(POSITIVE, 'p')}, {_POS.format(c=MIN_CONF, t='p')} SELECT vec_id, n > 0 AS passed, label, round(best, 6) AS margin FROM ps",
    "zero_shot_negative": f"WITH {_E}, {_margins(POSITIVE, 'p')}, {_margins(NEGATIVE, 'g')}, {_POS.format(c=MIN_CONF, t='p')}, ng AS (SELECT vec_id, max(m) AS worst, arg_max(tag, m) AS tag FROM g GROUP BY vec_id) SELECT vec_id, n > 0 AND worst <= 0 AS passed, CASE WHEN n > 0 AND worst > 0 THEN '-' || {_safe('tag')} ELSE label END AS label, round(CASE WHEN n > 0 AND worst > 0 THEN -worst ELSE best END, 6) AS margin FROM ps JOIN ng USING (vec_id)",
    "content_then_style": f"WITH {_E}, {_margins(POSITIVE[:2], 'p')}, {_POS.format(c=0.0, t='p')}, {_margins(POSITIVE[2:], 'p2')}, {_POS.format(c=0.0, t='p2').replace('ps AS', 'ps2 AS')}, {_margins(NEGATIVE[:1], 'g')} SELECT ps.vec_id, concat_ws('/', ps.label, ps2.label) AS folder FROM ps JOIN ps2 USING (vec_id) JOIN g USING (vec_id) WHERE ps.n > 0 AND ps2.n > 0 AND g.m <= 0",
    "semantic_assign": f"WITH {_E} SELECT vec_id, d AS description FROM (SELECT it.vec_id, s.d, row_number() OVER (PARTITION BY it.vec_id ORDER BY list_inner_product(it.e, l.e) DESC, l.vec_id) AS r FROM it, (VALUES (1, 'cat'), (2, 'dog'), (3, 'red car'), (4, 'tree')) s(v, d) JOIN e l ON l.vec_id = s.v) WHERE r = 1",
    "tag_embeddings": f"WITH {_E}, u AS (SELECT label, unnest({_unit('e')}) AS x, unnest(range(len(e))) AS pos FROM e), m AS (SELECT label, pos, avg(x) AS x FROM u GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label) SELECT label::VARCHAR AS tag, pos::INT AS pos, round(x / greatest(n, 1e-12), 6) AS x FROM m JOIN n USING (label)",
    "tag_scores": f"WITH {_SC} SELECT image_id, tag, category, score FROM sc WHERE score IS NOT NULL",
    "explicit_dominant": f"WITH {_SC}, {_DOM} SELECT * FROM dom",
    "tag_admission": f"WITH {_SC}, {_DOM} SELECT image_id, tag, score FROM sc LEFT JOIN dom USING (image_id) WHERE score IS NOT NULL AND tag NOT IN ({_q(BLOCKED_TAGS)}) AND CASE WHEN category = 4 THEN score > 0.05 WHEN regexp_matches(lower(tag), '{'|'.join(MATURE_ADMISSION)}') THEN coalesce(explicit_dominant, false) AND score > 0.35 ELSE score > 0.1 END",
    "group_vector": f"WITH {_SC} SELECT image_id, pos, round(x, 6) AS x FROM ({_GROUPS})",
    "character_vector": f"WITH {_SC}, c AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, tag_idx, tag) AS r FROM sc WHERE category = 4) SELECT image_id, (('0x' || substr(md5(tag), 1, 8))::BIGINT % 38)::INT AS slot, round(max(score), 6) AS x FROM c WHERE r <= 8 AND score > 0.35 GROUP BY ALL",
    "pooled_feature": f"WITH {_E}, p AS (SELECT vec_id, list_concat(e[1:16], list_transform(range(1, 17), lambda i: (e[16 + i] + e[32 + i] + e[48 + i]) / 3)) AS v FROM e) SELECT vec_id, unnest(range(32))::INT AS pos, round(unnest(v), 6) AS x FROM p",
    "fused_feature": f"WITH {_E}, n AS (SELECT vec_id, {_unit('e[1:32]')} AS a, {_unit('e[33:64]')} AS b, CASE WHEN label % 2 = 0 THEN {_unit('e')} ELSE list_transform(e, lambda x: 0.0::DOUBLE) END AS c FROM e), f AS (SELECT vec_id, list_concat(list_concat(a, list_transform(b, lambda x: x * 0.7)), list_transform(c, lambda x: x * 0.3)) AS v FROM n), g AS (SELECT vec_id, {_unit('v')} AS u FROM f) SELECT vec_id, unnest(range(128))::INT AS pos, round(unnest(u), 6) AS x FROM g",
    "similar_pairs": f"WITH {_E}, u AS (SELECT vec_id, {_unit('e')} AS u FROM it) SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.u, b.u), 6) AS score FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_inner_product(a.u, b.u) >= {SIMILAR}",
    "greedy_dedup": f"WITH RECURSIVE {_E}, u AS (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, {_unit('e')} AS u FROM it), p AS (SELECT a.n AS b, b.n AS n FROM u a JOIN u b ON a.n < b.n WHERE list_inner_product(a.u, b.u) >= {SIMILAR}), nb AS (SELECT u.n, u.vec_id, coalesce(list(p.b) FILTER (p.b IS NOT NULL), []) AS before FROM u LEFT JOIN p USING (n) GROUP BY ALL), w AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept UNION ALL SELECT w.n + 1, CASE WHEN list_has_any(w.kept, nb.before) THEN w.kept ELSE list_append(w.kept, nb.n) END FROM w JOIN nb ON nb.n = w.n + 1), l AS (SELECT arg_max(kept, n) AS kept FROM w) SELECT vec_id FROM u WHERE list_contains((SELECT kept FROM l), n)",
    "distance_stats": f"WITH {_PAIRS32} SELECT count(*) AS n, round(min(x), 6) AS min, round(avg(x), 6) AS mean, round(median(x), 6) AS median FROM dd",
    "distance_percentile": f"WITH {_PAIRS32} SELECT round(quantile_cont(x, 0.35), 6) AS threshold FROM dd",
    "cluster_tfidf": f"WITH {_SC}, {_MEM}, {_TFIDF} SELECT cluster_id, tag, df, round(avg_score, 9) AS avg_score, round(avg_score * ln(1 + (SELECT count(DISTINCT cluster_id) FROM mem) / df), 9) AS tfidf FROM av JOIN df USING (tag)",
    "fallback_names": f"WITH {_SC}, w AS (SELECT image_id, tag, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN tag IN ({_q(GENERIC_TAGS)}) THEN score * 0.1 ELSE score END DESC, tag_idx, tag) AS r FROM sc WHERE category <> 9 AND score > 0.35), t AS (SELECT image_id, string_agg(replace(tag, '_', ' '), ' ' ORDER BY r) AS s FROM w WHERE r <= 2 GROUP BY 1), n AS (SELECT image_id, {_title('s')} AS s FROM t) SELECT md.image_id, CASE WHEN s IS NULL THEN 'Other' ELSE substr({_safe('s')}, 1, 40) END AS name FROM md LEFT JOIN n USING (image_id)",
    "tag_coherence": f"WITH {_SC}, {_MEM}, pl AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY image_id) - 1 AS px, count(*) OVER (PARTITION BY cluster_id) AS n FROM mem), sm AS (SELECT cluster_id, image_id FROM pl WHERE px % greatest(1, n // 10) = 0 AND px // greatest(1, n // 10) < 10), r AS (SELECT image_id, tag, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, tag_idx, tag) AS r FROM sc WHERE score IS NOT NULL), t AS (SELECT image_id, list(DISTINCT tag) AS tags FROM r WHERE r <= 30 GROUP BY 1), s AS (SELECT cluster_id, image_id, coalesce(tags, []) AS tags FROM sm LEFT JOIN t USING (image_id)), p AS (SELECT a.cluster_id, len(list_intersect(a.tags, b.tags)) AS i, len(list_distinct(list_concat(a.tags, b.tags))) AS u FROM s a JOIN s b ON a.cluster_id = b.cluster_id AND a.image_id < b.image_id), o AS (SELECT cluster_id, avg(i / u) AS overlap FROM p WHERE u > 0 GROUP BY 1) SELECT cluster_id, round(coalesce(overlap, 1.0), 6) AS overlap FROM (SELECT DISTINCT cluster_id FROM mem) LEFT JOIN o USING (cluster_id)",
    "cluster_names": f"""WITH {_SC}, {_MEM}, {_FULL_TFIDF}, {_SPOKEN},
ch AS (SELECT cluster_id, tag, min({{'o': image_id, 't': tag_idx}}) AS seen FROM mem JOIN sc USING (image_id) WHERE category = 4 AND score > 0.15 AND tag NOT IN ({_q(NAMELESS_TAGS)}) GROUP BY 1, 2),
cr AS (SELECT cluster_id, clean, row_number() OVER (PARTITION BY cluster_id ORDER BY seen, tag) AS r FROM ch JOIN sp USING (tag)),
tr AS (SELECT cluster_id, clean, row_number() OVER (PARTITION BY cluster_id ORDER BY tfidf DESC, tag_idx, tag) AS r FROM tf JOIN sp USING (tag) WHERE category <> 4),
al AS (SELECT cluster_id, clean, min(o) AS o FROM (SELECT cluster_id, clean, r AS o FROM cr WHERE r <= 2 UNION ALL SELECT cluster_id, clean, 10 + r FROM tr) GROUP BY 1, 2),
pt AS (SELECT cluster_id, string_agg(clean, ' ' ORDER BY o) AS s FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY o) AS q FROM al) WHERE q <= 4 GROUP BY 1),
bs AS (SELECT cluster_id, CASE WHEN s IS NULL THEN printf('group_%03d', cluster_id + 1) ELSE substr({_safe('s')}, 1, 60) END AS base FROM (SELECT DISTINCT cluster_id FROM mem) LEFT JOIN pt USING (cluster_id)),
sh AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY cluster_id) AS k, count(*) OVER (PARTITION BY base) AS same FROM bs),
ow AS (SELECT cluster_id, base, tag, tag_idx, tfidf, clean FROM sh JOIN tf USING (cluster_id) JOIN sp USING (tag) WHERE same > 1 AND NOT contains(base, clean)),
ap AS (SELECT * FROM ow WHERE NOT EXISTS (SELECT 1 FROM sh o JOIN tf x USING (cluster_id) WHERE o.base = ow.base AND o.cluster_id <> ow.cluster_id AND x.tag = ow.tag AND x.avg_score > ow.tfidf * 0.5)),
ex AS (SELECT cluster_id, clean AS extra FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY tfidf DESC, tag_idx, tag) AS r FROM ap) WHERE r = 1),
nm AS (SELECT cluster_id, base, k, same, extra, base || ' ' || extra AS longer FROM sh LEFT JOIN ex USING (cluster_id))
SELECT cluster_id, CASE WHEN same = 1 THEN base WHEN extra IS NOT NULL THEN substr({_safe('longer')}, 1, 60) ELSE base || '_' || k END AS name FROM nm""",
    "cluster_refinement": f"""WITH {_SC}, {_MEM}, {_SAMPLE}, loose AS (SELECT cluster_id FROM o JOIN (SELECT cluster_id, count(*) AS n FROM mem GROUP BY 1) USING (cluster_id) WHERE overlap < 0.25 AND n > 3),
sc2 AS (SELECT m.cluster_id, m.image_id, s.image_id AS anchor, CASE WHEN m.image_id = s.image_id AND len(s.tags) > 0 THEN 2.0 ELSE coalesce(len(list_intersect(coalesce(t.tags, []), s.tags)) / nullif(len(list_distinct(list_concat(coalesce(t.tags, []), s.tags))), 0), 0) END AS v FROM mem m JOIN loose USING (cluster_id) JOIN s ON s.cluster_id = m.cluster_id LEFT JOIN t ON t.image_id = m.image_id)
SELECT cluster_id, anchor AS part, image_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, image_id ORDER BY v DESC, anchor) AS q FROM sc2) WHERE q = 1
UNION ALL SELECT cluster_id, 0, image_id FROM mem WHERE cluster_id NOT IN (SELECT cluster_id FROM loose)""",
    "placement_plan": rf"""WITH {_LISTING}, a AS (SELECT path, {_safe("concat_ws('_', 'by', substr(folder, 1, 4))")} AS dir, image_id AS ord, regexp_extract(path, '(?s)([^/]*)$', 1) AS name, {_EXT} AS ext FROM ls),
b AS (SELECT *, substr(name, 1, length(name) - length(ext)) AS stem, row_number() OVER (PARTITION BY dir, name ORDER BY ord) - 1 AS k FROM a),
u AS (SELECT dir, regexp_extract(name, '(?s)^(.*)_([1-9][0-9]*)(\.[^.]*)?$', 1) AS stem, ext, list(DISTINCT TRY_CAST(regexp_extract(name, '(?s)_([1-9][0-9]*)(\.[^.]*)?$', 1) AS INT)) AS used FROM a WHERE regexp_matches(name, '(?s)_([1-9][0-9]*)(\.[^.]*)?$') GROUP BY ALL),
f AS (SELECT path, b.dir, CASE WHEN k = 0 THEN name ELSE b.stem || '_' || list_filter(range(1, (k + 1 + len(coalesce(used, [])))::BIGINT), lambda x: NOT list_contains(coalesce(used, []), x::INT))[k] || b.ext END AS final FROM b LEFT JOIN u ON u.dir = b.dir AND u.stem = b.stem AND u.ext = b.ext)
SELECT path, concat_ws('/', nullif(dir, ''), final) AS target FROM f""",
    "sort_semantic": f"""WITH {_E}, {_margins(POSITIVE, 'p')}, {_POS.format(c=MIN_CONF, t='p')}, {_margins(NEGATIVE[:1], 'g')},
d AS (SELECT it.vec_id, CASE WHEN it.e[1] >= it.e[2] AND it.e[3] >= it.e[4] THEN 'ai' ELSE 'hum' END AS vote, CASE WHEN list_inner_product(it.e, x.e) >= list_inner_product(it.e, y.e) THEN 'animals' ELSE 'things' END AS description FROM it, e x, e y WHERE x.vec_id = 1 AND y.vec_id = 3),
j AS (SELECT vec_id, n > 0 AND g.m <= 0 AS ok, vote, label, description FROM ps JOIN g USING (vec_id) JOIN d USING (vec_id))
SELECT vec_id AS image_id, CASE WHEN ok THEN concat_ws('/', vote, label, description) ELSE '' END AS folder, CASE WHEN ok THEN 'saved' ELSE 'filtered' END AS status FROM j""",
    "folder_paths": "SELECT doc_id, concat_ws('/', nullif(source, ''), nullif(lang, '')) AS folder FROM documents",
    "image_metadata": f"WITH {_SC}, {_RANKED}, x AS (SELECT image_id, count(*) AS n, coalesce(string_agg(tag, ',' ORDER BY r) FILTER ({_MATURE}), '') AS mature, coalesce(string_agg(tag, ',' ORDER BY r) FILTER (category = 4 AND NOT {_MATURE}), '') AS character, coalesce(string_agg(tag, ',' ORDER BY r) FILTER (category <> 4 AND NOT {_MATURE}), '') AS general FROM rk WHERE r <= 30 GROUP BY 1), rt AS (SELECT image_id, coalesce(max(score) FILTER (tag = 'explicit'), 0.0) AS explicit FROM sc WHERE score IS NOT NULL GROUP BY 1) SELECT image_id, round(explicit, 3) AS explicit, coalesce(general, '') AS general, coalesce(character, '') AS character, coalesce(mature, '') AS mature, coalesce(n, 0)::INT AS n_scores FROM rt LEFT JOIN x USING (image_id)",
    "folder_metadata": f"""WITH {_SC}, {_ASSIGNED}, {_RANKED}, f AS (SELECT image_id, coalesce(nullif(folder, ''), 'root') AS folder, path, regexp_extract(path, '(?s)([^/]*)$', 1) AS base FROM ass),
k AS (SELECT *, count(*) OVER (PARTITION BY folder) AS total, count(*) OVER (PARTITION BY folder, base) AS c FROM f),
x AS (SELECT image_id, count(*) AS n, bool_or({_MATURE}) AS m, string_agg(tag, ',' ORDER BY r) FILTER (category <> 4 AND NOT {_MATURE}) AS general FROM rk WHERE r <= 30 GROUP BY 1),
rt AS (SELECT image_id, round(coalesce(max(score) FILTER (tag = 'explicit'), 0.0), 3) AS explicit FROM sc WHERE score IS NOT NULL GROUP BY 1)
SELECT folder, total AS total_images, total AS sampled, bool_or(coalesce(m, false)) OVER (PARTITION BY folder) AS has_mature, CASE WHEN c > 1 THEN path ELSE base END AS name, explicit, CASE WHEN rt.image_id IS NOT NULL THEN coalesce(general, '') END AS general, CASE WHEN rt.image_id IS NOT NULL THEN coalesce(n, 0)::INT END AS n_scores, CASE WHEN rt.image_id IS NULL THEN 'no tags found' END AS error FROM k LEFT JOIN x USING (image_id) LEFT JOIN rt USING (image_id)""",
    "folder_sample": f"WITH {_MD}, {_ASSIGNED} SELECT folder, path FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY substr(md5('42#' || path), 1, 16), path) AS q FROM ass WHERE folder IS NOT NULL) WHERE q <= 5",
    "run_counters": "SELECT count(*) AS total, count(*) FILTER (label > 3 OR label IS NULL) AS saved, count(*) FILTER (label IN (1, 2)) AS filtered, count(*) FILTER (label = 3) AS duplicates, count(*) FILTER (label = 0) AS failed FROM embeddings",
    "descriptions": "SELECT DISTINCT text AS description FROM documents WHERE text IS NOT NULL",
    "train_val_split": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY substr(md5('42#' || doc_id), 1, 16), doc_id) <= greatest(1, floor(0.15 * (SELECT count(*) FROM documents))) THEN 'val' ELSE 'train' END AS split FROM documents",
    "fingerprint": "WITH d AS (SELECT DISTINCT image_path, text FROM documents), h AS (SELECT md5(to_json({'image_path': image_path, 'text': text})::VARCHAR) AS m FROM d) SELECT md5(count(*) || '|' || coalesce(sum(('0x' || m[1:8])::BIGINT), 0) || '|' || coalesce(sum(('0x' || m[9:16])::BIGINT), 0) || '|' || coalesce(sum(('0x' || m[17:24])::BIGINT), 0) || '|' || coalesce(sum(('0x' || m[25:32])::BIGINT), 0)) AS fingerprint FROM h",
    "combined_loss": f"WITH {_E}, {_LOSS} SELECT vec_id, round(loss, 6) AS loss FROM lo",
    "batch_means": f"WITH {_E}, {_LOSS} SELECT round(avg(m), 6) AS loss FROM (SELECT avg(loss) AS m FROM lo GROUP BY vec_id // 32)",
    "one_cycle": "SELECT s AS step, round(CASE WHEN s <= 99 THEN 3e-4 + (3e-5 - 3e-4) / 2 * (1 + cos(pi() * s / 99)) ELSE 3e-7 + (3e-4 - 3e-7) / 2 * (1 + cos(pi() * (s - 99) / 900)) END, 12) AS lr FROM range(1000) t(s)",
    "early_stopping": "WITH b AS (SELECT user_id, event_id, value, row_number() OVER w AS n, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), i AS (SELECT *, value IS NOT NULL AND (m IS NULL OR value < m) AS improved FROM b), l AS (SELECT *, n - coalesce(max(CASE WHEN improved THEN n END) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS waited FROM i) SELECT user_id, event_id, improved, waited, max((waited >= 5)::INT) OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS stopped FROM l",
    "ema_fold": "SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda s, x: s * 0.9 + x * 0.1), 6) AS ema FROM events WHERE value IS NOT NULL GROUP BY user_id",
}
