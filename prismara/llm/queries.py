"""Driver queries of the training-data operators, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismara.llm.clusters import clusters, groups
from prismara.llm.cooccur import PairTable, at_least
from prismara.llm.garbled import garbled_documents, learned_mapping, restored_documents
from prismara.llm.leakage import leaks
from prismara.llm.neighbours import alike_pairs, nearest
from prismara.llm.tags import current_images, normal_tags
from prismara.llm.termfreq import marked, term_frequencies
from prismara.llm.tokens import decode_corpus, encode_corpus
from prismara.llm.vectors import usable_vectors
from prismara.session import table


def _pair_table(spark: SparkSession, sf_dir: str) -> PairTable:
    """The pair table after two batches: every image's first tagging, then the images tagged again."""
    metadata = table(spark, sf_dir, "image_metadata").select("image_id", "general_tags", "character_tags", "written_at")
    columns = ["general_tags", "character_tags"]
    items = F.concat(normal_tags(F.col("general_tags")), normal_tags(F.col("character_tags"))).alias("items")
    both = (
        metadata.where(F.col("image_id").isNotNull())
        .groupBy("image_id")
        .agg(*[pick(F.struct(*columns), F.coalesce("written_at", F.lit("0001-01-01").cast("timestamp"))).alias(name) for pick, name in ((F.min_by, "old"), (F.max_by, "new"))])
    )
    pairs = PairTable(spark)
    pairs.apply(both.select(F.col("image_id").alias("id"), "old.*").select("id", items))
    pairs.apply(both.where(~F.col("old").eqNullSafe(F.col("new"))).select(F.col("image_id").alias("id"), "new.*").select("id", items))
    return pairs


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tags that at least 4 images share, at least 3 times as often as by chance."""
    scores = _pair_table(spark, sf_dir).scores()
    return scores.where((F.col("n") >= 4) & at_least(F.col("n"), F.col("total"), F.col("n_a"), F.col("n_b"), 3)).select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b"))


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and lift of every pair of tags."""
    scores = _pair_table(spark, sf_dir).scores()
    return scores.select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b"), "n", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def _frequencies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    images = current_images(table(spark, sf_dir, "image_metadata").select("image_id", "general_tags", "written_at"), ["general_tags"])
    total = table(spark, sf_dir, "image_metadata").select("image_id").where("image_id IS NOT NULL").distinct().count()
    return term_frequencies(images.select(F.explode(normal_tags(F.col("general_tags"))).alias("term"), F.col("image_id").alias("record"))), total


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags too rare or too common to tell images apart."""
    return marked(*_frequencies(spark, sf_dir)).where("mark IS NOT NULL").select(F.col("term").alias("tag"), "mark")


def p6_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and images of every general tag."""
    return _frequencies(spark, sf_dir)[0].select(F.col("term").alias("tag"), "occurrences", F.col("records").alias("images"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of every group of three or more vectors of a kind that are all alike and apart from others."""
    return groups(usable_vectors(table(spark, sf_dir, "feat_cache")))


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster of vectors with its size and most typical members."""
    return clusters(usable_vectors(table(spark, sf_dir, "feat_cache")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alike pairs of which one is among the five most similar vectors of the other."""
    return alike_pairs(usable_vectors(table(spark, sf_dir, "feat_cache")))


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors of every vector whose id is divisible by 100."""
    near = nearest(usable_vectors(table(spark, sf_dir, "feat_cache")), 10, only="feat_id % 100 = 0")
    return near.select(F.col("q").alias("feat_id"), "rank", F.col("b").alias("neighbour"), F.round("s", 6).alias("similarity"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text again, from its ids."""
    return decode_corpus(encode_corpus(table(spark, sf_dir, "documents")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items of which they hold 12 consecutive words, or all of a shorter item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).where("kind = 'exact'").select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and re-parameterised leaks with the number of windows found."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which some stretch was decoded with another encoding than its own."""
    return garbled_documents(table(spark, sf_dir, "documents"))


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents with their text as far as it can be restored."""
    return restored_documents(table(spark, sf_dir, "documents"))


def p9_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte-to-letter mappings learned for each source."""
    return learned_mapping(table(spark, sf_dir, "documents"))


QUERIES = {"p9_found": p9_found, "p9_restored": p9_restored, "p9_mapping": p9_mapping, "p4_found": p4_found, "p4_nearest": p4_nearest, "p3_found": p3_found, "p3_clusters": p3_clusters, "p7_ids": p7_ids, "p7_decoded": p7_decoded, "p8_found": p8_found, "p8_leaks": p8_leaks, "p1_found": p1_found, "p1_scores": p1_scores, "p6_found": p6_found, "p6_frequencies": p6_frequencies}

_LATEST = r"""
latest AS (SELECT image_id, arg_max({'g': general_tags, 'c': character_tags}, coalesce(written_at, TIMESTAMP '0001-01-01')) AS r
           FROM image_metadata WHERE image_id IS NOT NULL GROUP BY image_id),
"""
_NORMAL = r"regexp_replace(lower(regexp_replace(t, '^[ \t]+|[ \t]+$', '', 'g')), '[ \t_]+', '_', 'g')"
_COUNTS = rf"""WITH {_LATEST}
raw AS (SELECT image_id, unnest(list_concat(coalesce(r.g, []), coalesce(r.c, []))) AS t FROM latest),
tags AS (SELECT DISTINCT image_id, {_NORMAL} AS tag FROM raw WHERE t IS NOT NULL AND {_NORMAL} <> ''),
m AS (SELECT tag, count(*) AS n FROM tags GROUP BY tag),
nn AS (SELECT count(*) AS total FROM latest),
pr AS (SELECT x.tag AS tag_a, y.tag AS tag_b, count(*) AS n FROM tags x JOIN tags y ON x.image_id = y.image_id AND x.tag < y.tag GROUP BY ALL),
s AS (SELECT tag_a, tag_b, pr.n, ma.n AS n_a, mb.n AS n_b, total FROM pr JOIN m ma ON ma.tag = tag_a JOIN m mb ON mb.tag = tag_b CROSS JOIN nn)
"""
_TERMS = rf"""WITH {_LATEST}
raw AS (SELECT image_id, unnest(coalesce(r.g, [])) AS t FROM latest),
tags AS (SELECT image_id, {_NORMAL} AS tag FROM raw WHERE t IS NOT NULL AND {_NORMAL} <> ''),
f AS (SELECT tag, count(*) AS occurrences, count(DISTINCT image_id) AS images FROM tags GROUP BY tag)
"""

# By brute force, exact; over the small tables only, as it compares all vectors.
_VECTORS = r"""k AS (SELECT feat_id, ckey, vec::DOUBLE[] AS v, CASE WHEN ckey LIKE 'siglip\_%' ESCAPE '\' THEN 'siglip' WHEN ckey LIKE 'dinov2ms\_%\_True' ESCAPE '\' THEN 'dinov2ms_True' WHEN ckey LIKE 'dinov2ms\_%\_False' ESCAPE '\' THEN 'dinov2ms_False' END AS kind FROM feat_cache WHERE feat_id IS NOT NULL),
w AS (SELECT * FROM k WHERE len(v) = CASE kind WHEN 'siglip' THEN 1152 WHEN 'dinov2ms_True' THEN 384 WHEN 'dinov2ms_False' THEN 1536 END AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
u AS (SELECT kind, feat_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM (SELECT *, row_number() OVER (PARTITION BY ckey ORDER BY feat_id) AS r FROM w) WHERE r = 1),
s AS (SELECT a.kind, a.feat_id AS a, b.feat_id AS b, list_inner_product(a.v, b.v) AS s FROM u a JOIN u b ON a.kind = b.kind)"""

ORACLES = {
    "p3_found": f"""WITH {_VECTORS}, l AS (SELECT kind, a, list_sort(list(b)) AS l FROM s WHERE s >= 0.6 GROUP BY 1, 2), g AS (SELECT *, count(*) OVER (PARTITION BY kind, l) AS n FROM l)
SELECT l[1] AS cluster_id, a AS feat_id FROM g WHERE n = len(l) AND n > 2""",
    "p4_found": f"""WITH {_VECTORS}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 12) DESC, b) AS r FROM s WHERE a <> b) SELECT DISTINCT least(a, b) AS feat_a, greatest(a, b) AS feat_b FROM r WHERE r <= 5 AND s >= 0.6""",
    "p4_nearest": f"""WITH {_VECTORS}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 12) DESC, b) AS r FROM s WHERE a <> b AND a % 100 = 0) SELECT a AS feat_id, r AS rank, b AS neighbour, round(s, 6) AS similarity FROM r WHERE r <= 10""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_found": r"""WITH
dw AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM eval_items WHERE text IS NOT NULL),
dk AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw WHERE len(w) >= 12)),
ik AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw WHERE len(w) >= 12)),
short AS (SELECT item_id, ' ' || array_to_string(w, ' ') || ' ' AS k FROM iw WHERE len(w) BETWEEN 1 AND 11),
dt AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS t FROM dw)
SELECT DISTINCT doc_id, item_id FROM dk JOIN ik USING (k)
UNION SELECT doc_id, item_id FROM dt JOIN short ON contains(t, k)""",
    "p1_found": _COUNTS + "SELECT tag_a, tag_b FROM s WHERE n >= 4 AND n * total >= 3 * n_a * n_b",
    "p1_scores": _COUNTS + "SELECT tag_a, tag_b, n, n_a, n_b, round(n * total / (n_a * n_b), 6) AS lift FROM s",
    "p6_found": _TERMS + "SELECT tag, 'rare' AS mark FROM f WHERE images < 5 UNION ALL SELECT tag, 'common' FROM f WHERE images > 0.3 * (SELECT count(*) FROM latest)",
    "p6_frequencies": _TERMS + "SELECT tag, occurrences, images FROM f",
}
