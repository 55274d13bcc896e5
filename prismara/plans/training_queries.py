"""Driver queries of the general training-data operators (problems 2 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismara.operators.drift import drift_report, unified_records
from prismara.operators.nested import flatten_documents
from prismara.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a file against the one before it in its feed."""
    return drift_report(table(spark, sf_dir, "training_files")).select("feed", "file_id", "change", "field_old", "field_new")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of all feeds in one consistent table."""
    return unified_records(table(spark, sf_dir, "training_files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders, images, tags and scores in their common columns."""
    return flatten_documents(table(spark, sf_dir, "metadata_files")).supertype()


def p5_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with their shape variant and links to their folders."""
    return flatten_documents(table(spark, sf_dir, "metadata_files")).images()


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as numbers, with links to their images."""
    return flatten_documents(table(spark, sf_dir, "metadata_files")).scores()


QUERIES = {"p2_found": p2_found, "p2_records": p2_records, "p5_found": p5_found, "p5_images": p5_images, "p5_scores": p5_scores}

# JSON is read by DuckDB itself.
ORACLES = {
    "p2_found": r"""WITH b AS (SELECT DISTINCT feed, file_id, written_at, body::JSON AS v FROM training_files WHERE body IS NOT NULL AND json_valid(body)),
o AS (SELECT feed, file_id, written_at, v FROM b WHERE json_type(v) = 'OBJECT' AND len(json_keys(v)) > 0),
n AS (SELECT *, list_bool_and(list_transform(map_values(v::MAP(VARCHAR, JSON)), lambda x: json_type(x) = 'OBJECT')) AS keyed FROM o),
li AS (SELECT feed, file_id, written_at, from_json(v, '["JSON"]') AS l FROM b WHERE json_type(v) = 'ARRAY'
 UNION ALL SELECT feed, file_id, written_at, CASE WHEN keyed THEN map_values(v::MAP(VARCHAR, JSON)) ELSE [v] END FROM n),
r AS (SELECT feed, file_id, written_at, x, i FROM (SELECT feed, file_id, written_at, unnest(l) AS x, unnest(range(len(l))) AS i FROM li) WHERE json_type(x) = 'OBJECT'),
u AS (SELECT feed, file_id, i, unnest(map_entries(x::MAP(VARCHAR, JSON))) AS e FROM r),
k AS (SELECT feed, file_id, i, e.key AS name, CASE json_type(e.value) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS t FROM u),
z AS (SELECT feed, file_id, name, t, row_number() OVER (PARTITION BY feed, file_id, name ORDER BY (t IS NULL)::INT, count(*) DESC, min(i)) AS q FROM k GROUP BY feed, file_id, name, t),
y AS (SELECT feed, file_id, name, t FROM z WHERE q = 1),
fl AS (SELECT feed, file_id, lag(file_id) OVER (PARTITION BY feed ORDER BY written_at, file_id) AS before FROM (SELECT DISTINCT feed, file_id, written_at FROM r)),
c AS (SELECT feed, file_id, name, t, CASE WHEN replace(lower(name), '_', '') IN ('imagepath', 'image', 'filepath', 'path', 'img', 'filename', 'source') THEN 'image' WHEN replace(lower(name), '_', '') IN ('description', 'caption', 'text', 'label', 'annotation') THEN 'text' END AS class FROM y),
old AS (SELECT fl.feed, fl.file_id, c.name, c.t, c.class FROM fl JOIN c ON c.file_id = fl.before AND c.feed IS NOT DISTINCT FROM fl.feed),
new AS (SELECT fl.feed, fl.file_id, c.name, c.t, c.class FROM fl JOIN c ON c.file_id = fl.file_id AND c.feed IS NOT DISTINCT FROM fl.feed WHERE fl.before IS NOT NULL),
gone AS (SELECT *, row_number() OVER (PARTITION BY file_id, class ORDER BY name) AS q FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.file_id = old.file_id AND new.name = old.name)),
come AS (SELECT *, row_number() OVER (PARTITION BY file_id, class ORDER BY name) AS q FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE new.file_id = old.file_id AND new.name = old.name)),
ren AS (SELECT g.feed, g.file_id, g.name AS o, h.name AS n, g.t AS ot, h.t AS nt FROM gone g JOIN come h ON g.file_id = h.file_id AND g.class = h.class AND g.q = h.q)
SELECT feed, file_id, 'renamed' AS change, o AS field_old, n AS field_new FROM ren
UNION ALL SELECT feed, file_id, 'removed', name, '' FROM gone WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.file_id = gone.file_id AND ren.o = gone.name)
UNION ALL SELECT feed, file_id, 'added', '', name FROM come WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.file_id = come.file_id AND ren.n = come.name)
UNION ALL SELECT feed, file_id, 'retyped', o, n FROM ren WHERE ot <> nt
UNION ALL SELECT old.feed, old.file_id, 'retyped', old.name, new.name FROM old JOIN new USING (file_id, name) WHERE old.t <> new.t""",
    "p5_found": r"""WITH RECURSIVE j AS (SELECT DISTINCT meta_id, body::JSON AS v FROM metadata_files WHERE body IS NOT NULL AND json_valid(body)),
t AS (SELECT meta_id, v FROM j WHERE json_type(v) = 'OBJECT' UNION ALL SELECT meta_id, unnest(from_json(v, '["JSON"]')) FROM j WHERE json_type(v) = 'ARRAY'),
f AS (SELECT meta_id, v AS node, '' AS above FROM t WHERE json_type(v) = 'OBJECT'
 UNION ALL SELECT meta_id, x, name FROM (SELECT meta_id, node ->> '$.folder' AS name, unnest(from_json(node -> '$.subfolders', '["JSON"]')) AS x FROM f WHERE json_type(node -> '$.subfolders') = 'ARRAY') WHERE json_type(x) = 'OBJECT'),
e AS (SELECT meta_id, node ->> '$.folder' AS folder, node -> '$.images' AS im FROM f),
k AS (SELECT meta_id, folder, unnest(map_entries(im::MAP(VARCHAR, JSON))) AS x FROM e WHERE json_type(im) = 'OBJECT'),
l AS (SELECT meta_id, folder, unnest(from_json(im, '["JSON"]')) AS v FROM e WHERE json_type(im) = 'ARRAY'),
i AS (SELECT meta_id, folder, x.key AS image_name, x.value AS v FROM k WHERE json_type(x.value) = 'OBJECT'
 UNION ALL SELECT meta_id, folder, coalesce(v ->> '$.file', v ->> '$.name', ''), v FROM l WHERE json_type(v) = 'OBJECT'),
g AS (SELECT meta_id, folder, image_name, rel, unnest(from_json(a, '["JSON"]')) AS x, unnest(range(json_array_length(a)::BIGINT))::INT AS pos FROM (SELECT meta_id, folder, image_name, unnest(['general_tag', 'character_tag', 'mature_tag']) AS rel, unnest([v -> '$.general_tags', v -> '$.character_tags', v -> '$.mature_tags']) AS a FROM i) WHERE json_type(a) = 'ARRAY'),
o AS (SELECT meta_id, folder, image_name, v -> '$.all_scores' AS a FROM i),
q AS (SELECT meta_id, folder, image_name, unnest(json_keys(a)) AS item FROM o WHERE json_type(a) = 'OBJECT'
 UNION ALL SELECT meta_id, folder, image_name, coalesce(x ->> '$.tag', x ->> '$.name') FROM (SELECT meta_id, folder, image_name, unnest(from_json(a, '["JSON"]')) AS x FROM o WHERE json_type(a) = 'ARRAY') WHERE json_type(x) = 'OBJECT')
SELECT meta_id, node ->> '$.folder' AS folder, '' AS image_name, 'folder' AS relation, -1 AS pos, above AS item FROM f
UNION SELECT meta_id, folder, image_name, 'image', -1, '' FROM i
UNION SELECT meta_id, folder, image_name, rel, pos, x ->> '$' FROM g WHERE json_type(x) <> 'NULL'
UNION SELECT meta_id, folder, image_name, 'score', -1, item FROM q WHERE item IS NOT NULL""",
}
