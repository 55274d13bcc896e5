"""Nested documents and drifting schemas against brute force."""

from __future__ import annotations

import itertools
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismara.operators import drift
from prismara.operators.nested import ShapeAutomaton, document_rows, flatten_documents
from prismara.plans import training_queries
from prismara.plans.adjacent import with_previous


@given(st.lists(st.lists(st.integers(0, 9), min_size=3, max_size=3), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_matching_is_best(rows):
    w = np.array(rows, float)
    got = sum(w[a, b] for a, b in drift.max_weight_matching(w))
    n, m = w.shape
    k = min(n, m)
    best = max(sum(w[i, j] for i, j in zip(r, c)) for r in itertools.permutations(range(n), k) for c in itertools.permutations(range(m), k))
    assert got == best


def test_previous_spans_partitions(spark):
    rows = [("hot", i, i * 10) for i in range(200)] + [(f"g{i}", 1, i) for i in range(5)] + [(None, 1, 7), (None, 2, 8)]
    t = spark.createDataFrame(rows, "g string, o int, v int").repartition(6)
    got = {(r["g"], r["o"]): None if r["prev"] is None else r["prev"]["v"] for r in with_previous(t, ["g"], ["o"], ["v"]).collect()}
    assert got == {(g, o): next((w for h, p, w in rows if h == g and p == o - 1), None) for g, o, _ in rows}
    assert with_previous(t.where("false"), ["g"], ["o"], ["v"]).count() == 0


def files(spark, bodies, feed="f"):
    rows = [(feed, i, f"2024-01-01 00:00:{i:02d}", b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "feed string, file_id long, at string, body string").selectExpr("feed", "file_id", "cast(at as timestamp) written_at", "body", "1 as records", "2 as prev_x")


def test_drift(spark):
    bodies = [
        [{"image_path": "a", "caption": "x", "n": 1}, {"image_path": None}],
        None,
        "{not json",
        "",
        [],
        {"a": {"imagePath": "a", "Caption": 5, "n": "1"}},
        '{"imagePath": "a", "Caption": NaN}',
        {"imagePath": "a", "extra": None, "n": None},
        {"imagePath": "a", "extra": {}, "n": 4},
    ]
    t = files(spark, bodies)
    got = {tuple(r) for r in drift.drift_report(t.unionByName(t)).select("file_id", "change", "field_old", "field_new").collect()}
    assert got == {
        (5, "renamed", "image_path", "imagePath"), (5, "renamed", "caption", "Caption"), (5, "retyped", "caption", "Caption"), (5, "retyped", "n", "n"),
        (7, "removed", "Caption", ""), (7, "added", "", "extra"),
    }
    assert drift.drift_report(t.where("false")).count() == 0
    records = drift.unified_records(t).collect()
    assert len(records) == 5 and {r["image_path"] for r in records} == {"a", None}


def test_records_keep_every_value(spark):
    record = {"image_path": "/moved/a.jpeg", "path": "/mirror/a.jpeg", "img": None, "description": "one", "Text": "two", "label": 0, "caption": "", "annotation": False, "Width": 1, "width": 2, "Seed_No": 3, "\ud800": 4, "\udc00": 5}
    (got,) = drift.unified_records(files(spark, [[record]])).collect()
    assert (got["image_path"], got["text"], got["image_field"], got["text_field"]) == ("/moved/a.jpeg", "one", "image_path", "description")
    assert got["attributes"] == {"path": "/mirror/a.jpeg", "img": None, "Text": "two", "label": "0", "caption": "", "annotation": "false", "Width": "1", "width": "2", "seedno": "3", "?": "4", "?#2": "5"}
    assert len(got["types"]) == len(record) - 1


def test_records_follow_renames(spark):
    bodies = [[{"image_path": "a", "height": 1, "note": "x"}], [{"image_path": "a", "heights": 1, "note": "x"}], [{"image_path": "a", "heights_px": 1, "note": "x"}], [{"image_path": "a", "heights_px": 2, "height": 3, "lang": "en"}]]
    t = files(spark, bodies).unionByName(files(spark, [[{"height": 7}], [{"height": 8}]], None)).unionByName(files(spark, [[{"heights": 9}]], "g"))
    got = {(r["feed"], r["file_id"]): r["attributes"] for r in drift.unified_records(t).collect()}
    assert got["f", 0] == got["f", 1] == got["f", 2] == {"height": "1", "note": "x"}
    assert got["f", 3] == {"heights_px": "2", "height": "3", "lang": "en"}  # both at once: kept apart
    assert (got[None, 0], got[None, 1], got["g", 0]) == ({"height": "7"}, {"height": "8"}, {"heights": "9"})


def test_renames_prefer_like_names():
    old = [{"name": n, "type": "string", "rows": 1, "nulls": 0, "length": 3.0, "sketch": []} for n in ("description", "caption", "keep")]
    new = [{"name": n, "type": "string", "rows": 1, "nulls": 0, "length": 3.0, "sketch": []} for n in ("Caption", "DESCRIPTION", "keep")]
    got = {(c["field_old"], c["field_new"]) for c in drift.changes(old, new)}
    assert got == {("description", "DESCRIPTION"), ("caption", "Caption")}
    other = drift.changes([dict(old[2], name="height")], [dict(old[2], name="heights")], other_renames=0.5)
    assert [c["change"] for c in other] == ["renamed"]


DOC = {
    "folder": "top",
    "images": {"a.png": {"general_tags": ["x", None, 3], "mature_tags": "no", "all_scores": {"x": 0.5, "y": {"score": "0.2"}, "z": None}}, "b.png": None, "c.png": {"error": "e"}},
    "subfolders": [{"folder": "sub", "images": [{"file": "d.png", "character_tags": ["k"], "all_scores": [{"tag": "k", "score": 1}, {"name": "l"}, 5]}, "n/a"]}, 7],
}
EXPECTED = {
    ("top", "", "folder", -1, ""), ("sub", "", "folder", -1, "top"), ("top", "a.png", "image", -1, ""), ("top", "c.png", "image", -1, ""), ("sub", "d.png", "image", -1, ""),
    ("top", "a.png", "general_tag", 0, "x"), ("top", "a.png", "general_tag", 2, "3"), ("sub", "d.png", "character_tag", 0, "k"),
    ("top", "a.png", "score", -1, "x"), ("top", "a.png", "score", -1, "y"), ("top", "a.png", "score", -1, "z"), ("sub", "d.png", "score", -1, "k"), ("sub", "d.png", "score", -1, "l"),
}


def test_nested(spark):
    rows = [(1, json.dumps(DOC), "x"), (1, json.dumps(DOC), "x"), (2, None, "x"), (3, '{"folder": ', "x"), (4, "5", "x"), (None, '{"images": {}}', "x"), (6, '"\\ud800"', "x")]
    t = spark.createDataFrame(rows, "meta_id long, body string, folder string")
    tables = flatten_documents(t)
    got = [tuple(r) for r in tables.supertype().collect()]
    assert len(got) == len(set(got)) and {g[1:] for g in got if g[0] == 1} == EXPECTED
    assert [g for g in got if g[0] != 1] == [(None, None, "", "folder", -1, "")]
    folders = {r["node_no"]: r for r in tables.folders().where("meta_id = 1").collect()}
    images = tables.images().where("meta_id = 1").collect()
    assert all(r["parent_no"] in folders for r in images) and len(images) == 3
    assert {r["tag"]: r["score"] for r in tables.scores().where("image_name = 'a.png'").collect()} == {"x": 0.5, "y": 0.2, "z": None}
    assert tables.images_failed().count() == 1 and tables.images_tagged().count() == 2 and tables.tags().count() == 2
    assert flatten_documents(t.where("false")).supertype().count() == 0


def test_deep_nesting_and_long_bodies():
    doc: dict = {"folder": "0", "images": {}}
    for i in range(1, 150):
        doc = {"folder": str(i), "images": {}, "subfolders": [doc]}
    assert len(document_rows(1, json.dumps(doc))) == 150
    assert document_rows(1, "[" * 200_000) == []
    assert len(document_rows(1, json.dumps({"images": {str(i): {} for i in range(30_000)}}))) == 30_001


@pytest.mark.parametrize(("value", "state"), [(None, "null"), ([], "empty_list"), (["a", None], "strings"), ({"score": 1, "tag": "t"}, "score_tag"), ([{"score": 1, "name": "t"}], "scores_by_name"), ({"a": 0.1}, "number_map"), ({"a": {"score": 1}}, "object_map"), ({"images": []}, "folder"), ({"error": "e"}, "image_failed"), ({"rating": {}}, "image_tagged")])
def test_shapes(value, state):
    assert ShapeAutomaton().run(value) == state


def test_queries_run(spark, tiny):
    for name, query in training_queries.QUERIES.items():
        assert query(spark, tiny).count() > 0, name


@pytest.mark.parametrize("levels", [1500, 20_000])
def test_deep_records(spark, levels):
    """Nesting of any depth is read, in entries and in folders."""
    from prismara.functions.jsonio import deep_loads, dumps, strict_loads
    from prismara.operators import drift, nested

    deep = "[" * levels + "]" * levels
    rows = [(1, '{"folder":"f","images":{"a.png":{"general_tags":["x"],"extra":' + deep + "}}}"), (2, '{"folder":"g","subfolders":[' * levels + '{"folder":"z","images":[]}' + "]}" * levels), (3, "[" * levels)]
    files = spark.createDataFrame(rows, "meta_id long, body string")
    counts = {r["meta_id"]: r["count"] for r in nested.flatten_documents(files).nodes.groupBy("meta_id").count().collect()}
    assert counts == {1: 3, 2: levels + 1}
    feed = spark.createDataFrame([("a", 1, '[{"path":"p","extra":' + deep + "}]")], "feed string, file_id long, body string").withColumn("written_at", F.current_timestamp())
    assert drift.profile_files(feed).count() == 1 and len(drift.unified_records(feed).first()["attributes"]["extra"]) == 2 * levels
    assert dumps(strict_loads(deep)) == deep
    for text in ('{"a": [1, -2.5e3, true, null, "\\u00e9"], "b": {}}', "[]", ' "x" '):
        assert deep_loads(text) == json.loads(text)
    for text in ("[1,]", "[1 2]", "01", '{"a"}', "[", "nul", "{1:2}"):
        with pytest.raises((ValueError, IndexError)):
            deep_loads(text)


def test_named_files_of_a_folder_without_images(spark):
    from prismara.sources import training_json

    body = '{"sample_files": ["sub/a.png", "gone.png"], "description": "one; two"}'
    files = spark.createDataFrame([("/d/m.json", body)], "path string, body string")
    got = training_json.training_pairs(files, spark.createDataFrame([("/d/sub/a.png",)], "path string")).collect()
    assert [(r["image_path"], r["description"]) for r in got] == [("/d/sub/a.png", "one; two")]
