"""Column functions against Python."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from prismara.functions import text as tx
from prismara.functions.vectors import argmax, cosine, euclidean, fuse, l2_normalize, norm, pooled_feature, softmax

NAMES = ["cat_dog", "3d_render", "(medium)", "o'neil", "1girl", "éa ÉB", "", "a__b", "watercolor_(medium)", "x:y/z\\w", "猫_耳", " - ", "!!!", "a\tb"]


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select("*", *columns).collect()]


def test_title_and_safe_name(spark):
    def safe(n):
        return "".join(c for c in n if c.isalnum() or c in " _-/\\").strip() or "other"

    for n, title, name in one(spark, [(n,) for n in NAMES], "n string", tx.spoken(F.col("n")), tx.safe_name(F.col("n"))):
        assert title == n.replace("_", " ").title()
        assert name == safe(n)
    assert one(spark, [(None,)], "n string", tx.safe_name(F.col("n")))[0][1] is None


@pytest.mark.parametrize(
    ("segment", "expected"),
    [
        ("cat", [("positive", "cat", 1.0)]),
        ("dog:1.5", [("positive", "dog", 1.5)]),
        ("-table", [("negative", "table", 1.0)]),
        ("-table:2", [("negative", "table", 2.0)]),
        ("a:b", [("positive", "a", 1.0)]),
        ("cat :2", [("positive", "cat ", 2.0)]),
        (" , ,", []),
        ("a:1_0,b:inf,c:1d,- d :-3", [("positive", "a", 10.0), ("positive", "b", math.inf), ("positive", "c", 1.0), ("negative", "d", -3.0)]),
        ("a:b:2", [("positive", "a:b", 2.0)]),
        (None, []),
    ],
)
def test_tag_spec(spark, segment, expected):
    got = one(spark, [(segment,)], "s string", tx.parse_tag_spec(F.col("s")))[0][1]
    assert [(x.polarity, x.tag, x.weight) for x in got] == expected


def test_paths(spark):
    import os.path

    paths = ["/a/b/c.PNG", "c.v2.jpeg", ".png", "/x/.hidden.gif", "/a/b/", "/top", "no_ext", "/a/b.c/d"]
    for p, base, stem, ext, folder in one(spark, [(p,) for p in paths], "p string", tx.basename(F.col("p")), tx.stem(F.col("p")), tx.extension(F.col("p")), tx.dirname(F.col("p"))):
        assert base == os.path.basename(p)
        assert (stem, ext) == os.path.splitext(base)
        assert folder == os.path.dirname(p)


def test_cache_keys(spark):
    rows = [("siglip_/a b/c_d.png_12.5",), ("dinov2ms_/a_b.png_0_True",), (None,), ("other",)]
    got = one(spark, rows, "k string", tx.cache_key_parts(F.col("k")))
    assert tuple(got[0][1]) == ("siglip", "/a b/c_d.png", 12.5, None)
    assert tuple(got[1][1]) == ("dinov2ms", "/a_b.png", 0.0, True)


def test_vectors(spark):
    rows = [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0, 1.0])]
    a, b = F.col("a"), F.col("b")
    got = one(spark, rows, "a array<double>, b array<double>", l2_normalize(a), cosine(a, b), euclidean(a, b), norm(a), argmax(b), softmax(b))
    assert got[0][2] == pytest.approx([0.6, 0.8]) and got[0][3] == pytest.approx(0.96) and got[0][4] == pytest.approx(math.sqrt(2)) and got[0][6] == 0
    assert got[1][2] == [0.0, 0.0] and got[1][3] == 0.0
    assert got[2][3] is None and got[2][4] is None
    assert got[3][2] is None and got[3][5] is None
    assert sum(got[0][7]) == pytest.approx(1)


def test_pooling_and_fusion(spark):
    rows = [([[1.0, 0.0], [2.0, 2.0], [4.0, 0.0]],), ([[5.0, 1.0]],)]
    got = one(spark, rows, "t array<array<double>>", pooled_feature(F.col("t")))
    assert got[0][1] == [1.0, 0.0, 3.0, 1.0] and got[1][1] == [5.0, 1.0, 5.0, 1.0]
    f = one(spark, [([3.0, 4.0], [0.0, 2.0])], "a array<double>, b array<double>", fuse((F.col("a"), 1.0), (F.col("b"), 0.7)))[0][2]
    assert sum(x * x for x in f) == pytest.approx(1) and f[3] / f[1] == pytest.approx(0.7 / 0.8)
