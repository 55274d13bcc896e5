"""Training-data operators against brute force, exact round trips and planted cases."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismara.llm import apart, garbled, leakage, neighbours, termfreq, tokens
from prismara.llm import clusters as cl
from prismara.llm.cooccur import PairTable
from prismara.llm.tags import current_images, normal_tag, normal_tags
from prismara.llm.vectors import usable_vectors

# --- items that appear together -------------------------------------------------


def counted(baskets):
    items, pairs = Counter(), Counter()
    for b in baskets.values():
        b = sorted(set(b or []))
        items.update(b)
        pairs.update(itertools.combinations(b, 2))
    return items, pairs


def test_pair_table_is_incremental(spark):
    rng = random.Random(3)
    table, state = PairTable(spark, buckets=4), {}
    for batch in range(3):
        change = {i: rng.sample("abcdefgh", rng.randint(0, 5)) for i in rng.sample(range(30), 12)}
        change |= {100 + batch: None, 7: ["hot"] * 3 + ["a"]}
        rows = spark.createDataFrame([(i, b, "x") for i, b in change.items()] + [(None, ["a", "b"], "x")], "id long, items array<string>, n string")
        hit = table.apply(rows)
        state |= change
        items, pairs = counted(state)
        assert {r["a"]: r["n"] for r in table.items().collect()} == dict(items)
        assert {(r["a"], r["b"]): r["n"] for r in table.pairs().collect()} == dict(pairs)
        assert table.total == len(state)
        scores = {(r["a"], r["b"]): r["lift"] for r in table.scores().collect()}
        assert scores == pytest.approx({(a, b): n * len(state) / (items[a] * items[b]) for (a, b), n in pairs.items()})
        some = {(r["a"], r["b"]) for r in table.scores(hit).collect()}
        assert some <= set(scores)
        if batch == 1:  # a later session goes on with the table
            table = PairTable(spark, path=table.path)
    assert table.apply(rows).count() == 0
    table.vacuum()
    again = PairTable(spark, path=table.path)
    assert again.total == len(state) and {(r["a"], r["b"]): r["n"] for r in again.pairs().collect()} == dict(pairs)
    assert PairTable(spark).apply(rows.where("false")).count() == 0


def test_small_batches_rewrite_little(spark, monkeypatch):
    from prismara.llm import cooccur

    monkeypatch.setattr(cooccur, "ROWS", 50)
    rng = random.Random(4)
    baskets = {i: rng.sample([f"t{k}" for k in range(120)], 8) for i in range(300)}
    table = PairTable(spark, buckets=4)
    table.apply(spark.createDataFrame(list(baskets.items()), "id long, items array<string>"))
    assert table.buckets["pairs"] >= 64
    before = dict(table.at["pairs"])
    table.apply(spark.createDataFrame([(1, ["t1", "t2", "new"])], "id long, items array<string>"))
    baskets[1] = ["t1", "t2", "new"]
    items, pairs = counted(baskets)
    assert {(r["a"], r["b"]): r["n"] for r in table.pairs().collect()} == dict(pairs)
    changed = sum(before.get(b) != p for b, p in table.at["pairs"].items())
    assert changed <= 31 < len(before)  # 28 pairs go, 3 come


def test_large_counts(spark):
    from prismara.llm.cooccur import at_least

    rows = [(6 * 10**9, 2 * 10**9, 10**9, 4 * 10**9), (6 * 10**9 - 1, 2 * 10**9, 10**9, 4 * 10**9), (9, 10, 5, 6), (8, 10, 5, 6), (10, 10, 5, 6)]
    t = spark.createDataFrame(rows, "n long, total long, n_a long, n_b long")
    got = [r[0] for r in t.select(at_least(F.col("n"), F.col("total"), F.col("n_a"), F.col("n_b"), 3)).collect()]
    assert got == [n * total >= 3 * a * b for n, total, a, b in rows]


def test_tags(spark):
    t = spark.createDataFrame([(" A \t_b__C ",), ("\t",), (None,), ("_x",)], "t string").select(normal_tag(F.col("t")).alias("n"))
    assert [r["n"] for r in t.collect()] == ["a_b_c", "", None, "_x"]
    m = spark.createDataFrame([(1, ["a"], "2024-01-02"), (1, ["b"], "2024-01-03"), (1, ["c"], None), (None, ["d"], "2024-01-01"), (2, None, None)], "image_id long, tags array<string>, w string").withColumn("written_at", F.col("w").cast("timestamp"))
    got = {r["image_id"]: r["t"] for r in current_images(m, ["tags"]).select("image_id", normal_tags(F.col("tags")).alias("t")).collect()}
    assert got == {1: ["b"], 2: []}


# --- frequency of terms ------------------------------------------------------------


def test_terms_with_a_hot_one(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", "Ω", "long" * 50]), rng.randint(0, 60)) for _ in range(3000)] + [(None, 1), ("", 1), ("z", None)]
    t = spark.createDataFrame(rows, "term string, record long").repartition(5)
    got = {r["term"]: (r["occurrences"], r["records"]) for r in termfreq.term_frequencies(t).collect()}
    ok = [(a, b) for a, b in rows if a and b is not None]
    assert got == {a: (sum(x == a for x, _ in ok), len({b for x, b in ok if x == a})) for a in {a for a, _ in ok}}
    assert termfreq.term_frequencies(t.where("false")).count() == 0
    marks = spark.createDataFrame([("a", 1, 4), ("b", 1, 40), ("c", 9, 10)], "term string, occurrences long, records long")
    assert {(r["term"], r["mark"]) for r in termfreq.marked(marks, 100).collect()} == {("a", "rare"), ("b", "common"), ("c", None)}


def test_run_carries_over_batches():
    import pyarrow as pa

    rows = [("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 3), ("c", 3)]
    batches = [pa.RecordBatch.from_pydict({"t": [t], "r": pa.array([r], pa.int64()), "n": pa.array([1], pa.int64())}) for t, r in rows]
    out = [tuple(x.values()) for b in termfreq._scan(batches) for x in b.to_pylist()]
    assert out == [("a", 3, 2), ("b", 2, 2), ("c", 1, 1)]


# --- encoding -----------------------------------------------------------------------

TEXTS = ["", None, "Hello  world", "a\r\n\tb  c ", "<|endoftext|> 123 don't", "猫の目 😀👩‍🎨", "Ᲊ new letters aᲉb", "word " * 3000, "x" * 5000, " ", "café naïve"]


def test_encoding_is_the_tokenizers(spark):
    whole = tokens.tokenizer(tokens.TOKENIZER_DIR + "/byte_bpe_50k.json")
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] * 2 + [(None, "Hello", "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    encoded = tokens.encode_corpus(docs).cache()
    got = [(r["doc_id"], tuple(r["ids"])) for r in encoded.collect()]
    want = [(i, tuple(whole.encode(t, add_special_tokens=False).ids) if t else ()) for i, t, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    back = [(r["doc_id"], r["text"]) for r in tokens.decode_corpus(encoded).collect()]
    assert sorted(back, key=str) == sorted(((i, t or "") for i, t, _ in rows), key=str)
    assert tokens.encode_corpus(docs.where("false")).count() == 0


# --- evaluation leaks ----------------------------------------------------------------


def brute_leaks(docs, items):
    out = set()
    for d, text in docs:
        words = leakage.words_of(text)
        for i, item in items:
            own = leakage.words_of(item)
            n = min(12, len(own))
            windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
            if any(tuple(words[k : k + n]) in windows for k in range(len(words) - n + 1)):
                out.add((d, i))
    return out


def test_leaks(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["two", "three", "7", "px", "Ämter"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 12, 20])))) for i in range(12)] + [(90, None), (91, ""), (92, "?!")]
    docs = []
    for d in range(60):
        text = rng.choices(vocabulary, k=rng.randint(0, 30))
        if d % 3 == 0:
            own = rng.choice(items[:12])[1].split()
            text[3:3] = own[rng.randint(0, 2) :]
        docs.append((d, ", ".join(text).upper() if d % 2 else " ".join(text)))
    docs += [(100, None), (101, ""), (102, docs[0][1])]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    items_df = spark.createDataFrame(items, "item_id long, text string")
    for most in (10**6, 0):  # with and without the filter of the corpus
        got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(docs_df, items_df, max_filter=most).where("kind = 'exact'").collect()}
        assert got == brute_leaks(docs, items) and got
    assert leakage.leaks(docs_df.where("false"), items_df).count() == 0 and leakage.leaks(docs_df, items_df.where("false")).count() == 0


def test_reparameterised(spark):
    item = "If the cook removes two apples from the red boat then how many apples are left in it"
    docs = [(1, item), (2, item.replace("two", "nine")), (3, item.replace("two", "many"))]
    got = {(r["doc_id"], r["kind"]) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert {(1, "exact"), (2, "reparameterised")} <= got and (2, "exact") in got or (2, "reparameterised") in got
    assert not any(d == 3 and k == "reparameterised" for d, k in got)


def test_slots_over_all_windows(spark):
    """Bare numbers leak nothing; replacements must agree over the whole of an occurrence."""
    item = "Then two boats leave the port with seven sailors each and later two more boats come back with nine sailors"
    good, bad = item.replace("two", "four"), item.replace("two", "four", 1).replace("two", "six")
    docs = [(1, "see page 9 of 12"), (2, "before " + good), (3, bad), (4, "Es sind 20px breit oder 9"), (5, item.replace("boats", "ships"))]
    items = [(1, "42"), (2, item), (3, "two 7px"), (4, None)]
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert (2, 2, "reparameterised") in got and not any(d in (1, 3, 4, 5) and k != "exact" for d, _, k in got)
    assert not any(i in (1, 3) for _, i, _ in got)


def test_many_names(spark):
    """Names are placeholders whether they are sent or joined."""
    item = "Here the cook Anna gives her friend Peter some red apples and then Anna goes home again"
    docs = spark.createDataFrame([(1, item), (2, item.replace("Anna", "Peter#").replace("Peter ", "Anna ").replace("#", "")), (None, item), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(5, item), (6, None)], "item_id long, text string")
    few, many = ({tuple(r) for r in leakage.leaks(docs, items, max_names=n).collect()} for n in (100, 1))
    assert few == many and (2, 5, "reparameterised") in {r[:3] for r in many}


@given(st.lists(st.integers(0, 2**63), min_size=0, max_size=40), st.integers(1, 12))
@settings(max_examples=50, deadline=None)
def test_rolling_hash(values, width):
    h = np.array(values, np.uint64)
    got = leakage.rolling(h, width).tolist()
    base = int(leakage._BASE)
    want = [sum(int(v) * pow(base, j, 1 << 64) for j, v in enumerate(values[i : i + width])) % (1 << 64) for i in range(len(values) - width + 1)]
    assert got == want


# --- similar vectors and clusters -----------------------------------------------------


def planted(groups, singles, d=384, seed=0, spread=0.35):
    rng = np.random.default_rng(seed)
    rows = []
    for n in groups:
        c = rng.standard_normal(d)
        c /= np.linalg.norm(c)
        for _ in range(n):
            noise = rng.standard_normal(d)
            rows.append((c + spread * noise / np.linalg.norm(noise)) * rng.uniform(0.5, 3))
    rows += list(rng.standard_normal((singles, d)))
    x = np.array(rows)[rng.permutation(len(rows))].astype(np.float32)
    return x


def cache(spark, x, first=1):
    rows = [(first + i, f"dinov2ms_/a_{i}.png_1.5_True", [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "feat_id long, ckey string, vec array<float>")


def unit(x):
    d = x.astype(np.float64)
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def true_groups(x, first=1):
    s = unit(x) @ unit(x).T >= 0.6
    out = set()
    for row in s:
        m = np.flatnonzero(row)
        if len(m) > 2 and all((s[j] == row).all() for j in m):
            out |= {(int(m[0]) + first, int(j) + first) for j in m}
    return out


def true_pairs(x, k=5, first=1):
    s = unit(x) @ unit(x).T
    np.fill_diagonal(s, -9)
    out = set()
    for i, row in enumerate(s):
        for j in np.lexsort((np.arange(len(row)), -row))[:k]:
            if row[j] >= 0.6:
                out.add((min(i, int(j)) + first, max(i, int(j)) + first))
    return out


def test_usable_vectors(spark):
    w = [0.5] * 384
    rows = [
        (1, "dinov2ms_/a_1_True", w), (2, "dinov2ms_/a_1_True", w), (3, "dinov2ms_/b_1_True", None), (4, "dinov2ms_/c_1_True", w[:-1]), (5, "dinov2ms_/d_1_True", [0.0] * 384),
        (6, "dinov2ms_/e_1_True", [float("nan"), *w[1:]]), (7, "dinov2ms_/f_1_True", [float("inf"), *w[1:]]), (8, "dinov2ms_/g_1_True", [None, *w[1:]]), (9, None, w), (10, "dinov2ms_/h_1_False", w), (11, "siglip_/x_True", [1.0] * 1152), (12, "other_/x_True", w), (13, "dinov2ms_/b_1_True", w),
    ]
    t = spark.createDataFrame(rows, "feat_id long, ckey string, vec array<float>").withColumn("kind", F.lit("clash"))
    assert {(r["kind"], r["feat_id"]) for r in usable_vectors(t).collect()} == {("dinov2ms_True", 1), ("siglip", 11), ("dinov2ms_True", 13)}


def test_groups_and_pairs(spark):
    x = planted([3, 4, 9, 25, 60, 3, 5], 60)
    x[5] = x[50]
    v = usable_vectors(cache(spark, x))
    assert {tuple(r) for r in cl.groups(v).collect()} == true_groups(x)
    got = {tuple(r) for r in neighbours.alike_pairs(v).collect()}
    want = true_pairs(x)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)
    members = cl.clusters(v).collect()
    assert sum(r["size"] for r in members) == len(x) and all(1 <= len(r["typical"]) <= 3 for r in members)


def test_vectors_empty_and_single(spark):
    v = usable_vectors(cache(spark, planted([], 1)))
    assert cl.groups(v).count() == 0 and neighbours.alike_pairs(v).count() == 0 and cl.clusters(v).count() == 1
    none = usable_vectors(cache(spark, planted([], 1)).where("false"))
    assert cl.groups(none).count() == 0 and neighbours.alike_pairs(none).count() == 0


def test_pages_of_any_size_give_the_same(spark, monkeypatch):
    """One page, small pages, several tiers of trees, and pages above LARGE."""
    x = planted([150, 20, 9, 4, 3], 60, seed=4)
    x[11] = x[12] = x[13]
    x[20:24] = planted([], 1, seed=77)[0]  # copies alone are a group
    v = usable_vectors(cache(spark, x))
    want, pairs = true_groups(x), true_pairs(x)
    for sizes in ({}, {"LEAF": 40}, {"LEAF": 20, "SAMPLE": 48, "WIDE": 30, "CAP": 25}, {"LARGE": 100}):
        for name, n in sizes.items():
            monkeypatch.setattr(cl if name == "LARGE" else neighbours, name, n)
        assert {tuple(r) for r in cl.groups(v).collect()} == want, sizes
        if "LARGE" in sizes:
            continue
        got = {tuple(r) for r in neighbours.alike_pairs(v).collect()}
        assert len(got & pairs) >= 0.97 * len(pairs), sizes


def test_mixture_decides(spark, monkeypatch):
    """Without components there is no group, whatever the links."""
    x = planted([9, 20, 4], 20, seed=5)
    u = unit(x).astype(np.float32)
    alike = cl.alike_matrix(u, x, 0.6)
    parts, grouped = cl.leaf_components(u, alike, np.ones(len(x), int))
    assert sorted(len(p) for p, g in zip(parts, grouped) if g) == [4, 9, 20]
    monkeypatch.setattr(cl, "_components", lambda u, charge, ridge: [np.array([i]) for i in range(len(u))])
    assert not any(cl.leaf_components(u, alike, np.ones(len(x), int))[1])


def test_links_of_large_pages(spark, monkeypatch):
    monkeypatch.setattr(cl, "ROUND_BYTES", 384 * 4 * 40)
    x = planted([60], 5, seed=6, spread=0.75)  # members are alike, but far from their centre
    rows = usable_vectors(cache(spark, x)).select("kind", F.lit("0").alias("node"), "feat_id", "vec")
    got = {r["feat_id"]: (r["links"], r["code"]) for r in cl._links(rows, 0.6).collect()}
    own, s = cl.own_codes(np.arange(1, len(x) + 1)), unit(x) @ unit(x).T >= 0.6
    assert got == {i + 1: (int(s[i].sum()), int(np.bitwise_xor.reduce(own[s[i]]))) for i in range(len(x))}


def test_large_page_keeps_small_groups(spark, monkeypatch):
    """A group above LARGE, smaller groups, a chain that is none and single rows, all in one page."""
    monkeypatch.setattr(cl, "LARGE", 60)
    monkeypatch.setattr(cl, "ROUND_BYTES", 384 * 4 * 50)
    x = planted([90, 70, 5, 3], 40, seed=8)
    rng = np.random.default_rng(2)
    a, b = (v / np.linalg.norm(v) for v in rng.standard_normal((2, 384)))
    x = np.concatenate([x, np.array([a, 0.75 * a + 0.75 * b, b], np.float32)])  # the middle one is alike to both others
    want = true_groups(x)
    assert len({c for c, _ in want}) == 4
    v = usable_vectors(cache(spark, x))
    assert {tuple(r) for r in cl.groups(v).collect()} == want
    found = cl.clusters(v).collect()
    assert sum(r["size"] for r in found) == len(x)
    assert {90, 70, 5, 3} <= {r["size"] for r in found}


def test_group_of_two_modes():
    """All members are alike, but the mixture tears them: the group must not be lost."""
    rng = np.random.default_rng(0)
    a, b = (v / np.linalg.norm(v) for v in rng.standard_normal((2, 384)))
    across = b - (a @ b) * a
    b = 0.75 * a + 0.66 * across / np.linalg.norm(across)
    noise = [0.2 * z / np.linalg.norm(z, axis=1, keepdims=True) for z in rng.standard_normal((2, 40, 384))]
    x = np.concatenate([a + noise[0], b + noise[1], rng.standard_normal((30, 384))]).astype(np.float32)
    u = unit(x).astype(np.float32)
    parts, grouped = cl.leaf_components(u, cl.alike_matrix(u, x, 0.6), np.ones(len(x), int))
    assert [sorted(p.tolist()) for p, g in zip(parts, grouped) if g] == [list(range(80))]
    assert sorted(i for p in parts for i in p.tolist()) == list(range(len(x)))


def test_no_alike_pair_crosses_a_page(spark, monkeypatch):
    """Whatever the places: rows are placed by id, seven each, and groups lie too near each other for the bound."""
    monkeypatch.setattr(neighbours, "LEAF", 10_000)
    monkeypatch.setattr(apart, "PLACE", 7)
    rng = np.random.default_rng(4)
    base = rng.standard_normal(384) / np.sqrt(384)
    centres = [0.66 * base + 0.75 * z / np.linalg.norm(z) for z in rng.standard_normal((3, 384))]
    x = np.concatenate([*(c + 0.35 * z / np.linalg.norm(z, axis=1, keepdims=True) for c, z in zip(centres, rng.standard_normal((3, 15, 384)))), planted([4, 3], 20, seed=13)])
    x = x[rng.permutation(len(x))].astype(np.float32)
    want = true_groups(x)
    assert sorted(Counter(c for c, _ in want).values()) == [3, 4, 15, 15, 15]
    rows = usable_vectors(cache(spark, x)).withColumn("copies", F.lit(1).cast("long"))
    pages, some = apart.closed_pages(rows, 0.6, 10, 12)
    got = {r["feat_id"]: (r["page"], r["large"]) for r in pages.collect()}
    assert some and sorted(got) == list(range(1, len(x) + 1))
    assert all(got[c][0] == got[i][0] for c, i in want)
    assert {c for c, _ in want if got[c][1]} == {c for c, n in Counter(c for c, _ in want).items() if n == 15}
    assert all(len({c for c, i in want if got[i][0] == p}) == 1 for p, large in got.values() if large)


def test_copies_that_are_no_group(spark):
    """A row alike to them is alike to another one."""
    a, b = (v / np.linalg.norm(v) for v in np.random.default_rng(3).standard_normal((2, 384)))
    x = np.concatenate([np.repeat(a[None], 50, axis=0), [0.75 * a + 0.75 * b, b]]).astype(np.float32)
    v = usable_vectors(cache(spark, x))
    assert not true_groups(x) and cl.groups(v).count() == 0
    assert sum(r["size"] for r in cl.clusters(v).collect()) == len(x)


def test_rest_of_large_page_is_divided(spark, monkeypatch):
    monkeypatch.setattr(cl, "LARGE", 60)
    monkeypatch.setattr(cl, "LEAF", 20)
    x = planted([8] * 10, 120, seed=9)
    rows = usable_vectors(cache(spark, x)).select("kind", F.lit("0").alias("page"), F.lit("0").alias("node"), "feat_id", F.lit(1).cast("long").alias("copies"), "vec", F.lit(True).alias("member"), F.lit(0.0).alias("density"))
    got = cl._divided(rows).collect()
    assert sorted(r["feat_id"] for r in got) == list(range(1, len(x) + 1))
    assert len({r["node"] for r in got}) > 3 and {r["kind"] for r in got} == {"dinov2ms_True"}
    assert max(Counter(r["node"] for r in got).values()) <= 60


def test_margin_where_alike_rows_are_rare(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 40)
    monkeypatch.setattr(neighbours, "QUERIES", 30)
    x = planted([2] * 15, 570, seed=12, spread=0.78)
    want = true_pairs(x)
    assert 5 < len(want) < 20
    v = usable_vectors(cache(spark, x))
    trees = neighbours.fit_trees(v, {"dinov2ms_True": len(x)})
    neighbours.calibrate(v, trees, {"dinov2ms_True": len(x)}, 5, 0.6)
    assert len(trees["dinov2ms_True"].children[0]) > 1 and trees["dinov2ms_True"].margin > 0.02
    assert {tuple(r) for r in neighbours.alike_pairs(v).collect()} == want


def test_visits_in_order_of_priority():
    x = unit(planted([30, 20, 9, 4, 3], 200, seed=21)).astype(np.float32)
    tree = neighbours.build_tree(x, len(x), leaf=20)
    tree.margin, tree.most = 0.1, 3
    gaps = tree.gaps(x)
    want = {(i, p) for i, g in enumerate(gaps) for p in np.lexsort((np.arange(tree.pages), g))[:3].tolist() if g[p] <= 0.1}
    q, page = tree.visit(x)
    assert len(q) == len(want) > len(x) and set(zip(q.tolist(), page.tolist())) == want


def test_vectors_sent_are_squeezed(spark):
    """Two bytes a number at most where the lower halves are zero; any others come back whole as well."""
    x = planted([9, 20], 200, seed=22)
    half = (x.view(np.uint32) & 0xFFFF0000).view(np.float32)
    for y in (x, half):
        assert (neighbours.unsqueezed(neighbours.squeeze(y), *y.shape) == y).all()
    rows = usable_vectors(cache(spark, half)).select("kind", "feat_id", "vec", F.lit(True).alias("asks"))
    trees = neighbours.fit_trees(rows, {"dinov2ms_True": len(x)})
    packs = neighbours.descend(rows, trees, 5).collect()
    assert sum(len(p["ids"]) // 8 for p in packs) == len(x)
    assert sum(len(p["vecs"]) for p in packs) < 2.1 * half.size


def test_more_ids_than_are_sent(spark, monkeypatch):
    """Repeated keys and copies beyond the bound: the rows are joined once and written, not at every use."""
    from prismara.llm import vectors

    x = planted([5, 4], 12, seed=23)
    x[6] = x[2] = x[1]
    t = cache(spark, x)
    t = t.unionByName(t.where("feat_id < 9").withColumn("feat_id", F.col("feat_id") + 100))
    monkeypatch.setattr(vectors, "IDS", 2)
    v = usable_vectors(t)
    rows, spare = vectors.distinct_vectors(v)
    assert all("Join" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (v, rows))
    assert rows.count() == len(x) - 2 and spare.count() == 2
    assert {tuple(r) for r in neighbours.alike_pairs(v).collect()} == true_pairs(x)


def test_ties_go_to_the_smaller_id(spark):
    x = np.repeat(planted([], 1), 9, axis=0)
    got = {(r["q"], r["rank"]): r["b"] for r in neighbours.nearest(usable_vectors(cache(spark, x)), 3).collect()}
    assert got[9, 1] == 1 and got[1, 1] == 2 and got[2, 3] == 4


# --- garbled text ---------------------------------------------------------------------

CLEAN = ["Das Mädchen im grünen Mantel öffnet die Tür über der Brücke.", "Où ranger l’image ? Ça ressemble à une échelle légère, déjà triée.", "¿Qué pequeño es el jardín? Así se ve la montaña.", "Снимок попал не в ту папку, порог был высокий. На заднем плане видно лодку.", "年老いた船乗りが霧の中で紙の舟を直している。"]


@pytest.mark.parametrize(("written", "read", "text"), [("utf-8", "cp1252", CLEAN[0]), ("utf-8", "latin-1", CLEAN[4]), ("utf-8", "mac_roman", CLEAN[1]), ("cp1251", "cp1252", CLEAN[3]), ("koi8-r", "cp1251", CLEAN[3]), ("cp1252", "cp437", CLEAN[0]), ("cp932", "latin-1", CLEAN[4])])
def test_undo(written, read, text):
    page = garbled.byte_letters(read)
    bad = "".join(chr(b) if b < 0x80 else page[b] for b in text.encode(written))
    assert garbled.undo(bad, written, read) == text


def read_as(text, written, read):
    raw = text.encode(written)
    if read in garbled.MULTI_READ:
        return raw.decode(read)
    page = garbled.byte_letters(read)
    return "".join(chr(b) if b < 0x80 else page[b] for b in raw)


LANGUAGES = {
    "el": "το παλιό καράβι φεύγει από το λιμάνι όταν ο ήλιος ανεβαίνει πάνω από τα βουνά και οι ψαράδες γυρίζουν με άδεια δίχτυα στην ακτή ενώ τα παιδιά παίζουν κοντά στη γέφυρα".split(),
    "ru": "старый моряк чинит бумажную лодку под мостом пока дети играют у реки и смотрят как ветер несёт жёлтые листья над тёмной водой а девочка рисует дерево и красный дом".split(),
    "de": "die müde Bäckerin öffnet früh die Tür während draußen über den Dächern dünner Nebel zieht und für später süße Brötchen übrig bleiben".split(),
    "zh": list("年老的船夫在雾中修理纸船孩子们在桥下看着黄色的叶子落到水面上一个小女孩在画红色的房子和树"),
    "ja": list("年老いた船乗りが霧の中で紙の舟を直している子供たちは橋の下で黄色い葉が水に落ちるのを見ているさむらいの人形とまるい小石が小さな店の棚にならんでいて女の子は赤い家と木の絵をかきながら母の帰りを静かに待っている"),
}
SWAPS = [("cp1253", "cp1252", "el"), ("iso8859-5", "latin-1", "ru"), ("gb18030", "cp1252", "zh"), ("utf-8", "cp932", "ja"), ("utf-8", "cp1252", "de"), ("cp1251", "koi8-r", "ru"), ("cp932", "latin-1", "ja"), ("mac_roman", "cp1252", "de")]


def planted_swaps(rng, clean=200, bad=8):
    """Clean texts of all languages, and texts of each swap that can be read that way as a whole."""
    def text(lang):
        words = LANGUAGES[lang]
        if lang in ("zh", "ja"):
            start = rng.randint(0, len(words) - 16)
            return "".join(words[start : start + rng.randint(8, 16)])
        start = rng.randint(0, len(words) - 8)
        return " ".join(words[start : start + rng.randint(5, 8)])

    docs, truth = [(i, f"clean{i % 5}", text(rng.choice(list(LANGUAGES)))) for i in range(clean * 5)], {}
    number = 1000
    for written, read, lang in SWAPS:
        made = 0
        while made < bad:
            own = text(lang)
            try:
                garbled_text = read_as(own, written, read)
            except (UnicodeDecodeError, UnicodeEncodeError):
                continue
            docs.append((number, f"{written}-{read}", garbled_text))
            truth[number] = (written, read, own)
            number, made = number + 1, made + 1
    return docs, truth


def test_learned_swaps(spark):
    """Recall per swap, and no clean text among the found."""
    docs, truth = planted_swaps(random.Random(7))
    rows = garbled.restored_documents(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()
    got = {r["doc_id"]: r["text"] for r in rows}
    assert len(got.keys() - truth.keys()) <= 2
    for written, read, _ in SWAPS:
        own = [i for i, t in truth.items() if t[:2] == (written, read)]
        found, right = sum(i in got for i in own), sum(got.get(i) == truth[i][2] for i in own)
        assert right >= 0.5 * len(own), (written, read, right)
        assert found >= 0.75 * len(own), (written, read, found)


def test_long_runs_are_restored_whole(spark):
    rng = random.Random(3)
    docs, truth = [], {}
    for i in range(60):
        own = "".join(rng.choices(LANGUAGES["ja"], k=560))
        truth[i] = own
        docs.append((i, "a", own if i % 6 else own.encode("utf-8").decode("latin-1")))
    assert len(docs[0][2]) == 1680
    rows = garbled.restored_documents(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {i: truth[i] for i in range(0, 60, 6)}


def test_garbled_documents(spark):
    rng = random.Random(2)
    docs, planted_ids = [], {}
    for i in range(400):
        text = " ".join(rng.sample(CLEAN[rng.randint(0, 4)].split(), 1) + rng.choice(CLEAN).split())
        if i % 40 == 7:
            planted_ids[i] = text
            text = text.encode("utf-8").decode("cp1252", "ignore") if i % 80 == 7 else text.encode("utf-8").decode("latin-1")
        docs.append((i, rng.choice(["a", "b", None]), text))
    docs += [(900, "a", None), (901, "a", ""), (902, "b", "plain & café ÄÖÜ &eacute; \\u00e9"), (903, "b", "K�che"), (904, None, "é" * 5000)]
    planted_ids = {i: t for i, t in planted_ids.items() if not t.isascii()}
    t = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("stretch", F.lit("clash"))
    got = {r["doc_id"] for r in garbled.garbled_documents(t).collect()}
    assert got == {*planted_ids, 903}
    restored = {r["doc_id"]: r for r in garbled.restored_documents(t).collect()}
    assert restored[903]["lost"] and sum(restored[i]["text"] == planted_ids[i] for i in planted_ids if i % 80 != 7) >= 0.8 * sum(i % 80 != 7 for i in planted_ids)
    assert garbled.garbled_documents(t.where("false")).count() == 0


def test_llm_queries_run(spark, tiny):
    from prismara.llm import queries

    for name in ("p1_found", "p6_found", "p7_ids", "p8_found"):
        assert queries.QUERIES[name](spark, tiny).count() > 0, name
