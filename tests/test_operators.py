"""Collection operators against brute force on small inputs."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismara.operators import classify, dedup, fusion, metadata, naming, training, ward
from prismara.operators.adapter import Adapter, loss_and_gradient, train
from prismara.plans.pipeline import SortPlan, run
from prismara.sources import listing, training_json, vocab
from prismara.sources.settings import Settings, load_settings, save_settings


def vectors(n, d=8, seed=0):
    return np.random.default_rng(seed).standard_normal((n, d))


def frame(spark, x, first=0):
    return spark.createDataFrame([(i + first, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")


def greedy(x, threshold):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    kept = []
    for i in range(len(u)):
        if all(u[i] @ u[j] < threshold for j in kept):
            kept.append(i)
    return kept


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.9])
def test_keep_first(spark, threshold):
    x = vectors(80)
    x[40:44] = x[3]
    got = sorted(r["id"] for r in dedup.dedup(frame(spark, x), "id", "vec", threshold).collect())
    assert got == greedy(x, threshold)
    pairs = dedup.similar_pairs(frame(spark, x), "id", "vec", threshold)
    assert sorted(r["id"] for r in dedup.keep_first(frame(spark, x), "id", pairs, finish=0).collect()) == got


def test_dedup_edges(spark):
    empty = spark.createDataFrame([], "id long, vec array<double>")
    assert dedup.dedup(empty, "id", "vec").count() == 0
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [2.0, 0.0])], "id long, vec array<double>")
    assert sorted(r["id"] for r in dedup.dedup(odd, "id", "vec", 0.9).collect()) == [1, 2, 3, 4]


def naive_ward(x, threshold):
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        best = min((math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0)), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if best[0] >= threshold:
            break
        _, i, j = best
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("threshold", [0.5, 1.0, 1.6, 9.0])
def test_ward_matches_naive(threshold):
    x = vectors(40, 4, 3)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = ward.ward_labels(x, threshold)
    assert {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label)} == naive_ward(x, threshold)


def test_ward_bounds(spark):
    one = frame(spark, vectors(1))
    assert [tuple(r) for r in ward.ward_clusters(one, "id", "vec").collect()] == [(0, 0)]
    assert ward.ward_clusters(spark.createDataFrame([], "id long, vec array<double>"), "id", "vec").count() == 0
    # Beyond the bound rows are taken together first; groups that are apart stay apart.
    x = np.concatenate([c + 0.01 * vectors(40, 8, k) for k, c in enumerate(5 * np.eye(8)[:3])])
    got = ward.ward_clusters(frame(spark, x), "id", "vec", sensitivity=50.0, most=30).collect()
    labels = {r["id"]: r["cluster_id"] for r in got}
    assert sorted(labels) == list(range(120)) and {len({labels[i] for i in range(a, a + 40)}) for a in (0, 40, 80)} == {1} and set(labels.values()) == {0, 1, 2}


def test_blocks_and_exact_percentiles(spark, monkeypatch):
    """Several narrow blocks and several passes of the histogram give what one would."""
    monkeypatch.setattr(dedup, "BLOCK", 20)
    monkeypatch.setattr(ward, "BINS", 8)
    monkeypatch.setattr(ward, "FEW", 5)
    x = np.concatenate([c + 0.2 * vectors(40, 8, k) for k, c in enumerate(np.eye(8)[:3])])
    x[3] = x[90]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    wide = spark.createDataFrame([(500, [1.0] * 9), (501, [1.0] * 9)], "id long, vec array<double>")
    got = {(r["a"], r["b"]) for r in dedup.similar_pairs(frame(spark, x).unionByName(wide), "id", "vec", 0.9).collect()}
    assert got == {(int(i), int(j)) for i, j in np.argwhere(np.triu(u @ u.T >= 0.9, 1))} | {(500, 501)}
    d = np.linalg.norm(u[:, None] - u[None, :], axis=2)[np.triu_indices(120, 1)]
    for q in (0, 35, 50, 100):
        assert ward.distance_percentile(frame(spark, x), "id", "vec", q).first()["threshold"] == pytest.approx(np.percentile(d, q), abs=1e-7)
    row = ward.distance_stats(frame(spark, x), "id", "vec").first()
    assert (row["n"], row["min"], row["mean"], row["median"]) == pytest.approx((len(d), d.min(), d.mean(), np.median(d)), abs=1e-7)


def test_products(spark):
    from prismara.functions.vectors import products

    t = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [])], "id long, v array<double>")
    got = {r["id"]: r["p"] for r in t.select("id", products(F.col("v"), [[3.0, 4.0], [1.0]], cosines=True).alias("p")).collect()}
    assert got[1] == [pytest.approx(11 / 5 / math.sqrt(5)), None] and got[2] is None and got[3] == [None, 1.0] and got[4][0] == 0.0 and got[5] == [None, None]


def test_rank_in_hot_groups(spark):
    from prismara.plans.adjacent import with_rank

    rows = [("hot" if i % 3 else None, i * 7 % 101) for i in range(101)]
    got = with_rank(spark.createDataFrame(rows, "g string, o long").repartition(5), ["g"], ["o"]).collect()
    for g in ("hot", None):
        own = sorted((r["o"], r["rank"]) for r in got if r["g"] == g)
        assert [k for _, k in own] == list(range(1, len(own) + 1))
    assert len(got) == 101


def test_free_numbers_of_a_hot_name(spark):
    names = ["IMG.png"] * 6 + ["IMG_2.png", "IMG_3.png", "IMG_07.png"]
    rows = spark.createDataFrame([(f"/d{i}/{n}", "f", i) for i, n in enumerate(names)], "path string, folder string, ord long")
    plan = {r["path"]: r["target"] for r in metadata.placement_plan(rows, spark.createDataFrame([("f/IMG_5.png",)], "target string")).collect()}
    assert [plan[f"/d{i}/IMG.png"] for i in range(6)] == ["f/IMG.png", "f/IMG_1.png", "f/IMG_4.png", "f/IMG_6.png", "f/IMG_7.png", "f/IMG_8.png"]
    assert len(set(plan.values())) == len(names)


def test_text_cache(spark, tmp_path):
    path, calls = str(tmp_path / "texts"), str(tmp_path / "calls")

    def embed(texts):
        with open(calls, "a") as f:
            f.write(f"{len(texts)}\n")
        return [np.full(2, len(t)) for t in texts]

    samples = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None)], "id long, description string")
    for _ in range(2):  # the second time nothing is embedded
        joined = training.with_text(samples, training.text_vectors(samples, path, embed, 1))
        assert {(r["id"], r["text_vec"][0]) for r in joined.collect()} == {(1, 2.0), (2, 1.0), (3, 2.0)}
        assert open(calls).read().split() == ["1", "1"]
    x, y = training.training_arrays(joined, "text_vec", "text_vec")
    assert x.shape == (3, 2) and (x == y).all()
    more = samples.unionByName(spark.createDataFrame([(5, "ccc")], samples.schema))
    assert training.text_vectors(more, path, embed).count() == 3


def test_training_resumes(tmp_path):
    x, y = vectors(40, 6, 1), vectors(40, 4, 2)
    whole = train(x, y, x, y, str(tmp_path / "a"), epochs=4, batch=8)
    train(x, y, x, y, str(tmp_path / "b"), epochs=4, batch=8, patience=99)
    part = tmp_path / "c"
    first = train(x[:], y, x, y, str(part), epochs=4, batch=8, best_copy=str(tmp_path / "best.npz"))
    assert [e["val_loss"] for e in first] == [e["val_loss"] for e in whole] and (tmp_path / "best.npz").exists()
    # Stop after two epochs, then go on: the same log.
    import prismara.operators.adapter as module

    real, seen = module._validated, []

    def stop(*a):
        seen.append(1)
        if len(seen) == 3:
            raise KeyboardInterrupt
        return real(*a)

    module._validated = stop
    try:
        with pytest.raises(KeyboardInterrupt):
            train(x, y, x, y, str(tmp_path / "d"), epochs=4, batch=8)
    finally:
        module._validated = real
    again = train(x, y, x, y, str(tmp_path / "d"), epochs=4, batch=8, resume=True)
    assert [(e["epoch"], e["val_loss"], e["lr"]) for e in again] == [(e["epoch"], e["val_loss"], e["lr"]) for e in whole] and "val_cos_sim" in again[0]


def test_image_inputs():
    from prismara.functions import images

    flat = np.full((30, 50, 3), 128, np.uint8)
    flat[..., 0] = 255
    made = images.tagger_input(flat)
    assert made.shape == (1, 448, 448, 3) and np.allclose(made[..., 2], 1) and np.allclose(made[..., 0], 128 / 255, atol=1e-6)
    assert images.thumbnail(np.zeros((1000, 400, 3), np.uint8)).shape == (512, 205, 3) and images.thumbnail(flat) is flat
    ramp = np.repeat(np.arange(64.0)[None, :, None], 64, 0).repeat(3, 2)
    assert np.allclose(images.resized(ramp, 32, 32)[5, 4:28, 0], (np.arange(32) * 2 + 0.5)[4:28])
    assert images.validation_input(None).sum() == 0 and images.training_input(flat, np.random.default_rng(1)).shape == (3, 224, 224)
    assert images.decoded({"height": 1, "width": 1, "nChannels": 3, "data": bytes([1, 2, 3])}).tolist() == [[[3, 2, 1]]] and images.decoded(None) is None


def test_model_hooks(spark):
    t = spark.createDataFrame([(1, "a"), (2, "bb")], "image_id long, path string")
    got = {r["image_id"]: r["vec"] for r in fusion.map_vectors(t, lambda: 2, lambda m, b: [[m * len(p)] if len(p) > 1 else None for p in b["path"]], ["image_id", "path"]).collect()}
    assert got == {1: None, 2: [4.0]}
    tags = fusion.map_tags(t, lambda: 0, lambda m, b: [[(p, 1, 0, 0.5)] * len(p) for p in b["path"]], ["image_id", "path"])
    assert tags.count() == 3

    def classify_one(model, batch):
        if len(batch) > 1:
            raise MemoryError
        return [[0.0, 1.0]]

    labels = fusion.map_logits(t.coalesce(1), lambda: 0, classify_one, ["hum", "ai"], ["image_id"])
    assert {(r["image_id"], r["label"]) for r in labels.collect()} == {(1, "ai"), (2, "ai")}


def test_search_copies(spark, tmp_path):
    from prismara.operators.search import copy_results

    (tmp_path / "a.png").write_bytes(b"1")
    found = spark.createDataFrame([(str(tmp_path / "a.png"), "r/001_0.90.png"), (str(tmp_path / "gone.png"), "r/002_0.80.png")], "path string, target string")
    assert copy_results(found, str(tmp_path / "out")) == 1 and (tmp_path / "out/r/001_0.90.png").exists()


def test_zero_shot(spark):
    images = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id long, vec array<double>")
    pos, neg = [("a!b", 1.0, [1.0, 0.0]), ("c", 1.0, [0.9, 0.1])], [("bad", 1.0, [0.0, 1.0])]
    got = {r["id"]: r for r in classify.zero_shot(images, "vec", pos, neg, [0.5, 0.5], 0.1).collect()}
    assert got[1]["passed"] and got[1]["label"] == "ab_c" and got[1]["margin"] == pytest.approx(0.5)
    assert not got[2]["passed"] and got[2]["label"] == ""
    assert not got[3]["passed"]
    only = {r["id"]: r for r in classify.zero_shot(images, "vec", [], neg, [0.5, 0.5]).collect()}
    assert only[1]["passed"] and only[1]["label"] == "" and not only[2]["passed"] and only[2]["label"] == "-bad" and not only[3]["passed"]


def scores(spark, rows):
    return spark.createDataFrame(rows, "image_id long, tag string, tag_idx int, category int, score double")


def test_cluster_names(spark):
    members = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 3, 3), (2, 4, 4), (3, 5, 5)], "cluster_id int, image_id long, ord long")
    s = scores(spark, [(1, "red_hat", 1, 0, 0.9), (2, "red_hat", 1, 0, 0.7), (1, "miku_(x)", 9, 4, 0.2), (3, "blue_sky", 2, 0, 0.8), (4, "blue_sky", 2, 0, 0.8), (4, "explicit", 3, 9, 0.9), (4, "manga", 5, 0, 0.9)])
    got = {r["cluster_id"]: r["name"] for r in naming.cluster_names(members, s).collect()}
    assert got == {0: "Miku X Red Hat", 1: "Blue Sky_1", 2: "Blue Sky_2", 3: "group_004"}
    tf = {(r["cluster_id"], r["tag"]): r["tfidf"] for r in naming.cluster_tfidf(members, s).collect()}
    assert tf[0, "red_hat"] == pytest.approx(0.8 * math.log(1 + 4 / 1)) and tf[1, "blue_sky"] == pytest.approx(0.8 * math.log(1 + 4 / 2))


def test_refine_splits_loose_clusters(spark):
    members = spark.createDataFrame([(0, i, i) for i in range(6)] + [(1, 10, 10), (1, 11, 11)], "cluster_id int, image_id long, ord long")
    s = scores(spark, [(i, t, k, 0, 0.5) for i in range(6) for k, t in enumerate(("a", "b") if i < 3 else (f"u{i}", f"v{i}"))])
    got = {(r["cluster_id"], r["image_id"]): r["part"] for r in naming.refine(members, s).collect()}
    assert len(got) == 8 and len({got[0, i] for i in range(6)}) > 1 and got[1, 10] == got[1, 11]


def test_placement_avoids_clashes(spark):
    rows = [("/x/a.png", "f", 1), ("/y/a.png", "f", 2), ("/z/a_1.png", "f", 3), ("/w/a.png", "f", 4), ("/v/a.png", None, 5), ("/u/b", "f", 6), ("/t/b", "f", 7)]
    plan = metadata.placement_plan(spark.createDataFrame(rows, "path string, folder string, ord long"))
    got = {r["path"]: r["target"] for r in plan.collect()}
    assert got == {"/x/a.png": "f/a.png", "/y/a.png": "f/a_2.png", "/z/a_1.png": "f/a_1.png", "/w/a.png": "f/a_3.png", "/v/a.png": "a.png", "/u/b": "f/b", "/t/b": "f/b_1"}
    busy = spark.createDataFrame([("f/a.png",)], "target string")
    again = {r["path"]: r["target"] for r in metadata.placement_plan(spark.createDataFrame(rows[:1], "path string, folder string, ord long"), busy).collect()}
    assert again == {"/x/a.png": "f/a_1.png"}


def test_metadata(spark):
    assigned = spark.createDataFrame([(1, "f", "/a/x.png"), (2, "f", "/b/x.png"), (3, "", "/c/y.png")], "image_id long, folder string, path string")
    s = scores(spark, [(1, "glasses", 1, 0, 0.9), (1, "hero", 2, 4, 0.8), (1, "hat", 3, 0, 0.05), (1, "explicit", 4, 9, 0.1234)])
    rows = {r["name"]: r for r in metadata.image_rows(assigned, s).collect()}
    assert rows["/a/x.png"]["mature_tags"] == ["glasses"] and rows["/a/x.png"]["character_tags"] == ["hero"] and rows["/a/x.png"]["rating"]["explicit"] == 0.123
    assert rows["y.png"]["error"] == "no tags found" and rows["y.png"]["folder"] == "root"
    docs = {r["folder"]: r for r in metadata.folder_metadata(assigned, s).collect()}
    assert docs["f"]["total_images"] == 2 and docs["f"]["has_mature"] and not docs["root"]["has_mature"]


def test_write_metadata(spark, tmp_path):
    assigned = spark.createDataFrame([(1, "f", "/a/x.png")], "image_id long, folder string, path string")
    metadata.write_metadata(metadata.folder_metadata(assigned, scores(spark, [(1, "hat", 1, 0, 0.5)])), str(tmp_path / "m"))
    text = "".join(p.read_text() for p in (tmp_path / "m" / "to_folder=f").glob("*.txt"))
    assert json.loads(text)["images"]["x.png"]["all_scores"] == {"hat": 0.5}


def test_training_layouts(spark):
    listed = spark.createDataFrame([(p,) for p in ("/d/a.png", "/d/b.jpg", "/e/c.png", "/f/r.png", "/g/x.webp", "/h/k.png")], "path string")
    files = [
        ("/d/metadata.json", {"folder": "d", "total_images": 2, "images": {"a.png": {"general_tags": ["g"], "character_tags": ["c"]}, "gone.png": {"general_tags": ["g"]}, "b.jpg": {"all_scores": {"x": 0.5, "y": 0.05}}, "n": None}}),
        ("/e/metadata.json", {"sample_files": ["c.png"], "description": "one"}),
        ("/h/list.json", {"k.png": {"caption": "keyed"}, "q.png": {"caption": "lost"}}),
        ("/f/l.json", [{"image_path": "r.png", "text": "rel"}, {"image_path": "r.png", "text": ""}, 5]),
        ("/g/x.json", {"label": "beside"}),
        ("/g/bad.json", None),
    ]
    rows = spark.createDataFrame([(p, None if v is None else json.dumps(v)) for p, v in files] + [("/g/cut.json", '{"a": ')], "path string, body string")
    got = {(r["layout"], r["image_path"], r["description"]) for r in training_json.training_pairs(rows, listed).collect()}
    assert got == {("tagger", "/d/a.png", "c, g"), ("tagger", "/d/b.jpg", "x"), ("folder", "/e/c.png", "one"), ("keyed", "/h/k.png", "keyed"), ("list", "/f/r.png", "rel"), ("single", "/g/x.webp", "beside")}


def test_split_is_exact(spark):
    rows = spark.range(101)
    got = training.train_val_split(rows, "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"val": 15, "train": 86}
    assert training.train_val_split(spark.range(0), "id").count() == 0
    a = {r["id"] for r in training.train_val_split(rows.repartition(7), "id").where("split = 'val'").collect()}
    assert a == {r["id"] for r in training.train_val_split(rows, "id").where("split = 'val'").collect()}


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    b = spark.createDataFrame([(2, None), (1, "x"), (1, "x")], "a int, b string")
    assert training.fingerprint(a, "a", "b") == training.fingerprint(b, "a", "b") != training.fingerprint(a.where("a = 1"), "a", "b")


def test_schedule_and_stopping(spark):
    lr = [r["lr"] for r in training.one_cycle(spark, 100).orderBy("step").collect()]
    assert lr[0] == pytest.approx(3e-5) and max(lr) == pytest.approx(3e-4) and lr[-1] == pytest.approx(3e-7)
    log = spark.createDataFrame(list(enumerate([3.0, 2.0, 2.0, None, 5.0, 1.0])), "epoch int, loss double")
    got = [tuple(r) for r in training.early_stopping(log, "epoch", "loss", 3).orderBy("epoch").select("improved", "waited", "stopped").collect()]
    assert got == [(True, 0, False), (True, 0, False), (False, 1, False), (False, 2, False), (False, 3, True), (True, 0, True)]
    assert spark.range(1).select(training.ema(F.array(F.lit(1.0), F.lit(2.0)), 0.9)).first()[0] == pytest.approx(1.1)


def test_adapter(spark, tmp_path):
    layers = fusion.random_adapter((8, 6, 4))
    fusion.save_adapter(layers, str(tmp_path / "w.npz"))
    assert fusion.load_adapter(str(tmp_path / "w.npz"), 9) is None
    x = vectors(5)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9, None), (10, [1.0])], "id long, vec array<double>")
    got = {r["id"]: r["adapted"] for r in fusion.adapt(rows, "vec", fusion.load_adapter(str(tmp_path / "w.npz"), 8)).collect()}
    assert np.allclose([got[i] for i in range(5)], fusion.forward(layers, x)) and got[9] is None and got[10] is None


def test_adapter_gradient_and_training(tmp_path):
    p, t = vectors(3, 5, 1), vectors(3, 5, 2)
    _, g = loss_and_gradient(p, t)
    q = p.copy()
    q[1, 2] += 1e-6
    assert (loss_and_gradient(q, t)[0] - loss_and_gradient(p, t)[0]) / 1e-6 == pytest.approx(g[1, 2], rel=1e-3)
    x, y = vectors(64, 6, 3), vectors(64, 4, 4)
    log = train(x, y, x[:8], y[:8], str(tmp_path), epochs=3)
    assert log[-1]["train_loss"] < log[0]["train_loss"] and (tmp_path / "best_adapter.npz").exists() and Adapter((6, 4)).parameters() == 28


def test_sort_plan_has_one_status_each(spark):
    x = vectors(30, 6, 5)
    x[7] = x[2]
    rows = frame(spark, x).select(F.col("id").alias("image_id"), F.col("vec"), F.lit("ai").alias("label1"), F.when(F.col("id") % 2 == 0, "artificial").otherwise("real").alias("label2"))
    rows = rows.unionByName(spark.createDataFrame([(99, None, "ai", "real")], rows.schema))
    out = run(SortPlan(vote=True, dedup_threshold=0.99, sensitivity=30.0), rows).collect()
    assert sorted(r["image_id"] for r in out) == [*range(30), 99]
    status = {r["image_id"]: r["status"] for r in out}
    assert status[99] == "failed" and status[7] == "duplicates" and status[2] == "saved"
    assert {r["folder"].split("/")[0] for r in out if r["status"] == "saved"} == {"ai", "hum"}
    with pytest.raises(ValueError, match="criterion"):
        SortPlan()


def test_listing_order_and_sources(spark, tmp_path):
    rows = [("/b.png", 2.0, 1, 1), ("/a.JPG", None, None, 2), ("/b.png", 5.0, 2, 3), (None, 1.0, 1, 4), ("/c.txt", 1.0, 1, 5)]
    t = spark.createDataFrame(rows, "path string, mtime double, length long, image_id long").withColumn("listed_at", F.current_timestamp())
    latest = listing.images_only(listing.latest_listing(t))
    assert {(r["path"], r["image_id"]) for r in latest.collect()} == {("/a.JPG", 2), ("/b.png", 3)}
    big = spark.range(500).select(F.concat(F.lit("/p"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("path"), "id")
    assert all(r["ord"] == r["id"] + 1 for r in listing.with_order(big.repartition(5)).collect())
    for name in ("x.png", "y.PNG", "z.txt"):
        (tmp_path / name).write_bytes(b"1")
    assert listing.scan_images(spark, str(tmp_path)).count() == 2
    snap = str(tmp_path / "snap")
    live = listing.scan_images(spark, str(tmp_path))
    listing.write_snapshot(live, snap, "k")
    assert listing.read_snapshot(spark, snap, "k", live).count() == 2 and listing.read_snapshot(spark, snap, "other", live) is None
    assert listing.read_snapshot(spark, str(tmp_path / "none"), "k", live) is None
    (tmp_path / "v.csv").write_text("name,category\na,0\nb,4\n")
    assert [tuple(r) for r in vocab.read_vocab(spark, str(tmp_path / "v.csv")).orderBy("tag_idx").collect()] == [(0, "a", 0), (1, "b", 4)]


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    assert load_settings(path) == Settings()
    s = Settings(dedup=True)
    for i in range(25):
        s.remember(str(i))
    save_settings(s, path)
    assert load_settings(path) == s and s.group_desc_history[0] == "24" and len(s.group_desc_history) == 20
    assert Settings().models() == {"vote", "second_vote"} and "tagger" in Settings(visual_clusters=True).models()
    with pytest.raises(ValueError, match="percentile"):
        Settings(sensitivity=101)


def test_streaming_placement(spark, tmp_path):
    from prismara.streaming.placement import can_stream, incremental_placement

    assert can_stream(False, False) and not can_stream(True, False)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "path string, mtime double, length long"
    for i, part in enumerate(([("/a/x.png", 1.0, 1), ("/a/n.txt", 1.0, 1)], [("/b/x.png", 1.0, 1)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        incremental_placement(spark, src, schema, out, str(tmp_path / "ck"), lambda d: d.withColumn("folder", F.lit("f"))).awaitTermination()
        assert spark.read.parquet(out).count() == i + 1
    assert {r["target"] for r in spark.read.parquet(out).collect()} == {"f/x.png", "f/x_1.png"}


def test_seed_changes_sample(spark):
    rows = spark.range(200).select(F.lit("f").alias("folder"), F.col("id").cast("string").alias("path"))
    a = {r["path"] for r in metadata.folder_sample(rows, 10, 1).collect()}
    assert len(a) == 10 and a != {r["path"] for r in metadata.folder_sample(rows, 10, 2).collect()} and metadata.folder_sample(rows, 0).count() == 200
