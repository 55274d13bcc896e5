"""Similar pairs and keep-first removal of near-duplicates.

Pairs come from blocked matrix products: rows of a width are put near one of a few
pivots and packed in blocks of about ``BLOCK``, so that blocks are narrow. Two blocks
meet in one task's product only if the angles between their centres and around them allow
a pair: angle(a, b) >= angle(c, d) - angle(a, c) - angle(b, d), which loses nothing.
Where vectors are not clustered the bound removes little and the product is quadratic in
the rows, as the relation itself may be; the neighbour index of the training operators suits
collections that can't be compared whole.

Defined cases: null and empty vectors have no pair; vectors of different widths have
none with each other; a zero vector is similar to nothing; equal rows are similar; an
empty table has no pair.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismara.session import materialize, sized

BLOCK, PIVOTS = 1000, 64
#: Undecided links are written again after so many rounds; between, they are told by the rows lost so far.
REWRITE = 3
#: Links that one task takes.
FINISH = 200_000


def _unit(v) -> np.ndarray:
    x = np.stack(list(v)).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _blocks(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """``block, width, ids, packed, centre, angle``: rows of a width near one pivot, with the greatest angle from their centre."""
    usable = rows.where(F.col(vec).isNotNull() & (F.size(vec) > 0) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), F.size(vec).alias("width"))
    counts = {r["width"]: r["count"] for r in usable.groupBy("width").count().collect()}  # widths are few
    if not counts:
        return rows.sparkSession.createDataFrame([], "block string, width int, ids array<long>, packed binary, centre binary, angle double")
    # Pivots decide the cost and not the result, so a bounded number of rows does.
    wanted = {w: min(PIVOTS, n // BLOCK) for w, n in counts.items()}
    pivots: dict[int, np.ndarray] = {}
    if any(n > 1 for n in wanted.values()):
        sizes = rows.sparkSession.createDataFrame([(w, n, wanted[w]) for w, n in counts.items()], "width int, rows long, pivots int")
        drawn = usable.join(F.broadcast(sizes), "width").where(F.pmod(F.xxhash64("id"), F.col("rows")) < F.col("pivots")).select("width", "v").collect()
        for w in counts:
            if own := [r["v"] for r in drawn if r["width"] == w]:
                pivots[w] = _unit(own)

    def near(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for w, part in batch.groupby("width", sort=False):
                cell = (_unit(part["v"]) @ pivots[w].T).argmax(1) if w in pivots else 0
                yield part.assign(cell=cell).astype({"cell": "int32"})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = _unit(pdf["v"])
        centre = x.sum(0)
        centre /= max(float(np.linalg.norm(centre)), 1e-12)
        angle = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
        name = "/".join(str(pdf[c].iloc[0]) for c in ("width", "cell", "part"))
        return pd.DataFrame({"block": [name], "width": [int(pdf["width"].iloc[0])], "ids": [pdf["id"].to_numpy()], "packed": [x.tobytes()], "centre": [centre.tobytes()], "angle": [angle]})

    celled = usable.mapInPandas(near, "id long, v array<double>, width int, cell int")
    cells, _ = sized(celled.groupBy("width", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts")), "cells")
    keyed = celled.join(cells, ["width", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    return materialize(keyed.groupBy("width", "cell", "part").applyInPandas(pack, "block string, width int, ids array<long>, packed binary, centre binary, angle double"), "blocks")


Emit = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool], pd.DataFrame]


def products(blocks: DataFrame, emit: Emit, schema: str, threshold: float = -1.0) -> DataFrame:
    """``emit(ids, other ids, rows, other rows, whether they are the same block)`` of every two blocks that may hold a cosine of ``threshold``."""
    slim = blocks.select("block", "width", "centre", "angle")
    reach = float(np.arccos(np.clip(threshold, -1, 1)))

    @F.pandas_udf("boolean")
    def meet(c: pd.Series, d: pd.Series, r: pd.Series, t: pd.Series) -> pd.Series:
        cos = np.array([np.dot(np.frombuffer(x), np.frombuffer(y)) for x, y in zip(c, d)])
        return pd.Series(np.arccos(np.clip(cos, -1, 1)) <= r.to_numpy() + t.to_numpy() + reach + 1e-6)

    other = slim.toDF("other", "width", "centre_2", "angle_2")
    pairs = slim.join(other, "width").where("block <= other")
    if threshold > -1.0:
        pairs = pairs.where(meet("centre", "centre_2", "angle", "angle_2"))
    left = blocks.select("block", F.col("ids").alias("ids_i"), F.col("packed").alias("x_i"))
    right = blocks.select(F.col("block").alias("other"), F.col("ids").alias("ids_j"), F.col("packed").alias("x_j"))

    def product(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, j, ids_i, x_i, ids_j, x_j in zip(*(batch[c] for c in ("block", "other", "ids_i", "x_i", "ids_j", "x_j"))):
                a, b = np.frombuffer(x_i).reshape(len(ids_i), -1), np.frombuffer(x_j).reshape(len(ids_j), -1)
                yield emit(ids_i, ids_j, a, b, i == j)

    joined = pairs.select("block", "other").join(left, "block").join(right, "other").repartition("block", "other")
    return joined.select("block", "other", "ids_i", "x_i", "ids_j", "x_j").mapInPandas(product, schema)


def distances(a: np.ndarray, b: np.ndarray, same: bool) -> np.ndarray:
    """Euclidean distances of all pairs of two blocks, each once."""
    s = a @ b.T
    p, q = np.nonzero(np.triu(np.ones_like(s, bool), 1) if same else np.ones_like(s, bool))
    return np.sqrt(np.maximum((a[p] ** 2).sum(1) + (b[q] ** 2).sum(1) - 2 * s[p, q], 0))


def similar_pairs(rows: DataFrame, key: str, vec: str, threshold: float) -> DataFrame:
    """``a, b, score`` with a < b: cosines of at least ``threshold``."""

    def emit(ids_i, ids_j, a, b, same) -> pd.DataFrame:
        s = a @ b.T
        p, q = np.nonzero(np.triu(s >= threshold, 1) if same else s >= threshold)
        return pd.DataFrame({"a": np.minimum(ids_i[p], ids_j[q]), "b": np.maximum(ids_i[p], ids_j[q]), "score": s[p, q]})

    return products(_blocks(rows, key, vec), emit, "a long, b long, score double", threshold).where("a <> b")


def _finish(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows that a pass in order removes, of all links in one task."""
    parts = list(batches)
    if parts:
        links = pd.concat(parts).sort_values("id")
        removed: set[int] = set()
        for row, before in links.groupby("id", sort=True)["before"]:
            if any(b not in removed for b in before.tolist()):
                removed.add(int(row))
        yield pd.DataFrame({"id": sorted(removed)}, dtype="int64")


def keep_first(rows: DataFrame, key: str, pairs: DataFrame, finish: int = FINISH) -> DataFrame:
    """Rows that a pass in order of ``key`` keeps: those not similar to any row kept before.

    A fixpoint: a row is kept once all similar rows before it are removed, and removed
    once one of them is kept. Every round removes at least one row or ends, and is one
    job over the undecided pairs. At most ``finish`` pairs that are left are
    decided in one task, with the same result and without the rounds.
    """
    undecided = materialize(pairs.select(F.col("a").alias("before"), F.col("b").alias("id")).distinct(), "links")
    removed: list[DataFrame] = []
    left = undecided.count()
    while left > finish:
        for _ in range(REWRITE):
            waiting = undecided.select(F.col("id").alias("before")).distinct()
            lost, _n = sized(undecided.join(waiting, "before", "left_anti").select("id").distinct(), f"lost{len(removed)}")
            removed.append(lost)
            undecided = undecided.join(lost, "id", "left_anti").join(lost.withColumnRenamed("id", "before"), "before", "left_anti").select("before", "id")
        undecided = materialize(undecided, f"undecided{len(removed)}")
        left = undecided.count()
    if left:
        removed.append(materialize(undecided.coalesce(1).mapInPandas(_finish, "id long"), "removed"))
    if not removed:
        return rows
    return rows.join(functools.reduce(DataFrame.unionByName, removed).select(F.col("id").alias(key)), key, "left_anti")


def dedup(rows: DataFrame, key: str, vec: str, threshold: float = 0.88) -> DataFrame:
    """Keep-first removal of near-duplicates in the order of ``key``."""
    return keep_first(rows, key, similar_pairs(rows, key, vec, threshold))
