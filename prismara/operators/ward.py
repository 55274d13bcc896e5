"""Agglomerative clustering by Ward's method, cut at a percentile of the distances.

Distance statistics are taken in the tasks that compute the distances, and no distance
leaves them: a histogram finds the bin of the wanted ranks, and further passes divide that
bin until its different values are few. Ward's linkage needs all distances at once, so
it runs in one task on at most ``MOST`` points (8 x MOST^2 bytes). More rows are first
taken together around MOST of them, drawn by hash; the linkage then merges those groups
by their means and sizes, and the percentile is that of the rows drawn. Up to MOST rows
the result is the exact one.

The threshold is the percentile itself: a low sensitivity gives many small clusters.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismara.operators.dedup import _blocks, _unit, distances, products

MOST = 5000
BINS, FEW = 4096, 50_000


def _histogram(blocks: DataFrame, low: float, high: float) -> pd.DataFrame:
    """``bin, n, s, least, most`` of the distances from ``low`` to ``high`` in BINS equal bins; of each bin its count, sum and ends."""
    width = (high - low) / BINS

    def emit(ids_i, ids_j, a, b, same) -> pd.DataFrame:
        d = distances(a, b, same)
        d = d[(d >= low) & (d <= high)]
        at = np.clip(((d - low) / width).astype(int), 0, BINS - 1) if width > 0 else np.zeros(len(d), int)
        return pd.DataFrame({"bin": at, "d": d}).groupby("bin")["d"].agg(n="count", s="sum", least="min", most="max").reset_index()

    out = products(blocks, emit, "bin int, n long, s double, least double, most double")
    return out.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("bin").toPandas()  # at most BINS rows


def _values(blocks: DataFrame, low: float, high: float) -> pd.DataFrame:
    """``d, n``: the different distances from ``low`` to ``high``."""

    def emit(ids_i, ids_j, a, b, same) -> pd.DataFrame:
        d, n = np.unique(distances(a, b, same), return_counts=True)
        inside = (d >= low) & (d <= high)
        return pd.DataFrame({"d": d[inside], "n": n[inside]})

    return products(blocks, emit, "d double, n long").groupBy("d").agg(F.sum("n").alias("n")).orderBy("d").toPandas()


def _at_rank(blocks: DataFrame, rank: int, held: pd.DataFrame) -> float:
    """The distance of ``rank`` (from 0), exactly; ``held`` is a histogram of all."""
    before = 0
    while True:
        upto = before + held["n"].cumsum()
        row = held.iloc[int((upto > rank).to_numpy().argmax())]
        before = int(upto[row.name] - row["n"])
        low, high = float(row["least"]), float(row["most"])
        if low == high:
            return low
        if row["n"] <= FEW:
            values = _values(blocks, low, high)
            return float(values["d"].iloc[int((before + values["n"].cumsum() > rank).to_numpy().argmax())])
        held = _histogram(blocks, low, high)


def _quantile(blocks: DataFrame, held: pd.DataFrame, q: float) -> float | None:
    """The linearly interpolated quantile."""
    n = int(held["n"].sum())
    if not n:
        return None
    place = q * (n - 1)
    low = _at_rank(blocks, math.floor(place), held)
    return low if place == math.floor(place) else low + (place - math.floor(place)) * (_at_rank(blocks, math.floor(place) + 1, held) - low)


def distance_stats(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """``n, min, mean, median`` of the pairwise distances of unit vectors, in one row."""
    blocks = _blocks(rows, key, vec)
    held = _histogram(blocks, 0.0, 2.1)
    n = int(held["n"].sum())
    row = (n, float(held["least"].min()), float(held["s"].sum() / n), _quantile(blocks, held, 0.5)) if n else (0, None, None, None)
    return rows.sparkSession.createDataFrame([row], "n long, min double, mean double, median double")


def distance_percentile(rows: DataFrame, key: str, vec: str, sensitivity: float) -> DataFrame:
    """``threshold``: the linearly interpolated percentile of the pairwise distances."""
    blocks = _blocks(rows, key, vec)
    return rows.sparkSession.createDataFrame([(_quantile(blocks, _histogram(blocks, 0.0, 2.1), sensitivity / 100),)], "threshold double")


def ward_labels(x: np.ndarray, threshold: float, weight: np.ndarray | None = None) -> np.ndarray:
    """Labels after all merges of a height below ``threshold``.

    Nearest-neighbour chains with the update of Lance and Williams on squared distances.
    ``weight`` says how many rows each point stands for.
    """
    n = len(x)
    sq = (x * x).sum(1)
    d = np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0)
    if weight is not None:
        d *= 2 * weight[:, None] * weight[None, :] / (weight[:, None] + weight[None, :])
    np.fill_diagonal(d, np.inf)
    size, alive, merges, chain = np.ones(n) if weight is None else weight.astype(float), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            b = int(d[a].argmin())
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        merges.append((float(np.sqrt(d[a, b])), a, b))
        others = alive.copy()
        others[[a, b]] = False
        na, nb, nk = size[a], size[b], size[others]
        new = ((na + nk) * d[a, others] + (nb + nk) * d[b, others] - nk * d[a, b]) / (na + nb + nk)
        d[a, others] = d[others, a] = new
        d[b, :] = d[:, b] = np.inf
        alive[b], size[a] = False, na + nb
    label = np.arange(n)
    for height, a, b in merges:
        if height < threshold:
            label[label == label[b]] = label[a]
    return np.unique(label, return_inverse=True)[1]


def ward_clusters(rows: DataFrame, key: str, vec: str, sensitivity: float = 50.0, most: int = MOST) -> DataFrame:
    """``key, cluster_id`` (from 0, by the smallest key of each cluster). No row gives none, one row one cluster."""
    if not 0 <= sensitivity <= 100:
        raise ValueError("sensitivity is a percentile, 0 to 100")
    keyed = rows.where(F.col(vec).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vec).cast("array<double>").alias("v"))
    counted = keyed.count()
    if counted > most:
        return _grouped(keyed, key, sensitivity, counted, most)
    found = distance_percentile(keyed, "k", "v", sensitivity).first()
    threshold = found["threshold"] if found["threshold"] is not None else 0.0

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        label = ward_labels(_unit(pdf["v"]), threshold)
        first = pd.Series(pdf["k"].to_numpy()).groupby(label).transform("min")
        return pd.DataFrame({key: pdf["k"].to_numpy(), "cluster_id": first.rank(method="dense").astype(int).to_numpy() - 1})

    return keyed.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(cluster, f"`{key}` long, cluster_id int")


def _grouped(keyed: DataFrame, key: str, sensitivity: float, counted: int, most: int) -> DataFrame:
    """Clusters of more rows than the linkage takes."""
    drawn = keyed.where(F.pmod(F.xxhash64("k"), F.lit(counted)) < most).orderBy(F.pmod(F.xxhash64("k"), F.lit(counted)), "k").limit(most)
    points = drawn.collect()  # at most `most` rows
    found = distance_percentile(keyed.sparkSession.createDataFrame(points, drawn.schema), "k", "v", sensitivity).first()
    threshold = found["threshold"] if found["threshold"] is not None else 0.0
    shared = keyed.sparkSession.sparkContext.broadcast(_unit([r["v"] for r in points]))

    def near(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _unit(batch["v"])
            yield pd.DataFrame({"k": batch["k"], "point": (x @ shared.value.T).argmax(1).astype(np.int32)})

    def sums(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, tuple[int, np.ndarray, int]] = {}
        for batch in batches:
            x = _unit(batch["v"])
            for p, at in _by_point(x, shared.value):
                n, s, k = total.get(p, (0, 0.0, None))
                least = int(batch["k"].to_numpy()[at].min())
                total[p] = (n + len(at), s + x[at].sum(0), least if k is None else min(k, least))
        yield pd.DataFrame([(p, n, s.tobytes(), k) for p, (n, s, k) in total.items()], columns=["point", "n", "s", "k"])

    groups: dict[int, list] = {}
    for r in keyed.mapInPandas(sums, "point int, n long, s binary, k long").toLocalIterator():  # per task at most `most` rows
        n, s, k = groups.get(r["point"], (0, 0.0, r["k"]))
        groups[r["point"]] = [n + r["n"], s + np.frombuffer(r["s"]), min(k, r["k"])]
    names = sorted(groups)
    weight = np.array([groups[p][0] for p in names], float)
    label = ward_labels(np.stack([groups[p][1] for p in names]) / weight[:, None], threshold, weight)
    first = pd.Series([groups[p][2] for p in names]).groupby(label).transform("min")
    number = dict(zip(names, (first.rank(method="dense").astype(int) - 1).tolist()))
    table = keyed.sparkSession.createDataFrame(list(number.items()), "point int, cluster_id int")
    return keyed.mapInPandas(near, "k long, point int").join(F.broadcast(table), "point").select(F.col("k").alias(key), "cluster_id")


def _by_point(x: np.ndarray, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of each point the rows that are nearest to it."""
    at = (x @ points.T).argmax(1)
    order = np.argsort(at, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else ():
        yield int(at[part[0]]), part
