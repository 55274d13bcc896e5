"""Preparation of image-text training, and its schedules, losses and stopping rules."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismara.functions.vectors import dot, l2_normalize
from prismara.operators.metadata import seeded
from prismara.session import read_if_there


def train_val_split(samples: DataFrame, key: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds ``split``: exactly max(1, floor(share x n)) rows are ``val``, drawn by a seeded hash.

    The cut is a value of the hash found by its percentile rank, so no row is sorted
    in one task: rows below the cut are counted and only those of the cut's prefix ranked.
    """
    hashed = samples.withColumn("_h", seeded(F.col(key), seed))
    n = samples.count()
    want = min(n, max(1, math.floor(share * n))) if n else 0
    # Rows by the first four hexadecimal digits of the hash: at most 65,536 counts.
    by = sorted((r["p"], r["count"]) for r in hashed.groupBy(F.substring("_h", 1, 4).alias("p")).count().collect())
    below, cut, left = 0, "", want
    for prefix, count in by:
        if below + count >= want:
            cut, left = prefix, want - below
            break
        below += count
    prefix = F.substring("_h", 1, 4)
    border = hashed.where(prefix == cut).withColumn("_r", F.row_number().over(Window.orderBy("_h", key)))
    inside = border.withColumn("split", F.when(F.col("_r") <= left, "val").otherwise("train")).drop("_r")
    rest = hashed.where(prefix != cut).withColumn("split", F.when(prefix < cut, "val").otherwise("train"))
    return inside.unionByName(rest).drop("_h")


def descriptions(samples: DataFrame) -> DataFrame:
    """The distinct texts, each of which is embedded once."""
    return samples.select("description").where("description IS NOT NULL").distinct()


TEXT_CACHE = "description string, vec array<float>, dataset string"


def read_texts(spark: SparkSession, path: str, dataset: str) -> DataFrame | None:
    """``description, vec`` of the stored text vectors; None if they are of another set of descriptions."""
    stored = read_if_there(spark, path)
    if stored is None:
        return None
    own = stored.where(F.col("dataset") == dataset).select("description", "vec")
    return own if own.limit(1).count() else None


def text_vectors(samples: DataFrame, path: str, embed: Callable[[list[str]], np.ndarray], batch: int = 256) -> DataFrame:
    """``description, vec`` of every distinct description; read from ``path`` if they were stored for the same set, else embedded once each and stored.

    ``embed`` takes at most ``batch`` texts.
    """
    spark = samples.sparkSession
    wanted = descriptions(samples)
    dataset = fingerprint(wanted, "description")
    stored = read_texts(spark, path, dataset)
    if stored is not None:
        return stored

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            texts = part["description"].tolist()
            for start in range(0, len(texts), batch):
                some = texts[start : start + batch]
                yield pd.DataFrame({"description": some, "vec": [v.astype(np.float32) for v in embed(some)], "dataset": dataset})

    wanted.mapInPandas(run, TEXT_CACHE).write.mode("overwrite").parquet(path)
    return spark.read.schema(TEXT_CACHE).parquet(path).select("description", "vec")


def with_text(samples: DataFrame, texts: DataFrame, out: str = "text_vec") -> DataFrame:
    """Each sample with the vector of its description; samples without one go."""
    return samples.join(texts.select("description", F.col("vec").alias(out)), "description")


def training_arrays(pairs: DataFrame, image: str, text: str, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of at most ``most`` pairs on the driver, for ``adapter.train``; more are refused."""
    rows = pairs.where(F.col(image).isNotNull() & F.col(text).isNotNull()).select(image, text).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the driver trains on at most {most} pairs")
    return np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)


def fingerprint(rows: DataFrame, *columns: str) -> str:
    """An MD5 of the set of rows, whatever their order.

    The digests of rows are added up modulo 2^64 in two halves, so that no list of all
    rows is gathered.
    """
    digest = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    halves = [F.conv(F.substring(digest, s, 8), 16, 10).cast("decimal(38,0)") for s in (1, 9, 17, 25)]
    sums = rows.select(*columns).distinct().agg(F.count("*").alias("n"), *[F.sum(h).alias(f"h{i}") for i, h in enumerate(halves)]).select(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("n", "h0", "h1", "h2", "h3")])).alias("f"))
    return sums.first()["f"]


def combined_loss(pred: Column, target: Column) -> Column:
    """``0.7 (1 - cos) + 0.3 MSE of unit vectors + 0.001 mean square of the prediction`` of a row."""
    unit_p, unit_t = l2_normalize(pred), l2_normalize(target)
    n = F.size(pred)
    mse = F.aggregate(F.zip_with(unit_p, unit_t, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / n
    size = F.aggregate(F.transform(pred.cast("array<double>"), lambda x: x * x), F.lit(0.0), lambda s, x: s + x) / n
    return 0.7 * (1 - dot(unit_p, unit_t)) + 0.3 * mse + 0.001 * size


def mean_of_batches(rows: DataFrame, batch: str, *values: str) -> DataFrame:
    """Means of batch means: a short last batch weighs as much as a full one."""
    each = rows.groupBy(batch).agg(*[F.avg(v).alias(v) for v in values])
    return each.agg(*[F.avg(v).alias(v) for v in values])


def with_batch(rows: DataFrame, ord_column: str, size: int) -> DataFrame:
    """Adds ``batch`` of rows numbered from 1 in ``ord_column``."""
    return rows.withColumn("batch", F.floor((F.col(ord_column) - 1) / size))


def total_steps(samples: int, batch: int, accumulate: int, epochs: int) -> int:
    return -(-(-(-samples // batch)) // accumulate) * epochs + 1


def learning_rate(step: int, steps: int, peak: float = 3e-4, warm_up: float = 0.1, start: float = 10.0, end: float = 100.0) -> float:
    """The rate of one step of ``one_cycle``."""
    low, last = peak / start, peak / start / end
    up = warm_up * steps - 1
    if step <= up:
        return peak + (low - peak) / 2 * (1 + math.cos(math.pi * step / up)) if up > 0 else peak
    return last + (peak - last) / 2 * (1 + math.cos(math.pi * (step - up) / max(steps - 1 - up, 1e-12)))


def one_cycle(spark: SparkSession, steps: int, peak: float = 3e-4, warm_up: float = 0.1, start: float = 10.0, end: float = 100.0) -> DataFrame:
    """``step, lr``: cosine rise from peak / start over the warm-up, then cosine fall to the start's 1 / end."""
    low, last = peak / start, peak / start / end
    up = warm_up * steps - 1
    down = steps - 1 - up
    s = F.col("id").cast("double")
    rise = F.lit(peak) + (low - peak) / 2 * (1 + F.cos(F.lit(math.pi) * s / up)) if up > 0 else F.lit(peak)
    fall = F.lit(last) + (peak - last) / 2 * (1 + F.cos(F.lit(math.pi) * (s - up) / max(down, 1e-12)))
    return spark.range(steps).select(F.col("id").alias("step"), F.when(s <= up, rise).otherwise(fall).alias("lr"))


def early_stopping(log: DataFrame, epoch: str, loss: str, patience: int = 5, group: list[str] | None = None) -> DataFrame:
    """Adds ``best``, ``improved``, ``waited`` and ``stopped`` to a log of epochs.

    ``waited`` counts epochs since the last improvement; ``stopped`` is set from the
    epoch on at which it reaches ``patience``. Null losses never improve. A run's log
    is short (its epochs), so a window per group holds it.
    """
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy(epoch)
    before = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = log.withColumn("improved", F.col(loss).isNotNull() & (before.isNull() | (F.col(loss) < before)))
    out = out.withColumn("best", F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    last = F.max(F.when(F.col("improved"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("waited", F.col("_n") - F.coalesce(last, F.lit(0)))
    return out.withColumn("stopped", F.max((F.col("waited") >= patience).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_n")


def ema(values: Column, decay: float = 0.999) -> Column:
    """The moving average after an ordered array of values; it starts at the first."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1), lambda s, x: s * decay + x * (1 - decay))


def label_noise(vectors: DataFrame, key: str, vec: str, scale: float = 0.02, seed: int = 42) -> DataFrame:
    """Vectors with Gaussian noise on every number; the order of numbers is kept."""
    noisy = vectors.select(key, F.posexplode(vec).alias("pos", "x")).withColumn("x", F.col("x") + F.randn(seed) * scale)
    return noisy.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(vec))


def latest_path(paths: DataFrame, column: str = "path") -> str | None:
    """The last path in lexical order."""
    return paths.agg(F.max(column)).first()[0]
