"""The feature store: vectors by model, path and modification time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismara.functions.text import cache_key_parts
from prismara.session import read_if_there

SCHEMA = "model string, path string, mtime double, adapter boolean, vec array<float>"


def parse_cache(cache: DataFrame) -> DataFrame:
    """The columns of the cache key beside the vector."""
    return cache.withColumn("k", cache_key_parts(F.col("ckey"))).select("*", "k.*").drop("k")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored features; an empty table where nothing is stored yet."""
    stored = read_if_there(spark, path)
    return spark.createDataFrame([], SCHEMA) if stored is None else stored


def latest_features(features: DataFrame, model: str) -> DataFrame:
    """One row per path of a model: that of the newest ``mtime``; ties by the smallest ``feat_id`` if there is one."""
    own = features.where((F.col("model") == model) & F.col("path").isNotNull())
    order = [F.coalesce("mtime", F.lit(-1.0))] + ([-F.col("feat_id")] if "feat_id" in own.columns else [])
    rest = [c for c in own.columns if c != "path"]
    return own.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select("path", "r.*")


def misses(listing: DataFrame, features: DataFrame, model: str) -> DataFrame:
    """Listed images whose (path, mtime) has no feature of that model."""
    known = features.where(F.col("model") == model).select("path", "mtime").distinct()
    return listing.join(known, ["path", "mtime"], "left_anti")


def append_new(computed: DataFrame, path: str) -> None:
    """Adds features whose key isn't stored yet."""
    spark = computed.sparkSession
    key = ["model", "path", "mtime", "adapter"]
    stored = read_store(spark, path).select(*[F.col(c).alias(f"_{c}") for c in key])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    condition = same[0] & same[1] & same[2] & same[3]
    computed.join(stored, condition, "left_anti").write.mode("append").partitionBy("model").parquet(path)
