"""Image listings: directory scans, snapshots of scans, decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismara.functions.text import is_image
from prismara.schema import IMAGE_EXTENSIONS
from prismara.session import materialize, read_if_there

LISTING = "path string, mtime double, length long"


def images_only(listing: DataFrame) -> DataFrame:
    """Rows whose path has an image extension, in any case. Null paths go."""
    return listing.where(is_image(F.col("path"), IMAGE_EXTENSIONS))


def scan_images(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """``path, mtime, length`` of the images below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    listed = files.select("path", F.unix_micros("modificationTime").cast("double").alias("m"), "length")
    return images_only(listed.select("path", (F.col("m") / 1e6).alias("mtime"), "length"))


def decode_images(spark: SparkSession, folder: str) -> DataFrame:
    """``path, image``: decoded images; null where a file can't be decoded."""
    raw = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(folder)
    return raw.select("image.origin", F.when(F.col("image.height") > 0, F.col("image")).alias("image")).withColumnRenamed("origin", "path")


def latest_listing(listings: DataFrame) -> DataFrame:
    """One row per path: the newest ``mtime``, then the latest ``listed_at``. Null times are oldest."""
    newest = F.struct(F.coalesce("mtime", F.lit(-1.0)), F.coalesce("listed_at", F.lit("0001-01-01").cast("timestamp")), F.coalesce("length", F.lit(-1)))
    rest = [c for c in listings.columns if c != "path"]
    return listings.where("path IS NOT NULL").groupBy("path").agg(F.max_by(F.struct(*rest), newest).alias("r")).select("path", "r.*")


def with_order(listing: DataFrame) -> DataFrame:
    """Adds ``ord``: the row's place by path, which stands for scan order.

    Places come from a range sort and the sizes of its partitions, not from one task.
    """
    sorted_ = listing.repartitionByRange("path").sortWithinPartitions("path")
    parts = materialize(sorted_.withColumn("_p", F.spark_partition_id()), "ordered")
    sizes = parts.groupBy("_p").count()
    # One row per partition of the sort.
    before = sizes.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_b"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy("path"))
    return parts.withColumn("_r", local).join(F.broadcast(before), "_p").withColumn("ord", F.col("_b") + F.col("_r")).drop("_p", "_r", "_b")


def scan_key(source: str, recursive: bool, mtime: float) -> str:
    return f"{source}|{recursive}|{mtime}"


def write_snapshot(listing: DataFrame, path: str, key: str) -> None:
    """Stores a scan under its key."""
    listing.withColumn("scan_key", F.lit(key)).write.mode("overwrite").parquet(path)


def read_snapshot(spark: SparkSession, path: str, key: str, live: DataFrame) -> DataFrame | None:
    """The stored scan without files that vanished; None if there is none of that key."""
    stored = read_if_there(spark, path)
    if stored is None:
        return None
    stored = stored.where(F.col("scan_key") == key)
    return stored.drop("scan_key").join(live.select("path"), "path", "left_semi") if stored.limit(1).count() else None
