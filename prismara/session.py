"""Session helpers: the shared folder, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share.

    It is the cluster's own ``spark.checkpoint.dir``. Only where that is unset and
    the master is local (tests), a temporary folder of this machine stands in.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="prismara-")
    return _fallback[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/prismara-{uuid.uuid4().hex[:12]}-{name}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    return path


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Lineage is cut at a table that survives the loss of any executor. Column order
    changes only with ``partition_by`` (those columns come last).
    """
    spark = df.sparkSession
    path = new_path(spark, name) + "/t"
    writer = df.write.mode("overwrite").option("compression", "zstd")  # packed vectors and token lists shrink far more than with the default
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, name: str, most: int = 100_000) -> tuple[DataFrame, int]:
    """``df``, written, and its number of rows; up to ``most`` rows it is marked to be broadcast, beyond that joins shuffle it."""
    written = materialize(df, name)
    rows = written.count()
    return (F.broadcast(written) if rows <= most else written), rows


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None if there is no file of it; what is there and can't be read is an error."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(pattern):
        return None
    files = fs.listFiles(pattern, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".parquet"):
            return spark.read.parquet(path)
    return None


def tagged(spark: SparkSession, tag: str) -> None:
    """Marks the jobs that this thread starts from now on; ``cancel`` ends them."""
    spark.sparkContext.addJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Ends all running jobs of a tag; the stage that waits for them raises."""
    spark.sparkContext.cancelJobsWithTag(tag)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
