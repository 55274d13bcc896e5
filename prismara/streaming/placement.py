"""Incremental placement: images are planned as they arrive, not at the end of a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prismara.operators.metadata import placement_plan
from prismara.session import read_if_there
from prismara.sources.listing import images_only


def can_stream(visual_features: bool, metadata: bool) -> bool:
    """Rows may be placed at once only if nothing later looks at all of them."""
    return not visual_features and not metadata


def incremental_placement(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, folder: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Plans each micro-batch of listings in ``source`` (Parquet) and appends it to ``out``; ends when all is read.

    ``folder`` adds a ``folder`` column. Names that earlier batches took are looked up
    in ``out``. A batch that runs again after a failure writes the same rows: each has
    its own subfolder, which is overwritten.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        listed = folder(images_only(batch)).withColumn("ord", F.col("path"))
        written = read_if_there(spark, out)
        before = None if written is None else written.where(F.col("batch") < number)
        fresh = listed if before is None else listed.join(before.select("path"), "path", "left_anti")
        plan = placement_plan(fresh.dropDuplicates(["path"]), None if before is None else before.select("target"))
        plan.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
