"""Previous row and rank within a group, without gathering a hot group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismara.session import materialize


def with_previous(df: DataFrame, group: list[str], order: list[str], payload: list[str], name: str = "adjacent") -> DataFrame:
    """Add ``prev STRUCT<payload>``: the payload of the row before, by ``order``, in ``group``.

    Rows are range-partitioned by (group, order), so a group that holds a third of
    all rows spans many tasks. Inside each task the predecessor comes from ``lag``;
    the first row of a group in a task takes the last row of that group from the
    task before it, an equi-join of at most one row per task and group.
    Null groups form one group; nulls in ``order`` come first. Ties in ``order``
    keep an arbitrary but single order. An empty table gives an empty table.
    """
    for taken in ("_pid", "_rn", "_last", "prev", "_prev"):
        if taken in df.columns:
            raise ValueError(f"column {taken} is reserved")
    asc: list[Column] = [F.col(c).asc_nulls_first() for c in order]
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in group], *asc)
    # The partition number must be frozen before it is used as a key.
    frozen = materialize(ranged.withColumn("_pid", F.spark_partition_id()), name)
    local = Window.partitionBy("_pid", *group)
    ordered = local.orderBy(*asc)
    rows = (
        frozen.withColumn("_prev", F.lag(F.struct(*payload)).over(ordered))
        .withColumn("_rn", F.row_number().over(ordered))
        .withColumn("_last", F.lead(F.lit(1)).over(ordered).isNull())
    )
    inner = rows.where("_rn > 1").select(*df.columns, F.col("_prev").alias("prev"))
    heads, tails = rows.where("_rn = 1"), rows.where("_last")
    tail = tails.select(
        *[F.col(c).alias(f"_t_{c}") for c in group],
        (F.col("_pid") + 1).alias("_t_pid"),
        F.struct(*payload).alias("_t_prev"),
    )
    on = F.col("_pid") == F.col("_t_pid")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    first = heads.join(tail, on, "left").select(*df.columns, F.col("_t_prev").alias("prev"))
    return inner.unionByName(first)


def with_rank(df: DataFrame, group: list[str], order: list[str], name: str = "ranked") -> DataFrame:
    """Adds ``rank``, from 1, of each row by ``order`` in its group.

    As in ``with_previous`` a group may span many tasks: ranks inside a task are moved up by the group's rows
    in the tasks before, of which there is one count per task and group that meet.
    """
    for taken in ("_pid", "_rn", "_before", "rank"):
        if taken in df.columns:
            raise ValueError(f"column {taken} is reserved")
    asc: list[Column] = [F.col(c).asc_nulls_first() for c in order]
    frozen = materialize(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in group], *asc).withColumn("_pid", F.spark_partition_id()), name)
    local = frozen.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid", *group).orderBy(*asc)))
    counts = frozen.groupBy("_pid", *group).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*group).orderBy("_pid")) - F.col("_n"))
    before = before.select(F.col("_pid").alias("_t_pid"), "_before", *[F.col(c).alias(f"_t_{c}") for c in group])
    on = F.col("_pid") == F.col("_t_pid")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    return local.join(before, on).select(*df.columns, (F.col("_rn") + F.col("_before")).alias("rank"))
