"""Images and their normalised tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_tag(tag: Column) -> Column:
    """Lower case, no blanks (spaces, tabs) at the ends, inner runs of blanks and underscores as one underscore."""
    return F.regexp_replace(F.lower(F.regexp_replace(tag, r"^[ \t]+|[ \t]+$", "")), r"[ \t_]+", "_")


def normal_tags(tags: Column) -> Column:
    """All usable tags of a list, repeats kept; null lists are empty."""
    usable = F.filter(F.transform(tags, normal_tag), lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(usable, F.array().cast("array<string>"))


def current_images(metadata: DataFrame, columns: list[str], oldest: bool = False) -> DataFrame:
    """One row per ``image_id``: that of the greatest (or least) ``written_at``.

    Rows without an id are no image; a null time is older than any other.
    """
    pick = F.min_by if oldest else F.max_by
    when = F.coalesce(F.col("written_at"), F.lit("0001-01-01").cast("timestamp"))
    row = F.struct(*columns)
    return metadata.where(F.col("image_id").isNotNull()).groupBy("image_id").agg(pick(row, when).alias("r")).select("image_id", "r.*")
