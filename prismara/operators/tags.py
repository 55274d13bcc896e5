"""Admission of predicted tags, and semantic vectors made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismara.schema import BLOCKED_TAGS, CHARACTER, CHARACTER_SLOTS, MATURE_ADMISSION, RATINGS, TAG_GROUPS


def holds_any(tag: Column, parts: tuple[str, ...]) -> Column:
    """Whether the lower-case tag contains any of some substrings."""
    return F.lower(tag).rlike("|".join(parts))


def explicit_dominant(scores: DataFrame) -> DataFrame:
    """``image_id, explicit_dominant``: the explicit rating is above all others; missing ratings are 0."""
    rated = scores.where(F.col("tag").isin(*RATINGS)).groupBy("image_id").agg(*[F.coalesce(F.max(F.when(F.col("tag") == r, F.col("score"))), F.lit(0.0)).alias(r) for r in RATINGS])
    return rated.select("image_id", (F.col("explicit") > F.greatest("general", "sensitive", "questionable")).alias("explicit_dominant"))


def admit(scores: DataFrame, dominant: DataFrame | None = None) -> DataFrame:
    """Rows of ``scores`` that are kept: characters above 0.05, mature tags above 0.35 on explicit images, others above 0.1."""
    dominant = explicit_dominant(scores) if dominant is None else dominant
    joined = scores.where(~F.col("tag").isin(*BLOCKED_TAGS)).join(dominant, "image_id", "left")
    kept = F.when(F.col("category") == CHARACTER, F.col("score") > 0.05).when(holds_any(F.col("tag"), MATURE_ADMISSION), F.coalesce("explicit_dominant", F.lit(False)) & (F.col("score") > 0.35)).otherwise(F.col("score") > 0.1)
    return joined.where(kept).drop("explicit_dominant")


def group_vector(scores: DataFrame) -> DataFrame:
    """``image_id, groups``: the greatest score in each tag group, at least 0; the second is 1 - the first."""
    greatest = [F.coalesce(F.greatest(F.max(F.when(F.col("tag").isin(*tags), F.col("score"))), F.lit(0.0)), F.lit(0.0)).alias(f"g{i}") for i, tags in enumerate(TAG_GROUPS.values()) if tags]
    wide = scores.groupBy("image_id").agg(*greatest)
    parts = [F.col(f"g{i}") if tags else F.greatest(F.lit(0.0), 1 - F.col("g0")) for i, tags in enumerate(TAG_GROUPS.values())]
    return wide.select("image_id", F.array(*parts).alias("groups"))


def slot(tag: Column) -> Column:
    """A stable slot of a character: the first eight hexadecimal digits of its MD5, modulo the slots."""
    return F.pmod(F.conv(F.substring(F.md5(tag), 1, 8), 16, 10).cast("long"), F.lit(CHARACTER_SLOTS)).cast("int")


def character_vector(scores: DataFrame, hashed: Callable[[Column], Column] = slot, top: int = 8, above: float = 0.35) -> DataFrame:
    """``image_id, characters``: greatest score per slot of an image's best characters."""
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "tag_idx", "tag"))
    best = scores.where(F.col("category") == CHARACTER).withColumn("r", rank).where((F.col("r") <= top) & (F.col("score") > above))
    slots = best.groupBy("image_id", hashed(F.col("tag")).alias("slot")).agg(F.max("score").alias("score"))
    filled = slots.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(CHARACTER_SLOTS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return filled.select("image_id", dense.alias("characters"))


def semantic_vector(scores: DataFrame) -> DataFrame:
    """``image_id, semantic``: groups, then characters (zeros where an image has none)."""
    none = F.array_repeat(F.lit(0.0), CHARACTER_SLOTS)
    return group_vector(scores).join(character_vector(scores), "image_id", "left").select("image_id", F.concat("groups", F.coalesce("characters", none)).alias("semantic"))
