"""The tag vocabulary and tag scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismara.schema import RATING, RATINGS


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``tag_idx, name, category`` of a CSV with ``name`` and perhaps ``category``; row order is the index."""
    raw = spark.read.csv(path, header=True)
    category = F.col("category").try_cast("int") if "category" in raw.columns else F.lit(None).cast("int")
    numbered = raw.withColumn("_at", F.monotonically_increasing_id())
    # A vocabulary is a few thousand rows of one file, read in order.
    return numbered.select((F.row_number().over(Window.orderBy("_at")) - 1).alias("tag_idx"), "name", category.alias("category"))


def tag_scores(metadata: DataFrame, vocab: DataFrame) -> DataFrame:
    """``image_id, tag, tag_idx, category, score`` of ``metadata(image_id, all_scores)``.

    Tags outside the vocabulary have category -1 and come last; null scores go. A name
    that the vocabulary has twice counts by its first row.
    """
    first = vocab.where("name IS NOT NULL").groupBy(F.col("name").alias("tag")).agg(F.min_by(F.struct("tag_idx", "category"), "tag_idx").alias("v"))
    long = metadata.select("image_id", F.explode("all_scores").alias("tag", "score")).where("score IS NOT NULL")
    return long.join(first, "tag", "left").select("image_id", "tag", F.coalesce("v.tag_idx", F.lit(2147483647)).alias("tag_idx"), F.coalesce("v.category", F.lit(-1)).alias("category"), "score")


def current_metadata(metadata: DataFrame) -> DataFrame:
    """One row per ``image_id``: that of the greatest ``written_at`` (null times are oldest). Rows without an id go."""
    when = F.coalesce("written_at", F.lit("0001-01-01").cast("timestamp"))
    rest = [c for c in metadata.columns if c != "image_id"]
    return metadata.where("image_id IS NOT NULL").groupBy("image_id").agg(F.max_by(F.struct(*rest), when).alias("r")).select("image_id", "r.*")


def scores_with_ratings(metadata: DataFrame, vocab: DataFrame) -> DataFrame:
    """Tag scores, and the rating struct's scores as tags of the rating category."""
    rated = metadata.select("image_id", F.explode(F.array(*[F.struct(F.lit(r).alias("tag"), F.col(f"rating.{r}").alias("score")) for r in RATINGS])).alias("x")).select("image_id", "x.*").where("score IS NOT NULL")
    ratings = rated.select("image_id", "tag", F.lit(2147483646).alias("tag_idx"), F.lit(RATING).alias("category"), "score")
    plain = tag_scores(metadata, vocab).where(~F.col("tag").isin(*RATINGS))
    return plain.unionByName(ratings)
