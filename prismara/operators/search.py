"""Semantic search: the most similar images of a query vector, and copies of them in a folder."""

from __future__ import annotations

import os
import shutil
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismara.functions.text import result_name, safe_name
from prismara.functions.vectors import products
from prismara.sources.features import latest_features


def top_k(features: DataFrame, key: str, vec: str, query: Sequence[float], k: int = 20) -> DataFrame:
    """``key, score`` of the ``k`` most similar rows; ties by key. Each task keeps k rows, so nothing is sorted whole."""
    if not 1 <= k <= 1000:
        raise ValueError("k is 1 to 1000")
    scored = features.select(key, F.element_at(products(F.col(vec), [query], cosines=True), 1).alias("score")).where("score IS NOT NULL AND NOT isnan(score)")
    return scored.orderBy(F.desc("score"), key).limit(k)


def search(features: DataFrame, query: Sequence[float], text: str, k: int = 20, model: str = "siglip") -> DataFrame:
    """``rank, path, score, target``: results over the latest feature of each path, and where they would be copied."""
    best = top_k(latest_features(features, model), "path", "vec", query, k)
    # At most 1000 rows, so one window is enough.
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")))
    folder = F.substring(safe_name(F.lit(text)), 1, 50)
    return ranked.select("rank", "path", "score", F.concat_ws("/", F.lit("AI_Search_Results"), folder, result_name(F.col("rank"), F.col("score"), F.col("path"))).alias("target"))


def copy_results(results: DataFrame, root: str) -> int:
    """Copies the files of ``search`` to their targets below ``root``; those that are gone are passed over. Returns the number copied.

    At most 1000 files, which the driver reads and writes as a user's file manager would.
    """
    copied = 0
    for row in results.select("path", "target").collect():
        if os.path.exists(row["path"]):
            target = os.path.join(root, row["target"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            shutil.copy2(row["path"], target)
            copied += 1
    return copied
