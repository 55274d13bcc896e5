"""The sort run as one plan: vote, filters, assignment, features, dedup, clusters, names."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismara.operators.classify import assign, dual_vote, zero_shot
from prismara.operators.dedup import dedup
from prismara.operators.naming import cluster_names, fallback_names, folder_path
from prismara.operators.ward import ward_clusters
from prismara.session import materialize

Label = tuple[str, float, Sequence[float]]
log = logging.getLogger("prismara")


@dataclass
class SortPlan:
    """Which stages run, and with what. Vectors are unit vectors of the text-image model."""

    vote: bool = False
    anchor: Sequence[float] = ()
    content: tuple[list[Label], list[Label]] | None = None
    style: tuple[list[Label], list[Label]] | None = None
    descriptions: list[tuple[str, Sequence[float]]] = field(default_factory=list)
    min_conf: float = 0.05
    style_min_conf: float | None = None
    dedup_threshold: float | None = None
    sensitivity: float | None = None

    def __post_init__(self):
        if not (self.vote or self.content or self.style or self.descriptions or self.dedup_threshold is not None or self.sensitivity is not None):
            raise ValueError("no criterion is set")
        if (self.content or self.style) and not len(self.anchor):
            raise ValueError("filters need an anchor")


def run(plan: SortPlan, images: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """``image_id, folder, status`` of every row of ``images``.

    ``images(image_id, vec, label1, label2)``. A row fails without a vector, is
    filtered by a filter, is a duplicate, or is saved; every row has one status.
    """
    rows = images.withColumn("folder", F.lit(""))
    failed = rows.where("vec IS NULL").select("image_id", "folder", F.lit("failed").alias("status"))
    rows = rows.where("vec IS NOT NULL")
    if plan.vote:
        rows = rows.withColumn("folder", dual_vote(F.col("label1"), F.col("label2")))
    rows = rows.withColumn("ok", F.lit(True))
    for axis, labels in (("content", plan.content), ("style", plan.style)):
        if labels:
            rows = zero_shot(rows, "vec", labels[0], labels[1], plan.anchor, plan.min_conf if axis == "content" or plan.style_min_conf is None else plan.style_min_conf, "z_")
            log.info("filter by %s: %d tags, %d against", axis, len(labels[0]), len(labels[1]))
            rows = rows.withColumn("ok", F.col("ok") & F.col("z_passed")).withColumn("folder", F.when(F.col("z_passed"), folder_path(F.col("folder"), F.col("z_label"))).otherwise(F.col("folder"))).drop("z_passed", "z_label", "z_margin")
    filtered = rows.where("NOT ok").select("image_id", F.lit("").alias("folder"), F.lit("filtered").alias("status"))
    kept = rows.where("ok").drop("ok")
    if plan.descriptions:
        kept = assign(kept, "vec", plan.descriptions).withColumn("folder", folder_path(F.col("folder"), F.col("description"))).drop("description")
    out = failed.unionByName(filtered)
    if plan.dedup_threshold is not None:
        log.info("near-duplicates at %.2f", plan.dedup_threshold)
        kept = materialize(kept, "kept")
        unique = materialize(dedup(kept, "image_id", "vec", plan.dedup_threshold), "unique")
        out = out.unionByName(kept.join(unique, "image_id", "left_anti").select("image_id", F.lit("").alias("folder"), F.lit("duplicates").alias("status")))
        kept = unique
    if plan.sensitivity is not None:
        log.info("clusters at sensitivity %.0f", plan.sensitivity)
        clusters = materialize(ward_clusters(kept, "image_id", "vec", plan.sensitivity), "clusters")
        if scores is None:
            names = clusters.select("cluster_id", F.format_string("group_%03d", F.col("cluster_id") + 1).alias("name")).distinct()
        else:
            names = cluster_names(clusters.withColumn("ord", F.col("image_id")), scores)
        kept = kept.join(clusters, "image_id").join(names, "cluster_id").withColumn("folder", folder_path(F.col("folder"), F.col("name"))).drop("name", "cluster_id")
    elif scores is not None:
        other = fallback_names(kept.where("folder = ''"), scores)
        kept = kept.join(other, "image_id", "left").withColumn("folder", F.when(F.col("folder") == "", F.col("name")).otherwise(F.col("folder")))
    return out.unionByName(kept.select("image_id", "folder", F.lit("saved").alias("status")))
