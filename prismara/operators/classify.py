"""Votes, zero-shot filters and semantic assignment.

Images and labels meet in a matrix product per Arrow batch: the few label vectors of a
user's specification go to the tasks, so no join, and no shuffle, is needed. Ties go to the
label that comes first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismara.functions.text import safe_name
from prismara.functions.vectors import argmax, l2_normalize, products, softmax


def prediction(logits: Column, labels: Sequence[str]) -> Column:
    """``struct<label, confidence>`` of a classifier's logits; null logits give nulls."""
    place = argmax(logits)
    names = F.array(*[F.lit(x) for x in labels])
    return F.struct(F.try_element_at(names, place + 1).alias("label"), F.array_max(softmax(logits)).alias("confidence"))


def dual_vote(label1: Column, label2: Column) -> Column:
    """``ai`` only if the first says ``ai`` and the second ``artificial``; else ``hum``, nulls included."""
    return F.when((label1 == "ai") & (label2 == "artificial"), F.lit("ai")).otherwise(F.lit("hum"))


def single_vote(label1: Column) -> Column:
    return label1


def _ranked(labels: Sequence[tuple[str, float, Sequence[float]]], value) -> Column:
    """``array<struct<loss, pos, tag>>`` of the labels, best first; ``value(i)`` is a label's score."""
    made = [F.struct((-value(i) * F.lit(float(w))).alias("loss"), F.lit(i).alias("pos"), F.lit(t).alias("tag")) for i, (t, w, _) in enumerate(labels)]
    return F.array_sort(F.array(*made)) if made else F.array().cast("array<struct<loss:double,pos:int,tag:string>>")


def zero_shot(images: DataFrame, vec: str, positive: Sequence[tuple[str, float, Sequence[float]]], negative: Sequence[tuple[str, float, Sequence[float]]], anchor: Sequence[float], min_conf: float = 0.05, prefix: str = "") -> DataFrame:
    """Adds ``{prefix}passed, {prefix}label, {prefix}margin``.

    A margin is (similarity - the anchor's) x weight. An image passes if a positive
    margin reaches ``min_conf`` (or there are no positive tags); its label joins the
    passing tags, best first. It is rejected if any negative margin is above 0; its
    label is then ``-tag`` of the worst. A null vector passes nothing. All similarities
    of a row come from one matrix product.
    """
    out = images.withColumn("_s", products(F.col(vec), [anchor, *(v for _, _, v in positive), *(v for _, _, v in negative)]))
    margin = lambda start: lambda i: F.element_at("_s", start + i) - F.element_at("_s", 1)
    null = F.col(vec).isNull()
    out = out.withColumn("_pos", F.when(~null, _ranked(positive, margin(2)))).withColumn("_neg", F.when(~null, _ranked(negative, margin(2 + len(positive)))))
    passing = F.filter("_pos", lambda s: -s["loss"] >= min_conf)
    first = (F.size(passing) > 0) if positive else F.col(vec).isNotNull()
    label = F.array_join(F.transform(passing, lambda s: safe_name(s["tag"])), "_")
    best = -F.try_element_at("_pos", F.lit(1))["loss"]
    worst = F.try_element_at("_neg", F.lit(1))
    rejected = F.coalesce(first & (-worst["loss"] > 0), F.lit(False))
    return (
        out.withColumn(f"{prefix}passed", F.coalesce(first, F.lit(False)) & ~rejected)
        .withColumn(f"{prefix}label", F.when(rejected, F.concat(F.lit("-"), safe_name(worst["tag"]))).when(F.coalesce(first, F.lit(False)), label).otherwise(F.lit("")))
        .withColumn(f"{prefix}margin", F.when(rejected, worst["loss"]).otherwise(best))
        .drop("_pos", "_neg", "_s")
    )


def assign(images: DataFrame, vec: str, descriptions: Sequence[tuple[str, Sequence[float]]], out: str = "description") -> DataFrame:
    """Adds the most similar description; the anchor never competes, so every image with a vector gets one."""
    labels = [(d, 1.0, v) for d, v in descriptions]
    scored = images.withColumn("_s", products(F.col(vec), [v for _, v in descriptions]))
    best = F.try_element_at(_ranked(labels, lambda i: F.element_at("_s", i + 1)), F.lit(1))["tag"]
    return scored.withColumn(out, F.when(F.col(vec).isNotNull(), best)).drop("_s")


def tag_embeddings(prompts: DataFrame) -> DataFrame:
    """``tag, vec``: normalised mean of the normalised prompt vectors of ``prompts(tag, vec)``.

    Prompts of a tag are few; sums are taken dimension by dimension.
    """
    unit = prompts.where("vec IS NOT NULL").select("tag", F.posexplode(l2_normalize(F.col("vec"))).alias("dim", "x"))
    mean = unit.groupBy("tag", "dim").agg(F.avg("x").alias("x"))
    gathered = mean.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("d"))
    return gathered.select("tag", l2_normalize(F.transform("d", lambda s: s["x"])).alias("vec"))
