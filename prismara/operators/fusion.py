"""Fused features, and the adapter that maps visual features."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismara.functions.vectors import fuse

# Weights of the visual, text-image and tag parts; widths of the adapter's layers.
WEIGHTS = (1.0, 0.7, 0.3)
ADAPTER_WIDTHS = (1536, 512, 256, 384)
SEMANTIC_WIDTH = 64


def fused(features: DataFrame, visual: str, image: str, semantic: str, out: str = "fused") -> DataFrame:
    """Adds the fused vector; a missing tag part is a zero vector, so that widths agree."""
    zero = F.array_repeat(F.lit(0.0), SEMANTIC_WIDTH)
    sem = F.coalesce(F.col(semantic).cast("array<double>"), zero)
    return features.withColumn(out, fuse((F.col(visual), WEIGHTS[0]), (F.col(image), WEIGHTS[1]), (sem, WEIGHTS[2])))


_erf = np.vectorize(math.erf, otypes=[float])


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + _erf(x / math.sqrt(2)))


def layer_norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    mean, var = x.mean(1, keepdims=True), x.var(1, keepdims=True)
    return (x - mean) / np.sqrt(var + eps) * scale + shift


def random_adapter(widths: tuple[int, ...] = ADAPTER_WIDTHS, seed: int = 42) -> list[dict[str, np.ndarray]]:
    """Layers with random weights, for tests and as a start of training."""
    rng = np.random.default_rng(seed)
    made = [{"w": rng.standard_normal((b, a)) / math.sqrt(a), "b": np.zeros(b)} for a, b in zip(widths, widths[1:])]
    return [m | ({"scale": np.ones(len(m["b"])), "shift": np.zeros(len(m["b"]))} if i < len(made) - 1 else {}) for i, m in enumerate(made)]


def save_adapter(layers: list[dict[str, np.ndarray]], path: str) -> None:
    np.savez(path, **{f"{i}.{k}": v for i, layer in enumerate(layers) for k, v in layer.items()})


def load_adapter(path: str, width: int = ADAPTER_WIDTHS[0]) -> list[dict[str, np.ndarray]] | None:
    """The layers in a file; None if they don't take vectors of ``width``."""
    with np.load(path) as stored:
        layers: dict[int, dict[str, np.ndarray]] = {}
        for key in stored.files:
            i, name = key.split(".", 1)
            layers.setdefault(int(i), {})[name] = stored[key]
    made = [layers[i] for i in sorted(layers)]
    return made if made and made[0]["w"].shape[1] == width else None


def forward(layers: list[dict[str, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Linear layers, each but the last followed by layer norm and GELU."""
    for layer in layers:
        x = x @ layer["w"].T + layer["b"]
        if "scale" in layer:
            x = gelu(layer_norm(x, layer["scale"], layer["shift"]))
    return x


def adapt(features: DataFrame, vec: str, layers: list[dict[str, np.ndarray]], out: str = "adapted") -> DataFrame:
    """Adds the adapter's output; null where a vector is null or of another width. The weights (a few MB) are broadcast."""
    shared = features.sparkSession.sparkContext.broadcast(layers)
    width = layers[0]["w"].shape[1]

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            ok = [v is not None and len(v) == width for v in batch]
            rows: list = [None] * len(batch)
            if any(ok):
                made = forward(shared.value, np.stack([v for v, k in zip(batch, ok) if k]).astype(float))
                for i, y in zip(np.flatnonzero(ok), made):
                    rows[i] = y
            yield pd.Series(rows)

    return features.withColumn(out, run(F.col(vec).cast("array<double>")))


def map_model(images: DataFrame, load, infer, schema: str, columns: list[str]) -> DataFrame:
    """The extension point of models: ``load()`` once per task, ``infer(model, pandas batch)`` per Arrow batch.

    No model is bundled; embedders, taggers and classifiers plug in here.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield infer(model, batch)

    return images.select(*columns).mapInPandas(run, schema)


def map_vectors(images: DataFrame, load, embed, columns: list[str], out: str = "vec") -> DataFrame:
    """An embedder of images or texts: ``embed(model, pandas batch)`` gives one vector (or None) per row, in order."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*columns).schema) + f", `{out}` array<float>"

    def infer(model, batch: pd.DataFrame) -> pd.DataFrame:
        return batch.assign(**{out: [None if v is None else np.asarray(v, np.float32) for v in embed(model, batch)]})

    return map_model(images, load, infer, schema, columns)


def map_tags(images: DataFrame, load, tag, columns: list[str], key: str = "image_id") -> DataFrame:
    """A tagger: ``tag(model, pandas batch)`` gives a list of (tag, tag_idx, category, score) per row; one row comes out per tag."""

    def infer(model, batch: pd.DataFrame) -> pd.DataFrame:
        rows = [(k, t, int(i), int(c), float(s)) for k, found in zip(batch[key], tag(model, batch)) for t, i, c, s in found]
        return pd.DataFrame(rows, columns=[key, "tag", "tag_idx", "category", "score"])

    return map_model(images, load, infer, f"`{key}` long, tag string, tag_idx int, category int, score double", columns)


def map_logits(images: DataFrame, load, classify, labels: list[str], columns: list[str], key: str = "image_id", out: str = "label") -> DataFrame:
    """A classifier: ``classify(model, pandas batch)`` gives logits per row; ``{out}`` and ``{out}_confidence`` come out.

    A batch that runs out of memory is tried again row by row; rows that fail then have a null label.
    """

    def infer(model, batch: pd.DataFrame) -> pd.DataFrame:
        try:
            logits = list(classify(model, batch))
        except MemoryError:
            logits = []
            for i in range(len(batch)):
                try:
                    logits += list(classify(model, batch.iloc[i : i + 1]))
                except MemoryError:
                    logits.append(None)
        names, sure = [], []
        for row in logits:
            x = None if row is None else np.asarray(row, float)
            share = None if x is None else np.exp(x - x.max()) / np.exp(x - x.max()).sum()
            names.append(None if x is None else labels[int(x.argmax())])
            sure.append(None if x is None else float(share.max()))
        return pd.DataFrame({key: batch[key], out: names, f"{out}_confidence": sure})

    return map_model(images, load, infer, f"`{key}` long, `{out}` string, `{out}_confidence` double", columns)
