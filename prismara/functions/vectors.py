"""Column functions on vectors (arrays of numbers). All compute in double precision.

Null vectors give null; vectors of different lengths give null in pairwise functions;
a zero vector stays zero when normalised.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(as_double(v), lambda x: x * x)))


def l2_normalize(v: Column, weight: float = 1.0) -> Column:
    """``v`` over max(its length, 1e-12), times ``weight``."""
    return let(as_double(v), lambda a: let(F.greatest(norm(a), F.lit(EPS)), lambda n: F.transform(a, lambda x: x * weight / n)))


def dot(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS)))


def products(v: Column, others: Sequence[Sequence[float]], cosines: bool = False) -> Column:
    """Dot products (or cosines) of ``v`` with a few fixed vectors, as an array: one matrix product per Arrow batch."""
    widths = [len(o) for o in others]
    made = [np.asarray(o, float) for o in others]
    if cosines:
        made = [o / max(float(np.linalg.norm(o)), EPS) for o in made]

    @F.pandas_udf("array<double>")
    def run(vec: pd.Series) -> pd.Series:
        out: list = [None] * len(vec)
        size = np.array([-1 if x is None else len(x) for x in vec])
        for w in np.unique(size[size >= 0]):
            rows = np.flatnonzero(size == w)
            x = np.stack([vec.iloc[i] for i in rows]).astype(float) if w else np.zeros((len(rows), 0))
            if cosines and w:
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), EPS)
            fits = [k for k, n in enumerate(widths) if n == w]
            made_here = np.full((len(rows), len(widths)), np.nan)
            if fits:
                made_here[:, fits] = x @ np.stack([made[k] for k in fits]).T if w else 0.0
            for i, row in zip(rows, made_here):
                out[i] = row
        return pd.Series(out)

    return F.transform(run(as_double(v)), lambda x: F.nanvl(x, F.lit(None).cast("double")))


def euclidean(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))))


def softmax(v: Column) -> Column:
    raised = let(as_double(v), lambda a: let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top))))
    return let(raised, lambda e: let(_sum(e), lambda total: F.transform(e, lambda x: x / total)))


def argmax(v: Column) -> Column:
    """Position from 0 of the greatest value; the first of equal ones."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def mean_pool(tokens: Column) -> Column:
    """Mean of the rows of an array of vectors; null for none."""
    zero = F.transform(F.element_at(tokens, 1), lambda _: F.lit(0.0))
    total = F.aggregate(tokens, zero, lambda s, t: F.zip_with(s, as_double(t), lambda x, y: x + y))
    return F.when(F.size(tokens) > 0, F.transform(total, lambda x: x / F.size(tokens)))


def pooled_feature(tokens: Column) -> Column:
    """The first token's vector, then the mean of the others (of itself where it is alone)."""
    rest = F.when(F.size(tokens) > 1, F.slice(tokens, 2, F.size(tokens))).otherwise(tokens)
    return F.when(F.size(tokens) > 0, F.concat(as_double(F.element_at(tokens, 1)), mean_pool(rest)))


def fuse(*weighted: tuple[Column, float]) -> Column:
    """Each part normalised and weighted, concatenated, normalised again."""
    return l2_normalize(F.concat(*[l2_normalize(v, w) for v, w in weighted]))
