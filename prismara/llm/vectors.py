"""Usable cached vectors, by kind."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismara.session import materialize, sized

# The kinds told apart by the cache key, and their widths.
WIDTHS = {"siglip": 1152, "dinov2ms_True": 384, "dinov2ms_False": 1536}
#: Ids that are sent to all tasks rather than vectors shuffled to them.
IDS = 2_000_000


def kind_of(ckey):
    """The kind a cache key names, or null. Paths may hold underscores; only prefix and last part count."""
    last = F.element_at(F.split(ckey, "_"), -1)
    return F.when(ckey.startswith("siglip_"), "siglip").when(ckey.startswith("dinov2ms_") & last.isin("True", "False"), F.concat(F.lit("dinov2ms_"), last))


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as packed float32; those with a null, infinite or no non-zero number are dropped."""
    for batch in batches:
        vec = batch.column(3)
        lengths = vec.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)  # nulls become NaN
        keep, packed = [], []
        for i, (at, n) in enumerate(zip(np.cumsum(lengths) - lengths, lengths)):
            v = flat[at : at + n]
            if np.isfinite(v).all() and v.any():
                keep.append(i)
                packed.append(v.tobytes())
        index = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(index) for c in range(3)), pa.array(packed, pa.binary())], ["kind", "feat_id", "ckey", "vec"])


def usable_vectors(cache: DataFrame) -> DataFrame:
    """``kind, feat_id, vec`` (packed float32) of ``cache(feat_id, ckey, vec)``, written once.

    A vector counts if it is not null, of its kind's width, all finite and not all
    zero; of the usable rows with one ckey that of the smallest ``feat_id`` counts.
    Unknown or null keys and null ids don't count.
    """
    kind = kind_of(F.col("ckey"))
    width = F.when(F.col("kind") == "siglip", WIDTHS["siglip"]).when(F.col("kind") == "dinov2ms_True", WIDTHS["dinov2ms_True"]).otherwise(WIDTHS["dinov2ms_False"])
    sized_ = cache.select(kind.alias("kind"), F.col("feat_id").cast("long").alias("feat_id"), "ckey", F.col("vec").cast("array<float>").alias("vec")).where(F.col("kind").isNotNull() & F.col("feat_id").isNotNull() & (F.size("vec") == width))
    usable = materialize(sized_.mapInArrow(_pack, "kind string, feat_id long, ckey string, vec binary"), "vectors")
    # The first row of each key is found on the keys alone, so that no vector is shuffled for it.
    repeats = usable.groupBy("ckey").agg(F.min("feat_id").alias("keep"), F.count("*").alias("c")).where("c > 1")
    spare, some = sized(usable.select("ckey", "feat_id").join(repeats, "ckey").where("feat_id > keep").select("feat_id").distinct(), "repeated", IDS)
    kept = (usable.join(spare, "feat_id", "left_anti") if some else usable).select("kind", "feat_id", "vec")
    return materialize(kept, "kept") if some > IDS else kept


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors of each kind and their other copies.

    ``kind, feat_id, copies, vec``: the first row of each vector and how many it has;
    ``kind, feat_id, rep``: the other rows, with the first one. Copies are told by a
    128-bit digest; vectors are not shuffled unless very many have copies.
    """
    keys = vectors.select("kind", "feat_id", F.md5("vec").alias("digest"))
    repeated = keys.groupBy("kind", "digest").agg(F.min("feat_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    held, some = sized(keys.join(repeated, ["kind", "digest"]).select("kind", "feat_id", "rep", "copies"), "copies", IDS)
    spare = held.where("feat_id <> rep").select("kind", "feat_id", "rep")
    if not some:
        return vectors.select("kind", "feat_id", F.lit(1).cast("long").alias("copies"), "vec"), spare
    out = ["kind", "feat_id", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "vec"]
    if some <= IDS:
        return vectors.join(held.drop("kind"), "feat_id", "left").where("rep IS NULL OR rep = feat_id").select(out), spare
    firsts, few = sized(keys.join(held.drop("kind"), "feat_id", "left").where("rep IS NULL OR rep = feat_id").select("feat_id", "copies"), "firsts", IDS)
    rows = vectors.join(firsts, "feat_id").select(out)
    return (rows if few <= IDS else materialize(rows, "distinct")), spare


def unpack(vecs, width: int | None = None) -> np.ndarray:
    """Packed vectors as the rows of a float32 array."""
    vecs = list(vecs)
    if not vecs:
        return np.empty((0, width or 0), np.float32)
    return np.frombuffer(b"".join(vecs), np.float32).reshape(len(vecs), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, computed in double precision."""
    d = x.astype(np.float64)
    # Scaled first: squares of extreme numbers would overflow or vanish.
    d /= np.abs(d).max(axis=1, keepdims=True)
    return (d / np.linalg.norm(d, axis=1, keepdims=True)).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    a /= np.abs(a).max(axis=1, keepdims=True)
    b /= np.abs(b).max(axis=1, keepdims=True)
    return np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
