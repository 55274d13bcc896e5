"""Column functions on names, paths and tag specifications."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A Python float literal: digits may hold single underscores.
_NUMBER = r"^\s*[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
_SPECIAL = r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$"


def safe_name(n: Column) -> Column:
    """Keeps letters, digits and ``_-/\\`` and blanks; trimmed; ``other`` where nothing is left. Null stays null."""
    kept = F.trim(F.regexp_replace(n, r"[^\p{L}\p{N} _\-/\\]", ""))
    return F.when(n.isNotNull(), F.coalesce(F.nullif(kept, F.lit("")), F.lit("other")))


def title_case(s: Column) -> Column:
    """First letter of each run of letters in upper case, the others in lower case."""
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("inside"))
    step = F.aggregate(
        F.split(s, ""),
        start,
        lambda a, c: F.struct(F.concat(a["out"], F.when(a["inside"], F.lower(c)).otherwise(F.upper(c))).alias("out"), c.rlike(r"\p{L}").alias("inside")),
        lambda a: a["out"],
    )
    return F.when(s == "", F.lit("")).otherwise(step)


def spoken(tag: Column) -> Column:
    """A tag as a title: underscores as blanks."""
    return title_case(F.replace(tag, F.lit("_"), F.lit(" ")))


def python_float(s: Column) -> Column:
    """The number a Python float literal means, else null."""
    plain = F.trim(F.replace(s, F.lit("_"), F.lit("")))
    special = F.lower(F.trim(s))
    value = F.when(special.endswith("nan"), F.lit(float("nan"))).when(special.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(s.rlike(_NUMBER), plain.try_cast("double")).when(s.rlike(_SPECIAL), value)


def parse_tag_spec(spec: Column) -> Column:
    """``array<struct<pos, polarity, tag, weight>>`` of a comma-separated specification.

    A segment is ``tag``, ``tag:weight`` or ``-tag:weight``. The text before the last
    colon is the tag even if what follows is no number (weight 1 then). Positive tags
    keep blanks before the colon, negative ones are trimmed. Empty segments don't
    count, nor does anything in a null specification.
    """
    segments = F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")

    def one(x: Column, i: Column) -> Column:
        has = F.contains(x, F.lit(":"))
        name = F.when(has, F.regexp_extract(x, r"(?s)^(.*):([^:]*)$", 1)).otherwise(x)
        weight = F.when(has, F.coalesce(python_float(F.regexp_extract(x, r"(?s)^(.*):([^:]*)$", 2)), F.lit(1.0))).otherwise(F.lit(1.0))
        negative = F.startswith(name, F.lit("-"))
        tag = F.when(negative, F.regexp_replace(F.substr(name, F.lit(2)), r"^\s+|\s+$", "")).otherwise(name)
        return F.struct(i.alias("pos"), F.when(negative, "negative").otherwise("positive").alias("polarity"), tag.alias("tag"), weight.alias("weight"))

    return F.coalesce(F.transform(segments, one), F.array().cast("array<struct<pos:int,polarity:string,tag:string,weight:double>>"))


def prompt_ensemble(tag: Column) -> Column:
    """Four prompts of a tag."""
    # The prompts.
    return F.array(F.concat(F.lit("a photo of "), tag), F.concat(F.lit("an image of "), tag), F.concat(F.lit("a picture of "), tag), tag)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)$", 1)


def dirname(path: Column) -> Column:
    """Everything before the last slash; the root keeps its slash."""
    head = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when(F.startswith(path, F.lit("/")) & (head == ""), F.lit("/")).otherwise(head)


def extension(path: Column) -> Column:
    """With its dot, as written; a leading dot starts no extension."""
    return F.regexp_extract(basename(path), r"(?s)[^.].*?(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.substr(name, F.lit(1), F.length(name) - F.length(extension(path)))


@F.pandas_udf(StringType())
def normalize_path(path: pd.Series) -> pd.Series:
    """Without doubled slashes, ``.`` and ``..``."""
    return path.map(lambda p: posixpath.normpath(p) if isinstance(p, str) else None)


def is_image(path: Column, extensions: tuple[str, ...]) -> Column:
    return F.lower(extension(path)).isin(*extensions)


def cache_key_parts(key: Column) -> Column:
    """``struct<model, path, mtime, adapter>`` of a feature-cache key; the path may hold underscores."""
    visual = F.startswith(key, F.lit("dinov2ms_"))
    v = r"(?s)^dinov2ms_(.*)_([^_]*)_(True|False)$"
    t = r"(?s)^siglip_(.*)_([^_]*)$"
    path = F.when(visual, F.regexp_extract(key, v, 1)).otherwise(F.regexp_extract(key, t, 1))
    mtime = F.when(visual, F.regexp_extract(key, v, 2)).otherwise(F.regexp_extract(key, t, 2))
    return F.struct(F.regexp_extract(key, r"^([^_]*)_", 1).alias("model"), path.alias("path"), mtime.try_cast("double").alias("mtime"), F.when(visual, F.regexp_extract(key, v, 3) == "True").alias("adapter"))


def cache_key(model: Column, path: Column, mtime: Column, adapter: Column | None = None) -> Column:
    return F.concat_ws("_", model, path, mtime.cast("string"), *([] if adapter is None else [F.initcap(adapter.cast("string"))]))


def first_truthy(*columns: Column) -> Column:
    """The first of some strings that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def result_name(rank: Column, score: Column, path: Column) -> Column:
    """``001_0.53.png``."""
    return F.concat(F.format_string("%03d", rank), F.format_string("_%.2f", score), extension(path))
