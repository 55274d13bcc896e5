"""Schemas that drift between the files of a feed.

Every file is profiled once: per field its JSON type, presence, nulls and a value
sketch (the smallest hashes of its values and their mean length). Profiles, not
bodies, meet their predecessor in the feed; a maximum-weight bipartite matching of
vanished and appeared fields decides the renames; what is left was removed or
added. ``unified_records`` brings all records into one table with matched columns.

Defined cases: bodies that are null, empty, not valid JSON as a whole or without a
record are passed over, and the comparison skips to the file before; ``{}`` and
``[]`` have no record; a field whose values are all null has no type and is never
``retyped``; of several types in a file the commonest counts (ties: first seen);
rows without a feed form one feed; copies collapse; files with equal times follow
each other by ``file_id``; an empty table gives an empty report.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismara.functions.jsonio import as_text, clean, dumps, strict_loads
from prismara.plans.adjacent import with_previous
from prismara.session import materialize

# The names under which records carry the image's path and its text.
IMAGE_KEYS = ("image_path", "image", "file_path", "path", "img", "filename", "source")
TEXT_KEYS = ("description", "caption", "text", "label", "annotation")

SKETCH = 32
#: Least similarity at which fields without a class share a column of the unified table.
SAME_COLUMN = 0.7
FIELD = "array<struct<name:string,type:string,rows:long,nulls:long,length:double,sketch:array<long>>>"
PROFILE_SCHEMA = f"feed string, file_id long, written_at timestamp, records long, fields {FIELD}"
CHANGE = "array<struct<change:string,field_old:string,field_new:string,score:double>>"


def plain(name: str) -> str:
    """A field name without case and underscores."""
    return name.lower().replace("_", "")


_CLASS = {plain(k): "image" for k in IMAGE_KEYS} | {plain(k): "text" for k in TEXT_KEYS}


def name_class(name: str) -> str:
    return _CLASS.get(plain(name), "")


def json_type(value: Any) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"


def records_of(body: str | None) -> list[tuple[str | None, dict]]:
    """(key, record) of a body: a list, an object of objects, or one record."""
    value = strict_loads(body)
    if isinstance(value, list):
        return [(None, x) for x in value if isinstance(x, dict)]
    if isinstance(value, dict) and value:
        if all(isinstance(x, dict) for x in value.values()):
            return list(value.items())
        return [(None, value)]
    return []


def _hash(value: Any) -> int:
    text = dumps(value, sort_keys=True, ensure_ascii=True)
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def profile(body: str | None) -> tuple[int, list[dict]]:
    """Number of records and the profile of every field, by name."""
    records = records_of(body)
    seen: dict[str, dict] = {}
    for _, record in records:
        for key, value in record.items():
            f = seen.setdefault(key, {"rows": 0, "nulls": 0, "types": Counter(), "length": 0, "hashes": set()})
            f["rows"] += 1
            kind = json_type(value)
            if kind is None:
                f["nulls"] += 1
                continue
            f["types"][kind] += 1
            f["length"] += len(value) if isinstance(value, (str, list, dict)) else 1
            f["hashes"].add(_hash(value))
            if len(f["hashes"]) > 4 * SKETCH:
                f["hashes"] = set(sorted(f["hashes"])[:SKETCH])
    fields = []
    for key in sorted(seen):
        f = seen[key]
        known = f["rows"] - f["nulls"]
        top = f["types"].most_common(1)
        fields.append({"name": clean(key), "type": top[0][0] if top else None, "rows": f["rows"], "nulls": f["nulls"], "length": f["length"] / known if known else 0.0, "sketch": sorted(f["hashes"])[:SKETCH]})
    return len(records), fields


def _profiles(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = [profile(b) for b in batch["body"]]
        yield pd.DataFrame({"feed": batch["feed"], "file_id": batch["file_id"], "written_at": batch["written_at"], "records": [n for n, _ in made], "fields": [f for _, f in made]})


def profile_files(files: DataFrame) -> DataFrame:
    """One profile per usable file of ``files(feed, file_id, written_at, body)``."""
    slim = files.select("feed", F.col("file_id").cast("long"), "written_at", "body")
    return slim.mapInPandas(_profiles, PROFILE_SCHEMA).where("records > 0").dropDuplicates(["feed", "file_id", "written_at"])


def max_weight_matching(weights: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight matching of rows to columns; weights <= 0 are no edges.

    Shortest augmenting paths with potentials, O(rows^2 * columns).
    """
    if not weights.size:
        return []
    flip = weights.shape[0] > weights.shape[1]
    cost = -np.maximum(weights.T if flip else weights, 0.0)
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        owner[m], col = i, m
        dist, back, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[col] != -1:
            done[col] = True
            row = owner[col]
            open_ = ~done[:m]
            slack = cost[row] - u[row] - v[:m]
            better = open_ & (slack < dist)
            dist[better], back[better] = slack[better], col
            nxt = int(np.where(open_, dist, np.inf).argmin())
            delta = dist[nxt]
            for c in np.nonzero(done)[0]:
                u[owner[c]] += delta
                v[c] -= delta
            dist[open_] -= delta
            col = nxt
        while col != m:
            owner[col] = owner[back[col]]
            col = int(back[col])
    pairs = [(int(owner[c]), c) for c in range(m) if owner[c] >= 0]
    pairs = [(b, a) for a, b in pairs] if flip else pairs
    return sorted((a, b) for a, b in pairs if weights[a, b] > 0)


def similarity(old: dict, new: dict) -> float:
    """How alike two fields are, 0 to 1: name, values, type, presence and length."""
    a, b = set(old["sketch"]), set(new["sketch"])
    values = len(a & b) / len(a | b) if a or b else 0.0
    name = SequenceMatcher(None, plain(old["name"]), plain(new["name"])).ratio()
    kind = 1.0 if old["type"] == new["type"] or None in (old["type"], new["type"]) else 0.0
    long_, short = max(old["length"], new["length"]), min(old["length"], new["length"])
    return 0.45 * name + 0.25 * values + 0.2 * kind + 0.1 * (short / long_ if long_ else 1.0)


def changes(old: list[dict], new: list[dict], other_renames: float | None = None) -> list[dict]:
    """Changes from one file's fields to the next one's.

    Names of one class (image, text) may always be renamed into each other. Other
    fields are matched only if ``other_renames`` gives the least similarity.
    """
    before, after = {f["name"]: f for f in old}, {f["name"]: f for f in new}
    gone, come = [f for n, f in before.items() if n not in after], [f for n, f in after.items() if n not in before]
    weights = np.zeros((len(gone), len(come)))
    for i, a in enumerate(gone):
        for j, b in enumerate(come):
            ka, kb = name_class(a["name"]), name_class(b["name"])
            if ka and ka == kb:
                weights[i, j] = 2.0 + similarity(a, b)  # as many renames as can be, then the most alike
            elif not ka and not kb and other_renames is not None and (s := similarity(a, b)) >= other_renames:
                weights[i, j] = s
    matched = max_weight_matching(weights)
    out = [{"change": "renamed", "field_old": gone[i]["name"], "field_new": come[j]["name"], "score": float(weights[i, j] % 2.0)} for i, j in matched]
    left, right = {i for i, _ in matched}, {j for _, j in matched}
    out += [{"change": "removed", "field_old": f["name"], "field_new": "", "score": None} for i, f in enumerate(gone) if i not in left]
    out += [{"change": "added", "field_old": "", "field_new": f["name"], "score": None} for j, f in enumerate(come) if j not in right]
    both = [(f, after[n]) for n, f in before.items() if n in after] + [(gone[i], come[j]) for i, j in matched]
    out += [{"change": "retyped", "field_old": a["name"], "field_new": b["name"], "score": None} for a, b in both if a["type"] and b["type"] and a["type"] != b["type"]]
    return out


def drift_report(files: DataFrame, other_renames: float | None = None) -> DataFrame:
    """``feed, file_id, change, field_old, field_new, score``: each file against the one before it."""

    return _report(profile_files(files), other_renames)


def _report(profiles: DataFrame, other_renames: float | None) -> DataFrame:
    @F.pandas_udf(CHANGE)
    def compare(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([changes([dict(f) for f in a], [dict(f) for f in b], other_renames) for a, b in zip(old, new)])

    paired = with_previous(profiles, ["feed"], ["written_at", "file_id"], ["fields"], "drift")
    paired = paired.where(F.col("prev").isNotNull())
    return paired.select("feed", "file_id", F.explode(compare(F.col("prev.fields"), F.col("fields"))).alias("c")).select("feed", "file_id", "c.*")


RECORD_SCHEMA = "feed string, file_id long, written_at timestamp, rec_no long, rec_key string, image_path string, text string, image_field string, text_field string, attributes map<string,string>, types map<string,string>"


def _first(record: dict, kind: str, order: tuple[str, ...]) -> str | None:
    """The key of the first usable value among the names of a class, in their fixed order."""
    rank = {plain(k): i for i, k in enumerate(order)}
    for key in sorted((k for k in record if name_class(k) == kind), key=lambda k: (rank[plain(k)], k)):
        if record[key] not in (None, "", [], {}, 0, False):
            return key
    return None


def _apart(named: Iterable[tuple[str, Any]]) -> dict[str, Any]:
    """A map of all the values; a name that is taken already gets a number."""
    out: dict[str, Any] = {}
    for name, value in named:
        free, n = name, 1
        while free in out:
            n += 1
            free = f"{name}#{n}"
        out[free] = value
    return out


def _attributes(record: dict, chosen: set[str | None], columns: dict[str, str]) -> dict[str, str | None]:
    """Every field but the chosen ones: under its column, if it has no class and no other field of the record that column, else as written."""
    column = {k: columns.get(plain(clean(k)), plain(clean(k))) for k in record if not name_class(k)}
    shared = Counter(column.values())
    return _apart((clean(k) if name_class(k) or shared[column[k]] > 1 else column[k], as_text(v)) for k, v in record.items() if k not in chosen)


def _columns(pdf: pd.DataFrame) -> pd.DataFrame:
    """The column of each renamed field of a feed, by plain name: of the names in its chain of renames the one that most files have."""
    top: dict[str, str] = {}
    used: Counter = Counter()
    named: set[str] = set()

    def find(name: str) -> str:
        while top.setdefault(name, name) != name:
            name = top[name]
        return name

    for r in pdf.itertuples():
        a, b = plain(r.field_old), plain(r.field_new)
        top[find(a)] = find(b)
        for written, files in ((r.field_old, r.n_old), (r.field_new, r.n_new)):
            if written not in named:
                named.add(written)
                used[plain(written)] += files
    chains: dict[str, list[str]] = {}
    for name in sorted(top):
        chains.setdefault(find(name), []).append(name)
    columns = {name: max(chain, key=lambda n: used[n]) for chain in chains.values() for name in chain}
    return pd.DataFrame({"feed": [pdf["feed"].iloc[0]], "columns": [columns]})


def renamed_columns(files: DataFrame, other_renames: float = SAME_COLUMN) -> DataFrame:
    """``feed, columns``: for each feed with renames of fields without a class, the column of each such plain name."""
    profiles = materialize(profile_files(files), "profiles")
    unclassed = F.udf(lambda name: not name_class(name), "boolean")
    renames = _report(profiles, other_renames).where("change = 'renamed'").select("feed", "field_old", "field_new").distinct().where(unclassed("field_old"))
    used = profiles.select(F.explode("fields.name").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    counted = renames.join(used.toDF("field_old", "n_old"), "field_old").join(used.toDF("field_new", "n_new"), "field_new")
    return counted.groupBy("feed").applyInPandas(_columns, "feed string, columns map<string,string>")


def _records(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for feed, file_id, at, body, columns in zip(batch["feed"], batch["file_id"], batch["written_at"], batch["body"], batch["columns"]):
            columns = dict(columns) if columns is not None else {}
            for no, (key, record) in enumerate(records_of(body)):
                image, text = _first(record, "image", IMAGE_KEYS), _first(record, "text", TEXT_KEYS)
                values = [None if k is None else as_text(record[k]) for k in (image, text)]
                fields = [None if k is None else clean(k) for k in (image, text)]
                kinds = _apart((clean(k), t) for k, v in record.items() if (t := json_type(v)))
                rows.append((feed, file_id, at, no, None if key is None else clean(key), *values, *fields, _attributes(record, {image, text}, columns), kinds))
        names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        yield pd.DataFrame(rows, columns=names).astype({"written_at": "datetime64[us]"})


def unified_records(files: DataFrame, other_renames: float = SAME_COLUMN) -> DataFrame:
    """All records of all feeds in one table.

    Names of a class are one column each (``image_path``, ``text``) that takes the
    first usable value. Every other field is an attribute, its values as text: those
    of a class (second values, empty ones) under their names as written, the others
    under one column for each chain of renames that the matching finds in the feed (at
    a similarity of ``other_renames`` or more), else under their plain names, or as
    written where two of a record have the same column. ``types`` has the JSON type
    each field had in this record.
    """
    slim = files.select("feed", F.col("file_id").cast("long"), "written_at", "body")
    columns = materialize(renamed_columns(files, other_renames), "columns")
    slim = slim.join(columns.withColumnRenamed("feed", "of"), F.col("feed").eqNullSafe(F.col("of")), "left").drop("of")
    return slim.mapInPandas(_records, RECORD_SCHEMA).dropDuplicates(["feed", "file_id", "written_at", "rec_no"])
