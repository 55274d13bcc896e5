"""Image-text pairs from five JSON layouts.

Which layout a file has is decided by its keys, first match first: tagger metadata,
legacy folder, keyed by file name, list of records, single record. The files of each
layout take their own path; parsing is Arrow-batched, joins with the listing of
existing files are Spark's.

Defined cases: null, empty and invalid bodies give nothing; records that are no
objects are skipped; of several keys the first with a truthy value counts; pairs
without a path, a description or an existing file are dropped; copies of a file
give their pairs again (as often as the file was read).
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismara.functions.jsonio import BAD, as_text, strict_loads
from prismara.functions.text import basename, dirname, is_image
from prismara.operators.drift import IMAGE_KEYS, TEXT_KEYS
from prismara.schema import SIBLING_EXTENSIONS
from prismara.session import materialize

FOUND = "json_path string, layout string, image_path string, candidates array<string>, folder string, captions map<string,string>, description string"


def read_json_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, body`` of every JSON file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    return files.select("path", F.decode("content", "UTF-8").alias("body"))


def _truthy(record: dict, keys: Iterable[str]) -> Any:
    return next((record[k] for k in keys if record.get(k)), None)


def layout_of(value: Any) -> str:
    if isinstance(value, dict):
        if isinstance(value.get("images"), dict) and "total_images" in value:
            return "tagger"
        if "sample_files" in value and "description" in value:
            return "folder"
        if value and all(isinstance(v, dict) for v in value.values()):
            return "keyed"
        return "single"
    return "list" if isinstance(value, list) else "single"


def _tagger(parent: str, value: dict) -> Iterator[dict]:
    for name, info in value["images"].items():
        if not isinstance(info, dict):
            continue
        tags = [t for k in ("character_tags", "general_tags") for t in (info.get(k) if isinstance(info.get(k), list) else []) if t is not None]
        scores = info.get("all_scores")
        if not tags and isinstance(scores, dict):
            numbers = [(t, s) for t, s in scores.items() if isinstance(s, (int, float)) and not isinstance(s, bool)]
            tags = [t for t, s in sorted(numbers, key=lambda x: -x[1])[:15] if s > 0.1]
        if tags:
            yield {"image_path": posixpath.normpath(posixpath.join(parent, name)), "description": ", ".join(str(as_text(t)) for t in tags[:20])}


def _folder(parent: str, value: dict) -> Iterator[dict]:
    names = value["sample_files"] if isinstance(value["sample_files"], list) else []
    names = [n for n in names if isinstance(n, str)]
    text = value["description"] if isinstance(value["description"], str) else ""
    parts = [p.strip() for p in text.split(";") if p.strip()]
    captions = dict(zip(names, parts)) if len(parts) == len(names) else dict.fromkeys(names, text) if parts else {}
    yield {"folder": parent, "captions": captions, "description": text, "candidates": [posixpath.normpath(posixpath.join(parent, n)) for n in names]}


def _keyed(parent: str, value: dict) -> Iterator[dict]:
    for name, record in value.items():
        text, path = _truthy(record, TEXT_KEYS), _truthy(record, ("source", "image_path", "path"))
        if text and path:
            yield {"image_path": posixpath.normpath(str(as_text(path))), "description": as_text(text)}
        elif text:
            yield {"candidates": [posixpath.normpath(posixpath.join(parent, name))], "description": as_text(text)}


def _records(parent: str, value: Any, json_path: str) -> Iterator[dict]:
    for record in value if isinstance(value, list) else [value]:
        if not isinstance(record, dict):
            continue
        text, path = _truthy(record, TEXT_KEYS), _truthy(record, IMAGE_KEYS)
        if text and path:
            yield {"image_path": posixpath.normpath(posixpath.join(parent, str(as_text(path)))), "description": as_text(text)}
        elif text:
            base = posixpath.splitext(json_path)[0]
            yield {"candidates": [posixpath.normpath(base + e) for e in SIBLING_EXTENSIONS], "description": as_text(text)}


def _parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in FOUND.split(", ")]
    for batch in batches:
        rows = []
        for path, body in zip(batch["path"], batch["body"]):
            value = strict_loads(body)
            if value is BAD or not isinstance(path, str):
                continue
            layout, parent = layout_of(value), posixpath.dirname(path)
            made = _tagger(parent, value) if layout == "tagger" else _folder(parent, value) if layout == "folder" else _keyed(parent, value) if layout == "keyed" else _records(parent, value, path)
            rows += [{"json_path": path, "layout": layout} | m for m in made]
        yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)


def training_pairs(files: DataFrame, listing: DataFrame) -> DataFrame:
    """``json_path, layout, image_path, description`` of ``files(path, body)``; only files in ``listing(path)`` count."""
    found = materialize(files.select("path", "body").mapInPandas(_parse, FOUND), "pairs")
    existing = listing.where("path IS NOT NULL").select(F.col("path").alias("image_path")).distinct()
    direct = found.where("image_path IS NOT NULL").select("json_path", "layout", "image_path", "description").join(existing, "image_path", "left_semi")
    # Candidates in their order; the first that exists counts.
    tried = found.where("candidates IS NOT NULL AND folder IS NULL").withColumn("no", F.monotonically_increasing_id())
    options = tried.select("no", "json_path", "layout", "description", F.posexplode("candidates").alias("at", "image_path")).join(existing, "image_path", "left_semi")
    beside = options.groupBy("no").agg(F.min_by(F.struct("json_path", "layout", "image_path", "description"), "at").alias("r")).select("r.*")
    images = existing.where(is_image(F.col("image_path"), SIBLING_EXTENSIONS)).withColumn("folder", dirname(F.col("image_path")))
    legacy = found.where("folder IS NOT NULL").select("json_path", "layout", "folder", "captions", "description", "candidates")
    # Of a folder without images the files that are named count, wherever they are.
    named = legacy.join(images.select("folder").distinct(), "folder", "left_anti").select("json_path", "layout", "captions", "description", F.explode(F.array_distinct("candidates")).alias("image_path")).join(existing, "image_path", "left_semi")
    here = F.col("image_path")
    caption = F.coalesce(F.try_element_at("captions", basename(here)), F.col("description")).alias("description")
    described = legacy.join(images, "folder").select("json_path", "layout", here, caption).unionByName(named.select("json_path", "layout", here, caption))
    return direct.select("json_path", "layout", "image_path", "description").unionByName(beside).unionByName(described).where("description <> ''")
