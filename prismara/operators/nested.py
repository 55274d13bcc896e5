"""Deeply nested folder documents into related flat tables.

A bottom-up tree automaton gives every JSON node a state (its shape). A top-down
walk then emits one row per folder, image, tag and score, with the node's number,
its parent's number and the shape variant. Rows are written once, partitioned by
relation and variant; the typed subtype tables are scans of those partitions, and
the supertype columns are common to all.

Defined cases: a null, empty or invalid body gives no row; a valid body that holds
no folder gives none; entries that are not objects are no images; a tag list that
is not a list gives no tags; null elements keep their place but give no row; a
missing ``folder`` is null; copies of a file collapse; extra columns of the input
are ignored. Bodies of any depth are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismara.functions.jsonio import BAD, as_text, strict_loads
from prismara.session import materialize

TAG_RELATIONS = {"general_tags": "general_tag", "character_tags": "character_tag", "mature_tags": "mature_tag"}
RATINGS = ("explicit", "questionable", "sensitive", "general")
SUPERTYPE = ["meta_id", "folder", "image_name", "relation", "pos", "item"]

NODE_SCHEMA = T.StructType(
    [
        T.StructField("meta_id", T.LongType()),
        T.StructField("node_no", T.LongType()),
        T.StructField("parent_no", T.LongType()),
        T.StructField("folder", T.StringType()),
        T.StructField("image_name", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("item", T.StringType()),
        T.StructField("number", T.DoubleType()),
        T.StructField("detail", T.StringType()),
        *[T.StructField(f"rating_{r}", T.DoubleType()) for r in RATINGS],
        T.StructField("relation", T.StringType()),
        T.StructField("variant", T.StringType()),
    ]
)


class ShapeAutomaton:
    """Deterministic bottom-up tree automaton over JSON values.

    ``run`` maps a value to a state, from the states of its children alone. States
    of leaves: null, bool, number, string. Lists: list[<states>], or a named state.
    Objects: the first rule whose condition on (key -> child state) holds.
    """

    LEAVES = ((type(None), "null"), (bool, "bool"), (int, "number"), (float, "number"), (str, "string"))

    def leaf_state(self, value: Any) -> str | None:
        return next((state for kind, state in self.LEAVES if isinstance(value, kind)), None)

    def run(self, value: Any) -> str:
        """The state of ``value``; containers whose children are not done wait on a list, as nesting is unbounded."""
        state = self.leaf_state(value)
        if state is not None:
            return state
        # Each entry: container, iterator of its (key, child), states of the children so far, key of the child that is open.
        open_ = [self._opened(value)]
        while True:
            entry = open_[-1]
            box, children, states, _ = entry
            for key, child in children:
                state = self.leaf_state(child)
                if state is None:
                    entry[3] = key
                    open_.append(self._opened(child))
                    break
                self._note(states, key, state)
            else:
                open_.pop()
                state = self.list_state(states) if isinstance(box, list) else self.object_state(states)
                if not open_:
                    return state
                self._note(open_[-1][2], open_[-1][3], state)

    @staticmethod
    def _opened(box: Any) -> list:
        return [box, iter([(None, x) for x in box]), set(), None] if isinstance(box, list) else [box, iter(box.items()), {}, None]

    @staticmethod
    def _note(states: dict | set, key: str | None, state: str) -> None:
        if isinstance(states, set):
            states.add(state)
        else:
            states[key] = state

    def list_state(self, inner: set[str]) -> str:
        if not inner:
            return "empty_list"
        if inner <= {"string", "null"}:
            return "strings"
        if inner & {"score_tag", "score_name"}:
            return "scores_by_tag" if "score_tag" in inner else "scores_by_name"
        return "list"

    def object_state(self, inner: dict[str, str]) -> str:
        if not inner:
            return "empty_object"
        if "score" in inner:
            if inner.get("tag") == "string":
                return "score_tag"
            if inner.get("name") == "string":
                return "score_name"
            return "score_object"
        if "images" in inner or "subfolders" in inner or "total_images" in inner:
            return "folder"
        if "error" in inner and not any(k in inner for k in (*TAG_RELATIONS, "all_scores")):
            return "image_failed"
        if any(k in inner for k in (*TAG_RELATIONS, "all_scores", "rating")):
            return "image_tagged"
        kinds = set(inner.values())
        if kinds <= {"number"}:
            return "number_map"
        if kinds <= {"number", "null"}:
            return "sparse_number_map"
        if kinds <= {"string", "null"}:
            return "string_map"
        if "score_object" in kinds:
            return "object_map"
        return "object"


def _number(value: Any) -> float | None:
    if isinstance(value, dict):
        value = value.get("score")
    if isinstance(value, bool) or value is None:
        return None
    try:
        return float(value)
    except (TypeError, ValueError, OverflowError):
        return None


class _Walk:
    """Rows of one document, in pre-order."""

    def __init__(self, meta_id: int | None, automaton: ShapeAutomaton):
        self.meta_id, self.auto, self.no, self.rows = meta_id, automaton, 0, []

    def row(self, parent: int, relation: str, variant: str, folder: str | None, image: str, pos: int, item: str | None, number: float | None = None, detail: str | None = None, rating: tuple = (None,) * 4) -> int:
        self.no += 1
        self.rows.append((self.meta_id, self.no, parent, folder, image, pos, item, number, detail, *rating, relation, variant))
        return self.no

    def folder(self, top: dict) -> None:
        """The folder and all below it; an explicit stack, as nesting is unbounded."""
        stack: list[tuple[dict, int, str | None]] = [(top, 0, "")]
        while stack:
            node, parent, above = stack.pop()
            name, images = as_text(node.get("folder")), node.get("images")
            form = "images_keyed" if isinstance(images, dict) else "images_listed" if isinstance(images, list) else "images_none"
            me = self.row(parent, "folder", form, name, "", -1, above, _number(node.get("total_images")), as_text(node.get("sampled")))
            for key, entry in images.items() if isinstance(images, dict) else ((None, x) for x in images) if isinstance(images, list) else ():
                if isinstance(entry, dict):
                    self.image(me, name, key, entry)
            below = node.get("subfolders")
            if isinstance(below, list):
                stack.extend((x, me, name) for x in reversed(below) if isinstance(x, dict))

    def image(self, parent: int, folder: str | None, key: str | None, entry: dict) -> None:
        if key is None:
            key = next((entry[k] for k in ("file", "name") if entry.get(k) is not None), "")
        name, state = as_text(key), self.auto.run(entry)
        rating = entry.get("rating")
        marks = tuple(_number(rating.get(r)) for r in RATINGS) if isinstance(rating, dict) else (None,) * 4
        variant = state if state in ("image_tagged", "image_failed") else "image_other"
        me = self.row(parent, "image", variant, folder, name, -1, "", None, as_text(entry.get("error")), marks)
        for field, relation in TAG_RELATIONS.items():
            tags = entry.get(field)
            if isinstance(tags, list):
                shape = self.auto.list_state({self.auto.run(x) for x in tags})
                for pos, tag in enumerate(tags):
                    if tag is not None:
                        self.row(me, relation, "strings" if shape == "strings" else "mixed", folder, name, pos, as_text(tag))
        scores = entry.get("all_scores")
        if isinstance(scores, dict):
            shape = self.auto.run(scores) if scores else "empty_object"
            for tag, value in scores.items():
                self.row(me, "score", shape, folder, name, -1, as_text(tag), _number(value), as_text(value) if isinstance(value, dict) else None)
        elif isinstance(scores, list):
            shape = self.auto.run(scores)
            for value in scores:
                if isinstance(value, dict):
                    tag = next((value[k] for k in ("tag", "name") if value.get(k) is not None), None)
                    if tag is not None:
                        self.row(me, "score", shape, folder, name, -1, as_text(tag), _number(value))


def document_rows(meta_id: int | None, body: str | None) -> list[tuple]:
    """All rows of one document."""
    value = strict_loads(body)
    walk = _Walk(meta_id, ShapeAutomaton())
    if value is not BAD:
        for top in value if isinstance(value, list) else [value]:
            if isinstance(top, dict):
                walk.folder(top)
    return walk.rows


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=NODE_SCHEMA.names)
    return out.astype({"meta_id": "Int64", "node_no": "Int64", "parent_no": "Int64", "pos": "Int32", "number": "float64"})


def _parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        held: list[tuple] = []
        for meta_id, body in zip(batch["meta_id"], batch["body"]):
            held += document_rows(None if pd.isna(meta_id) else int(meta_id), body)
            if len(held) > 20_000:
                yield _frame(held)
                held = []
        if held:
            yield _frame(held)


@dataclass
class NestedTables:
    """Typed tables of a set of nested documents, routed by relation and variant."""

    nodes: DataFrame

    def _of(self, relation: str, *columns: str) -> DataFrame:
        return self.nodes.where(F.col("relation") == relation).select("meta_id", "node_no", "parent_no", *columns).distinct()

    def folders(self) -> DataFrame:
        return self._of("folder", "folder", F.col("item").alias("enclosing"), F.col("number").cast("long").alias("total_images"), F.col("detail").try_cast("long").alias("sampled"), "variant")

    def images_tagged(self) -> DataFrame:
        return self._of("image", "folder", "image_name", *[f"rating_{r}" for r in RATINGS], "variant").where("variant = 'image_tagged'")

    def images_failed(self) -> DataFrame:
        return self._of("image", "folder", "image_name", F.col("detail").alias("error"), "variant").where("variant = 'image_failed'")

    def images(self) -> DataFrame:
        return self._of("image", "folder", "image_name", "variant")

    def tags(self, relation: str = "general_tag") -> DataFrame:
        return self._of(relation, "folder", "image_name", "pos", F.col("item").alias("tag"))

    def scores(self) -> DataFrame:
        return self._of("score", "folder", "image_name", F.col("item").alias("tag"), F.col("number").alias("score"), "variant")

    def supertype(self) -> DataFrame:
        """The distinct rows of all relations, in their common columns."""
        return self.nodes.select(*SUPERTYPE).distinct()


def flatten_documents(files: DataFrame) -> NestedTables:
    """Flat tables of ``files(meta_id, body)``; parsed and written once."""
    parsed = files.select(F.col("meta_id").cast("long"), F.col("body").cast("string")).mapInPandas(_parse, NODE_SCHEMA)
    return NestedTables(materialize(parsed, "nested", ["relation", "variant"]))
