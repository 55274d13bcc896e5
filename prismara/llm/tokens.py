"""Encoding of a corpus with a public byte-level BPE, one encoding per distinct word.

Texts are cut into pre-tokens; the corpus' distinct words are counted by a shuffle
and each is encoded once. A document becomes a skeleton: the ids of frequent words
in place, and numbered gaps for the others. Gaps are joined with the word table and
filled by position. Decoding joins ids with the token-byte table.

The frequent words are those that hold at least 1/FREQUENT of all pre-tokens, so
there are at most FREQUENT of them, each of at most FREQUENT_CHARS characters: a
table of proven size that each task gets. With them the hot keys leave the join.

Defined cases: null and empty texts give an empty list; special tokens' strings are
ordinary text; null and repeated ``doc_id``s keep one row per input row; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prismara.session import materialize

#: Folder of the vocabulary files, unless a call names another.
TOKENIZER_DIR = os.environ.get("PRISMARA_TOKENIZERS", "/opt/tokenizers")
FREQUENT, FREQUENT_CHARS = 1000, 64

# The pre-token pattern of the public tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blocks whose letters and digits are the same in every Unicode version that a library may hold.
_BLOCKS = ((0x0, 0x52F), (0x2000, 0x206F), (0x20A0, 0x20BD), (0x2100, 0x214F), (0x2190, 0x23CF), (0x2500, 0x27BF), (0x3000, 0x3096), (0x3099, 0x30FF), (0x4E00, 0x9FCC), (0xAC00, 0xD7A3), (0xFE0F, 0xFE0F), (0xFF01, 0xFF5E), (0xFFFD, 0xFFFD), (0x1F300, 0x1F64F))
_SETTLED = regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _BLOCKS) + "]*")
_PIECES = regex.compile(PATTERN)


@cache
def tokenizer(path: str) -> Tokenizer:
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


def pretokens(text: str, path: str) -> list[str]:
    """The pre-tokens of ``text``; the tokenizer's own cutter decides wherever Unicode versions could differ."""
    if _SETTLED.fullmatch(text):
        return _PIECES.findall(text)
    return [text[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]


@cache
def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def encode_word(word: str, path: str) -> list[int]:
    letters = _byte_letters()
    return [t.id for t in tokenizer(path).model.tokenize("".join(letters[b] for b in word.encode("utf-8")))]


def _path(directory: str, name: str) -> str:
    return os.path.join(directory, name)


def word_table(texts: DataFrame, path: str) -> DataFrame:
    """``word, n, ids``: every distinct pre-token with its count; each is encoded once."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    held.update(pretokens(text, path))
            if len(held) > 200_000:
                yield pa.RecordBatch.from_pydict({"word": list(held.keys()), "n": pa.array(held.values(), pa.int64())})
                held = Counter()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(held.keys()), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode_word(w, path) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    counted = texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(encode, "word string, n long, ids array<int>")


def encode_corpus(documents: DataFrame, directory: str = TOKENIZER_DIR, name: str = "byte_bpe_50k.json") -> DataFrame:
    """``doc_id, ids`` of every row of ``documents(doc_id, text)``."""
    path = _path(directory, name)
    words = materialize(word_table(documents, path), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = {r["word"]: r["ids"] for r in words.where((F.col("n") * FREQUENT >= total) & (F.length("word") <= FREQUENT_CHARS)).select("word", "ids").collect()}
    shared = documents.sparkSession.sparkContext.broadcast({w: tuple(i) for w, i in frequent.items()})

    def skeletons(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document a row with its skeleton (gap k is -k, from 1), and a row for each gap's word."""
        known = shared.value
        for batch in batches:
            # All skeletons of a batch are one flat array of ids; rows of words follow those of documents.
            flat, ends, rid, doc, k = array("i"), [0], [], [], []
            word_rid, word_k, word = [], [], []
            for r, d, text in zip(*(c.to_pylist() for c in batch.columns)):
                gaps: dict[str, int] = {}
                for w in pretokens(text, path) if text else ():
                    ids = known.get(w)
                    if ids is None:
                        flat.append(-gaps.setdefault(w, len(gaps) + 1))
                    else:
                        flat.extend(ids)
                ends.append(len(flat)), rid.append(r), doc.append(d), k.append(len(gaps))
                word_rid += [r] * len(gaps)
                word_k += gaps.values()
                word += gaps
            n, m = len(rid), len(word)
            skeleton = pa.concat_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32))), pa.nulls(m, pa.list_(pa.int32()))])
            columns = [pa.array(rid + word_rid, pa.int64()), pa.array(doc + [None] * m, pa.int64()), pa.array(k + word_k, pa.int32()), pa.array([None] * n + word, pa.string()), skeleton]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "k", "word", "skeleton"])

    numbered = documents.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), "text")
    cut = materialize(numbered.mapInArrow(skeletons, "rid long, doc_id long, k int, word string, skeleton array<int>"), "skeletons")
    gaps = cut.where("word IS NOT NULL").select("rid", "k", "word").join(words.select("word", "ids"), "word")
    filled = gaps.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("gaps"))
    whole = cut.where("word IS NULL")
    ready = whole.where("k = 0").select("doc_id", F.col("skeleton").alias("ids"))
    fill = F.flatten(F.transform("skeleton", lambda x: F.when(x >= 0, F.array(x)).otherwise(F.element_at("gaps", -x)["ids"])))
    return ready.unionByName(whole.where("k > 0").join(filled, "rid").select("doc_id", fill.alias("ids")))


def token_bytes(spark: SparkSession, directory: str = TOKENIZER_DIR, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``id, bytes`` of every token: a vocabulary, so of fixed size."""
    with open(_path(directory, name), "rb") as lines:
        rows = [(int(rank), bytearray(base64.b64decode(token))) for token, rank in (line.split() for line in lines if line.strip())]
    return spark.createDataFrame(rows, "id int, bytes binary")


def decode_corpus(encoded: DataFrame, directory: str = TOKENIZER_DIR) -> DataFrame:
    """``doc_id, text`` of ``encoded(doc_id, ids)``; an empty list gives an empty text."""
    numbered = materialize(encoded.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "ids"), "encoded")
    tokens = F.broadcast(token_bytes(encoded.sparkSession, directory))
    pieces = numbered.select("rid", F.posexplode("ids").alias("pos", "id")).join(tokens, "id")
    texts = pieces.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("bytes").alias("h")))).alias("p"))
    text = F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")), "UTF-8")
    return numbered.join(texts, "rid", "left").select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
