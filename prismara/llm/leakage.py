"""Evaluation texts leaking into training text, by template windows.

Every word is canonicalised on its own: numbers, units and names become typed
placeholders, so equal word windows always have equal templates. Windows of both
sides meet in a hash join on their template; then slots are checked. Equal words are
an exact leak, so exact leaks are never lost. A re-parameterised one is an occurrence (windows
of one item at one distance in the text) in which each word of the item is replaced by one
word of its type and no two by the same, over all its windows together, at least one is
replaced, and the template has enough plain words of its own: ``PLAIN`` and half of its width.

Names are words that the evaluation texts write with a capital, and not first in a
sentence, every time; texts that write over ``NOUNS`` of their words so (as German does with
all nouns) and scripts without capitals tell no names. More than ``max_names`` are not sent to the tasks but joined to
the texts by word. The corpus is filtered by a sorted array of the items' window
hashes while that has at most ``max_filter`` entries (8 bytes each); beyond it the hashes
of the corpus' windows are joined with the items' first, and only those that meet carry words.

Defined cases: null, empty and wordless texts have no window; items of fewer than
``width`` words count as a whole; repeated documents are found each; null ids are
kept; an empty side gives no row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismara.session import materialize

WIDTH = 12
MAX_FILTER, MAX_NAMES = 2_000_000, 100_000
#: Plain words that a template needs to tell a re-parameterised leak, and the share of capitals above which a text tells no names.
PLAIN, NOUNS = 4, 0.25
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_DIGITS = regex.compile(r"\p{N}+")
_SENTENCE = regex.compile(r"[.!?:\n]\s*\P{L}*$|^\P{L}*$")

# Number words and units of measure. A unit may stand at the end of a number ("20px"); signs such as % are no words.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand "
    "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn zwanzig dreißig hundert tausend "
    "zéro deux trois quatre cinq sept huit neuf dix onze douze treize vingt trente cent mille "
    "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece veinte treinta cien mil "
    "due tre quattro cinque sei sette otto nove dieci undici dodici venti trenta cento "
    "dois três quatro sete oito dez doze vinte trinta cem "
    "ноль один два три четыре пять шесть семь восемь девять десять двенадцать двадцать тридцать сто тысяча".split()
)
UNITS = frozenset("px pixel pixels mm cm m km g kg mg s ms min h kb mb gb tb kib mib gib hz khz mhz ghz dpi fps v w kw ml l".split())
_WITH_UNIT = regex.compile(r"\p{N}+(" + "|".join(sorted(UNITS)) + ")")

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def words_of(text: str | None) -> list[str]:
    """The longest runs of letters and digits, in lower case."""
    return [w.lower() for w in _WORD.findall(text)] if text else []


class Canon(NamedTuple):
    """Template token of a word: a function of the lower-case word alone."""

    names: frozenset

    def __call__(self, word: str) -> str:
        if word in NUMBER_WORDS or _DIGITS.fullmatch(word):
            return "<number>"
        if _WITH_UNIT.fullmatch(word):
            return "<number><unit>"
        if word in UNITS:
            return "<unit>"
        return "<name>" if word in self.names else word


def _hashes(words: list[str], canon: Canon, known: dict[str, int]) -> np.ndarray:
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(canon(w))
    return np.fromiter((known[w] for w in words), np.uint64, len(words))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash, modulo 2^64, of every window of ``width`` values."""
    n = len(h)
    if n < width:
        return np.empty(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(n, _BASE), dtype=np.uint64)])
    return (sums[width:] - sums[:-width]) * _powers(n - width + 1, _INVERSE)


def name_table(items: DataFrame) -> DataFrame:
    """``word``: the names in the items."""

    def spans(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                own = []
                for m in _WORD.finditer(text) if isinstance(text, str) else ():
                    w = m.group()
                    if _SENTENCE.search(text[max(0, m.start() - 12) : m.start()]):
                        continue
                    own.append((w.lower(), int(w[0].isupper() and not w.isupper())))
                nouns = sum(c for _, c in own) > NOUNS * len(own)
                rows += [(w, 0 if nouns else c, 0 if nouns else 1 - c) for w, c in own]
            yield pd.DataFrame(rows, columns=["word", "upper", "other"])

    seen = items.select("text").mapInPandas(spans, "word string, upper long, other long").groupBy("word").agg(F.sum("upper").alias("upper"), F.sum("other").alias("other"))
    return seen.where("upper > 0 AND other = 0 AND length(word) > 1").select("word")


def find_names(names: DataFrame, limit: int) -> frozenset | None:
    """The names as a set, or None where they are more than ``limit``."""
    found = names.limit(limit + 1).collect()
    return frozenset(r["word"] for r in found) if len(found) <= limit else None


def _own_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``texts`` with the names that each holds in ``names``, by a join on word."""

    def words(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(row, w) for row, text in zip(batch["row"], batch["text"]) if isinstance(text, str) for w in dict.fromkeys(words_of(text))]
            yield pd.DataFrame(rows, columns=["row", "word"])

    numbered = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "numbered")
    held = numbered.select("row", "text").mapInPandas(words, "row long, word string").join(names, "word", "left_semi")
    return numbered.join(held.groupBy("row").agg(F.collect_list("word").alias("names")), "row", "left").drop("row")


WINDOW = "id long, width int, template long, pos int, plain int, words array<string>"


def _windows(id_column: str, canon: Canon, widths: list[int] | None, keep: dict[int, np.ndarray] | None, width: int):
    """Windows of a batch of texts. ``widths`` None: an item's own (``width``, or all of a shorter one)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            rows: list[tuple] = []
            if len(known) > 500_000:
                known = {}
            for key, text, own in zip(batch[id_column], batch["text"], batch["names"] if "names" in batch else [None] * len(batch)):
                words = words_of(text) if isinstance(text, str) else []
                if not words:
                    continue
                own_canon = canon if own is None else Canon(frozenset(own))
                h = _hashes(words, own_canon, known if own is None else {})
                for w in [min(width, len(words))] if widths is None else widths:
                    rolled = rolling(h, w)
                    at = np.arange(len(rolled))
                    if keep is not None:
                        sorted_ = keep[w]
                        found = np.minimum(np.searchsorted(sorted_, rolled), len(sorted_) - 1)
                        at = np.flatnonzero(sorted_[found] == rolled)
                    if len(at):
                        plain = np.concatenate([[0], np.cumsum([own_canon(x) == x for x in words])])
                        rows += [(key, w, int(t), i, int(plain[i + w] - plain[i]), words[i : i + w]) for i, t in zip(at.tolist(), rolled[at].view(np.int64).tolist())]
                    if len(rows) > 50_000:
                        yield _frame(rows)
                        rows = []
            if rows:
                yield _frame(rows)

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["id", "width", "template", "pos", "plain", "words"]).astype({"id": "Int64"})

    return run


def leaks(documents: DataFrame, items: DataFrame, width: int = WIDTH, max_filter: int = MAX_FILTER, max_names: int = MAX_NAMES) -> DataFrame:
    """``doc_id, item_id, kind, windows``: kind ``exact`` or ``reparameterised``; the number of distinct windows."""
    names = materialize(name_table(items), "names")
    few = find_names(names, max_names)
    canon = Canon(few or frozenset())
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    if few is None:
        texts = _own_names(texts, names)
    own = materialize(texts.mapInPandas(_windows("item_id", canon, None, None, width), WINDOW), "items")
    widths = sorted(r["width"] for r in own.select("width").distinct().collect())  # at most `width` values
    hashes = own.select("width", "template").distinct()
    keep = None
    if hashes.limit(max_filter + 1).count() <= max_filter:
        keep = {}
        for w, t in hashes.collect():
            keep.setdefault(w, []).append(t)
        keep = {w: np.sort(np.array(t, np.int64).view(np.uint64)) for w, t in keep.items()}
    corpus = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if few is None:
        corpus = _own_names(corpus, names)
    if keep is None:
        corpus = _that_meet(corpus, hashes, canon, widths, width)
    found = corpus.mapInPandas(_windows("doc_id", canon, widths, keep, width), WINDOW).select(F.col("id").alias("doc_id"), "width", "template", F.col("pos").alias("at"), F.col("words").alias("there"))
    pairs = found.join(own.withColumnRenamed("id", "item_id"), ["width", "template"])
    exact = F.col("there") == F.col("words")
    alike = pairs.select("doc_id", "item_id", "pos", F.when(exact, "exact").otherwise("reparameterised").alias("kind"), (F.col("at") - F.col("pos")).alias("distance"), "width", "plain", F.arrays_zip("there", "words").alias("slots"))
    same = alike.where("kind = 'exact'").groupBy("doc_id", "item_id", "kind").agg(F.count_distinct("pos").alias("windows"))
    # An occurrence has at most as many windows as its item. Windows without a change count for its consistency, too.
    whole = alike.groupBy("doc_id", "item_id", "distance").agg(F.flatten(F.collect_list("slots")).alias("slots"), F.collect_set(F.when((F.col("kind") != "exact") & (F.col("plain") >= F.greatest(F.lit(PLAIN), F.col("width") / 2)), F.col("pos"))).alias("changed"))
    pair = F.array_distinct("slots")
    one_to_one = (F.size(pair) == F.size(F.array_distinct(F.transform("slots", lambda p: p["there"])))) & (F.size(pair) == F.size(F.array_distinct(F.transform("slots", lambda p: p["words"]))))
    other = whole.where((F.size("changed") > 0) & one_to_one).select("doc_id", "item_id", F.explode("changed").alias("pos"))
    return same.unionByName(other.groupBy("doc_id", "item_id").agg(F.count_distinct("pos").alias("windows")).select("doc_id", "item_id", F.lit("reparameterised").alias("kind"), "windows"))


def _that_meet(corpus: DataFrame, hashes: DataFrame, canon: Canon, widths: list[int], width: int) -> DataFrame:
    """The texts of which some window's hash is one of ``hashes``; hashes alone are shuffled."""
    numbered = materialize(corpus.withColumn("row", F.monotonically_increasing_id()), "corpus")
    run = _windows("doc_id", canon, widths, None, width)

    def slim(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in run([batch.assign(doc_id=batch["row"])]):
                yield part[["id", "width", "template"]].drop_duplicates()

    met = numbered.drop("doc_id").withColumn("doc_id", F.col("row")).mapInPandas(slim, "id long, width int, template long").join(hashes, ["width", "template"], "left_semi").select(F.col("id").alias("row")).distinct()
    return numbered.join(met, "row", "left_semi").drop("row")
