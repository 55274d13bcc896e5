"""Garbled text: code-page swaps as substitution ciphers, solved by expectation-maximisation.

A swap writes text in one encoding and reads it in another, which replaces letters
by other letters. Which cipher was used is unknown; it is latent for every stretch
(a run without blanks that holds a non-ASCII character). Each source has its own
distribution over ciphers, shrunk towards that of all sources.

* Language model: bigrams of lower-case characters, and of their classes (block, case), over all texts, in a hashed table
  that is counted again at four times its size while more than ``FULL`` of its places are taken (from ``TABLE`` to ``MOST_TABLE`` counts).
* E step: a stretch's posterior over "as it is" and every letter mapping that can be
  undone, from the bigram likelihood of the restored stretch and the source's ciphers.
* M step: the sources' cipher weights (counted over different stretches, so that a frequent
  one can't make its own cipher likely), then the bigrams themselves: garbled stretches
  are taken out of the counts and their restorations put in.

The learned byte-to-letter mapping is applied with ``str.translate``: a table takes
each character to its byte, another each byte to its letter; bytes of multi-byte
encodings are regrouped. Restoring repeats for stretches garbled more than once.
A replacement character (U+FFFD) is a symbol that no cipher makes and no language has: it marks text whose bytes were lost when it was read in
a wrong encoding. Its cipher is ``LOST_KEY``, which restores nothing.

Defined cases: null, empty and pure ASCII texts are never garbled; null sources form
one source; repeated documents are found each; an empty table gives no row; extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismara.session import materialize, sized

# Public encodings that texts are written or read in.
SINGLE = ("cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "cp1254", "mac_roman", "cp437", "cp850", "cp866", "koi8-r", "cp1253", "iso8859-5")
MULTI = ("utf-8", "cp932", "euc_jp", "gb18030", "big5", "euc_kr")
MULTI_READ = ("cp932", "euc_jp", "gbk", "big5", "euc_kr")

TABLE, MOST_TABLE, FULL = 1 << 20, 1 << 24, 0.5
SMOOTH, ALPHABET = 2.0, 3000.0
PRIOR, SHRINK = 0.02, 300.0
#: Passes of expectation-maximisation, and those after which bigrams are counted anew.
PASSES, RECOUNT = 4, (1, 3)
#: Restorations less likely than the stretch by more than this are dropped before the first pass; the last pass asks for more than -2.
KEEP_GAIN = -6.0
#: A restoration must consist of bigrams that occur in the texts at least to this share; else it is only less unlikely.
ATTESTED = 0.5
LOST_GAIN = 50.0
LOST = "�"
_STRETCH = regex.compile(r"[^ \t\r\n]+")
_NON_ASCII = regex.compile(r"[^\x00-\x7f]")
_SEQUENCE = regex.compile("([\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})")
_HIDE = 0xF0000


@cache
def byte_letters(page: str) -> dict[int, str]:
    """The letters of a page's bytes from 0x80 on; undefined bytes stand for control characters, as readers do."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(page)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


@cache
def letter_bytes(page: str) -> dict[int, str]:
    """Translation table: letter to byte (as the character of that number)."""
    return {ord(c): chr(b) for b, c in reversed(byte_letters(page).items())}


@cache
def _hiding(page: str) -> dict[int, str]:
    table = letter_bytes(page)
    return table | {c: chr(_HIDE + c) for c in range(0x80, 0x100) if c not in table}


@cache
def _back(page: str) -> dict[int, str]:
    return byte_letters(page) | {_HIDE + c: chr(c) for c in range(0x80, 0x100)}


def undo(text: str, written: str, read: str) -> str | None:
    """``text`` as it was before it was written as ``written`` and read as ``read``; None if that can't be."""
    if written == "utf-8" and read not in MULTI_READ:
        parts = _SEQUENCE.split(text.translate(_hiding(read)))
        if len(parts) == 1:
            return None
        out, back = [], _back(read)
        for i, part in enumerate(parts):
            if i % 2:
                try:
                    out.append(part.encode("latin-1").decode("utf-8"))
                    continue
                except UnicodeDecodeError:
                    pass
            out.append(part.translate(back))
        restored = "".join(out)
        return restored if restored != text else None
    raw = as_bytes(text, read)
    if raw is None:
        return None
    restored = decoded(raw, written)
    return restored if restored != text else None


def as_bytes(text: str, read: str) -> bytes | None:
    """The bytes that ``text`` was read from, or None."""
    try:
        if read in MULTI_READ:
            return text.encode(read)
        return text.translate(_refusing(read)).encode("latin-1")
    except UnicodeEncodeError:
        return None


@cache
def _refused(read: str) -> dict[int, str]:
    """Characters of the upper half of Latin-1 that the page hasn't: they would pass as bytes."""
    table = letter_bytes(read)
    return {c: LOST for c in range(0x80, 0x100) if c not in table}


@cache
def _refusing(read: str) -> dict[int, str]:
    return letter_bytes(read) | _refused(read)


def decoded(raw: bytes, written: str) -> str | None:
    if written in MULTI:
        try:
            return raw.decode(written)
        except UnicodeDecodeError:
            return None
    return raw.decode("latin-1").translate(byte_letters(written))


KEYS = [(w, r) for r in SINGLE for w in (*MULTI, *SINGLE) if w != r] + [(w, r) for r in MULTI_READ for w in MULTI if w != r and (w, r) != ("gb18030", "gbk")]
KEY_NUMBER = {k: i for i, k in enumerate(KEYS)}
LOST_KEY = len(KEYS)
#: Kanji and Hangul stand for anything, so what a reader of many bytes made must be this long to tell.
LEAST_WIDE = 3


def restorations(stretch: str) -> dict[str, list[int]]:
    """Every different restoration of a stretch, with the numbers of the swaps that give it."""
    out: dict[str, list[int]] = {}

    def keep(restored: str | None, key: tuple[str, str]) -> bool:
        if restored is None or restored == stretch or any(0xF0000 <= ord(c) or c == LOST for c in restored):
            return False
        out.setdefault(restored, []).append(KEY_NUMBER[key])
        return True

    for read in SINGLE:
        # Only a swap that lengthens text can be told apart when it happened again.
        restored = undo(stretch, "utf-8", read)
        while keep(restored, ("utf-8", read)):
            restored = undo(restored, "utf-8", read)
        raw = as_bytes(stretch, read)
        if raw is not None:
            for written in (*MULTI[1:], *SINGLE):
                if written != read:
                    keep(decoded(raw, written), (written, read))
    if len(stretch) >= LEAST_WIDE and any(c > "\u2e7f" for c in stretch):
        for read in MULTI_READ:
            raw = as_bytes(stretch, read)
            if raw is not None:
                for written in MULTI:
                    if (written, read) in KEY_NUMBER:
                        keep(decoded(raw, written), (written, read))
    return out


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point below 0x10000: its lower case, and its class as a number beyond Unicode.

    Classes tell blocks of 128 characters apart (of CJK: all one), letters from others, and cases.
    """
    lower, kind = np.arange(0x10000), np.zeros(0x10000, np.int64)
    for c in range(0x10000):
        ch = chr(c)
        block = 0x1FF if c >= 0x3400 else 0 if ch.isalpha() and c < 0x250 else c >> 7
        kind[c] = 0x110000 + 8 * block + (3 if ch.isupper() else 2 if ch.islower() else 1 if ch.isalpha() else 0)
        if ch.isupper() and len(ch.lower()) == 1:
            lower[c] = ord(ch.lower())
    lower[[9, 10, 13]] = 32
    lower[48:58] = 48
    return lower, kind


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text in lower case (blanks and digits are one character each), and their classes."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    lower, kind = _letters()
    small = np.minimum(c, 0xFFFF)
    return np.where(c < 0x10000, lower[small], c), kind[small]


def _bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after the other, each between two blanks: characters, classes, and where each text starts."""
    both = [_codes(f" {t} ") for t in texts]
    starts = np.cumsum([0, *(len(c) for c, _ in both)])
    return np.concatenate([c for c, _ in both]), np.concatenate([k for _, k in both]), starts


def _mixed(x: np.ndarray, size: int) -> np.ndarray:
    """Table places of 64-bit numbers, well mixed."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(33))) % np.uint64(size)).astype(np.int64)


def _slots(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Table places of bigrams and of their first characters."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    return _mixed((a << np.uint64(32)) + b + np.uint64(1), size), _mixed(a, size)


class Bigrams:
    """Counts of bigrams and characters in two hashed tables."""

    def __init__(self, pairs: np.ndarray, ones: np.ndarray):
        self.size = len(pairs)
        self.pairs, self.ones, self.total = np.maximum(pairs, 0), np.maximum(ones, 0), max(float(ones.sum()), 1.0)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each text between two blanks, and the share of its non-ASCII bigrams that were ever seen."""
        if not texts:
            return np.empty(0), np.empty(0)
        flat, kinds, starts = _bigrams(texts)
        pair, one = _slots(flat[:-1], flat[1:], self.size)
        _, second = _slots(flat[1:], flat[1:], self.size)
        unigram = (self.ones[second] + 0.2) / (self.total + 0.2 * ALPHABET)
        seen = self.pairs[pair] >= 0.5
        logs = np.log((self.pairs[pair] + SMOOTH * unigram) / (self.ones[one] + SMOOTH))
        pair, one = _slots(kinds[:-1], kinds[1:], self.size)
        logs += np.log((self.pairs[pair] + 0.1) / (self.ones[one] + 2.0))
        logs = np.minimum(logs, 0.0)  # places of the table may be shared
        logs[starts[1:-1] - 1] = 0.0  # from one text to the next
        telling = (flat[:-1] > 0x7F) | (flat[1:] > 0x7F)
        telling[starts[1:-1] - 1] = False

        def per_text(x: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0.0], np.cumsum(x)])
            return sums[starts[1:] - 1] - sums[starts[:-1]]

        return per_text(logs), per_text(telling & seen) / np.maximum(per_text(telling), 1)


class _Counts:
    """Weighted counts of bigrams of characters and of classes."""

    def __init__(self, size: int):
        self.size = size
        self.pairs, self.ones = np.zeros(size), np.zeros(size)

    def add(self, texts: list[str], weights: list[float] | None = None) -> None:
        for start in range(0, len(texts), 2000):
            part = texts[start : start + 2000]
            flat, kinds, starts = _bigrams(part)
            w = None if weights is None else np.repeat(weights[start : start + 2000], np.diff(starts))[:-1]
            inside = np.ones(len(flat) - 1)
            inside[starts[1:-1] - 1] = 0
            w = inside if w is None else w * inside
            for values in (flat, kinds):
                pair, one = _slots(values[:-1], values[1:], self.size)
                self.pairs += np.bincount(pair, w, self.size)
                self.ones += np.bincount(one, w, self.size)

    def frame(self) -> pd.DataFrame:
        p, o = np.flatnonzero(self.pairs), np.flatnonzero(self.ones)
        return pd.DataFrame({"table": np.repeat([0, 1], [len(p), len(o)]).astype(np.int32), "slot": np.concatenate([p, o]), "n": np.concatenate([self.pairs[p], self.ones[o]])})


COUNTS = "table int, slot long, n double"


def _gather(counts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two tables, each of ``size`` numbers."""
    summed = counts.groupBy("table", "slot").agg(F.sum("n").alias("n")).toPandas()
    out = []
    for t in (0, 1):
        part = summed[summed["table"] == t]
        full = np.zeros(size)
        full[part["slot"].to_numpy(np.int64)] = part["n"]
        out.append(full)
    return out[0], out[1]


def _count_all(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams and characters of all texts, in tables that are large enough to keep them apart."""
    size = TABLE
    while True:

        def count(batches: Iterable[pd.DataFrame], size=size) -> Iterator[pd.DataFrame]:
            counts = _Counts(size)
            for batch in batches:
                counts.add([t for t in batch["text"] if isinstance(t, str)])
            yield counts.frame()

        pairs, ones = _gather(texts.select("text").mapInPandas(count, COUNTS), size)
        if size >= MOST_TABLE or (pairs > 0).mean() <= FULL:
            return pairs, ones
        size *= 4


def _stretches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches with a non-ASCII character, counted per source before they are shuffled."""
    for batch in batches:
        held: Counter = Counter()
        for source, text in zip(batch["source"], batch["text"]):
            if isinstance(text, str) and not text.isascii():
                held.update((source, s) for s in _STRETCH.findall(text) if not s.isascii())
        yield pd.DataFrame([(s, t, n) for (s, t), n in held.items()], columns=["source", "stretch", "n"])


OPTION = "restored array<string>, keys array<array<int>>"
CANDIDATES = f"source string, stretch string, n long, spread long, {OPTION}, total long"
FOUND = "source string, stretch string, n long, restored string, key int, posterior double"


def _options(model):
    """All restorations of each stretch that are not hopeless and consist of what the texts attest; a lost character is one that restores nothing."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm = Bigrams(*model.value)
        for batch in batches:
            found = {s: restorations(s) for s in batch["stretch"]}
            texts = list(dict.fromkeys([*found, *(r for f in found.values() for r in f)]))
            likelihood, seen = lm.score(texts)
            score, known = dict(zip(texts, likelihood)), dict(zip(texts, seen))
            rows = []
            for s in batch["stretch"]:
                good = [(r, k) for r, k in found[s].items() if score[r] - score[s] > KEEP_GAIN and (known[r] >= ATTESTED or r.isascii())]
                if LOST in s:
                    good.append((None, [LOST_KEY]))
                if good:
                    rows.append((s, [r for r, _ in good], [k for _, k in good]))
            if rows:
                yield pd.DataFrame(rows, columns=["stretch", "restored", "keys"])

    return run


def _gains(lm: Bigrams, batch: pd.DataFrame) -> list[np.ndarray]:
    """Gain in log likelihood of each restoration."""
    texts = list(dict.fromkeys([*batch["stretch"], *(r for o in batch["restored"] for r in o if r is not None)]))
    score = dict(zip(texts, lm.score(texts)[0]))
    return [np.array([LOST_GAIN if r is None else score[r] - score[s] for r in o]) for s, o in zip(batch["stretch"], batch["restored"])]


def _posteriors(weights: np.ndarray, keys, gain) -> np.ndarray:
    """Posterior of each restoration; what is left is the stretch as it is."""
    w = np.array([weights[k].sum() for k in keys]) * np.exp(np.minimum(gain, 500.0))
    return w / (w.sum() + max(1 - weights.sum(), 0.1))


class _Weights:
    """Cipher weights of each source, shrunk towards those of all sources."""

    def __init__(self, overall: np.ndarray):
        self.overall, self.held = overall, {}

    def __call__(self, source: str, total: int, expected) -> np.ndarray:
        if source not in self.held:
            own = np.zeros(len(self.overall))
            for e in expected if expected is not None else ():
                # What goes beyond a single stretch: none is evidence for itself.
                own[e["key"]] = max(e["w"] - 1.0, 0.0)
            if len(self.held) > 10_000:
                self.held.clear()
            self.held[source] = (own + SHRINK * self.overall) / (total + SHRINK)
        return self.held[source]


PASS = "source string, key int, w double, t double, table int, slot long, n double"


def _expect(model, overall: np.ndarray, recount: bool):
    """One pass: the expected uses of each cipher by each source and, at a recount, the bigrams that move."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm, weights = Bigrams(*model.value), _Weights(overall)
        sums: dict[tuple[str, int], list[float]] = {}
        counts = _Counts(lm.size) if recount else None
        for batch in batches:
            moved: tuple[list, list, list] = ([], [], [])
            for source, stretch, n, spread, restored, keys, total, expected, gain in zip(*(batch[c] for c in ("source", "stretch", "n", "spread", "restored", "keys", "total", "expected")), _gains(lm, batch)):
                own = weights(source, total, expected)
                p = _posteriors(own, keys, gain)
                for k, q in zip(keys, p):
                    share = own[k]
                    for key, s in zip(k.tolist(), (q * share / share.sum()).tolist()):
                        held = sums.setdefault((source, key), [0.0, 0.0])
                        held[0] += s
                        held[1] += s / spread
                if recount and p.sum() > 0.5 and restored[int(p.argmax())] is not None:
                    for box, x in zip(moved, (stretch, restored[int(p.argmax())], float(n * p.sum()))):
                        box.append(x)
            if recount:
                counts.add(moved[0], [-w for w in moved[2]])
                counts.add(moved[1], moved[2])
        rows = pd.DataFrame([(*k, *w) for k, w in sums.items()], columns=["source", "key", "w", "t"])
        yield rows.assign(table=-1, slot=0, n=0.0).astype({"key": "int32", "table": "int32"})
        if recount:
            frame = counts.frame()
            yield frame.assign(source="", key=-1, w=0.0, t=0.0)[[c.split()[0] for c in PASS.split(", ")]].astype({"key": "int32"})

    return run


def _decide(model, overall: np.ndarray):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm, weights = Bigrams(*model.value), _Weights(overall)
        for batch in batches:
            rows = []
            for source, stretch, n, restored, keys, total, expected, gain in zip(*(batch[c] for c in ("source", "stretch", "n", "restored", "keys", "total", "expected")), _gains(lm, batch)):
                own = weights(source, total, expected)
                p = np.where(gain > -2.0, _posteriors(own, keys, gain), 0.0)
                if p.sum() > 0.5:
                    j = int(p.argmax())
                    rows.append((source, stretch, n, restored[j], int(keys[j][int(own[keys[j]].argmax())]), float(p.sum())))
            yield pd.DataFrame(rows, columns=["source", "stretch", "n", "restored", "key", "posterior"])

    return run


def solve(documents: DataFrame) -> DataFrame:
    """``source, stretch, n, restored, key, posterior`` of every stretch that is more likely garbled than not; of a lost one ``restored`` is null."""
    spark = documents.sparkSession
    texts = documents.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text").where("text IS NOT NULL")
    base = _count_all(texts)
    stretches = materialize(texts.mapInPandas(_stretches, "source string, stretch string, n long").groupBy("source", "stretch").agg(F.sum("n").alias("n")), "stretches")
    totals = stretches.groupBy("source").agg(F.sum("n").alias("total"))
    model = spark.sparkContext.broadcast(tuple(x.astype(np.float32) for x in base))
    # Each distinct stretch is undone once. They are few bytes and much work, so they are spread over all tasks, whatever their size.
    distinct = stretches.groupBy("stretch").agg(F.count("*").alias("spread")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    options = materialize(distinct.mapInPandas(_with_spread(_options(model)), f"stretch string, {OPTION}, spread long"), "options")
    types = distinct.count()
    found = stretches.join(options, "stretch").join(sized(totals, "totals")[0], "source")
    found = materialize(found.select(*(c.split()[0] for c in CANDIDATES.split(", "))), "candidates")
    size = len(KEYS) + 1
    overall = np.full(size, PRIOR / size)
    informed = found.withColumn("expected", F.lit(None).cast("array<struct<key:int,w:double>>"))
    for step in range(PASSES):
        out = materialize(informed.mapInPandas(_expect(model, overall, step in RECOUNT), PASS), "pass")
        expected = out.where("key >= 0").groupBy("source", "key").agg(F.sum("w").alias("w"), F.sum("t").alias("t"))
        expected = materialize(expected, "expected")
        sums = {r["key"]: r["t"] for r in expected.groupBy("key").agg(F.sum("t").alias("t")).collect()}  # at most len(KEYS) + 1 rows
        overall = np.array([(max(sums.get(i, 0.0) - 1.0, 0.0) + PRIOR / size) / (types + 1.0) for i in range(size)])  # beyond one stretch
        lists, _ = sized(expected.where("w > 1").groupBy("source").agg(F.collect_list(F.struct("key", "w")).alias("expected")), "weights")
        informed = found.join(lists, "source", "left")
        if step in RECOUNT:
            moved = _gather(out.where("table >= 0").select("table", "slot", "n"), len(base[0]))
            model = spark.sparkContext.broadcast(tuple((x + y).astype(np.float32) for x, y in zip(base, moved)))
    return materialize(informed.mapInPandas(_decide(model, overall), FOUND), "solved")


def _with_spread(run):
    """Passes the number of sources of each stretch on."""

    def both(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for out in run([batch]):
                yield out.merge(batch, on="stretch")

    return both


def _by_document(documents: DataFrame) -> DataFrame:
    """Distinct stretches with a non-ASCII character of each row; ``lost`` says that bytes were lost."""
    spans = F.filter(F.regexp_extract_all("text", F.lit(r"[^ \t\r\n]+"), F.lit(0)), lambda s: s.rlike(r"[^\x00-\x7f]"))
    return documents.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.explode(F.array_distinct(spans)).alias("stretch"))


def garbled_documents(documents: DataFrame) -> DataFrame:
    """``doc_id`` of every document that holds a garbled stretch."""
    solved = solve(documents).select("source", "stretch")
    return _by_document(documents).join(solved, ["source", "stretch"], "left_semi").select("doc_id").distinct()


def restored_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, text, stretches, lost``: garbled documents with what could be restored.

    A stretch garbled several times is undone with its source's ciphers until no
    restoration is found any more.
    """
    numbered = materialize(documents.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", "text"), "numbered")
    solved = solve(documents)
    spans = _by_document(numbered.withColumn("doc_id", F.col("rid"))).join(solved.select("source", "stretch", "restored", "key"), ["source", "stretch"])
    per_row = spans.groupBy(F.col("doc_id").alias("rid")).agg(F.collect_list(F.struct("stretch", "restored", "key")).alias("found"))

    @F.pandas_udf("string")
    def rewrite(text: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, f in zip(text, found):
            if f is None:
                out.append(t)
                continue
            known = {x["stretch"]: _again(x["restored"], x["key"]) for x in f if x["restored"] is not None}
            # Where one cipher made nearly all of a text's stretches it made the few others, too, which are too short to tell.
            keys = Counter(x["key"] for x in f if x["restored"] is not None)
            left = {m.group() for m in _STRETCH.finditer(t) if not m.group().isascii()} - known.keys()
            if keys and keys.most_common(1)[0][1] >= max(3, 3 * len(left)):
                key = KEYS[keys.most_common(1)[0][0]]
                known |= {s: r for s in left if (r := undo(s, *key)) is not None and LOST not in s}
            out.append(_STRETCH.sub(lambda m, known=known: known.get(m.group(), m.group()), t))
        return pd.Series(out)

    joined = numbered.join(per_row, "rid", "left").withColumn("lost", F.coalesce(F.contains("text", F.lit(LOST)), F.lit(False)))
    hit = joined.where(F.col("found").isNotNull() | F.col("lost"))
    return hit.select("doc_id", rewrite("text", "found").alias("text"), F.coalesce(F.size(F.filter("found", lambda x: x["restored"].isNotNull())), F.lit(0)).alias("stretches"), "lost")


def _again(text: str, key: int) -> str:
    """Undoes the same swap as long as every non-ASCII character takes part in it."""
    if key == LOST_KEY:
        return text
    written, read = KEYS[key]
    if written != "utf-8":
        return text
    while True:
        nxt = undo(text, written, read)
        if nxt is None or len(_NON_ASCII.findall(nxt)) * 2 > len(_NON_ASCII.findall(text)):
            return text
        text = nxt


def learned_mapping(documents: DataFrame) -> DataFrame:
    """``source, symbol, letter, weight``: the letter mapping learned for each source, from single-letter swaps."""
    solved = solve(documents).where(F.length("stretch") == F.length("restored"))
    letters = F.explode(F.arrays_zip(F.split("stretch", "").alias("symbol"), F.split("restored", "").alias("letter"))).alias("x")
    flat = solved.select("source", (F.col("n") * F.col("posterior")).alias("w"), letters).select("source", "w", "x.symbol", "x.letter")
    return flat.where("symbol <> letter").groupBy("source", "symbol", "letter").agg(F.round(F.sum("w"), 3).alias("weight"))
