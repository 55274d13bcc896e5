"""The most similar vectors for every vector: a hierarchical k-means tree, searched best bin first.

Vectors that are copies of each other are searched once. A tree is fitted on a
bounded sample (about ``SAMPLE`` rows a node); every row is put in a page of about
``FOLD`` times ``LEAF`` rows. Bins (the tree's leaves) with near centres share a page, so that few
neighbours lie across a border. A page that holds more than ``WIDE`` rows, as one
sample can't tell enough bins apart, gets a tree of its own, tier after tier: pages
have the same size however many rows there are.

A query visits the pages best bin first; a bin's priority is the
greatest lead that another centre has over one on its path. It stops at the first bin
beyond a margin, or after a number of pages. Both are calibrated: a bounded set of
queries is compared with all rows by brute force, the number of pages is widened
(1, 2, 4, ...) until ``TARGET`` of their true neighbours is reached, then the margin
(see ``calibrate``, also for tables with few neighbours of interest). Without bounds every page would be visited; no candidate
within them is dropped.

Rows meet their queries page by page, sent in packs of compressed vectors; pages of more than ``CAP`` rows or queries are
cut into blocks, so no task holds more than two blocks. Cosines that decide are
computed in double precision; ties go to the smaller id.

Defined cases: unusable vectors are left out (see ``usable_vectors``); copies are
neighbours of each other; a kind with a single vector has no neighbour; an empty
table gives no row; fewer than k others give fewer neighbours.
"""

from __future__ import annotations

import functools
import math
import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismara.llm.vectors import IDS, WIDTHS, cosine, distinct_vectors, unit, unpack
from prismara.session import materialize, sized

SAMPLE, BRANCH, LEAF = 5000, 64, 500
#: Sample rows that a bin must rest on; bins fitted for each page; rows at which a page gets a tree of its own.
BACKING, BINS, WIDE = 8, 2, 8000
#: Pages of the search hold so many times LEAF rows: cosines are cheaper than rows sent to several pages.
FOLD = 4
CAP = 6000
#: Cosine of bins' centres from which it is asked whether they are one; it saves work only.
ONE = 0.75
TARGET, QUERIES = 0.999, 300
#: Share of the queries all of whose neighbours lie within the margin ``whole``.
WHOLE = 0.998
#: Neighbours above the similarity of interest that a margin must rest on; with fewer, all nearest neighbours count, whatever their similarity.
BACKED = 500


@dataclass
class Tree:
    """Nodes in arrays: centres (unit length) and children; bins are grouped into pages. Node 0 is the root."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[np.ndarray] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    margin: float = 0.0
    whole: float = 0.0
    most: int = 1

    def add(self, centre: np.ndarray, parent: int) -> int:
        self.centres.append(centre)
        self.children.append(np.empty(0, int))
        self.parent.append(parent)
        return len(self.centres) - 1

    def freeze(self, page: dict[int, int], single: set[int]) -> None:
        """``page`` of every bin; ``single`` are the pages that are not to be divided."""
        self.matrix = np.stack(self.centres).astype(np.float32)
        self.page = np.full(len(self.centres), -1)
        for node, p in page.items():
            self.page[node] = p
        self.pages = int(self.page.max()) + 1
        self.single = single

    def leads(self, u: np.ndarray, node: int) -> np.ndarray:
        """How far each child of ``node`` is behind the best one."""
        s = u @ self.matrix[self.children[node]].T
        return s.max(1, keepdims=True) - s

    def home(self, u: np.ndarray) -> np.ndarray:
        """The page that a greedy descent reaches, for many rows at once."""
        at = np.zeros(len(u), int)
        open_ = np.flatnonzero(self.page[at] < 0)
        while len(open_):
            for node in np.unique(at[open_]):
                rows = open_[at[open_] == node]
                at[rows] = self.children[node][self.leads(u[rows], node).argmin(1)]
            open_ = open_[self.page[at[open_]] < 0]
        return self.page[at]

    def visit(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, page) of every visit: of each query's pages within the margin the first ``most``, best bin first."""
        # Priorities never fall along a path, so sorting the bins gives the order in which a queue would pop them.
        todo = [(0, np.arange(len(u)), np.zeros(len(u), np.float32))]
        found = []
        while todo:
            node, rows, gap = todo.pop()
            if self.page[node] >= 0:
                found.append((rows, np.full(len(rows), self.page[node]), gap))
                continue
            g = np.maximum(self.leads(u[rows], node), gap[:, None])
            for j, kid in enumerate(self.children[node]):
                near = np.flatnonzero(g[:, j] <= self.margin)
                if len(near):
                    todo.append((int(kid), rows[near], g[near, j]))
        q, page, gap = (np.concatenate([f[c] for f in found]) for c in range(3))
        order = np.lexsort((gap, page, q))
        order = order[np.r_[True, (q[order][1:] != q[order][:-1]) | (page[order][1:] != page[order][:-1])]]
        q, page, gap = q[order], page[order], gap[order]
        order = np.lexsort((page, gap, q))
        q, page = q[order], page[order]
        on = np.arange(len(q)) - np.searchsorted(q, q) < self.most
        return q[on], page[on]

    def gaps(self, u: np.ndarray) -> np.ndarray:
        """Of each row and page the least priority of the page's bins."""
        out = np.full((len(u), self.pages), np.inf, np.float32)
        todo = [(0, np.zeros(len(u), np.float32))]
        while todo:
            node, gap = todo.pop()
            if self.page[node] >= 0:
                np.minimum(out[:, self.page[node]], gap, out=out[:, self.page[node]])
                continue
            g = np.maximum(self.leads(u, node), gap[:, None])
            todo += [(int(c), g[:, j]) for j, c in enumerate(self.children[node])]
        return out


    def bound(self, gaps: np.ndarray, query: list[int], page: list[int]) -> float:
        """Sets the bounds from the pages that hold the queries' neighbours; returns the share of neighbours within them."""
        if not query:
            self.margin, self.whole, self.most = 2.0, 2.0, self.pages
            return 1.0
        lead = gaps[query, page]
        place = np.concatenate([(gaps[query[a : a + 4096]] < lead[a : a + 4096, None]).sum(1) for a in range(0, len(query), 4096)])  # pages visited before
        each = (1 + TARGET) / 2  # both bounds together lose no more than 1 - TARGET
        self.most = 1
        while (place < self.most).mean() < each:
            self.most *= 2
        self.margin = float(np.quantile(lead, each, method="higher")) + 1e-6
        self.whole = float(pd.Series(lead).groupby(query).max().quantile(WHOLE, interpolation="higher")) + 1e-6
        return float(((place < self.most) & (lead <= self.margin)).mean())

    def bound_by_sample(self, u: np.ndarray, k: int) -> None:
        """Sets the bounds from neighbours among the sample itself, which are farther than those among all rows, so the bounds are wide."""
        q = np.random.default_rng(5).permutation(len(u))[:QUERIES]
        s = u[q] @ u.T
        s[np.arange(len(q)), q] = -np.inf
        n = min(k, len(u) - 1)
        near = np.argpartition(-s, n - 1, axis=1)[:, :n] if n else np.empty((len(q), 0), int)
        home = self.home(u)
        self.bound(self.gaps(u[q]), np.repeat(np.arange(len(q)), n).tolist(), home[near].ravel().tolist())


def _spread(u: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """Row numbers of ``k`` seeds of unit rows, drawn in proportion to the squared distance from those before."""
    rng = np.random.default_rng(seed)
    order = [int(rng.integers(len(u)))]
    far = np.maximum(2 - 2 * (u @ u[order[0]]), 0)
    for _ in range(min(k, len(u)) - 1):
        total = float(far.sum())
        if total <= 1e-6 * len(u):
            break
        i = min(int(np.searchsorted(np.cumsum(far), rng.random() * total)), len(u) - 1)
        order.append(i)
        np.minimum(far, np.maximum(2 - 2 * (u @ u[i]), 0), out=far)
    return np.array(order)


def kmeans(u: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centres of unit length and labels; empty clusters vanish."""
    centres = u[_spread(u, k)]
    label = (u @ centres.T).argmax(1)
    for _ in range(rounds):
        order = np.argsort(label, kind="stable")
        used, start = np.unique(label[order], return_index=True)
        sums = np.add.reduceat(u[order], start, axis=0)
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        new = (u @ centres.T).argmax(1)
        if len(used) == int(label.max()) + 1 and (new == label).all():
            break
        label = new
    used = np.unique(label)
    return centres[used], np.searchsorted(used, label)


def _paged(centres: np.ndarray, rows: np.ndarray, most: float, joins: Callable[[list[int]], bool] | None) -> list[list[int]]:
    """Bins with near centres share a page of at most ``most`` rows, or more where ``joins`` says that they are one."""
    i, j = np.triu_indices(len(centres), 1)
    near = (centres @ centres.T)[i, j]
    order = np.argsort(-near, kind="stable")
    page, held, size = list(range(len(centres))), {k: [k] for k in range(len(centres))}, dict(enumerate(rows.tolist()))
    for a, b, s in zip(i[order].tolist(), j[order].tolist(), near[order].tolist()):
        p, q = page[a], page[b]
        if p == q or (size[p] + size[q] > most and not (joins is not None and s >= ONE and joins(held[p] + held[q]))):
            continue
        for k in held[q]:
            page[k] = p
        held[p] += held.pop(q)
        size[p] += size.pop(q)
    return [sorted(h) for h in held.values()]


def build_tree(u: np.ndarray, rows: int, divisible: Callable[[np.ndarray], bool] | None = None, leaf: int = LEAF) -> Tree:
    """A tree with pages of about ``leaf`` of ``rows`` rows, of which ``u`` is a sample.

    ``divisible`` may say of a node's rows that they are to stay in one page.
    """
    tree = Tree()
    mean = u.mean(0)
    root = tree.add(mean / max(float(np.linalg.norm(mean)), 1e-9), -1)
    want = int(np.clip(math.ceil(rows / leaf), 1, max(1, len(u) // BACKING)))
    todo = [(root, np.arange(len(u)), want * BINS if want > 1 else 1)]
    bins: dict[int, np.ndarray] = {}
    single = set()
    while todo:
        node, own, n = todo.pop()
        whole = n > 1 and divisible is not None and not divisible(u[own])
        centres, label = kmeans(u[own], min(BRANCH, n, max(1, len(own) // 2))) if n > 1 and not whole else (u[:1], None)
        if len(centres) < 2:
            bins[node] = own
            if whole or n > 1:
                single.add(node)
            continue
        kids = []
        for k, c in enumerate(centres):
            kid = tree.add(c, node)
            kids.append(kid)
            part = own[label == k]
            todo.append((kid, part, round(n * len(part) / len(own))))
        tree.children[node] = np.array(kids)
    nodes = list(bins)
    share = np.array([len(bins[b]) for b in nodes]) * (rows / max(len(u), 1))
    one: dict[tuple, bool] = {}

    def joins(some: list[int]) -> bool:
        key = tuple(sorted(some))
        if key not in one:
            one[key] = not divisible(u[np.concatenate([bins[nodes[k]] for k in some])])
        return one[key]

    most = 1.5 * max(leaf, rows / want)
    pages = _paged(np.stack([tree.centres[b] for b in nodes]), share, most, None if divisible is None else joins)
    undivided = {p for p, held in enumerate(pages) if (len(held) == 1 and nodes[held[0]] in single) or (len(held) > 1 and share[held].sum() > most)}
    tree.freeze({nodes[k]: p for p, held in enumerate(pages) for k in held}, undivided)
    return tree


def fit_trees(vectors: DataFrame, counts: dict[str, int], divisible=None, fold: int = 1) -> dict[str, Tree]:
    """One tree a kind with pages of ``fold`` times LEAF rows, fitted on a sample chosen by hash."""
    sizes = vectors.sparkSession.createDataFrame(list(counts.items()), "kind string, rows long")
    sampled = vectors.join(F.broadcast(sizes), "kind").where(F.pmod(F.xxhash64("feat_id", F.lit(5)), F.col("rows")) < SAMPLE).select("kind", "feat_id", "vec", "rows")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        u = unit(unpack(pdf.sort_values("feat_id")["vec"]))
        return pd.DataFrame({"kind": [pdf["kind"].iloc[0]], "tree": [pickle.dumps(build_tree(u, int(pdf["rows"].iloc[0]), divisible, fold * LEAF))]})

    return {r["kind"]: pickle.loads(r["tree"]) for r in sampled.groupBy("kind").applyInPandas(fit, "kind string, tree binary").collect()}


def _top(s: np.ndarray, rows: np.ndarray, cols: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, least: float = -2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row id, column id and cosine (``least`` or more) of the k best columns of each row of ``s`` (cosines in single precision, own cell -inf), decided in double precision."""
    n = min(k, s.shape[1])
    if not n or not len(s):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    out = []
    for start in range(0, len(s), 256):
        part = s[start : start + 256]
        kth = np.partition(part, part.shape[1] - n, axis=1)[:, part.shape[1] - n, None]
        i, j = np.nonzero(part >= np.maximum(kth - 2e-6, least - 1e-5))
        exact = np.concatenate([cosine(x[start + i[a : a + 2048]], y[j[a : a + 2048]]) for a in range(0, len(i), 2048)]) if len(i) else np.empty(0)
        order = np.lexsort((cols[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = (rank < n) & (exact >= least)
        out.append((rows[start + i[keep]], cols[j[keep]], exact[keep]))
    return tuple(np.concatenate([o[c] for o in out]) for c in range(3))


def calibrate(vectors: DataFrame, trees: dict[str, Tree], counts: dict[str, int], k: int, least: float, queries: int = QUERIES) -> dict[str, float]:
    """Sets each tree's bounds from brute-force neighbours of a bounded set of queries; returns the recall reached.

    The neighbours are those of similarity ``least`` or more among the ``k`` nearest, or,
    if fewer than ``BACKED`` are, all ``k`` nearest. Without any, every page is visited.
    """
    spark = vectors.sparkSession
    sizes = spark.createDataFrame(list(counts.items()), "kind string, rows long")
    chosen = vectors.join(F.broadcast(sizes), "kind").where(F.pmod(F.xxhash64("feat_id", F.lit(9)), F.col("rows")) < queries).select("kind", "feat_id", "vec").collect()
    asked: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # at most about `queries` rows a kind
    for kind in counts:
        own = sorted((r["feat_id"], r["vec"]) for r in chosen if r["kind"] == kind)
        asked[kind] = (np.array([i for i, _ in own], np.int64), unpack([v for _, v in own]))
    shared = spark.sparkContext.broadcast((asked, trees))

    def compare(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each task's rows the k nearest of every query, with the page they are in."""
        asked, trees = shared.value
        best: dict[str, pd.DataFrame] = {}
        for batch in batches:
            for kind, part in batch.groupby("kind", sort=False):
                ids, x = asked[kind]
                if not len(ids):
                    continue
                y, own = unpack(part["vec"]), part["feat_id"].to_numpy()
                v = unit(y)
                s = unit(x) @ v.T
                s[ids[:, None] == own[None, :]] = -np.inf
                q, b, e = _top(s, ids, own, x, y, k)
                near, back = np.unique(b, return_inverse=True)
                page = trees[kind].home(v[pd.Index(own).get_indexer(near)]) if len(near) else np.empty(0, int)
                found = pd.DataFrame({"kind": kind, "q": q, "b": b, "s": e, "page": page[back]})
                found = pd.concat([best[kind], found]) if kind in best else found
                best[kind] = found.sort_values(["q", "s", "b"], ascending=[True, False, True]).groupby("q").head(k)
        yield from best.values()

    near = vectors.select("kind", "feat_id", "vec").mapInPandas(compare, "kind string, q long, b long, s double, page int")
    best = near.groupBy("kind", "q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("d"), "b", "page"))), 1, k).alias("t")).collect()
    reached = {}
    for kind, tree in trees.items():
        ids, x = asked[kind]
        row = {int(q): i for i, q in enumerate(ids)}
        gaps = tree.gaps(unit(x)) if len(ids) else np.empty((0, tree.pages))
        at = [(-t["d"], row[r["q"]], t["page"]) for r in best if r["kind"] == kind for t in r["t"]]
        alike = [a for a in at if a[0] >= least]
        at = alike if len(alike) >= BACKED else at
        reached[kind] = tree.bound(gaps, [q for _, q, _ in at], [p for _, _, p in at])
    return reached


ENTRY = "kind string, node string, feat_id long, vec binary, member boolean, query boolean"
PACK = "kind string, node string, mb int, qb int, ids binary, flags binary, vecs binary"


def _entries(u: np.ndarray, tree: Tree, member: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row number, page, member and query of every page where a row is a member, a query or both."""
    own = np.flatnonzero(member)
    home = np.full(len(u), -1)
    home[own] = tree.home(u[own])
    where = np.flatnonzero(asks)
    q, page = tree.visit(u[where]) if len(where) else (where, where)
    q = where[q]
    other = home[q] != page
    n = int(other.sum())
    return np.r_[own, q[other]], np.r_[home[own], page[other]], np.repeat([True, False], [len(own), n]), np.r_[asks[own], np.ones(n, bool)]


def _names(tree: Tree, prefix: str = "") -> np.ndarray:
    return np.array([f"{prefix}/{p}" + "!" * (p in tree.single) for p in range(tree.pages)], object)


def _placed(part: pd.DataFrame, tree: Tree, prefix: str, member: np.ndarray, asks: np.ndarray) -> pd.DataFrame:
    """ENTRY rows of one tree."""
    i, page, m, q = _entries(unit(unpack(part["vec"])), tree, member, asks)
    return pd.DataFrame({"kind": part["kind"].iloc[0], "node": _names(tree, prefix)[page], "feat_id": part["feat_id"].to_numpy()[i], "vec": part["vec"].to_numpy()[i], "member": m, "query": q})


def squeeze(x: np.ndarray) -> bytes:
    """Rows of float32 as compressed planes of bytes, of the upper halves alone where nothing is lost."""
    planes = np.ascontiguousarray(x, np.float32).view(np.uint8).reshape(-1, 4)
    planes = planes[:, 2:] if not planes[:, :2].any() else planes
    return bytes([planes.shape[1]]) + pa.compress(np.ascontiguousarray(planes.T).tobytes(), "zstd", asbytes=True)


def unsqueezed(packed: bytes, rows: int, width: int) -> np.ndarray:
    n = packed[0]
    planes = np.zeros((rows * width, 4), np.uint8)
    planes[:, 4 - n :] = np.frombuffer(pa.decompress(packed[1:], n * rows * width, "zstd"), np.uint8).reshape(n, -1).T
    return planes.view(np.float32).reshape(rows, width)


def _mixed(ids: np.ndarray, seed: int) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _packs(kind: str, node: np.ndarray, ids: np.ndarray, x: np.ndarray, row: np.ndarray, member: np.ndarray, query: np.ndarray, blocks: dict) -> pd.DataFrame:
    """PACK rows of the entries ``node, row, member, query`` of rows ``x``; ``blocks``: of (kind, node) above CAP its blocks of members and of queries."""
    names, at = np.unique(node, return_inverse=True)
    many = [blocks.get((kind, n), (1, 1)) for n in names]
    m, q = (np.array([b[c] for b in many], np.int64)[at] for c in (0, 1))
    plain = (m == 1) & (q == 1)
    pieces = [(np.flatnonzero(plain), 0, 0, member[plain], query[plain])]
    for as_member, some in ((True, np.flatnonzero(~plain & member)), (False, np.flatnonzero(~plain & query))):
        if len(some):  # a member meets all blocks of queries, a query all of members
            times = (q if as_member else m)[some]
            e = np.repeat(some, times)
            each = np.arange(len(e)) - np.repeat(np.cumsum(times) - times, times)
            fixed = (_mixed(ids[row[e]], 0 if as_member else 1) % (m if as_member else q)[e].astype(np.uint64)).astype(np.int64)
            pieces.append((e, fixed if as_member else each, each if as_member else fixed, np.full(len(e), as_member), np.full(len(e), not as_member)))
    e, mb, qb, is_m, is_q = (np.concatenate([np.broadcast_to(p[c], len(p[0])) for p in pieces]) for c in range(5))
    order = np.lexsort((ids[row[e]], qb, mb, at[e]))
    e, mb, qb, is_m, is_q = e[order], mb[order], qb[order], is_m[order], is_q[order]
    cut = np.flatnonzero(np.r_[True, (at[e][1:] != at[e][:-1]) | (mb[1:] != mb[:-1]) | (qb[1:] != qb[:-1])]) if len(e) else np.empty(0, int)
    flags = (is_m + 2 * is_q).astype(np.uint8)
    out = []
    for a, b in zip(cut, np.r_[cut[1:], len(e)]):
        rows = row[e[a:b]]
        out.append((kind, names[at[e[a]]], int(mb[a]), int(qb[a]), ids[rows].tobytes(), flags[a:b].tobytes(), squeeze(x[rows])))
    return pd.DataFrame(out, columns=["kind", "node", "mb", "qb", "ids", "flags", "vecs"])


def _blocked(sizes: DataFrame) -> DataFrame:
    """Of ``kind, node, members, queries`` above CAP the numbers ``m`` and ``q`` of their blocks."""
    return sizes.where(f"members > {CAP} OR queries > {CAP}").select("kind", "node", *(F.greatest(F.ceil(F.col(c) / CAP), F.lit(1)).cast("int").alias(c[0]) for c in ("members", "queries")))


def descend(rows: DataFrame, trees: dict[str, Tree], k: int) -> DataFrame:
    """PACK rows of ``rows(kind, feat_id, vec, asks)``: each row once for every page where it is a member or a query.

    ``trees`` place them in the first tier; no vector is written for it, rows are routed
    once to count the pages and once to send them. Pages that are still wide get trees
    of their own, which are joined to the rows and not sent to all tasks.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(trees)  # at most BINS * SAMPLE / BACKING centres a kind, and inner ones

    def routed(batches: Iterable[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for kind, part in batch.groupby("kind", sort=False):
                x = unpack(part["vec"])
                tree = shared.value[kind]
                yield kind, tree, part["feat_id"].to_numpy(), x, _entries(unit(x), tree, np.ones(len(part), bool), part["asks"].to_numpy(bool))

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for kind, tree, _, _, (_, page, m, q) in routed(batches):
            yield pd.DataFrame({"kind": kind, "node": _names(tree), "members": np.bincount(page[m], minlength=tree.pages), "queries": np.bincount(page[q], minlength=tree.pages)})

    counted = rows.mapInPandas(count, "kind string, node string, members long, queries long").groupBy("kind", "node").agg(F.sum("members").alias("members"), F.sum("queries").alias("queries"))
    first = counted.collect()  # at most SAMPLE / BACKING pages a kind
    wide = {(r["kind"], r["node"]): r for r in first if r["members"] > WIDE and not r["node"].endswith("!")}
    blocks = {(r["kind"], r["node"]): tuple(max(1, math.ceil(r[c] / CAP)) for c in ("members", "queries")) for r in first if max(r["members"], r["queries"]) > CAP}

    def send(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for kind, tree, ids, x, (row, page, m, q) in routed(batches):
            names = _names(tree)
            on = ~np.array([(kind, n) in wide for n in names])[page]
            yield _packs(kind, names[page[on]], ids, x, row[on], m[on], q[on], blocks)

    done = [rows.mapInPandas(send, PACK)]
    if not wide:
        return done[0]

    def rest(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for kind, tree, ids, x, (row, page, m, q) in routed(batches):
            names = _names(tree)
            on = np.array([(kind, n) in wide for n in names])[page]
            yield pd.DataFrame({"kind": kind, "node": names[page[on]], "feat_id": ids[row[on]], "vec": [v.tobytes() for v in x[row[on]]], "member": m[on], "query": q[on]})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        u = unit(unpack(pdf.sort_values("feat_id")["vec"]))
        tree = build_tree(u, int(pdf["members"].iloc[0]), None, FOLD * LEAF)
        tree.bound_by_sample(u, k)
        if tree.pages < 2:
            tree.single = {0}
        return pdf[["kind", "node"]].iloc[:1].assign(model=[pickle.dumps(tree)])

    def deeper(part: pd.DataFrame, tree: bytes) -> pd.DataFrame:
        return _placed(part, pickle.loads(tree), part["node"].iloc[0], part["member"].to_numpy(bool), part["query"].to_numpy(bool))

    def pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind, part in batch.groupby("kind", sort=False):
                many = {(kind, n): (m, q) for n, m, q in zip(part["node"], part["m"], part["q"])}
                yield _packs(kind, part["node"].to_numpy(), part["feat_id"].to_numpy(), unpack(part["vec"]), np.arange(len(part)), part["member"].to_numpy(bool), part["query"].to_numpy(bool), many)

    open_ = materialize(rows.mapInPandas(rest, ENTRY), "wide")
    while True:
        sizes = materialize(open_.groupBy("kind", "node").agg(F.count_if("member").alias("members"), F.count_if("query").alias("queries"), F.count("*").alias("rows")), "sizes")
        wider, few = sized(sizes.where((F.col("members") > WIDE) & ~F.endswith("node", F.lit("!"))).drop("queries"), "wide")
        small = open_.join(wider, ["kind", "node"], "left_anti") if few else open_
        numbered = small.join(sized(_blocked(sizes), "blocks")[0], ["kind", "node"], "left")
        done.append(numbered.withColumns({c: F.coalesce(c, F.lit(1)) for c in "mq"}).mapInPandas(pack, PACK))
        if not few:
            return functools.reduce(DataFrame.unionByName, done)
        inner = open_.join(wider, ["kind", "node"])
        sampled = inner.where(F.col("member") & (F.pmod(F.xxhash64("feat_id", F.lit(5)), F.col("members")) < SAMPLE))
        fitted = sampled.groupBy("kind", "node").applyInPandas(fit, "kind string, node string, model binary")
        open_ = materialize(with_models(inner, fitted.join(wider, ["kind", "node"]), deeper, ENTRY), "routed")


def with_models(rows: DataFrame, models: DataFrame, apply: Callable[[pd.DataFrame, bytes], pd.DataFrame], schema: str) -> DataFrame:
    """``apply`` to ``rows(kind, node, rows, ...)``, in blocks of about CAP, with the model of their node in ``models(kind, node, rows, model)``.

    Models are joined to the blocks, so they may be as many as there are nodes.
    """
    blocks = F.ceil(F.col("rows") / CAP).cast("int")
    held = materialize(models.select("kind", "node", "rows", "model"), "models").select("kind", "node", "model", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    cut = rows.withColumn("block", F.pmod(F.xxhash64("feat_id"), blocks).cast("int"))
    empty = [f.split()[0] for f in schema.split(", ")]

    def run(part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({c: [] for c in empty})
        return apply(part.reset_index(drop=True), model["model"].iloc[0])

    return cut.groupBy("kind", "node", "block").cogroup(held.groupBy("kind", "node", "block")).applyInPandas(run, schema)


def nearest(vectors: DataFrame, k: int = 5, least: float = -1.0, only: str = "true") -> DataFrame:
    """``kind, q, rank, b, s``: the k most similar others of each query, best first.

    ``least`` is the similarity below which neighbours are of no interest: the bounds
    are calibrated on neighbours above it, and none below it is returned. ``only`` is
    a condition on ``feat_id`` that says which rows are queries.
    """
    spark = vectors.sparkSession
    rows, spare = distinct_vectors(vectors)
    counts = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    if not counts:
        return spark.createDataFrame([], "kind string, q long, rank int, b long, s double")
    copied, some = sized(spare, "spare")
    asks = rows.withColumn("asks", F.expr(only))
    if some and only != "true":
        also, _ = sized(copied.where(F.expr(only)).select(F.col("rep").alias("feat_id")).distinct(), "asked", IDS)
        asks = asks.join(also.withColumn("also", F.lit(True)), "feat_id", "left").withColumn("asks", F.col("asks") | F.coalesce("also", F.lit(False)))
    trees = fit_trees(rows, counts, fold=FOLD)
    calibrate(rows, trees, counts, k, least)
    packs = descend(asks.select("kind", "feat_id", "vec", "asks"), trees, k)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = pdf["kind"].iloc[0]
        held = [np.frombuffer(i, np.int64) for i in pdf["ids"]]
        ids, flags = np.concatenate(held), np.frombuffer(b"".join(pdf["flags"]), np.uint8)
        x = np.concatenate([unsqueezed(v, len(i), WIDTHS[kind]) for v, i in zip(pdf["vecs"], held)])
        m, q = np.flatnonzero(flags & 1), np.flatnonzero(flags & 2)
        found = []
        if len(m) and len(q):
            u = np.concatenate([unit(x[a : a + 1000]) for a in range(0, len(x), 1000)])
            y, v = x[m], u[m]
            for start in range(0, len(q), 500):
                part = q[start : start + 500]
                s = u[part] @ v.T
                s[ids[part][:, None] == ids[m][None, :]] = -np.inf
                found.append(_top(s, ids[part], ids[m], x[part], y, k, least))
        a, b, e = (np.concatenate([f[c] for f in found]) if found else np.empty(0) for c in range(3))
        cut = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, int)
        d, b = (pd.Series(np.split(c, cut[1:]) if len(a) else [], dtype=object) for c in (-e.astype(float), b.astype(np.int64)))
        return pd.DataFrame({"kind": kind, "q": a[cut].astype(np.int64), "d": d, "b": b})

    hits = packs.groupBy("kind", "node", "mb", "qb").applyInPandas(search, "kind string, q long, d array<double>, b array<long>")
    near = lambda pairs: pairs.groupBy("kind", "q").agg(F.array_sort(F.collect_set(F.struct((-F.col("s")).alias("d"), "b"))).alias("t"))
    # At most k neighbours come from each visited block, and a row is a member of one.
    best = hits.groupBy("kind", "q").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", "b")))), 1, k).alias("t"))
    if some:
        best = _with_copies(best, copied, k, least, only, near)
    return best.select("kind", "q", F.posexplode("t").alias("pos", "n")).select("kind", "q", (F.col("pos") + 1).alias("rank"), "n.b", (-F.col("n.d")).alias("s"))


def _with_copies(best: DataFrame, spare: DataFrame, k: int, least: float, only: str, near) -> DataFrame:
    """Neighbours of distinct vectors, as neighbours of all rows: a vector stands for its k + 1 first copies, and each copy asks for itself."""
    whole = spare.unionByName(spare.select("kind", F.col("rep").alias("feat_id"), "rep").distinct())
    # k + 1 copies are picked before the shuffle, so that a hot vector stays small.
    order = F.row_number().over(Window.partitionBy("kind", "rep").orderBy("feat_id"))
    first = whole.withColumn("no", order).where(F.col("no") <= k + 1).groupBy("kind", "rep").agg(F.array_sort(F.collect_list("feat_id")).alias("ids"))
    ids, _ = sized(first, "copies")
    pairs = best.select("kind", "q", F.explode("t").alias("n")).select("kind", "q", "n.b", (-F.col("n.d")).alias("s"))
    if least <= 1.0:
        pairs = pairs.unionByName(ids.select("kind", F.col("rep").alias("q"), F.col("rep").alias("b"), F.lit(1.0).alias("s")))
    wide = pairs.join(ids.withColumnRenamed("rep", "b"), ["kind", "b"], "left").select("kind", "q", F.explode(F.coalesce("ids", F.array("b"))).alias("b"), "s")
    lists = materialize(near(wide), "lists")
    own = lists.select("kind", F.col("q").alias("feat_id"), "t")
    others = spare.withColumnRenamed("rep", "q").join(lists, ["kind", "q"]).select("kind", "feat_id", "t")
    askers = own.unionByName(others).where(F.expr(only)).withColumnRenamed("feat_id", "q")
    return askers.select("kind", "q", F.slice(F.filter("t", lambda n: n["b"] != F.col("q")), 1, k).alias("t"))


def alike_pairs(vectors: DataFrame, k: int = 5, least: float = 0.6) -> DataFrame:
    """``feat_a, feat_b``: pairs of which one is among the other's k most similar, and alike."""
    near = nearest(vectors, k, least)
    return near.select(F.least("q", "b").alias("feat_a"), F.greatest("q", "b").alias("feat_b")).distinct()
