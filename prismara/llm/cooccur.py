"""Items that appear together: an incremental pair table.

Changed baskets emit signed deltas of pairs and marginals. Deltas are summed before
the shuffle and merged into persistent counts that are hash-bucketed; only buckets a
delta touches are rewritten. Scores of affected pairs are recomputed from the merged
counts.

The table lives in a folder. Every batch writes new files and then a manifest that
names the files that count; renaming it into place is the switch to the new version, so
a batch that fails leaves the table as it was. A later session opens the folder and
goes on. Buckets are doubled when they hold more than ``ROWS`` rows on average, so the
share that a small batch rewrites falls as the table grows. Files of older versions
stay until ``vacuum``.

Defined cases: a null id is no basket; a null or empty basket counts towards N
only; repeated items count once per basket; of several rows with one id in a batch
any one counts, so pass one; an empty batch changes nothing; a basket whose items
become null gives back its counts. A basket of k items has k(k-1)/2 pairs, which is
the result itself; they are streamed one left item at a time, never held together.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismara.session import new_path

#: Rows of a bucket, on average, from which the buckets are doubled.
ROWS = 200_000
KEYS = {"baskets": ["id"], "items": ["a"], "pairs": ["a", "b"]}


class PairTable:
    """Persistent counts of items and pairs in hash buckets, in the folder ``path`` (default: one for this session)."""

    SCHEMAS = {"baskets": "id long, items array<string>, _b int", "items": "a string, n long, _b int", "pairs": "a string, b string, n long, _b int"}

    def __init__(self, spark: SparkSession, buckets: int = 16, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "pairs")
        self.version, self.total = 0, 0
        self.buckets = {kind: buckets for kind in KEYS}
        self.rows = {kind: 0 for kind in KEYS}
        self.at: dict[str, dict[int, str]] = {kind: {} for kind in KEYS}
        self._open()

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _manifests(self) -> list[int]:
        fs, path = self._fs()
        found = fs.globStatus(path(f"{self.path}/manifest-*.json")) or []
        return sorted(int(f.getPath().getName()[len("manifest-") : -len(".json")]) for f in found)

    def _open(self) -> None:
        known = self._manifests()
        if known:
            text = self.spark.read.text(f"{self.path}/manifest-{known[-1]}.json", wholetext=True).first()[0]
            held = json.loads(text)
            self.version, self.total, self.buckets, self.rows = held["version"], held["total"], held["buckets"], held["rows"]
            self.at = {kind: {int(b): f"{self.path}/{p}" for b, p in at.items()} for kind, at in held["at"].items()}

    def _commit(self) -> None:
        fs, path = self._fs()
        held = {"version": self.version, "total": self.total, "buckets": self.buckets, "rows": self.rows, "at": {kind: {b: p[len(self.path) + 1 :] for b, p in at.items()} for kind, at in self.at.items()}}
        hidden, name = path(f"{self.path}/.manifest-{self.version}.tmp"), path(f"{self.path}/manifest-{self.version}.json")
        out = fs.create(hidden, True)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        if fs.exists(name) or not fs.rename(hidden, name):
            raise RuntimeError(f"another batch has written version {self.version} of {self.path}")

    def vacuum(self) -> None:
        """Deletes the files and manifests of versions before this one."""
        fs, path = self._fs()
        kept = {p.rsplit("/", 2)[1] for at in self.at.values() for p in at.values()}
        for kind in KEYS:
            for f in fs.listStatus(path(f"{self.path}/{kind}")) if fs.exists(path(f"{self.path}/{kind}")) else []:
                if f.getPath().getName() not in kept:
                    fs.delete(f.getPath(), True)
        for v in self._manifests()[:-1]:
            fs.delete(path(f"{self.path}/manifest-{v}.json"), False)

    def _bucket(self, kind: str):
        return F.pmod(F.xxhash64(*KEYS[kind]), F.lit(self.buckets[kind])).cast("int").alias("_b")

    def _read(self, kind: str, buckets: set[int] | None = None) -> DataFrame:
        paths = sorted(p for b, p in self.at[kind].items() if buckets is None or b in buckets)
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMAS[kind])
        return self.spark.read.schema(self.SCHEMAS[kind]).parquet(*paths)

    def _write(self, kind: str, df: DataFrame, touched: set[int] | None) -> None:
        """Replaces the touched buckets of ``kind``, or all; a bucket left empty disappears."""
        root = f"{self.path}/{kind}/v{self.version}"
        df.withColumn("_bucket", F.col("_b")).write.mode("overwrite").partitionBy("_bucket").parquet(root)
        fs, path = self._fs()
        written = {int(s.getPath().getName()[8:]) for s in fs.listStatus(path(root)) if s.getPath().getName().startswith("_bucket=")}
        kept = {} if touched is None else {b: p for b, p in self.at[kind].items() if b not in touched}
        self.at[kind] = kept | {b: f"{root}/_bucket={b}" for b in written}

    def _merge(self, kind: str, delta: DataFrame) -> None:
        """Adds the signed ``delta`` (keys, n, _b), which is written already, to the counts."""
        touched = {r["_b"] for r in delta.select("_b").distinct().collect()}  # at most as many as buckets
        known = self._read(kind, touched)
        keys = KEYS[kind]
        self._write(kind, known.unionByName(delta).groupBy("_b", *keys).agg(F.sum("n").alias("n")).where("n <> 0").select(*keys, "n", "_b"), touched)

    def _grow(self, kind: str) -> None:
        """Doubles the buckets while they hold too many rows; all are rewritten, which few batches do."""
        self.rows[kind] = self._read(kind).count()
        wanted = self.buckets[kind]
        while self.rows[kind] > wanted * ROWS:
            wanted *= 2
        if wanted != self.buckets[kind]:
            self.buckets[kind] = wanted
            old = self._read(kind).drop("_b")
            self.version += 1
            self._write(kind, old.withColumn("_b", self._bucket(kind)), None)

    def apply(self, batch: DataFrame) -> DataFrame:
        """Merge ``batch(id, items)``; returns the affected pairs' (a, b) and items' (a, null b)."""
        fresh = batch.where(F.col("id").isNotNull()).select(F.col("id").cast("long"), F.array_sort(F.array_distinct(F.filter(F.coalesce("items", F.array().cast("array<string>")), lambda x: x.isNotNull()))).alias("new"))
        first = not self.at["baskets"]
        self.version += 1
        if first:
            # The baskets are the table; nothing is there to compare or to merge with.
            self._write("baskets", fresh.select("id", F.col("new").alias("items"), self._bucket("baskets")), None)
            baskets = self._read("baskets")
            self.total += baskets.count()
            signed = baskets.select(F.lit(1).cast("long").alias("s"), F.col("items").alias("x"))
        else:
            joined = fresh.join(self._read("baskets").select("id", F.col("items").alias("old")), "id", "left")
            root = f"{self.path}/delta/v{self.version}"
            joined.where(F.col("old").isNull() | (F.col("old") != F.col("new"))).withColumn("_b", self._bucket("baskets")).write.mode("overwrite").parquet(f"{root}/changed")
            changed = self.spark.read.schema("id long, old array<string>, new array<string>, _b int").parquet(f"{root}/changed")
            self.total += changed.where("old IS NULL").count()
            empty = F.array().cast("array<string>")
            signed = changed.select(F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("s"), F.coalesce("old", empty).alias("x")), F.struct(F.lit(1).cast("long").alias("s"), F.col("new").alias("x")))).alias("e")).select("e.s", "e.x")
        signed = signed.where(F.size("x") > 0)
        left = signed.where(F.size("x") > 1).select("s", F.posexplode("x").alias("p", "a"), "x")
        deltas = {
            "items": signed.select("s", F.explode("x").alias("a")).groupBy("a").agg(F.sum("s").alias("n")).where("n <> 0"),
            "pairs": left.select("s", "a", F.explode(F.slice("x", F.col("p") + 2, F.size("x"))).alias("b")).groupBy("a", "b").agg(F.sum("s").alias("n")).where("n <> 0"),
        }
        if first:
            for kind, delta in deltas.items():
                self._write(kind, delta.withColumn("_b", self._bucket(kind)), None)
            hit = {kind: self._read(kind) for kind in deltas}
        else:
            hit = {}
            for kind, delta in deltas.items():
                delta.withColumn("_b", self._bucket(kind)).write.mode("overwrite").parquet(f"{root}/{kind}")
                hit[kind] = self.spark.read.schema(self.SCHEMAS[kind]).parquet(f"{root}/{kind}")
                self._merge(kind, hit[kind])
            touched = {r["_b"] for r in changed.select("_b").distinct().collect()}
            kept = self._read("baskets", touched).join(changed.select("id"), "id", "left_anti")
            self._write("baskets", kept.unionByName(changed.select("id", F.col("new").alias("items"), "_b")), touched)
        for kind in KEYS:
            self._grow(kind)
        self._commit()
        return hit["pairs"].select("a", "b").unionByName(hit["items"].select("a", F.lit(None).cast("string").alias("b")))

    def items(self) -> DataFrame:
        return self._read("items").select("a", "n")

    def pairs(self) -> DataFrame:
        return self._read("pairs").select("a", "b", "n")

    def scores(self, affected: DataFrame | None = None) -> DataFrame:
        """``a, b, n, n_a, n_b, total, lift`` of all pairs, or of those a batch affected.

        A pair is affected if it, or one of its items, changed. (A change of N
        alone scales every lift alike and is applied on reading.)
        """
        pairs = self.pairs()
        if affected is not None:
            touched = affected.where("b IS NULL").select("a").distinct()
            own = affected.where("b IS NOT NULL").select("a", "b").distinct()
            by_a = pairs.join(touched, "a", "left_semi")
            by_b = pairs.join(touched.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b", "n")
            pairs = by_a.unionByName(by_b).unionByName(pairs.join(own, ["a", "b"], "left_semi").select("a", "b", "n")).distinct()
        item = self.items()
        out = pairs.join(item.withColumnRenamed("n", "n_a"), "a").join(item.select(F.col("a").alias("b"), F.col("n").alias("n_b")), "b")
        total = F.lit(self.total).cast("long")
        return out.select("a", "b", "n", "n_a", "n_b", total.alias("total"), (F.col("n").cast("double") * total / (F.col("n_a").cast("double") * F.col("n_b"))).alias("lift"))


def at_least(n, total, n_a, n_b, times: int):
    """Whether n * total >= times * n_a * n_b, exactly and for counts of any size: in doubles unless they are too near to tell."""
    have, need = n.cast("double") * total, times * n_a.cast("double") * n_b
    wide = lambda c: c.cast("decimal(19,0)")
    exact = wide(n) * wide(total) >= F.lit(times).cast("decimal(9,0)").cast("decimal(19,0)") * (wide(n_a) * wide(n_b)).cast("decimal(38,0)")
    return F.when(F.abs(have - need) > 1e-9 * F.greatest(have, need), have >= need).otherwise(exact)
