"""Frequency of every term: range-partitioned external sort and run-length scans.

(term, record) pairs are sorted by range, so that a term that holds a third of all
rows spans many tasks while equal pairs never do. Each task scans its sorted pairs
once and keeps one run at a time; runs of a term that spans tasks are added up.

Defined cases: null records and null or blank terms don't count; a term repeated in
a record is several occurrences and one record; an empty table gives no term.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_SCHEMA = "term string, occurrences long, records long"


def _starts(column: pa.Array) -> np.ndarray:
    """Where a sorted column's value differs from the one before; the first always does."""
    differs = np.ones(len(column), bool)
    if len(column) > 1:
        differs[1:] = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return differs


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths of sorted (term, record, occurrences) batches; the open run is carried over."""
    term, occurrences, records, last = None, 0, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        terms, ids, counts = batch.column(0), batch.column(1), batch.column(2).to_numpy()
        new_term = _starts(terms)
        new_pair = new_term | _starts(ids)
        head = terms[0].as_py()
        if head == term:
            new_term[0] = False
            new_pair[0] = ids[0].as_py() != last
        at = np.flatnonzero(new_term)
        cuts = np.concatenate([[0], at]) if not new_term[0] else at
        n, d = np.add.reduceat(counts, cuts), np.add.reduceat(new_pair.astype(np.int64), cuts)
        names = terms.take(pa.array(cuts)).to_pylist()
        n, d = n.tolist(), d.tolist()
        if not new_term[0]:
            n[0] += occurrences
            d[0] += records
        elif term is not None:
            names.insert(0, term)
            n.insert(0, occurrences)
            d.insert(0, records)
        term, occurrences, records, last = names.pop(), n.pop(), d.pop(), ids[-1].as_py()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["term", "occurrences", "records"])
    if term is not None:
        yield pa.RecordBatch.from_arrays([pa.array([term]), pa.array([occurrences], pa.int64()), pa.array([records], pa.int64())], ["term", "occurrences", "records"])


def term_frequencies(pairs: DataFrame) -> DataFrame:
    """``term, occurrences, records`` of ``pairs(term, record)``."""
    usable = pairs.select("term", F.col("record").cast("long").alias("record")).where("term IS NOT NULL AND term <> '' AND record IS NOT NULL")
    counted = usable.withColumn("occurrences", F.lit(1).cast("long"))
    runs = counted.repartitionByRange("term", "record").sortWithinPartitions("term", "record").mapInArrow(_scan, RUN_SCHEMA)
    return runs.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(frequencies: DataFrame, total: int, rare_below: int = 5, common_above: float = 0.3) -> DataFrame:
    """Adds ``mark``: rare, common, or null. A term that is both is rare and common, in two rows."""
    rare = F.when(F.col("records") < rare_below, F.lit("rare"))
    common = F.when(F.col("records") > common_above * total, F.lit("common"))
    marks = F.array_compact(F.array(rare, common))
    return frequencies.withColumn("mark", F.explode_outer(F.when(F.size(marks) > 0, marks)))
