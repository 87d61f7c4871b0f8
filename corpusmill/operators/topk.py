"""Best rows of each query within a partition, before anything is shuffled.

Defined results: only valid scores count; ties go to the smaller key, or to the
larger one if asked for.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type


class Best:
    """Running top-k of each query over the batches of one partition."""

    def __init__(self, queries: int, k: int, larger: bool):
        self.k, self.larger = k, larger
        self.rows: list[list[tuple]] = [[] for _ in range(queries)]

    def add(self, scores: np.ndarray, valid: np.ndarray, keys: pa.Array) -> None:
        """scores and valid: a row for each key, a column for each query."""
        for q, best in enumerate(self.rows):
            column = scores[:, q]
            at = np.flatnonzero(valid[:, q])
            if len(best) == self.k:
                at = at[column[at] >= best[-1][0]]
            if len(at) > self.k:
                cut = len(at) - self.k
                at = at[column[at] >= np.partition(column[at], cut)[cut]]
            if not len(at):
                continue
            both = best + list(zip(column[at].tolist(), keys.take(pa.array(at)).to_pylist()))
            self.rows[q] = heapq.nlargest(self.k, both) if self.larger else heapq.nsmallest(self.k, both, key=lambda x: (-x[0], x[1]))

    def batch(self, names: list, q_type: pa.DataType, doc_type: pa.DataType) -> pa.RecordBatch:
        flat = [(names[q], doc, score) for q, best in enumerate(self.rows) for score, doc in best]
        columns = [[r[c] for r in flat] for c in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (q_type, doc_type, pa.float64()))], names=["q", "doc", "score"])


def ranked(rows: DataFrame, score, names: list, q_type: T.DataType, k: int, larger: bool = False) -> DataFrame:
    """(q, doc, rank, score): rows (doc first) scored in batches, cut to k for each query and partition, then ranked.

    score(batch) gives (keys, scores, valid), a column for each name.
    """
    doc_type = rows.schema.fields[0].dataType
    arrow_q, arrow_doc = to_arrow_type(q_type), to_arrow_type(doc_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(names), k, larger)
        for batch in batches:
            keys, scores, valid = score(batch)
            if len(keys):
                best.add(scores, valid, keys)
        yield best.batch(names, arrow_q, arrow_doc)

    schema = T.StructType([T.StructField("q", q_type), T.StructField("doc", doc_type), T.StructField("score", T.DoubleType())])
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("doc") if larger else F.asc("doc"))
    found = rows.mapInArrow(run, schema).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("q", "doc", "rank", "score")


def blocks(queries: DataFrame, size: int) -> Iterator[list]:
    """A stated query set, a block of rows at a time."""
    block: list = []
    for row in queries.toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out
