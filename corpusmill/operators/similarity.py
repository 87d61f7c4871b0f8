"""How alike texts are that follow one another.

Defined results: the last row of a group has no next one and gives nothing; equal
rows follow one another; rows of equal order are taken in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.session import checkpointed

PLACES = 6


def alike(a: str, b: str) -> float:
    """Share of equal characters in matching blocks, whole texts."""
    return round(SequenceMatcher(None, a, b).ratio(), PLACES)


def similarity_in_order(rows: DataFrame, group: str, order: list[str], key: str, text: str) -> DataFrame:
    """(key, similarity) of each row with the next of its group.

    The rows are sorted by group and order over all tasks, so that a group with a
    third of all rows is spread like any other; each task streams its part, and the
    pairs across the ends of two parts come from one row for each end.
    """
    sides = [group, *order]
    parts = checkpointed(rows.select(*dict.fromkeys([*sides, key, text])).repartitionByRange(*sides).sortWithinPartitions(*sides)).select(group, key, text)
    key_type, group_type = parts.schema[key], parts.schema[group]
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField(group, group_type.dataType), T.StructField(key, key_type.dataType),
        T.StructField("text", T.StringType()), T.StructField("similarity", T.DoubleType()),
    ])
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in enumerate(types)], names=schema.names)

        for batch in batches:
            found = []
            for g, k, t in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if before is None:
                    found.append((part, 1, g, k, t, None))
                elif before[0] == g:
                    found.append((part, 0, None, before[1], None, alike(before[2], t)))
                before = (g, k, t)
            yield out(found)
        if before is not None:
            yield out([(part, 2, *before, None)])

    done = checkpointed(parts.mapInArrow(stream, schema))
    ends = done.where(F.col("end") > 0).groupBy("part").agg(*[F.max(F.when(F.col("end") == e, F.struct(group, key, "text"))).alias(n) for e, n in ((1, "first"), (2, "last"))])
    # a row for each task
    met = ends.withColumn("next", F.lead("first").over(Window.partitionBy(F.lit(0)).orderBy("part"))).where(F.col(f"next.{group}").eqNullSafe(F.col(f"last.{group}")) & F.col("next").isNotNull())

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alike(x, y) for x, y in zip(a, b)], dtype="float64")

    across = met.select(F.col(f"last.{key}").alias(key), ratio("last.text", "next.text").alias("similarity"))
    return done.where(F.col("end") == 0).select(key, "similarity").unionByName(across)
