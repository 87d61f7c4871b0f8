"""Source files that do not parse.

Each row's text is parsed by the grammar of the language its extension claims;
if that fails, by all other grammars in the order of a token-based ranking. A
foreign parse means a wrong extension, none at all means corruption.

Defined results: a null or blank text is a valid whole file (but no Jsonnet
file, which needs an expression) and an invalid definition; a null file claims
C++ and is left out of the list; repeated rows count once per file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.grammars import verdict
from corpusmill.parsers.languages import claimed
from corpusmill.session import spread

_CHECKED = "file string, language string, valid boolean, parses_as string"


def _check_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files, symbols, texts = (batch.column(k).to_pylist() for k in range(3))
        found = [verdict(f, s, t) for f, s, t in zip(files, symbols, texts)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(files, pa.string()),
                pa.array([claimed(f) for f in files], pa.string()),
                pa.array([v for v, _ in found], pa.bool_()),
                pa.array([o for _, o in found], pa.string()),
            ],
            names=["file", "language", "valid", "parses_as"],
        )


def checked_rows(chunks: DataFrame) -> DataFrame:
    """(file, language, valid, parses_as) for every row of chunks."""
    return spread(chunks.select("file", "symbol", "text")).mapInArrow(_check_batches, _CHECKED)


def checked_files(chunks: DataFrame) -> DataFrame:
    """One row per file: its language, rows, invalid rows, and what the invalid ones are."""
    return (
        checked_rows(chunks)
        .where("file is not null")
        .groupBy("file", "language")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.when(F.col("valid"), 0).otherwise(1)).alias("n_invalid"),
            F.min("parses_as").alias("parses_as"),
        )
        .withColumn(
            "state",
            F.when(F.col("n_invalid") == 0, "valid").when(F.col("parses_as").isNotNull(), "wrong_extension").otherwise("corrupt"),
        )
    )


def invalid_files(chunks: DataFrame) -> DataFrame:
    return checked_rows(chunks).where("not valid and file is not null").select("file").distinct()


def invalid_rates(chunks: DataFrame) -> DataFrame:
    """Files and invalid files of each repository (first part of the path) and language."""
    bad = F.when(F.col("n_invalid") > 0, 1).otherwise(0)
    return (
        checked_files(chunks)
        .groupBy(F.substring_index("file", "/", 1).alias("repo"), "language")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum(bad).alias("invalid_files"),
            F.sum(F.when(F.col("state") == "wrong_extension", 1).otherwise(0)).alias("wrong_extension"),
            F.round(F.sum(bad) / F.count(F.lit(1)), 6).alias("invalid_rate"),
        )
    )
