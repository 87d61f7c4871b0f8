"""Corpus building: dispatch, exclusion, chunk extraction, numbering and statistics.

Defined results: files of unknown extensions are skipped and counted nowhere;
the first matching exclusion rule counts; a file whose parser gives nothing
becomes one whole-file chunk; repeated ids get #2, #3 and so on in file order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.functions.text import extension, line_count
from corpusmill.parsers.chunkers import chunks_of
from corpusmill.parsers.languages import EXTENSIONS, LANGUAGES, WHOLE_FILE

#: Ordered (name, pattern) pairs.
Rules = Sequence[tuple[str, str]]


def dispatch(path: Column) -> Column:
    """Language by extension, null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(table, extension(path))


def exclusion(path: Column, rules: Rules) -> Column:
    """Name of the first rule that matches, or null."""
    out = None
    for name, pattern in rules:
        out = F.when(path.rlike(pattern), name) if out is None else out.when(path.rlike(pattern), name)
    return out if out is not None else F.lit(None).cast("string")


def exclusion_counts(files: DataFrame, rules: Rules, path: str = "file") -> DataFrame:
    """(rule, files) for every rule, those without files too."""
    spark = files.sparkSession
    names = spark.createDataFrame([(k, n) for k, (n, _) in enumerate(rules)], "ord int, rule string")
    known = files.select(F.col(path).alias("_p")).distinct().where(dispatch(F.col("_p")).isNotNull())
    counted = known.select(exclusion(F.col("_p"), rules).alias("rule")).where("rule is not null").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return names.join(F.broadcast(counted), "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("files"))


def extract(files: DataFrame, rules: Rules = ()) -> DataFrame:
    """(file, ord, symbol, start_line, end_line, text, language, fallback) from (path, text) rows of files that no rule excludes."""
    kept = files.withColumn("language", dispatch(F.col("path"))).where("language is not null").where(exclusion(F.col("path"), rules).isNull())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text, language in zip(frame["path"], frame["text"], frame["language"]):
                for k, c in enumerate(chunks_of(language, text or "")):
                    rows.append((path, k, c["symbol"], c["start_line"], c["end_line"], c["text"], language, False))
                if not rows or rows[-1][0] != path:
                    rows.append((path, 0, WHOLE_FILE, 1, (text or "").count("\n") + 1, text or "", language, True))
            yield pd.DataFrame(rows, columns=["file", "ord", "symbol", "start_line", "end_line", "text", "language", "fallback"])

    return kept.select("path", "text", "language").mapInPandas(run, "file string, ord int, symbol string, start_line int, end_line int, text string, language string, fallback boolean")


def numbered(chunks: DataFrame, order: list) -> DataFrame:
    """Adds id with #n for the nth row of an id, n from 2."""
    base = F.concat(F.col("file"), F.lit("_"), F.col("symbol"), F.lit("_"), F.col("start_line").cast("string"))
    n = F.row_number().over(Window.partitionBy("_id").orderBy(*order))
    out = chunks.withColumn("_id", base).withColumn("_n", n)
    return out.withColumn("id", F.when(F.col("_n") > 1, F.concat("_id", F.lit("#"), F.col("_n").cast("string"))).otherwise(F.col("_id"))).drop("_id", "_n")


def whole_file(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One chunk for each file (path, text, language) without any."""
    left = files.join(chunks.select(F.col("file").alias("path")).distinct(), "path", "left_anti")
    return left.select(F.col("path").alias("file"), F.lit(WHOLE_FILE).alias("symbol"), F.lit(1).alias("start_line"), line_count(F.col("text")).alias("end_line"), "language", "text")


def language_statistics(chunks: DataFrame) -> DataFrame:
    """(language, files, chunks, fallbacks) for every language of the domain, by extension."""
    spark = chunks.sparkSession
    domain = spark.createDataFrame([(x,) for x in LANGUAGES], "language string")
    # files are counted once even if one of them has a third of all rows
    per_file = chunks.select(dispatch(F.col("file")).alias("language"), "file", (F.col("symbol") == WHOLE_FILE).cast("int").alias("w")).groupBy("language", "file").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("w", F.lit(0))).alias("fallbacks")
    )
    sums = per_file.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("chunks"), F.sum("fallbacks").alias("fallbacks"))
    zero = F.lit(0)
    return domain.join(F.broadcast(sums), "language", "left").select("language", *[F.coalesce(c, zero).alias(c) for c in ("files", "chunks", "fallbacks")])
