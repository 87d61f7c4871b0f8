"""Schemas of chunks, gold rows and request records; chunk ids and validation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from corpusmill.parsers.languages import LANGUAGES

CHUNK = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("file", T.StringType()), T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()), T.StructField("symbol", T.StringType()), T.StructField("language", T.StringType()), T.StructField("text", T.StringType()),
])
GOLD = T.StructType([
    T.StructField("question", T.StringType()), T.StructField("relevant_chunk_ids", T.ArrayType(T.StringType())),
    T.StructField("language", T.StringType()), T.StructField("note", T.StringType()),
])
REQUEST = T.StructType([
    T.StructField("idx", T.IntegerType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("latency", T.DoubleType()),
    T.StructField("success", T.BooleanType()), T.StructField("error_type", T.StringType()), T.StructField("error", T.StringType()), T.StructField("answer_chars", T.IntegerType()),
])
FIELDS = tuple(f.name for f in CHUNK.fields)


def chunk_id(file: Column, symbol: Column, start_line: Column) -> Column:
    """file_symbol_line; null if a part is null."""
    return F.concat(file, F.lit("_"), symbol, F.lit("_"), start_line.cast("string"))


def chunk_errors() -> Column:
    """All that is wrong with a chunk: each missing field, a language outside the domain, lines in reverse."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing field: {c}")) for c in FIELDS]
    language = F.when(F.col("language").isNotNull() & ~F.col("language").isin(*LANGUAGES), F.concat(F.lit("bad language: "), F.col("language")))
    lines = F.when(F.col("end_line") < F.col("start_line"), F.lit("end_line before start_line"))
    return F.array_compact(F.array(*missing, language, lines))
