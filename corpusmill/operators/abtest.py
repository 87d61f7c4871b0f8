"""Complete against partial corpus: manifests, verdicts, citations.

Defined results: a null module belongs to no excluded module; a listed module
without chunks has a zero count; a row with an empty gold set is a miss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _out(modules: list[str], module: Column) -> Column:
    return F.coalesce(module.isin(*modules), F.lit(False))


def partial_corpus(chunks: DataFrame, modules: list[str], module: Column) -> DataFrame:
    """The rows outside the modules."""
    return chunks.where(~_out(modules, module))


def dropped_files(chunks: DataFrame, modules: list[str], module: Column) -> DataFrame:
    """(file) of the rows that are left out, distinct."""
    return chunks.where(_out(modules, module)).select("file").distinct()


def manifest(chunks: DataFrame, modules: list[str], module: Column) -> DataFrame:
    """One row: kept and dropped chunks, dropped by module (zeros too), the number of dropped files."""
    rows = chunks.select("file", module.alias("m"), _out(modules, module).alias("out"))
    # files first, so that a hot file costs nothing
    per_file = rows.groupBy("file", "m", "out").agg(F.count(F.lit(1)).alias("n"))
    by = lambda name: F.struct(F.lit(name).alias("module"), F.coalesce(F.sum(F.when(F.col("out") & (F.col("m") == name), F.col("n"))), F.lit(0)).alias("chunks"))
    return per_file.agg(
        F.coalesce(F.sum(F.when(~F.col("out"), F.col("n"))), F.lit(0)).alias("kept_chunks"),
        F.coalesce(F.sum(F.when(F.col("out"), F.col("n"))), F.lit(0)).alias("dropped_chunks"),
        F.map_from_entries(F.array(*[by(m) for m in sorted(modules)])).alias("dropped_by_module"),
        F.sum(F.when(F.col("out") & F.col("file").isNotNull(), 1).otherwise(0)).alias("dropped_files"),
    )


def dropped_by_module(chunks: DataFrame, modules: list[str], module: Column) -> DataFrame:
    """(module, chunks, files) for every listed module, in rows rather than a map."""
    names = chunks.sparkSession.createDataFrame([(m,) for m in modules], "module string")
    per_file = chunks.select(module.alias("module"), "file").groupBy("module", "file").agg(F.count(F.lit(1)).alias("n"))
    counted = per_file.groupBy("module").agg(F.sum("n").alias("chunks"), F.count("file").alias("files"))
    return names.join(counted, "module", "left").select("module", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks", "files")])


def verdict(excluded: Column, complete_hit: Column, partial_hit: Column, ungrounded: Column) -> Column:
    """What became of a question when modules were left out."""
    # The verdicts.
    return (
        F.when(~complete_hit, "complete_retrieval_miss")
        .when(excluded & partial_hit, "leak")
        .when(excluded & ungrounded, "hallucination_suspected")
        .when(excluded, "declined_correctly")
        .when(partial_hit, "ok")
        .otherwise("partial_retrieval_miss")
    )


def cites(answer: Column, file: Column, symbol: Column) -> Column:
    """Whether a text names the base name of a file, or a symbol qualified by ::"""
    base = F.element_at(F.split(file, "/"), -1)
    return F.coalesce(F.contains(answer, base), F.lit(False)) | (F.coalesce(F.contains(symbol, F.lit("::")), F.lit(False)) & F.coalesce(F.contains(answer, symbol), F.lit(False)))
