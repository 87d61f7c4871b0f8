"""The queries of this subpackage, for the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import formatting, layout, leaks, packing, pairs, pii, split, syntax
from corpusmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _chunks(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(table(spark, d, "chunks"))


def _documents(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {
        "p2_found": _chunks(lambda c: layout.machine_files(c).select("file")),
        "p2_kinds": _chunks(layout.machine_files),
        "p3_found": _chunks(syntax.invalid_files),
        "p3_rates": _chunks(syntax.invalid_rates),
        "p4_found": _chunks(formatting.copies),
        "p4_records": _chunks(formatting.records),
        "p5_found": _chunks(split.oversized_ids),
        "p5_pieces": _chunks(lambda c: split.pieces(c).distinct()),
        "p6_found": _chunks(pairs.documented_ids),
        "p6_pairs": _chunks(pairs.pairs),
        "p7_containers": _documents(packing.packed),
        "p7_fill": _documents(lambda c: packing.fill_report(packing.packed(c))),
        "p8_found": lambda spark, d: leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items")),
        "p8_items": lambda spark, d: leaks.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items")),
        "p8_cleaned": lambda spark, d: leaks.cleaned(table(spark, d, "documents"), table(spark, d, "eval_items")),
        "p9_found": _documents(pii.found_values),
        "p9_masked": _documents(pii.masked),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": "select distinct id from chunks where length(text) > 6000 and id is not null",
    }
