"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmill.session import BROADCAST_ROWS, broadcast_if_small

#: Keys with more rows than this are salted; at most rows / HOT keys exist.
HOT = 50_000
SALTS = 32


def join_counted(rows: DataFrame, groups: DataFrame, key: str, count: str, spread: str) -> DataFrame:
    """Inner join of rows with groups (one row per key, with its row count; written once, as its size is checked).

    The few keys over HOT rows are spread over SALTS parts by a hash of the
    column spread; their group row is repeated once per part.
    """
    hot = broadcast_if_small(groups.where(F.col(count) > HOT).select(key, F.lit(True).alias("_hot")))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0))
    left = rows.join(hot, key, "left").withColumn("_part", part.cast("int")).drop("_hot")
    parts = F.when(F.col(count) > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(groups.withColumn("_part", F.explode(parts)), [key, "_part"]).drop("_part")


def join_split(rows: DataFrame, groups: DataFrame, key: str, count: str, spread: str) -> DataFrame:
    """join_counted without the count column, as a broadcast where the groups are few (their number is checked)."""
    few = groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(groups.drop(count)), key) if few else join_counted(rows, groups, key, count, spread).drop(count)
