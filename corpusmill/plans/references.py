"""p1: references held against the index as it stood."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.operators.references import orphan_report, orphaned_keys, orphans, state_of
from corpusmill.sources.tables import table


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def _deltas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(references, created, deleted)"""
    gold, points = table(spark, sf_dir, "gold"), table(spark, sf_dir, "points")
    refs = gold.select(
        F.lit("gold").alias("ref_table"), F.col("gold_id").cast("string").alias("ref_key"), F.explode("relevant_chunk_ids").alias("key"), _micros("created_at").alias("t")
    ).unionByName(points.select(F.lit("points").alias("ref_table"), F.col("id").alias("ref_key"), F.col("chunk_id").alias("key"), _micros("upserted_at").alias("t")))
    created = table(spark, sf_dir, "chunks").select(F.col("id").alias("key"), _micros("indexed_at").alias("t"))
    deleted = table(spark, sf_dir, "tombstones").select(F.col("chunk_id").alias("key"), _micros("deleted_at").alias("t"))
    return refs, created, deleted


def orphan_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(*_deltas(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(spark, sf_dir).select("ref_table", "ref_key", F.col("key").alias("chunk_id")).distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(orphan_references(spark, sf_dir))


def p1_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that are referred to and do not exist after all changes."""
    return orphaned_keys(state_of(*_deltas(spark, sf_dir)).counts).select(F.col("key").alias("chunk_id"), "n_references")


# The plain definition: each reference against all comings and deletions of its key.
_CASES = """
with refs as (
  select distinct 'gold' ref_table, cast(gold_id as varchar) ref_key, chunk_id, created_at t
  from (select gold_id, unnest(relevant_chunk_ids) chunk_id, created_at from gold) where chunk_id is not null
  union
  select distinct 'points', id, chunk_id, upserted_at from points where chunk_id is not null
),
came as (select r.ref_table, r.ref_key, r.chunk_id, r.t, max(c.indexed_at) came
         from refs r left join chunks c on c.id = r.chunk_id and c.indexed_at <= r.t group by all),
cases as (select k.ref_table, k.ref_key, k.chunk_id, k.t
          from came k left join tombstones d on d.chunk_id = k.chunk_id and d.deleted_at > k.came and d.deleted_at <= k.t
          group by k.ref_table, k.ref_key, k.chunk_id, k.t, k.came having k.came is null or count(d.chunk_id) > 0)
"""
ORACLE = {
    "p1_found": _CASES + "select distinct ref_table, ref_key, chunk_id from cases",
    "p1_report": _CASES + "select ref_table, strftime(t, '%Y-%m') as month, count(*) as orphans, count(distinct chunk_id) as keys from cases group by 1, 2",
    "p1_current": _CASES.replace("cases as", "unused as") + """, came_at as (select id, max(indexed_at) a from chunks where id is not null group by 1), gone as (select chunk_id, max(deleted_at) g from tombstones where chunk_id is not null group by 1)
select r.chunk_id, count(*) n_references from refs r left join came_at c on c.id = r.chunk_id left join gone g on g.chunk_id = r.chunk_id where c.a is null or g.g > c.a group by 1""",
}
QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_current": p1_current}
