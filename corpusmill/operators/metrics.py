"""Ranking metrics.

Defined results: an empty gold set gives recall, nDCG and MRR 0; precision is
over the rows returned up to k and 0 without any; questions without results
count with 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

KS = (1, 3, 5, 10)


def relevance(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """ranked (q, doc, rank) with rel; gold (q, doc) distinct."""
    return ranked.select("q", "doc", "rank").join(gold.select("q", "doc", F.lit(1).alias("_g")), ["q", "doc"], "left").select("q", "doc", "rank", F.col("_g").isNotNull().alias("rel"))


def per_query(ranked: DataFrame, gold: DataFrame, questions: DataFrame, ks=KS) -> DataFrame:
    """(q, k, recall, precision, ndcg, mrr) for every question and k."""
    flagged = relevance(ranked, gold)
    sizes = gold.groupBy("q").agg(F.count(F.lit(1)).alias("n_gold"))
    gain = F.log2(F.lit(2.0)) / F.log2(F.col("rank") + 1.0)
    grid = questions.select("q").distinct().select("q", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    hits = F.col("rel") & (F.col("rank") <= F.col("k"))
    sums = (
        flagged.select("q", "rank", "rel", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
        .groupBy("q", "k")
        .agg(
            F.sum(F.when(hits, 1).otherwise(0)).alias("hits"),
            F.sum(F.when(F.col("rank") <= F.col("k"), 1).otherwise(0)).alias("shown"),
            F.sum(F.when(hits, gain).otherwise(0.0)).alias("dcg"),
            F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"),
        )
    )
    n, zero = F.coalesce(F.col("n_gold"), F.lit(0)), F.lit(0.0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.col("k")), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return grid.join(sums, ["q", "k"], "left").join(sizes, "q", "left").select(
        "q", "k",
        F.round(F.when(n > 0, F.coalesce(F.col("hits"), F.lit(0)) / n).otherwise(zero), 9).alias("recall"),
        F.round(F.coalesce(F.try_divide(F.col("hits"), F.col("shown")), zero), 9).alias("precision"),
        F.round(F.when(n > 0, F.coalesce(F.col("dcg"), zero) / ideal).otherwise(zero), 9).alias("ndcg"),
        F.round(F.coalesce(1.0 / F.col("first"), zero), 9).alias("mrr"),
    )


def macro(per: DataFrame) -> DataFrame:
    """Means over all questions, per k."""
    return per.groupBy("k").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "ndcg", "mrr")])


def best(macros: DataFrame, measures: tuple[str, ...] = ("recall", "precision", "ndcg", "mrr")) -> DataFrame:
    """(k, metric, model, value) of the best model of each k and metric, from macro averages with a model column; ties to the smaller name."""
    rows = macros.select("k", "model", F.explode(F.create_map(*[x for c in measures for x in (F.lit(c), F.col(c))])).alias("metric", "value"))
    order = Window.partitionBy("k", "metric").orderBy(F.desc("value"), "model")  # a row for each model
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("k", "metric", "model", "value")
