"""Reciprocal-rank fusion, reranking and diversity.

Defined results: a side that is empty leaves the other side's order; equal fused
scores are ordered by dense rank, then by sparse rank; a rerank score that is
null keeps the fused order behind all scored rows; per (file, symbol) the best
ranked row stays, null files or symbols being groups of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from corpusmill.operators.bm25 import words

#: The constant of the fusion, candidates of a leg, candidates to rerank.
RRF_K, POOL, RERANK_POOL = 60, 10, 40


def fuse(dense: DataFrame, sparse: DataFrame, k: int = RRF_K) -> DataFrame:
    """(q, doc, score, rank) from two ranked lists (q, doc, rank; rank from 1)."""
    a = dense.select("q", "doc", F.col("rank").alias("dense_rank"))
    b = sparse.select("q", "doc", F.col("rank").alias("sparse_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    both = a.join(b, ["q", "doc"], "full").withColumn("score", part("dense_rank") + part("sparse_rank"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"))
    return both.withColumn("rank", F.row_number().over(order))


def rerank(fused: DataFrame, scores: DataFrame, pool: int = RERANK_POOL) -> DataFrame:
    """The pool's best by rerank score (q, doc, rerank_score), stable on the fused rank; the fused score stays."""
    cut = fused.where(F.col("rank") <= pool).withColumnRenamed("rank", "fused_rank")
    order = Window.partitionBy("q").orderBy(F.desc_nulls_last("rerank_score"), "fused_rank")
    return cut.join(scores, ["q", "doc"], "left").withColumn("rank", F.row_number().over(order))


def diverse(ranked: DataFrame, meta: DataFrame, k: int) -> DataFrame:
    """The first row of each (q, file, symbol) in rank order, then the first k of each q, ranked anew."""
    return diverse_rows(ranked.join(meta, "doc"), k)


def diverse_rows(rows: DataFrame, k: int) -> DataFrame:
    """The same of ranked rows with their file and symbol."""
    first = Window.partitionBy("q", "file", "symbol").orderBy("rank")
    kept = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    order = Window.partitionBy("q").orderBy("rank")
    return kept.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= k)


#: Gives a score for each passage, best highest: scorer(question, passages).
Scorer = Callable[[str, list[str]], list[float]]


def word_overlap(question: str, passages: list[str]) -> list[float | None]:
    """The default scorer: the share of the question's distinct words that a passage has."""
    asked = set(words(question))
    return [round(len(asked & set(words(p))) / len(asked), 9) if asked else None for p in passages]


def rerank_scores(candidates: DataFrame, scorer: Scorer) -> DataFrame:
    """(q, doc, rerank_score, error) of candidates (q, doc, question, passage), at most a pool for each question.

    A scorer that fails, or gives another number of scores than passages, leaves
    the scores of its question null, so that the fused order stands, and the error beside them.
    """
    rows = candidates.select("q", "doc", "question", "passage")
    schema = T.StructType([rows.schema["q"], rows.schema["doc"], *T._parse_datatype_string("rerank_score double, error string").fields])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame, scores, error = frame.sort_values("doc"), [None] * len(frame), None
        try:
            got = list(scorer(frame["question"].iloc[0], frame["passage"].tolist()))
            if len(got) != len(frame):
                raise ValueError(f"{len(got)} scores for {len(frame)} passages")
            scores = [None if x is None else float(x) for x in got]
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:500]
        return frame[["q", "doc"]].assign(rerank_score=pd.array(scores, "Float64"), error=error)

    return rows.groupBy("q").applyInPandas(run, schema)


def logit_scorer(logits: Callable[[str, list[str]], list[tuple[float, float]]]) -> Scorer:
    """A scorer from a model's (no, yes) logits: the probability of yes."""

    def score(question: str, passages: list[str]) -> list[float]:
        return [1.0 / (1.0 + math.exp(min(no - yes, 700.0))) for no, yes in logits(question, passages)]

    return score


def class_scorer(values: Callable[[list[tuple[str, str]]], list[float]], batch: int = 16) -> Scorer:
    """A scorer from a model that gives one value to each (question, passage) pair, in batches."""

    def score(question: str, passages: list[str]) -> list[float]:
        pairs = [(question, p) for p in passages]
        return [x for at in range(0, len(pairs), batch) for x in values(pairs[at : at + batch])]

    return score
