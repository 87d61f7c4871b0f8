"""Dense retrieval, embedding de-duplication and reuse.

Defined results: a null or zero vector, one with a null element and one of
another length than the query's match nothing; a row without a key is left out;
rows with equal input text share one vector; a reused vector must come from the
same model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from corpusmill.functions.text import embed_input
from corpusmill.operators.topk import blocks, ranked, union

PLACES = 9
#: Queries that one scan of the vectors answers.
BLOCK = 512


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows with a usable vector of a length, and these vectors scaled to length 1."""
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
    # a row that spans the whole values buffer is flattened; nulls become NaN
    values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), dim)
    norm = np.sqrt(np.einsum("ij,ij->i", values, values))
    good = np.isfinite(norm) & (norm > 0)
    return at[good], values[good] / norm[good, None]


def nearest(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int = 20, block: int = BLOCK, places: int = PLACES, larger: bool = False) -> DataFrame:
    """(q, doc, rank, score): exact cosine top-k of a stated query set against all rows, in blocks of queries.

    One scan of the vectors answers a block: each batch is one matrix product, and
    only k candidates per query and partition are shuffled.
    """
    asked = queries.select(F.col(query_key).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where("q is not null and v is not null")
    docs = vectors.select(F.col(key).alias("doc"), F.col(vector).alias("v")).where("doc is not null and v is not null")
    q_type, found = asked.schema["q"].dataType, []
    for rows in blocks(asked, block):
        for dim in sorted({len(r["v"]) for r in rows} - {0}):
            mine = [r for r in rows if len(r["v"]) == dim]
            at, unit = unit_rows(pa.array([r["v"] for r in mine], pa.list_(pa.float64())), dim)
            if len(at):
                found.append(ranked(docs, _scorer(unit.T.copy(), dim, places), [mine[a]["q"] for a in at], q_type, k, larger))
    empty = T.StructType([T.StructField("q", q_type), T.StructField("doc", docs.schema["doc"].dataType), T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType())])
    out = union(found)
    return vectors.sparkSession.createDataFrame([], empty) if out is None else out


def _scorer(asked: np.ndarray, dim: int, places: int):
    def score(batch: pa.RecordBatch):
        at, unit = unit_rows(batch.column(1), dim)
        scores = np.round(unit @ asked, places) + 0.0
        return batch.column(0).take(pa.array(at)), scores, np.ones(scores.shape, bool)

    return score


def embed_inputs(chunks: DataFrame) -> DataFrame:
    """(key, n): each distinct embedding input, by the digest of its first 6000 characters, with the rows that share it."""
    return chunks.where("text is not null").groupBy(F.md5(embed_input(F.col("text"))).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def embed_statistics(chunks: DataFrame) -> DataFrame:
    return embed_inputs(chunks).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("distinct_inputs"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates_skipped"))


def live_inputs(points: DataFrame, chunks: DataFrame, model: str) -> DataFrame:
    """(key, vector): input digests that the live index has a vector of this model for; the smallest point id wins."""
    texts = chunks.where("text is not null").select(F.col("id").alias("chunk_id"), F.md5(embed_input(F.col("text"))).alias("key")).distinct()
    live = points.where((F.col("embed_model") == model) & F.col("vector").isNotNull()).select("chunk_id", F.struct("id", "vector").alias("point"))
    return live.join(texts, "chunk_id").groupBy("key").agg(F.min("point.id").alias("point_id"), F.min_by("point.vector", "point.id").alias("vector"))


def reuse_statistics(points: DataFrame, model: str) -> DataFrame:
    """One row: points with a vector of the model, and those skipped for another model, none, or no vector."""
    same = F.coalesce((F.col("embed_model") == model) & F.col("vector").isNotNull(), F.lit(False))
    return points.agg(F.coalesce(F.sum(same.cast("bigint")), F.lit(0)).alias("usable"), F.coalesce(F.sum((~same).cast("bigint")), F.lit(0)).alias("skipped"))


def to_embed(chunks: DataFrame, live: DataFrame) -> DataFrame:
    """Input digests that are not in the live index."""
    return embed_inputs(chunks).join(live.select("key"), "key", "left_anti")


def fan_out(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every chunk with the vector of its input."""
    return chunks.where("text is not null").withColumn("key", F.md5(embed_input(F.col("text")))).join(vectors, "key").drop("key")
