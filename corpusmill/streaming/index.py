"""Incremental index maintenance as a stream of chunk files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.functions.embed import hash_vector
from corpusmill.functions.hashing import uuid5
from corpusmill.functions.text import embed_input
from corpusmill.operators.dense import embed_inputs
from corpusmill.schema import CHUNK


def maintain(spark: SparkSession, incoming: str, index: str, checkpoint: str, model: str = "hash-64") -> StreamingQuery:
    """Embeds what is new in each batch of JSON-lines chunk files and appends its points to the index folder.

    Inputs the index has a vector of this model for are reused. A batch that is
    run again writes the same folder again, so points come once.
    """
    stream = spark.readStream.schema(CHUNK).json(incoming)

    def step(batch: DataFrame, number: int) -> None:
        # folders of this model's batches before this one
        past = spark.read.option("basePath", index).parquet(index).where(F.col("batch") < number) if number else None
        inputs = embed_inputs(batch).select("key")
        texts = batch.where("text is not null").select(F.md5(embed_input(F.col("text"))).alias("key"), embed_input(F.col("text")).alias("t")).groupBy("key").agg(F.min("t").alias("t"))
        if past is None:
            known = None
            new = texts
        else:
            known = past.where(F.col("embed_model") == model).join(inputs, "key", "left_semi").groupBy("key").agg(F.min_by("vector", "id").alias("vector"))
            new = texts.join(known.select("key"), "key", "left_anti")
        vectors = new.select("key", hash_vector(F.col("t")).alias("vector"))
        if known is not None:
            vectors = vectors.unionByName(known)
        points = batch.where("text is not null").withColumn("key", F.md5(embed_input(F.col("text")))).join(vectors, "key")
        points = points.select(uuid5(F.col("id")).alias("id"), F.col("id").alias("chunk_id"), "key", "vector", "file", "start_line", "end_line", "symbol", "language", F.lit(model).alias("embed_model"))
        points.dropDuplicates(["id"]).write.mode("overwrite").parquet(f"{index}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_points(spark: SparkSession, index: str) -> DataFrame:
    """The last point of each id over all batches."""
    rows = spark.read.option("basePath", index).parquet(index)
    return rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), "batch").alias("p")).select("id", "p.*")
