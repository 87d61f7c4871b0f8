"""Ids and digests as expressions and plans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.session import checkpointed

#: Fixed value: the DNS name space of version 5 UUIDs.
DNS = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """Version 5 UUID of a name in the DNS name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS)), F.encode(name, "UTF-8")))
    variant = F.substr(F.lit("89ab"), (F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4 + 1), F.lit(1))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def fingerprint(chunks: DataFrame) -> DataFrame:
    """The first 12 hex digits of one SHA-1 over all (id, text), sorted.

    The digest is sequential by definition: the rows are sorted in parallel, then
    one task streams them through it, holding a batch at a time. corpus_digest
    adds up in parallel where the value need not be this one.
    """
    rows = chunks.where("id is not null and text is not null").select(F.col("id").cast("string").alias("id"), "text").orderBy("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha1()
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                digest.update(f"{id_}\0{text}\1".encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()[:12]])], names=["fingerprint"])

    return checkpointed(rows).coalesce(1).mapInArrow(run, "fingerprint string")


def row_code(id_: Column, text: Column) -> Column:
    """A 60-bit number of one row, for digests that add up."""
    return F.conv(F.substring(F.md5(F.concat(id_, F.lit("\0"), text)), 1, 15), 16, 10).cast("decimal(38,0)")


def corpus_digest(chunks: DataFrame) -> DataFrame:
    """Rows and the sum of their codes: as independent of order as the fingerprint, and added up in parallel."""
    rows = chunks.where("id is not null and text is not null")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row_code(F.col("id").cast("string"), F.col("text"))).cast("string").alias("digest"))
