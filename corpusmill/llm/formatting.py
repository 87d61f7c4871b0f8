"""Duplicates hidden by formatting differences.

Every distinct value is canonicalised once per worker dictionary (letters and
digits in lower case) and encoded as an integer; a record is the sorted tuple of
its field-value integers: one field for a plain text, one per leaf for a text that
is a single FHiCL or Jsonnet table without comments, so that entries may stand in
any order. Records are grouped by their compact tuples. Integers are 128-bit
digests, so that no dictionary has to be shared, and so are those of the tuples.

Defined results: a null id is left out, a null text is no record; texts without
a letter or digit (empty ones too) are alike only if both have none; repeated
rows and an id that comes back count as rows but once as an id; letters are alike
if their lower case is, so the micro sign is no mu and a sharp s no double s.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.tables import table_leaves
from corpusmill.operators.skew import join_counted
from corpusmill.session import checkpointed, spread

_OTHER = re.compile(r"[\W_]+")
#: Distinct values a worker remembers before it starts afresh; the codes do not depend on it.
MEMO = 400_000


class _Dictionary(dict):
    """value -> integer; each distinct value is canonicalised once per worker."""

    def remember(self, key, code: bytes) -> bytes:
        if len(self) > MEMO:
            self.clear()
        self[key] = code
        return code

    def leaf(self, leaf: tuple[str, str]) -> bytes:
        """The integer of one field with its value."""
        if code := self.get(leaf):
            return code
        path, value = leaf
        mark = value if value in ("{", "[") else canonical(value)
        return self.remember(leaf, xxhash.xxh3_128_digest(("/".join(map(canonical, path.split("/"))) + "\0" + mark).encode("utf-8", "surrogatepass")))

    def text(self, text: str) -> bytes:
        """The integer of a whole text."""
        raw = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"), seed=7)
        return self.get(raw) or self.remember(raw, xxhash.xxh3_128_digest(canonical(text).encode("utf-8", "surrogatepass")))


def canonical(text: str) -> str:
    # the small sigma at a word's end is a letter of its own in lower case only
    return _OTHER.sub("", text.lower()).replace("ς", "σ")


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = _Dictionary()
    for batch in batches:
        files, texts = (batch.column(k).to_pylist() for k in (1, 2))
        plain, record = [], []
        for file, text in zip(files, texts):
            key, leaves = memo.text(text), table_leaves(text, file)
            plain.append(key)
            record.append(key if leaves is None else xxhash.xxh3_128_digest(b"".join(sorted(map(memo.leaf, leaves))), seed=1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, pa.binary()), pa.array(record, pa.binary())], names=["id", "plain", "record"])


def encoded(chunks: DataFrame) -> DataFrame:
    """(id, plain, record, n_rows): the digests of the plain text and of the record tuple; one row per id and text."""
    rows = chunks.where("id is not null and text is not null").select("id", "file", "text")
    return spread(rows).mapInArrow(_encode, "id string, plain binary, record binary").groupBy("id", "plain", "record").agg(F.count(F.lit(1)).alias("n_rows"))


def grouped(chunks: DataFrame) -> DataFrame:
    """(id, group, n_rows): two ids are in one group if their plain texts or their record tuples are equal."""
    rows = checkpointed(encoded(chunks))
    pairs = rows.select("plain", "record").distinct()
    # equal plain texts nearly always have equal tuples; the rest is joined until nothing changes
    labels = None
    split = pairs.groupBy("plain").agg(F.min("record").alias("label"), F.count(F.lit(1)).alias("n"))
    while not split.where("n > 1").isEmpty():
        smaller = split.select("plain", "label")
        by_record = pairs.join(smaller, "plain").groupBy("record").agg(F.min("label").alias("label"))
        labels = checkpointed(by_record)
        again = pairs.join(labels, "record").groupBy("plain").agg(F.min("label").alias("label"), F.countDistinct("label").alias("n"))
        split = checkpointed(again)
    if labels is None:
        return rows.select("id", F.col("record").alias("group"), "n_rows")
    # a record may have a third of all rows, so its rows are counted and dealt out
    counted = checkpointed(rows.groupBy("record").agg(F.count(F.lit(1)).alias("_n")).join(labels, "record"))
    return join_counted(rows, counted, "record", "_n", "id").select("id", F.col("label").alias("group"), "n_rows")


def copies(chunks: DataFrame) -> DataFrame:
    """(first_id, other_id) for each group of two or more ids, one row for each id but the smallest."""
    rows = grouped(chunks).select("id", "group").distinct()
    groups = checkpointed(rows.groupBy("group").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_ids")).where("n_ids > 1"))
    joined = join_counted(rows, groups, "group", "n_ids", "id")
    return joined.where("id <> first_id").select("first_id", F.col("id").alias("other_id"))


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: its smallest id, its number of ids and of rows."""
    return (
        grouped(chunks)
        .groupBy("group", "id")
        .agg(F.sum("n_rows").alias("n_rows"))
        .groupBy("group")
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_ids"), F.sum("n_rows").alias("n_rows"))
        .drop("group")
    )
