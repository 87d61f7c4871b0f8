"""Okapi BM25.

The words of a text are counted where it is read; only the counts of the words
asked for are shuffled, once, to make one row of each document. A block of
questions is scored against such rows in batches, and cut to the best before it
is shuffled.

Defined results: null texts and questions have no terms; a key with repeated rows
is one document, with different texts the one of the smallest digest; repeated question words
count repeatedly; only positive scores come out; ties go to the larger document
key; scores are rounded to nine places before they are ranked; a row without a key is left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.functions.text import TOKEN
from corpusmill.operators.topk import blocks, ranked, union
from corpusmill.session import checkpointed

#: Term saturation and length normalisation.
K1, B = 1.5, 0.75
PLACES = 9
#: Questions that one pass over the documents answers.
BLOCK = 512
_TOKEN = re.compile(TOKEN)


def words(text: str | None) -> list[str]:
    """The identifier tokenizer, where Python reads the text."""
    return [x.lower() for x in _TOKEN.findall(text)] if text else []


def counted(docs: DataFrame, key: str, text, wanted: set[str] | None = None) -> DataFrame:
    """(doc, code, dl, terms, tfs): the words of each row with their counts, of the wanted ones only if given.

    The code tells texts of one key apart.
    """
    rows = docs.select(F.col(key).alias("doc"), F.coalesce(text, F.lit("")).alias("text")).where("doc is not null")
    rows = rows.select("doc", F.md5("text").alias("code"), "text")
    doc_type = to_arrow_type(rows.schema["doc"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for one in batch.column(2).to_pylist():
                found = words(one)
                count = Counter(found) if wanted is None else Counter(w for w in found if w in wanted)
                sizes.append(len(found))
                terms.append(list(count))
                tfs.append(list(count.values()))
            arrays = [batch.column(0).cast(doc_type), batch.column(1), pa.array(sizes, pa.int32()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "code", "dl", "terms", "tfs"])

    schema = T.StructType([rows.schema["doc"], *T._parse_datatype_string("code string, dl int, terms array<string>, tfs array<int>").fields])
    return rows.mapInArrow(run, schema)


def chosen(rows: DataFrame) -> DataFrame:
    """(doc, dl, terms, tfs): each document once, by its smallest code."""
    return rows.groupBy("doc").agg(F.min(F.struct("code", "dl", "terms", "tfs")).alias("c")).select("doc", "c.dl", "c.terms", "c.tfs")


def statistics(lengths: DataFrame) -> DataFrame:
    """One row: number of documents and mean length."""
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def document_frequencies(documents: DataFrame) -> DataFrame:
    """(term, df) of one row for each document."""
    return documents.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf), idf = ln(1 + (n - df + 0.5) / (df + 0.5)), always positive."""
    half = F.lit(0.5)
    value = F.log(1 + (F.col("n") - F.col("df") + half) / (F.col("df") + half))
    return frequencies.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", value.alias("idf"))


class Asked:
    """A block of questions: their words with how often each has them."""

    def __init__(self, rows: list):
        self.names = [r[0] for r in rows]
        self.counts = [Counter(words(r[1])) for r in rows]
        self.terms = sorted(set().union(*self.counts))

    def scorer(self, n: int, avgdl: float, df: dict[str, int]):
        """Scores batches of (doc, dl, terms, tfs)."""
        known = [t for t in self.terms if df.get(t)]
        place = {t: k for k, t in enumerate(known)}
        # of each known word the questions that have it, as slices of two flat arrays
        per: list[list[tuple[int, int]]] = [[] for _ in known]
        for q, count in enumerate(self.counts):
            for t, m in count.items():
                if t in place:
                    per[place[t]].append((q, m))
        sizes = np.array([len(p) for p in per], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if known else np.zeros(0, np.int64)
        questions = np.array([q for p in per for q, _ in p], np.int64)
        weight = np.array([m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t, p in zip(known, per) for _, m in p])
        names, width = pa.array(known, pa.string()), len(self.names)
        mean = avgdl or 1.0

        def score(batch: pa.RecordBatch):
            docs, rows = batch.column(0), batch.num_rows
            term = pc.fill_null(pc.index_in(batch.column(2).flatten(), value_set=names), -1).to_numpy(zero_copy_only=False)
            tf = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(float)
            length = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(rows), length)
            hit = term >= 0
            term, tf, row = term[hit].astype(np.int64), tf[hit], row[hit]
            dl = batch.column(1).to_numpy(zero_copy_only=False).astype(float)[row]
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
            # each posting once for each question with its word
            each = sizes[term]
            at = np.repeat(starts[term] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            flat = np.bincount(np.repeat(row, each) * width + questions[at], weights=np.repeat(part, each) * weight[at], minlength=rows * width)
            scores = np.round(flat.reshape(rows, width), PLACES)
            return docs, scores, scores > 0

        return score


def score_block(asked: Asked, documents: DataFrame, n: int, avgdl: float | None, df: dict[str, int], q_type: T.DataType, k: int) -> DataFrame:
    """(q, doc, rank, score) of a block of questions over (doc, dl, terms, tfs)."""
    return ranked(documents.select("doc", "dl", "terms", "tfs"), asked.scorer(n, avgdl or 0.0, df), asked.names, q_type, k, larger=True)


def question_rows(questions: DataFrame, key: str, text: str) -> DataFrame:
    return questions.select(F.col(key).alias("q"), F.col(text).alias("question")).where("q is not null")


def search(docs: DataFrame, key: str, text, questions: DataFrame, question_key: str, question_text: str, k: int = 20, block: int = BLOCK) -> DataFrame:
    """(q, doc, rank, score) without an index: one pass over the texts for each block of questions."""
    rows = question_rows(questions, question_key, question_text)
    q_type, found = rows.schema["q"].dataType, []
    for part in blocks(rows, block):
        asked = Asked(part)
        # read by three plans below, so written once: a row for each document, with the words asked for only
        documents = checkpointed(chosen(counted(docs, key, text, set(asked.terms))))
        total = statistics(documents).first()
        df = {r["term"]: r["df"] for r in document_frequencies(documents).collect()}  # at most the words of a block
        found.append(score_block(asked, documents, total["n"], total["avgdl"], df, q_type, k))
    out = union(found)
    return empty(docs, key, q_type) if out is None else out


def empty(docs: DataFrame, key: str, q_type: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("q", q_type), T.StructField("doc", docs.schema[key].dataType), T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType())])
    return docs.sparkSession.createDataFrame([], schema)
