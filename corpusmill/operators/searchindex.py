"""A persisted search index: documents with their vectors, and postings by term.

Built once per corpus version into an IndexStore and read by version; a search
reads only the term buckets it asks for, the vectors and the candidates.

Defined results: an id that comes back is one document, with different texts the
one of the smallest digest; a leg that fails is left out with a warning and the
other leg's order stands; both failing gives no rows; a null language is ''.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpusmill.functions.embed import HashEmbedder
from corpusmill.functions.text import EMBED_CHARS, TOKEN, snippet
from corpusmill.operators import bm25, dense, fusion
from corpusmill.operators.topk import blocks, union
from corpusmill.session import BROADCAST_ROWS, broadcast_if_small, checkpointed, spread
from corpusmill.sources.paths import Folder
from corpusmill.sources.store import IndexStore

#: Documents to a term bucket of the postings, and the most buckets (a folder each).
DOCS_PER_BUCKET, MOST_BUCKETS = 100_000, 1024
#: Parts that a bucket's postings are dealt out over.
SPREAD = 64
#: Places a dense score is rounded to before it is ranked.
DENSE_PLACES = 6
POSTINGS = "doc string, dl int, term string, tf int, bucket int"
_TOKEN = re.compile(TOKEN)
META = ("file", "symbol", "start_line", "end_line", "language")


def searched_text() -> Column:
    """What the lexical leg reads of a chunk."""
    return F.concat_ws(" ", F.col("text"), F.col("symbol"))


def corpus_rows(chunks: DataFrame) -> DataFrame:
    """The rows with an id and a text, with the code that tells texts of one id apart."""
    rows = chunks.select("id", "file", "symbol", "start_line", "end_line", F.coalesce("language", F.lit("")).alias("language"), "text")
    return rows.where("id is not null and text is not null").withColumn("code", F.md5(searched_text()))


def _analysed(rows: DataFrame, embedder: Callable[[], Callable], wanted: Broadcast | None = None) -> DataFrame:
    """Each row with its length, words (the wanted ones if given), counts and vector in place of its text."""
    given = rows.select("id", "code", *META, "text")
    kept = [f for f in given.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, *T._parse_datatype_string("dl int, terms array<string>, tfs array<int>, vector array<float>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed, only = embedder(), None if wanted is None else wanted.value
        counts, symbol_at = hasattr(embed, "sums_of"), [f.name for f in kept].index("symbol")
        for batch in batches:
            sizes, terms, tfs, embedded = [], [], [], []
            # a blank stands between text and symbol, so their words are those of the two
            for text, symbol in zip(batch.column(len(kept)).to_pylist(), batch.column(symbol_at).to_pylist()):
                own, more = bm25.Counter(_TOKEN.findall(text)), bm25.words(symbol)
                count: dict[str, int] = {}
                for x, n in own.items():
                    w = x.lower()
                    if only is None or w in only:
                        count[w] = count.get(w, 0) + n
                for w in more:
                    if only is None or w in only:
                        count[w] = count.get(w, 0) + 1
                sizes.append(own.total() + len(more))
                terms.append(list(count))
                tfs.append(list(count.values()))
                short = len(text) <= EMBED_CHARS
                embedded.append((own if short else bm25.Counter(_TOKEN.findall(text[:EMBED_CHARS]))) if counts else text[:EMBED_CHARS])
            # a search scales the vectors anyway
            vectors = np.asarray(embed.sums_of(embedded) if counts else embed(embedded), np.float32)
            ends = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1])
            arrays = [batch.column(k) for k in range(len(kept))]
            arrays += [pa.array(sizes, pa.int32()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int32())), pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return given.mapInArrow(run, schema)


def documents_of(chunks: DataFrame, embedder: Callable[[], Callable], wanted: Broadcast | None = None) -> DataFrame:
    """(doc, code, metadata, dl, terms, tfs, vector): each document once, by its smallest code.

    Only ids that come back have to meet: where they are few (they are counted), the
    other rows go from the scan to the index without a shuffle.
    """
    parts = ["code", *META, "dl", "terms", "tfs", "vector"]
    rows = corpus_rows(chunks)
    once = lambda df: df.groupBy(F.col("id").alias("doc")).agg(F.min(F.struct(*parts)).alias("c")).select("doc", "c.*")
    again = checkpointed(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    if again.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return once(_analysed(spread(rows), embedder, wanted))
    single = _analysed(spread(rows.join(F.broadcast(again), "id", "left_anti")), embedder, wanted).select(F.col("id").alias("doc"), *parts)
    return single.unionByName(once(_analysed(spread(rows.join(F.broadcast(again), "id", "left_semi")), embedder, wanted)))


def build_index(chunks: DataFrame, store: IndexStore, fingerprint: str, embedder: Callable[[], Callable] = HashEmbedder, force: bool = False) -> str:
    """Writes documents and postings of a corpus as a new version; gives its name. Equal fingerprints are skipped."""
    spark = chunks.sparkSession

    def build(path: str) -> None:
        documents_of(chunks, embedder).write.parquet(f"{path}/documents")
        documents = spark.read.parquet(f"{path}/documents")
        total = bm25.statistics(documents).first()
        buckets = min(MOST_BUCKETS, 1 + total["n"] // DOCS_PER_BUCKET)
        posted = documents.select("doc", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("doc", "dl", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
        posted = posted.withColumn("bucket", term_bucket(F.col("term"), buckets))
        # dealt out by document too, so that no term is one task's; sorted, so that a reader skips what it does not ask for
        posted.repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
        Folder(spark, path).write("layout.json", json.dumps({"buckets": buckets, "n": total["n"], "avgdl": total["avgdl"]}))

    return store.rebuild(fingerprint, build, force)


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass
class SearchIndex:
    """One version of an index."""

    spark: SparkSession
    path: str
    kept: Column | None = None

    @classmethod
    def open(cls, spark: SparkSession, store: IndexStore, version: str | None = None) -> SearchIndex:
        """The live version, or a named older one."""
        return cls(spark, store.path(version))

    def restricted(self, kept: Column) -> SearchIndex:
        """The index of the documents that meet a condition on their metadata, with weights and lengths of their own."""
        return SearchIndex(self.spark, self.path, kept if self.kept is None else self.kept & kept)

    def documents(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/documents")
        return rows if self.kept is None else rows.where(self.kept)

    def layout(self) -> dict:
        """The number of term buckets, and of the documents their number and mean length."""
        text = Folder(self.spark, self.path).read("layout.json")
        if text is None:
            raise LookupError(f"{self.path} holds no index")
        return json.loads(text)

    def postings(self, terms: list[str]) -> DataFrame:
        """(doc, dl, term, tf) of some words, from their buckets only."""
        rows = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")  # an empty corpus has no file to tell it
        buckets = self.layout()["buckets"]
        wanted = self.spark.createDataFrame([(t,) for t in terms], "term string").withColumn("bucket", term_bucket(F.col("term"), buckets))
        if buckets > 1:
            asked = [r[0] for r in wanted.select("bucket").distinct().collect()]
            rows = rows.where(F.col("bucket").isin(asked))
        rows = rows.join(F.broadcast(wanted.select("term")), "term")  # the words of a block of questions
        return rows if self.kept is None else rows.join(self.documents().select("doc"), "doc", "left_semi")

    def lexical(self, questions: DataFrame, k: int = 20, block: int = bm25.BLOCK) -> DataFrame:
        """(q, doc, rank, score) for questions (q, question)."""
        rows = bm25.question_rows(questions, "q", "question")
        q_type, found = rows.schema["q"].dataType, []
        total = self.layout() if self.kept is None else bm25.statistics(self.documents()).first()
        for part in blocks(rows, block):
            asked = bm25.Asked(part)
            posts = self.postings(asked.terms)
            matched = posts.groupBy("doc", "dl").agg(F.collect_list(F.struct("term", "tf")).alias("p")).select("doc", "dl", F.col("p.term").alias("terms"), F.col("p.tf").alias("tfs"))
            matched = checkpointed(matched)  # a row for each document with a word of the block
            df = {r["term"]: r["df"] for r in bm25.document_frequencies(matched).collect()}
            found.append(bm25.score_block(asked, matched, total["n"], total["avgdl"], df, q_type, k))
        out = union(found)
        return bm25.empty(self.documents(), "doc", q_type) if out is None else out

    def dense(self, questions: DataFrame, k: int = 20, embedder: Callable[[], Callable] = HashEmbedder) -> DataFrame:
        """(q, doc, rank, score) by exact cosine."""
        asked = _embedded(questions.select("q", "question"), embedder)
        return dense.nearest(self.documents().select("doc", "vector"), "doc", "vector", asked, "q", "vector", k, places=DENSE_PLACES, larger=True)

    def legs(self, questions: DataFrame, pool: int, embedder: Callable[[], Callable] = HashEmbedder) -> tuple[DataFrame, DataFrame]:
        """(dense, lexical), written once; a leg that fails is empty and said so in a warning."""
        out = []
        for name, leg in (("dense", lambda: self.dense(questions, pool, embedder)), ("lexical", lambda: self.lexical(questions, pool))):
            try:
                out.append(checkpointed(leg()))
            except Exception as e:
                warnings.warn(f"the {name} leg failed and is left out: {type(e).__name__}: {e}"[:500], stacklevel=2)
                out.append(bm25.empty(self.spark.createDataFrame([], "doc string"), "doc", questions.schema["q"].dataType))
        return out[0], out[1]

    def texts(self, chunks: DataFrame, ids: DataFrame) -> DataFrame:
        """(doc, text) of some documents; only their rows are shuffled."""
        few = broadcast_if_small(ids.select("doc").distinct())
        rows = corpus_rows(chunks).withColumnRenamed("id", "doc").join(few, "doc", "left_semi")
        return rows.groupBy("doc").agg(F.min(F.struct("code", "text")).alias("c")).select("doc", "c.text")

    def metadata(self, ids: DataFrame) -> DataFrame:
        """(doc, file, symbol, start_line, end_line, language) of some documents."""
        return self.documents().select("doc", *META).join(broadcast_if_small(ids.select("doc").distinct()), "doc", "left_semi")

    def rerank_scores(self, chunks: DataFrame, fused: DataFrame, questions: DataFrame, scorer: fusion.Scorer) -> DataFrame:
        """(q, doc, rerank_score, error) of the pool's candidates."""
        texts = self.texts(chunks, fused).select("doc", snippet(F.col("text")).alias("passage"))
        pool = fused.where(F.col("rank") <= fusion.RERANK_POOL).select("q", "doc")
        return fusion.rerank_scores(pool.join(texts, "doc").join(questions.select("q", "question"), "q"), scorer)

    def hybrid(self, chunks: DataFrame, questions: DataFrame, k: int = 10, reranker: fusion.Scorer | None = None, pool: int = fusion.POOL) -> DataFrame:
        """(q, rank, doc, file, symbol, start_line, end_line, language, score): both legs, fusion, rerank, one row per file and symbol.

        With a reranker each leg gives a larger pool.
        """
        pool = max(pool, fusion.RERANK_POOL) if reranker else pool
        ranked = fusion.fuse(*self.legs(questions, pool))
        if reranker:
            ranked = checkpointed(ranked)  # at most twice the pool for each question
            scores = self.rerank_scores(chunks, ranked, questions, reranker)
            ranked = fusion.rerank(ranked, scores)
        best = fusion.diverse(ranked.select("q", "doc", "score", "rank"), self.metadata(ranked), k)
        return best.select("q", F.col("final_rank").alias("rank"), "doc", *META, "score")


def _embedded(questions: DataFrame, embedder: Callable[[], Callable]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = embedder()
        for batch in batches:
            vectors = np.asarray(embed(batch.column(1).to_pylist()), float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(vectors), pa.list_(pa.float64()))], names=["q", "vector"])

    schema = T.StructType([questions.schema["q"], T.StructField("vector", T.ArrayType(T.DoubleType()))])
    return questions.where("question is not null").mapInArrow(run, schema)
