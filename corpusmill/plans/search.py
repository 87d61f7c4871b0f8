"""Retrieval queries: lexical, dense, fused, reranked, and what is built for them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.functions.text import line_count, tokens
from corpusmill.operators import bm25, dense, fusion
from corpusmill.operators.searchindex import SearchIndex, build_index
from corpusmill.plans.answer import context_block, source_line
from corpusmill.session import checkpoint_folder, checkpointed, spread
from corpusmill.sources.store import IndexStore
from corpusmill.sources.tables import table

#: A search takes every question whose id is divisible by this, against all rows.
EVERY = 50


def corpus(spark: SparkSession, d: str) -> SearchIndex:
    """The search index of the chunks, built when their files are new or changed, else the one that is there."""
    chunks = table(spark, d, "chunks")
    files = chunks.select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("string").alias("at"))
    version = files.distinct().agg(F.sha1(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "file_path", "file_size", "at"))), "\n")).alias("v")).first()["v"]
    store = IndexStore(spark, checkpoint_folder(spark) + "/search-index", "s" + hashlib.md5(d.encode()).hexdigest()[:12])
    build_index(chunks, store, version[:12])
    return SearchIndex.open(spark, store)


def all_questions(spark: SparkSession, d: str) -> DataFrame:
    """(q, question) of the whole gold table."""
    gold = table(spark, d, "gold").where("question is not null and gold_id is not null")
    return gold.groupBy(F.col("gold_id").alias("q")).agg(F.min("question").alias("question"))


def questions(spark: SparkSession, d: str, every: int = EVERY) -> DataFrame:
    """(q, question) of a search."""
    return all_questions(spark, d).where(F.col("q") % every == 0)


def lexical(spark: SparkSession, d: str, k: int = 20, every: int = EVERY) -> DataFrame:
    return corpus(spark, d).lexical(questions(spark, d, every), k)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical(spark, d)


def bm25_scan(spark: SparkSession, d: str) -> DataFrame:
    """Without an index: the questions against the documents, in one pass over the texts."""
    return bm25.search(spread(table(spark, d, "documents")), "doc_id", F.col("text"), questions(spark, d), "q", "question", 20)


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(tokens(F.coalesce("text", F.lit("")))).alias("n_tokens")).distinct()


def _counted_documents(spark: SparkSession, d: str) -> DataFrame:
    return bm25.chosen(bm25.counted(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", F.col("text")))


def doc_statistics(spark: SparkSession, d: str) -> DataFrame:
    return bm25.statistics(_counted_documents(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


def term_stats(spark: SparkSession, d: str) -> DataFrame:
    documents = checkpointed(_counted_documents(spark, d))
    weights = bm25.idf(bm25.document_frequencies(documents), bm25.statistics(documents))
    return weights.select("term", "df", F.round("idf", 9).alias("idf"))


def dense_leg(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    """(q, doc, rank, score) by the hashing embedder."""
    return corpus(spark, d).dense(questions(spark, d), k)


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    fused = fusion.fuse(*corpus(spark, d).legs(questions(spark, d), fusion.POOL))
    return fused.select("q", "doc", F.round("score", 9).alias("score"), "dense_rank", "sparse_rank", "rank")


def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    index, asked = corpus(spark, d), questions(spark, d)
    fused = checkpointed(fusion.fuse(*index.legs(asked, fusion.RERANK_POOL)))  # at most twice the pool for each question
    scores = index.rerank_scores(table(spark, d, "chunks"), fused, asked, fusion.word_overlap)
    ranked = fusion.rerank(fused, scores)
    return ranked.where("rank <= 10").select("q", "doc", F.round("score", 9).alias("score"), "rerank_score", "rank")


def hybrid_search(spark: SparkSession, d: str, k: int = 10, every: int = EVERY) -> DataFrame:
    """Both legs, fusion, rerank, one row per file and symbol, the first k."""
    found = corpus(spark, d).hybrid(table(spark, d, "chunks"), questions(spark, d, every), k, fusion.word_overlap)
    return found.select("q", "rank", "doc", "file", "symbol", "start_line", "end_line", F.round("score", 9).alias("score"))


def dedup_file_symbol(spark: SparkSession, d: str) -> DataFrame:
    index = corpus(spark, d)
    ranked = checkpointed(index.lexical(questions(spark, d)).select("q", "doc", "rank"))
    return fusion.diverse(ranked, index.metadata(ranked), 10).select("q", "doc", "file", "symbol", "rank", "final_rank")


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    asked = e.where(F.col("vec_id") % EVERY == 0)
    return dense.nearest(e, "vec_id", "embedding", asked, "vec_id", "embedding", 10)


def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The prompt's context: a header and a fenced snippet for each hit, in rank order."""
    index = corpus(spark, d)
    hits = checkpointed(index.lexical(questions(spark, d), 6).select("q", "doc", "rank"))
    hits = hits.join(index.metadata(hits), "doc").join(index.texts(table(spark, d, "chunks"), hits), "doc")
    # at most six rows per question
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", c.alias("b")))), lambda x: x["b"])
    return hits.groupBy("q").agg(F.md5(F.array_join(in_order(context_block()), "\n\n")).alias("context_md5"), F.array_join(in_order(source_line()), "\n").alias("sources"))


def embed_dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    return dense.embed_statistics(table(spark, d, "chunks"))


MODEL = "codevec-small"


def _live(spark: SparkSession, d: str) -> DataFrame:
    return dense.live_inputs(table(spark, d, "points"), table(spark, d, "chunks"), MODEL)


def incremental_reuse(spark: SparkSession, d: str) -> DataFrame:
    live = _live(spark, d)
    return dense.embed_inputs(table(spark, d, "chunks")).join(live.select("key", "point_id"), "key").select("key", "n", "point_id")


def reuse_stats(spark: SparkSession, d: str) -> DataFrame:
    return dense.reuse_statistics(table(spark, d, "points"), MODEL)


def to_embed(spark: SparkSession, d: str) -> DataFrame:
    return dense.to_embed(table(spark, d, "chunks"), _live(spark, d))


def embed_fanout(spark: SparkSession, d: str) -> DataFrame:
    made = dense.fan_out(table(spark, d, "chunks"), _live(spark, d).select("key", "point_id"))
    return made.select("id", "point_id").distinct()


def line_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", line_count(F.col("text")).alias("lines")).distinct()


QUERIES = {
    "token_counts": token_counts, "doc_lengths_stats": doc_statistics, "term_stats": term_stats, "bm25_topk": bm25_topk, "bm25_scan": bm25_scan, "cosine_topk": cosine_topk,
    "dense_hash_topk": dense_leg, "rrf_fusion": rrf_fusion, "rerank_topk": rerank_topk, "hybrid_search": hybrid_search, "dedup_file_symbol": dedup_file_symbol,
    "context_blocks": context_blocks, "embed_dedup_stats": embed_dedup_stats, "incremental_reuse": incremental_reuse, "to_embed": to_embed, "reuse_stats": reuse_stats, "embed_fanout": embed_fanout,
    "line_counts": line_counts,
}


def tk(c: str) -> str:
    """The tokenizer in RE2, which has no look-ahead: a space is put before the word first."""
    return f"list_transform(regexp_extract_all(regexp_replace({c}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x))"


CORPUS = """corpus as (select id, c.text, c.file, c.symbol, c.start_line, c.end_line, c.language from
  (select id, min({'code': md5(concat_ws(' ', text, symbol)), 'file': file, 'symbol': symbol, 'start_line': start_line, 'end_line': end_line, 'language': coalesce("language", ''), 'text': text}) c from chunks where id is not null and text is not null group by id)),
asked as (select gold_id, min(question) question from gold where question is not null and gold_id % 50 = 0 group by gold_id)"""
_BM25 = f"""d as (select id, {tk("concat_ws(' ', text, symbol)")} ts from corpus),
dl as (select id, len(ts) dl from d), st as (select count(*) n, avg(dl) avgdl from dl),
tf as (select id, term, count(*) f from (select id, unnest(ts) term from d) group by all),
idf as (select term, ln(1 + (n - c + 0.5::double) / (c + 0.5::double)) idf from (select term, count(*) c from tf group by 1), st),
qt as (select gold_id q, term, count(*) m from (select gold_id, unnest({tk("question")}) term from asked) group by all),
ls as (select q, id, round(sum(m * idf * f * 2.5::double / (f + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))), 9) score
       from qt join tf using (term) join idf using (term) join dl using (id) cross join st group by 1, 2),
lex as (select q, id as doc, row_number() over (partition by q order by score desc, id desc) as rank, score from ls qualify rank <= 40)"""
_DOCUMENTS = """corpus as (select doc_id id, min({'code': md5("text"), 'text': "text"})."text" as text, null as symbol from (select doc_id, coalesce("text", '') as text from documents where doc_id is not null) group by doc_id),
asked as (select gold_id, min(question) question from gold where question is not null and gold_id % 50 = 0 group by gold_id)"""
_HASH = """{0}p as (select {1} k, cast(('0x' || substr(md5(t), 1, 4)) as int) % 64 bucket, case when cast(('0x' || substr(md5(t), 5, 1)) as int) % 2 = 0 then 1.0::double else -1.0::double end s
  from (select {1}, unnest({2}) t from {3})),
{0}s as (select k, bucket, sum(s) w from {0}p group by 1, 2 having sum(s) <> 0),
{0}v as (select k, bucket, w / norm w from {0}s join (select k, sqrt(sum(w * w)) norm from {0}s group by 1) using (k))"""
_DENSE = (
    _HASH.format("d", "id", tk("substr(text, 1, 6000)"), "corpus") + ",\n" + _HASH.format("k", "gold_id", tk("question"), "asked")
    + """,
den as (select q, doc, row_number() over (partition by q order by score desc, doc desc) as rank, score from
  (select av.k q, dv.k doc, round(sum(dv.w * av.w), 6) score from dv join kv av using (bucket) group by 1, 2) qualify rank <= 40)"""
)
_FUSE = """x as (select coalesce(a.q, b.q) q, coalesce(a.doc, b.doc) doc, a.rank dense_rank, b.rank sparse_rank, coalesce(1.0::double / (60 + a.rank), 0) + coalesce(1.0::double / (60 + b.rank), 0) raw
  from (select * from den where rank <= {pool}) a full join (select * from lex where rank <= {pool}) b on a.q = b.q and a.doc = b.doc),
fused as (select q, doc, round(raw, 9) score, dense_rank, sparse_rank, row_number() over (partition by q order by raw desc, dense_rank asc nulls last, sparse_rank asc nulls last) as rank from x)"""
_RERANK = f"""ov as (select f.q, f.doc, f.score, f.rank fused_rank, round(len(list_intersect(list_distinct({tk("question")}), list_distinct({tk("substr(text, 1, 2000)")})))::double / len(list_distinct({tk("question")})), 9) rerank_score
  from fused f join corpus c on c.id = f.doc join asked a on a.gold_id = f.q where f.rank <= 40),
rr as (select *, row_number() over (partition by q order by rerank_score desc nulls last, fused_rank) as rank from ov)"""
_ALL = f"with {CORPUS}, {_BM25}, {_DENSE}, {_FUSE.format(pool=40)}, {_RERANK}"
_DIVERSE = """r1 as (select r.q, r.doc, c.file, c.symbol, c.start_line, c.end_line, r.rank, {extra} row_number() over (partition by r.q, c.file, c.symbol order by r.rank) n1 from {src} r join corpus c on c.id = r.doc),
r2 as (select *, row_number() over (partition by q order by rank) final_rank from r1 where n1 = 1)"""
_LINES = "' L' || start_line || '-' || end_line"
_DOCS = f"d as (select doc_id, {tk(chr(34) + 'text' + chr(34))} ts from (select doc_id, coalesce(text, '') as text from documents))"
_LIVE = f"""txt as (select distinct id chunk_id, md5(substr(text, 1, 6000)) as key from chunks where text is not null),
live as (select txt.key as key, min(p.id) point_id from points p join txt on txt.chunk_id = p.chunk_id where embed_model = '{MODEL}' and vector is not null group by txt.key),
inputs as (select md5(substr(text, 1, 6000)) as key, count(*) n from chunks where text is not null group by 1)"""
ORACLE = {
    "token_counts": f"with {_DOCS} select distinct doc_id, len(ts) n_tokens from d",
    "doc_lengths_stats": f"with {_DOCS} select count(*) n, round(avg(len(ts)), 6) avgdl from d",
    "term_stats": f"with {_DOCS}, st as (select count(*) n from d) select term, c as df, round(ln(1 + (n - c + 0.5::double) / (c + 0.5::double)), 9) idf from (select term, count(distinct doc_id) c from (select doc_id, unnest(ts) term from d) group by 1), st",
    "bm25_topk": f"with {CORPUS}, {_BM25} select q, doc, rank, score from lex where rank <= 20",
    "bm25_scan": f"with {_DOCUMENTS}, {_BM25} select q, doc, rank, score from lex where rank <= 20",
    "cosine_topk": """with s as (select a.vec_id q, b.vec_id doc, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) score from embeddings a, embeddings b where a.vec_id % 50 = 0)
select q, doc, row_number() over (partition by q order by score desc, doc) as rank, score from s qualify rank <= 10""",
    "dense_hash_topk": f"with {CORPUS}, {_DENSE} select q, doc, rank, score from den where rank <= 20",
    "rrf_fusion": f"with {CORPUS}, {_BM25}, {_DENSE}, {_FUSE.format(pool=10)} select q, doc, score, dense_rank, sparse_rank, rank from fused",
    "rerank_topk": f"{_ALL} select q, doc, score, rerank_score, rank from rr where rank <= 10",
    "hybrid_search": f"{_ALL}, {_DIVERSE.format(extra='r.score,', src='rr')} select q, final_rank as rank, doc, file, symbol, start_line, end_line, score from r2 where final_rank <= 10",
    "dedup_file_symbol": f"with {CORPUS}, {_BM25}, {_DIVERSE.format(extra='', src='(select * from lex where rank <= 20)')} select q, doc, file, symbol, rank, final_rank from r2 where final_rank <= 10",
    "context_blocks": f"""with {CORPUS}, {_BM25} select q, md5(string_agg('### ' || file || {_LINES} || '  (' || symbol || ')' || chr(10) || '```' || "language" || chr(10) || substr(text, 1, 2000) || chr(10) || '```', chr(10) || chr(10) order by rank)) context_md5,
  string_agg('  ' || file || ' ' || {_LINES} || '  ' || symbol, chr(10) order by rank) sources from lex join corpus on corpus.id = lex.doc where rank <= 6 group by q""",
    "embed_dedup_stats": "select count(*) n_rows, count(distinct substr(text, 1, 6000)) distinct_inputs, count(*) - count(distinct substr(text, 1, 6000)) duplicates_skipped from chunks where text is not null",
    "incremental_reuse": f"with {_LIVE} select key, n, point_id from inputs join live using (key)",
    "to_embed": f"with {_LIVE} select key, n from inputs where key not in (select key from live)",
    "reuse_stats": f"select count(*) filter (coalesce(embed_model = '{MODEL}' and vector is not null, false)) usable, count(*) filter (not coalesce(embed_model = '{MODEL}' and vector is not null, false)) skipped from points",
    "embed_fanout": f"with {_LIVE} select distinct c.id, point_id from chunks c join live on live.key = md5(substr(c.text, 1, 6000))",
    "line_counts": "select distinct doc_id, length(text) - length(replace(text, chr(10), '')) + 1 as lines from documents where text is not null",
}
