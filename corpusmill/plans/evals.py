"""Queries of the evaluation suite: ranking metrics, load, speed, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.operators import dense, loadtest, metrics
from corpusmill.operators.similarity import similarity_in_order
from corpusmill.operators import fusion
from corpusmill.operators.topk import union
from corpusmill.plans.search import CORPUS, _BM25, _DENSE, _FUSE, EVERY, corpus, lexical, questions
from corpusmill.session import broadcast_if_small, checkpointed
from corpusmill.sources.tables import table


def _ranked(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    asked = e.where(F.col("vec_id") % EVERY == 0)
    return dense.nearest(e, "vec_id", "embedding", asked, "vec_id", "embedding", 10)


def _label_gold(s: SparkSession, d: str) -> DataFrame:
    """Relevant to a query vector are all vectors of its label."""
    e = table(s, d, "embeddings").select("vec_id", "label").distinct()
    asked = e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("q"), "label")
    return e.withColumnRenamed("vec_id", "doc").join(broadcast_if_small(asked), "label").select("q", "doc")


def _label_scores(s: SparkSession, d: str) -> DataFrame:
    asked = table(s, d, "embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("q"))
    return metrics.per_query(_ranked(s, d), _label_gold(s, d), asked)


def relevance_at_k(s: SparkSession, d: str) -> DataFrame:
    return _label_scores(s, d)


def macro_average(s: SparkSession, d: str) -> DataFrame:
    return metrics.macro(_label_scores(s, d))


def metric_pivot(s: SparkSession, d: str) -> DataFrame:
    """The macro averages with one column for each k."""
    m = macro_average(s, d)
    rows = m.select("k", F.explode(F.create_map(*[x for c in ("recall", "precision", "ndcg") for x in (F.lit(c), F.col(c))])).alias("metric", "value"))
    return rows.groupBy("metric").pivot("k", list(metrics.KS)).agg(F.first("value")).select("metric", *[F.col(str(k)).alias(f"at_{k}") for k in metrics.KS])


def gold_metrics(s: SparkSession, d: str) -> DataFrame:
    """The lexical leg against the gold sets."""
    gold = table(s, d, "gold").select(F.col("gold_id").alias("q"), F.explode("relevant_chunk_ids").alias("doc")).where("doc is not null and q is not null").distinct()
    asked = questions(s, d).select("q")
    return metrics.per_query(lexical(s, d, 10).select("q", "doc", "rank"), gold.join(asked, "q", "left_semi"), asked)


def best_leg(s: SparkSession, d: str) -> DataFrame:
    """The retrieval legs held against the gold sets: which is best at each k."""
    asked = questions(s, d)
    gold = table(s, d, "gold").select(F.col("gold_id").alias("q"), F.explode("relevant_chunk_ids").alias("doc")).where("doc is not null and q is not null").distinct().join(asked.select("q"), "q", "left_semi")
    gold = checkpointed(gold)
    found = dict(zip(("dense", "lexical"), corpus(s, d).legs(asked, 10)))
    found["fused"] = fusion.fuse(found["dense"], found["lexical"])
    macros = union([metrics.macro(metrics.per_query(r.select("q", "doc", "rank"), gold, asked.select("q"))).withColumn("model", F.lit(m)) for m, r in found.items()])
    return metrics.best(macros)


def gold_limit(s: SparkSession, d: str) -> DataFrame:
    """The first questions of the gold set, as a smoke run takes them."""
    return questions(s, d, 1).orderBy("q").limit(20)


def _requests(s: SparkSession, d: str) -> DataFrame:
    """The event table as a request log."""
    return table(s, d, "events").select("user_id", "event_type", F.col("value").alias("latency"), (F.col("event_type") != "error").alias("success"), "ts", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


def latency_percentiles(s: SparkSession, d: str) -> DataFrame:
    return loadtest.summary(_requests(s, d).withColumn("level", F.col("k") % 6), ["level"])


def throughput_medians(s: SparkSession, d: str) -> DataFrame:
    r = _requests(s, d).where((F.coalesce("k", F.lit(0)) != 0) & (F.coalesce("latency", F.lit(0.0)) != 0))
    speed = loadtest.speed(F.col("k"), F.col("latency") * 1e9)
    return r.groupBy("event_type").agg(F.round(F.median(speed), 9).alias("tok_per_s"), F.median("k").alias("tokens"), F.round(F.median("latency"), 9).alias("answer_s"))


def peak_usage(s: SparkSession, d: str) -> DataFrame:
    return _requests(s, d).groupBy("user_id").agg(F.max(F.when(F.col("success"), F.col("latency"))).alias("peak"))


def rerank_probability(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select("event_id", F.round(loadtest.p_yes(F.col("value") / 100, F.lit(1.0)), 9).alias("p_yes"))


def temp_sweep(s: SparkSession, d: str) -> DataFrame:
    """Per temperature: accuracy over all runs, and the share of questions whose runs agree."""
    runs = _requests(s, d).select((F.col("k") % 3).alias("temp"), F.col("user_id").alias("question"), F.when(F.col("latency") > 30, 1).otherwise(0).alias("cited")).where("temp is not null")
    per = runs.groupBy("temp", "question").agg(F.count(F.lit(1)).alias("n"), F.sum("cited").alias("hits"), F.min("cited").alias("lo"), F.max("cited").alias("hi"))
    return per.groupBy("temp").agg(F.round(F.sum("hits") / F.sum("n"), 6).alias("accuracy"), F.round(F.avg(F.when(F.col("lo") == F.col("hi"), 1.0).otherwise(0.0)), 6).alias("agreement"), F.sum("n").alias("runs"))


def parameter_grid(s: SparkSession, d: str) -> DataFrame:
    """Temperatures x repetitions x languages, each with its number of questions: a product of three stated lists."""
    temps = s.createDataFrame([(0.0,), (0.3,), (0.7,)], "temp double")
    reps = s.range(1, 4).select(F.col("id").cast("int").alias("rep"))
    counts = table(s, d, "gold").groupBy(F.coalesce("language", F.lit("none")).alias("language")).agg(F.countDistinct("gold_id").alias("n_questions"))
    return counts.join(F.broadcast(temps), F.lit(True)).join(F.broadcast(reps), F.lit(True))


def round_robin(s: SparkSession, d: str) -> DataFrame:
    workers = s.range(12).select(F.col("id").cast("int").alias("worker"))
    asked = table(s, d, "region").select(F.col("r_regionkey").alias("q_ord"), F.col("r_name").alias("question"))
    return loadtest.round_robin(workers, asked, 5).select("worker", "question")


def events_per_hour(s: SparkSession, d: str) -> DataFrame:
    """The monitor's samples in tumbling windows."""
    e = table(s, d, "events")
    return e.groupBy(F.date_format(F.date_trunc("hour", F.col("ts")), "yyyy-MM-dd HH:mm").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("peak"))


def adjacent_similarity(s: SparkSession, d: str) -> DataFrame:
    """Each document with the next of its source: how alike their texts are, by matching blocks."""
    rows = table(s, d, "documents").where("text is not null and posted_at is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "posted_at", "text")
    return similarity_in_order(rows, "source", ["posted_at", "doc_id"], "doc_id", "text")


QUERIES = {
    "relevance_at_k": relevance_at_k, "macro_average": macro_average, "metric_pivot": metric_pivot, "gold_metrics": gold_metrics, "best_leg": best_leg, "gold_limit": gold_limit, "latency_percentiles": latency_percentiles,
    "throughput_medians": throughput_medians, "peak_usage": peak_usage, "rerank_probability": rerank_probability, "temp_sweep_agreement": temp_sweep, "parameter_grid": parameter_grid,
    "round_robin": round_robin, "events_per_hour": events_per_hour, "adjacent_similarity": adjacent_similarity,
}

_METRICS = """g as (select q, k from {asked}, (values (1), (3), (5), (10)) v(k)),
f as (select r.q, r.rank, gd.doc is not null rel from {ranked} r left join {gold} gd on gd.q = r.q and gd.doc = r.doc),
sz as (select q, count(*) n from {gold} group by q),
sm as (select g.q, g.k, count(*) filter (rel and rank <= k) hits, count(*) filter (rank <= k) shown, coalesce(sum(1.0::double / log2(rank + 1.0::double)) filter (rel and rank <= k), 0) dcg, min(rank) filter (rel) first
       from g join f on f.q = g.q group by 1, 2),
pq as (select g.q, g.k, round(case when coalesce(n, 0) > 0 then coalesce(hits, 0)::double / n else 0 end, 9) recall, round(coalesce(case when shown > 0 then hits::double / shown end, 0), 9) "precision",
       round(case when coalesce(n, 0) > 0 then coalesce(dcg, 0) / (select sum(1.0::double / log2(i + 1.0::double)) from range(1, 11) t(i) where i <= least(n, g.k)) else 0 end, 9) ndcg, round(coalesce(1.0::double / first, 0), 9) mrr
       from g left join sm on sm.q = g.q and sm.k = g.k left join sz on sz.q = g.q)"""
_LABELS = f"""with aq as (select vec_id q from embeddings where vec_id % 50 = 0),
rk as (select q, doc, row_number() over (partition by q order by score desc, doc) as rank from
  (select a.vec_id q, b.vec_id doc, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) score from embeddings a, embeddings b where a.vec_id % 50 = 0) qualify rank <= 10),
gl as (select a.vec_id q, b.vec_id doc from embeddings a join embeddings b using (label) where a.vec_id % 50 = 0),
{_METRICS.format(asked="aq", ranked="rk", gold="gl")}"""
_MACRO = "mc as (select k, round(avg(recall), 6) recall, round(avg(\"precision\"), 6) \"precision\", round(avg(ndcg), 6) ndcg, round(avg(mrr), 6) mrr from pq group by k)"
_REQ = "r as (select user_id, event_type, value latency, event_type <> 'error' success, ts, try_cast(json_extract_string(props, '$.k') as bigint) k from events)"
ORACLE = {
    "relevance_at_k": f"{_LABELS} select * from pq",
    "macro_average": f"{_LABELS}, {_MACRO} select * from mc",
    "metric_pivot": f"""{_LABELS}, {_MACRO}, u as (select k, 'recall' metric, recall v from mc union all select k, 'precision', "precision" from mc union all select k, 'ndcg', ndcg from mc)
select metric, max(v) filter (k = 1) at_1, max(v) filter (k = 3) at_3, max(v) filter (k = 5) at_5, max(v) filter (k = 10) at_10 from u group by metric""",
    "gold_metrics": f"""with {CORPUS}, {_BM25}, aq as (select gold_id q from asked), rk as (select q, doc, rank from lex where rank <= 10),
gl as (select distinct q, doc from (select gold_id q, unnest(relevant_chunk_ids) doc from gold) where doc is not null and q in (select q from aq)),
{_METRICS.format(asked="aq", ranked="rk", gold="gl")} select * from pq""",
    "best_leg": f"""with {CORPUS}, {_BM25}, {_DENSE}, {_FUSE.format(pool=10)}, aq as (select gold_id q from asked),
gl as (select distinct q, doc from (select gold_id q, unnest(relevant_chunk_ids) doc from gold) where doc is not null and q in (select q from aq)),
legs as ({" union all ".join(f"select '{m}' model, * from (with {_METRICS.format(asked='aq', ranked=f'(select * from {t} where rank <= 10)' if m != 'fused' else t, gold='gl')}, {_MACRO} select * from mc)" for m, t in (("dense", "den"), ("lexical", "lex"), ("fused", "fused")))}),
u as (select k, model, 'recall' metric, recall v from legs union all select k, model, 'precision', "precision" from legs union all select k, model, 'ndcg', ndcg from legs union all select k, model, 'mrr', mrr from legs)
select k, metric, model, v as value from u qualify row_number() over (partition by k, metric order by v desc, model) = 1""",
    "gold_limit": "select gold_id q, min(question) question from gold where question is not null and gold_id is not null group by 1 order by 1 limit 20",
    "latency_percentiles": f"""with {_REQ} select k % 6 as level, count(*) n, count(*) filter (success) ok, count(*) - count(*) filter (success) failures, round(count(*) filter (success)::double / count(*), 6) rate,
  quantile_disc(latency, 0.5) filter (success) p50, quantile_disc(latency, 0.95) filter (success) p95, max(latency) filter (success) "max", round(avg(latency) filter (success), 6) "mean" from r group by 1""",
    "throughput_medians": f"with {_REQ} select event_type, round(median(k / latency), 9) tok_per_s, median(k) tokens, round(median(latency), 9) answer_s from r where coalesce(k, 0) <> 0 and coalesce(latency, 0) <> 0 group by 1",
    "peak_usage": f"with {_REQ} select user_id, max(latency) filter (success) peak from r group by 1",
    "rerank_probability": "select event_id, round(exp(1.0::double - greatest(value / 100, 1.0::double)) / (exp(value / 100 - greatest(value / 100, 1.0::double)) + exp(1.0::double - greatest(value / 100, 1.0::double))), 9) p_yes from events",
    "temp_sweep_agreement": f"""with {_REQ}, p as (select k % 3 as temp, user_id, count(*) n, count(*) filter (latency > 30) hits from r where k is not null group by 1, 2)
select temp, round(sum(hits)::double / sum(n), 6) accuracy, round(avg(case when hits = 0 or hits = n then 1.0 else 0.0 end), 6) agreement, sum(n) runs from p group by 1""",
    "parameter_grid": "select language, n_questions, temp, rep from (select coalesce(language, 'none') as language, count(distinct gold_id) n_questions from gold group by 1), (values (0.0::double), (0.3::double), (0.7::double)) t(temp), (values (1), (2), (3)) r(rep)",
    "round_robin": "select cast(i as int) worker, r_name question from range(12) t(i) join region on r_regionkey = i % 5",
    "events_per_hour": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as hour, count(*) n, round(max(value), 6) peak from events group by 1",
}
