"""Queries of the session operators; the event table is read as conversations of users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.operators import sessions
from corpusmill.sources.tables import table


def _turns(s: SparkSession, d: str) -> DataFrame:
    """A conversation is one user's events of a day."""
    e = table(s, d, "events")
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return e.select((F.col("user_id") * 100_000 + day).alias("conv"), F.col("event_id").alias("turn"), "event_type", "value", F.get_json_object("props", "$.k").alias("k"))


def history_window(s: SparkSession, d: str) -> DataFrame:
    t = sessions.history(_turns(s, d), "conv", "turn", F.col("event_type"))
    return t.select("conv", "turn", F.array_join("history", ",").alias("history"))


def carry_forward(s: SparkSession, d: str) -> DataFrame:
    """Each turn brings two chunks, failed ones (errors) none."""
    fresh = F.when(F.col("event_type") == "error", F.array().cast("array<string>")).otherwise(F.array("event_type", "k"))
    t = _turns(s, d).select("conv", "turn", fresh.alias("fresh"))
    out = sessions.carry_forward(t)
    return out.select("conv", "turn", F.array_join("chunks", ",").alias("chunks"))


def session_summary(s: SparkSession, d: str) -> DataFrame:
    return _turns(s, d).groupBy("conv").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("failures"), F.round(F.max("value"), 6).alias("slowest"))


def rating_reasons(s: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(",", F.col("k"), (F.col("k").cast("int") % 7).cast("string"), F.lit(" 2"), (F.col("turn") % 9).cast("string"))
    return _turns(s, d).select("turn", F.array_join(sessions.reasons(text), ",").alias("reasons"))


def history_messages(s: SparkSession, d: str) -> DataFrame:
    """The messages of a prompt; errors are turns without an answer."""
    t = _turns(s, d).withColumn("answer", F.when(F.col("event_type") != "error", F.col("k")))
    out = sessions.messages(t, "conv", "turn", "event_type", "answer")
    return out.select("conv", "turn", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("messages"))


def asked_turns(s: SparkSession, d: str) -> DataFrame:
    """Turns whose question is neither blank nor behind a quit word."""
    question = F.when(F.col("k") == "7", " Quit ").when(F.col("k") == "3", "  ").otherwise(F.col("event_type"))
    return sessions.asked(_turns(s, d).withColumn("question", question), "conv", "turn", "question").select("conv", "turn", "question")


def rating_class(s: SparkSession, d: str) -> DataFrame:
    typed = F.element_at(F.array(*[F.lit(x) for x in TYPED]), (F.col("turn") % len(TYPED) + 1).cast("int"))
    return _turns(s, d).select("turn", sessions.rating(typed).alias("rating"))


def session_documents(s: SparkSession, d: str) -> DataFrame:
    """Each conversation as one nested row, shown by the digest of its turns."""
    t = _turns(s, d).select("conv", "turn", F.col("event_type").alias("question"), F.col("k").alias("answer"), F.col("value").alias("latency"))
    line = lambda x: F.concat_ws(":", x["turn"].cast("string"), x["question"], x["answer"])
    return sessions.documents(t).select("conv", "n_turns", F.md5(F.array_join(F.transform("turns", line), "|")).alias("turns_md5"))


#: What is typed at the rating prompt, in turn.
TYPED = ("G ", "n", "skip", "", "bad", "Needs Improvement", "s", " good")
QUERIES = {"history_messages": history_messages, "asked_turns": asked_turns, "rating_class": rating_class, "session_documents": session_documents, "history_window": history_window, "carry_forward": carry_forward, "session_summary": session_summary, "rating_reasons": rating_reasons}
_T = "t as (select user_id * 100000 + date_diff('day', date '2024-01-01', cast(ts as date)) conv, event_id turn, event_type, value, json_extract_string(props, '$.k') k from events)"
_R = "[" + ", ".join(f"'{r}'" for r in sessions.REASONS) + "]"
ORACLE = {
    "history_messages": f"""with {_T}, c as (select *, count(*) filter (event_type <> 'error' and k is not null) over (partition by conv order by turn rows between unbounded preceding and 1 preceding) before from t),
a as (select *, row_number() over (partition by conv order by turn) n from t where event_type <> 'error' and k is not null)
select c.conv, c.turn, coalesce(string_agg('user:' || a.event_type || '|assistant:' || a.k, '|' order by a.n), '') messages from c left join a on a.conv = c.conv and a.n <= c.before and a.n > c.before - 8 group by 1, 2""",
    "asked_turns": f"""with {_T}, q as (select conv, turn, case when k = '7' then ' Quit ' when k = '3' then '  ' else event_type end question from t)
select conv, turn, question from q where trim(question) <> '' and not exists (select 1 from q x where x.conv = q.conv and x.turn <= q.turn and lower(trim(x.question)) in ('quit', 'exit', '/quit', '/exit', '/q'))""",
    "rating_class": f"""with {_T} select turn, case (turn % 8) when 0 then 'good' when 1 then 'needs_improvement' when 2 then 'skipped' when 3 then 'skipped' when 5 then 'needs_improvement' when 6 then 'skipped' when 7 then 'good' end rating from t""",
    "session_documents": f"with {_T} select conv, count(*) n_turns, md5(string_agg(concat_ws(':', turn, event_type, k), '|' order by turn)) turns_md5 from t group by 1",
    "history_window": f"with {_T} select conv, turn, coalesce(string_agg(event_type, ',') over (partition by conv order by turn rows between 8 preceding and 1 preceding), '') history from t",
    "session_summary": f"with {_T} select conv, count(*) turns, count(*) filter (event_type = 'error') failures, round(max(value), 6) slowest from t group by 1",
    "rating_reasons": f"""with {_T}, n as (select turn, list_sort(list_distinct(list_filter([cast(k as int), cast(k as int) % 7, 2, cast(turn % 9 as int)], lambda x: x between 1 and 6))) ns from t)
select turn, coalesce(array_to_string(list_transform(ns, lambda x: {_R}[x]), ','), '') reasons from n""",
    # a chunk is carried from the first turn that brings it, in order, until twelve are full
    "carry_forward": f"""with {_T}, f as (select conv, turn, unnest([event_type, k]) c, unnest([1, 2]) o from t where event_type <> 'error'),
firsts as (select conv, c, min(struct_pack(t := turn, o := o)) ao from f where c is not null group by 1, 2),
slot as (select *, row_number() over (partition by conv order by ao) n from firsts qualify n <= 12)
select t.conv, t.turn, coalesce(string_agg(c, ',' order by n), '') chunks from t left join slot s on s.conv = t.conv and s.ao.t <= t.turn group by 1, 2""",
}
