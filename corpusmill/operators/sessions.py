"""Chat sessions: history windows, carried chunks, ratings, summaries.

Defined results: the first turn has an empty history; a turn that failed or
found nothing changes no state; nulls in a list of chunks are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusmill.sources.paths import Folder

#: Turns of history, carried chunks, words that end a session, rating reasons in their order.
HISTORY_TURNS, CARRY = 8, 12
QUIT_WORDS = ("quit", "exit", "/quit", "/exit", "/q")
REASONS = ("missing_incomplete_info", "wrong_citations", "inaccurate_hallucinated", "too_vague", "retrieval_missed_code", "other")


def history(turns: DataFrame, conversation: str, turn: str, value: Column, window: int = HISTORY_TURNS) -> DataFrame:
    """Adds history: the values of up to `window` turns before, oldest first."""
    w = Window.partitionBy(conversation).orderBy(turn).rowsBetween(-window, -1)
    return turns.withColumn("history", F.collect_list(value).over(w))


def messages(turns: DataFrame, conversation: str, turn: str, question: str, answer: str, window: int = HISTORY_TURNS) -> DataFrame:
    """Adds messages: question and answer of the last `window` answered turns before as (role, content), oldest first."""
    part = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).cast("string").alias("content"))
    pair = F.when(F.col(answer).isNotNull(), F.struct(F.col(turn).alias("t"), F.array(part("user", question), part("assistant", answer)).alias("p")))
    before = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    # how many answered turns came before tells which of them lie in the window
    near = Window.partitionBy(conversation).orderBy("_n").rangeBetween(-window, -1)
    rows = turns.withColumn("_pair", pair).withColumn("_n", F.count("_pair").over(before)).withColumn("_near", F.array_sort(F.collect_list("_pair").over(near)))
    return rows.withColumn("messages", F.flatten(F.transform("_near", lambda x: x["p"]))).drop("_pair", "_n", "_near")


def asked(turns: DataFrame, conversation: str, turn: str, question: str) -> DataFrame:
    """The turns before the first quit word of each conversation, blank ones left out."""
    word = F.lower(F.trim(F.coalesce(F.col(question), F.lit(""))))
    stop = turns.where(word.isin(*QUIT_WORDS)).groupBy(conversation).agg(F.min(turn).alias("_stop"))
    return turns.where(word != "").join(stop, conversation, "left").where(F.col("_stop").isNull() | (F.col(turn) < F.col("_stop"))).drop("_stop")


def rating(choice: Column) -> Column:
    """good, needs_improvement or skipped for what was typed, null for anything else."""
    word = F.lower(F.trim(choice))
    return F.when(word.isin("g", "good"), "good").when(word.isin("n", "needs improvement", "needs_improvement"), "needs_improvement").when(word.isin("s", "skip", ""), "skipped")


def documents(turns: DataFrame) -> DataFrame:
    """(conv, n_turns, turns): each conversation's turns (turn, question, answer, latency) as one nested row, in order; latency in tenths.

    A conversation is one row of the result, so it is one task's by definition.
    """
    one = F.struct("turn", "question", "answer", F.round("latency", 1).alias("latency_seconds"))
    return turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(one)).alias("turns"))


def session_path(slug: str, started: datetime, base: str) -> tuple[str, str]:
    """(folder, file) of a session: the researcher's folder and the time it began."""
    return f"{base.rstrip('/')}/{slug}", started.strftime("%Y%m%d_%H%M%S") + ".json"


def save_session(spark: SparkSession, session: dict, slug: str, started: datetime, base: str) -> str:
    """Writes a session's whole state at once, in place of what was saved before; gives its path."""
    folder, name = session_path(slug, started, base)
    target = Folder(spark, folder)
    target.write(name, json.dumps(session, indent=2, default=str))
    return target / name


def merge(previous: list, fresh: list, cap: int = CARRY) -> list:
    """Carried chunks first, then the new ones, each once, cut at the cap."""
    return list(dict.fromkeys(x for x in [*previous, *fresh] if x is not None))[:cap]


def carry_forward(turns: DataFrame, cap: int = CARRY, carry: str = "all") -> DataFrame:
    """(conv, turn, chunks): the context of each turn of (conv, turn, fresh array).

    With carry 'all' chunks pile up until the cap is full and then nothing new
    comes in; with 'last_turn' only the last turn's own chunks are carried. The
    sorted turns are folded as a stream, so a long conversation is never held whole.
    """
    if carry not in ("all", "last_turn"):
        raise ValueError("carry is 'all' or 'last_turn'")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, []
        for frame in frames:
            out = []
            for c, t, fresh in zip(frame["conv"], frame["turn"], frame["fresh"]):
                if c != conv:
                    conv, state = c, []
                fresh = [] if fresh is None else list(fresh)
                got = merge(state, fresh, cap)
                if fresh:
                    state = got if carry == "all" else [x for x in fresh if x is not None]
                out.append((c, t, got))
            yield pd.DataFrame(out, columns=["conv", "turn", "chunks"])

    sorted_ = turns.select("conv", "turn", "fresh").repartition("conv").sortWithinPartitions("conv", "turn")
    return sorted_.mapInPandas(run, "conv bigint, turn bigint, chunks array<string>")


def reasons(text: Column) -> Column:
    """Comma-separated numbers -> the distinct reason codes in order; numbers out of range are dropped."""
    numbers = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int")), lambda n: n.isNotNull() & (n >= 1) & (n <= len(REASONS)))
    return F.transform(F.array_sort(F.array_distinct(numbers)), lambda n: F.element_at(F.array(*[F.lit(r) for r in REASONS]), n))
