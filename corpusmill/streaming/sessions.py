"""Session state in a stream, and windowed request monitoring."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill.operators.sessions import CARRY, HISTORY_TURNS, merge


def carried(turns: DataFrame, cap: int = CARRY) -> DataFrame:
    """(conv, turn, chunks) for a stream of (conv bigint, turn bigint, fresh array<string>); the state is at most cap chunks."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        previous = list(state.get[0]) if state.exists else []
        rows = pd.concat(frames).sort_values("turn")
        out = []
        for turn, fresh in zip(rows["turn"], rows["fresh"]):
            fresh = [] if fresh is None else list(fresh)
            got = merge(previous, fresh, cap)
            if fresh:
                previous = got
            out.append((key[0], turn, got))
        state.update((previous,))
        yield pd.DataFrame(out, columns=["conv", "turn", "chunks"])

    return turns.groupBy("conv").applyInPandasWithState(
        step, "conv bigint, turn bigint, chunks array<string>", "chunks array<string>", "append", GroupStateTimeout.NoTimeout
    )


def session_state(turns: DataFrame, cap: int = CARRY, window: int = HISTORY_TURNS) -> DataFrame:
    """(conv, turn, number, chunks, history) for a stream of (conv bigint, turn bigint, question string, answer string, fresh array<string>).

    number counts the answered turns so far; history holds question and answer of
    the last `window` answered turns before. A turn without an answer changes no
    state. The state of a conversation is its number, cap chunks and window pairs.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, chunks, history = (state.get[0], list(state.get[1]), list(state.get[2])) if state.exists else (0, [], [])
        rows = pd.concat(frames).sort_values("turn")
        out = []
        for turn, question, answer, fresh in zip(rows["turn"], rows["question"], rows["answer"], rows["fresh"]):
            got = merge(chunks, [] if fresh is None else list(fresh), cap)
            shown = list(history)
            if answer is not None and not pd.isna(answer):
                number, chunks, history = number + 1, got, [*history, question or "", answer][-2 * window :]
            out.append((key[0], turn, number, got, shown))
        state.update((number, chunks, history))
        yield pd.DataFrame(out, columns=["conv", "turn", "number", "chunks", "history"])

    return turns.groupBy("conv").applyInPandasWithState(
        step, "conv bigint, turn bigint, number bigint, chunks array<string>, history array<string>", "number bigint, chunks array<string>, history array<string>", "append", GroupStateTimeout.NoTimeout
    )


def monitor(requests: DataFrame, time: str = "ts", value: str = "value", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Requests, failures and the slowest per window, with rows later than the watermark dropped."""
    timed = requests.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", window)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("failures"), F.max(value).alias("slowest")
    ).select(F.col("window.start").alias("start"), "n", "failures", "slowest")
