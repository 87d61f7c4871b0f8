"""Request records: percentiles, level summaries, speed, agreement.

Defined results: statistics of latency are over successes and null without any;
a rate over no requests is null; samples without a count or a time are skipped.
"""

from __future__ import annotations

import subprocess
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, TimeoutError as Late

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusmill.schema import REQUEST

#: Requests at once of the batches of a ramp.
LEVELS = (1, 3, 5, 8, 10, 12)


def nearest_rank(value: str, p: float) -> Column:
    """The smallest value with at least p percent of all at or below it."""
    return F.expr(f"percentile_disc({p / 100}) within group (order by {value})")


def summary(records: DataFrame, by: list[str], latency: str = "latency", success: str = "success") -> DataFrame:
    """n, ok, failures, rate, p50, p95, max and mean of each level."""
    good = F.when(F.col(success), F.col(latency))
    rows = records.withColumn("_ok", good)
    n, ok = F.count(F.lit(1)), F.sum(F.when(F.col(success), 1).otherwise(0))
    return rows.groupBy(*by).agg(
        n.alias("n"), ok.alias("ok"), (n - ok).alias("failures"), F.round(ok / n, 6).alias("rate"),
        nearest_rank("_ok", 50).alias("p50"), nearest_rank("_ok", 95).alias("p95"), F.max("_ok").alias("max"), F.round(F.avg("_ok"), 6).alias("mean"),
    )


def speed(tokens: Column, nanoseconds: Column) -> Column:
    """Tokens per second."""
    return F.try_divide(tokens.cast("double"), nanoseconds.cast("double") / 1e9)


def answer_seconds(prompt: Column, generation: Column) -> Column:
    """Seconds of a whole answer from the nanoseconds of its two parts."""
    return (prompt.cast("double") + generation.cast("double")) / 1e9


def p_yes(no: Column, yes: Column) -> Column:
    """Softmax of two logits, without overflow."""
    top = F.greatest(no, yes)
    return F.exp(yes - top) / (F.exp(no - top) + F.exp(yes - top))


def round_robin(workers: DataFrame, questions: DataFrame, n: int) -> DataFrame:
    """Worker i with question i mod n; questions (q_ord, question) numbered from 0."""
    return workers.join(F.broadcast(questions), F.pmod(F.col("worker"), F.lit(n)) == F.col("q_ord"))


def preflight(leg: DataFrame, name: str) -> None:
    """Refuses to score with a leg that finds nothing."""
    if leg.isEmpty():
        raise RuntimeError(f"the {name} leg gives no rows; a degraded stack is not scored")


def run_level(spark: SparkSession, ask: Callable[[str], str], questions: list[str], level: int, timeout: float = 120.0, marker: str = "[generation unavailable") -> DataFrame:
    """One batch of `level` requests at once, worker i asking question i mod n; a record each (schema.REQUEST).

    An answer with the marker, an exception and a request that is late all fail.
    """

    def one(i: int) -> tuple:
        start = time.time()
        try:
            text = ask(questions[i % len(questions)])
            failed = marker in text
            return (i, start, time.time(), time.time() - start, not failed, "unavailable" if failed else None, text[:500] if failed else None, None if failed else len(text))
        except Exception as e:
            return (i, start, time.time(), time.time() - start, False, type(e).__name__, str(e)[:500], None)

    pool = ThreadPoolExecutor(level)
    began = time.time()
    waiting = [pool.submit(one, i) for i in range(level)]
    rows = []
    for i, f in enumerate(waiting):
        try:
            rows.append(f.result(max(0.0, timeout - (time.time() - began))))
        except Late:
            rows.append((i, began, time.time(), time.time() - began, False, "timeout", f"over {timeout} s", None))
    pool.shutdown(wait=False, cancel_futures=True)
    return spark.createDataFrame(sorted(rows), REQUEST)


def ramp(spark: SparkSession, ask: Callable[[str], str], questions: list[str], levels: tuple[int, ...] = LEVELS, timeout: float = 120.0, monitor: Monitor | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, summary): one batch after the other, the records with their level; the summary with wall_s and peak_mem_mb of each.

    The device is sampled while each batch runs.
    """
    records, times = None, []
    for level in levels:
        watch = monitor or Monitor()
        began = time.time()
        with watch:
            rows = run_level(spark, ask, questions, level, timeout).withColumn("level", F.lit(level))
        times.append((level, time.time() - began, watch.peak()))
        records = rows if records is None else records.unionByName(rows)
    walls = spark.createDataFrame(times, "level int, wall_s double, peak_mem_mb int")
    return records, summary(records, ["level"]).join(F.broadcast(walls), "level")  # a row for each level


class Monitor:
    """Samples a device every interval while its block runs; a failing poll is a sample with an error."""

    def __init__(self, interval: float = 1.0, command: tuple[str, ...] | None = None):
        self.interval, self.command, self.samples = interval, command, []
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    def _poll(self) -> None:
        while True:
            self.samples.append(sample_device(self.command) if self.command else sample_device())
            if self._stop.wait(self.interval):
                return

    def __enter__(self) -> Monitor:
        self.samples = []
        self._stop.clear()
        self._thread = threading.Thread(target=self._poll, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        self._thread.join(self.interval + 5)

    def peak(self) -> int | None:
        return max((m for _, m, _, e in self.samples if e is None), default=None)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.samples, "t double, mem_used_mb int, util_pct int, error string")


def sample_device(command: tuple[str, ...] = ("nvidia-smi", "--query-gpu=memory.used,utilization.gpu", "--format=csv,noheader,nounits")) -> tuple:
    """(t, mem_used_mb, util_pct, error) of one poll; a failure is a row with an error."""
    now = time.time()
    try:
        out = subprocess.run(command, capture_output=True, text=True, check=True, timeout=10).stdout
        memory, use = (int(x) for x in out.splitlines()[0].split(","))
        return now, memory, use, None
    except Exception as e:
        return now, None, None, f"{type(e).__name__}: {e}"[:300]
