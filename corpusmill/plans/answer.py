"""Prompt assembly, generation and sources, with a pluggable generator.

Defined results: a generator that fails leaves its answer null and the error
beside it; the sources stay. Questions without hits have empty sources.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusmill.functions.text import snippet
from corpusmill.operators.fusion import Scorer
from corpusmill.operators.searchindex import SearchIndex
from corpusmill.session import checkpointed

#: What a generator is told first; give your own.
SYSTEM = "Answer from the code snippets only, cite file and line range of each claim, name every distinct implementation, and say so if the snippets hold no answer."
#: What stands in an answer's place, and chunks of a prompt.
UNAVAILABLE, NOTHING, TOP_K = "[generation unavailable", "No relevant chunks found.", 6


def _lines() -> Column:
    return F.concat(F.lit("L"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))


def context_block() -> Column:
    """Fixed format: a header, then the first part of a chunk's text in a fence that names its language."""
    head = F.concat(F.lit("### "), "file", F.lit(" "), _lines(), F.lit("  ("), "symbol", F.lit(")"))
    return F.concat(head, F.lit("\n```"), F.coalesce("language", F.lit("")), F.lit("\n"), snippet(F.col("text")), F.lit("\n```"))


def source_line() -> Column:
    """Fixed format: file, lines and symbol, two blanks between them and before."""
    return F.concat(F.lit("  "), "file", F.lit("  "), _lines(), F.lit("  "), "symbol")


def prompts(hits: DataFrame, questions: DataFrame, history: str | None = None, system: str = SYSTEM) -> DataFrame:
    """(q, messages, sources): the system text, the history if any, then the question with its snippets in rank order.

    hits: q, rank and the chunk columns, at most top-k rows per question.
    """
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", c.alias("b")))), lambda x: x["b"])
    blocks = hits.groupBy("q").agg(F.array_join(ordered(context_block()), "\n\n").alias("context"), F.array_join(ordered(source_line()), "\n").alias("sources"))
    rows = questions.join(blocks, "q", "left").withColumn("sources", F.coalesce("sources", F.lit("")))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    user = F.concat(F.lit("Question: "), "question", F.lit("\n\nCode snippets:\n\n"), F.coalesce("context", F.lit("")))
    first, last = F.array(message("system", F.lit(system))), F.array(message("user", user))
    return rows.withColumn("messages", F.concat(first, F.col(history), last) if history else F.concat(first, last)).select("q", "messages", "sources")


def generate(rows: DataFrame, generator: Callable[[list[dict]], str]) -> DataFrame:
    """Adds answer and error; each failure stays in its row."""
    schema = T.StructType([*rows.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers, errors = [], []
            for messages in frame["messages"]:
                try:
                    answers.append(generator([dict(m) if isinstance(m, dict) else m.asDict() for m in messages]))
                    errors.append(None)
                except Exception as e:
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield frame.assign(answer=answers, error=errors)

    return rows.mapInPandas(run, schema)


def answers(rows: DataFrame) -> DataFrame:
    """(q, text, failed): the answer, or a marker where it failed, and the sources below; a fixed sentence where nothing was found."""
    body = F.coalesce("answer", F.concat(F.lit(UNAVAILABLE + "] "), F.coalesce("error", F.lit(""))))
    found = F.concat(body, F.lit("\n\nSources:\n"), "sources")
    return rows.select("q", F.when(F.col("sources") == "", NOTHING).otherwise(found).alias("text"), (F.col("answer").isNull() & (F.col("sources") != "")).alias("failed"))


def search(index: SearchIndex, chunks: DataFrame, questions: DataFrame, k: int = 10, reranker: Scorer | None = None) -> DataFrame:
    """(q, rank, id, file, start_line, end_line, symbol, language, text, score): the best chunks of each question (q, question)."""
    hits = checkpointed(index.hybrid(chunks, questions, k, reranker))  # at most k for each question
    rows = hits.join(index.texts(chunks, hits), "doc")
    return rows.select("q", "rank", F.col("doc").alias("id"), "file", "start_line", "end_line", "symbol", "language", "text", "score")


def ask(index: SearchIndex, chunks: DataFrame, questions: DataFrame, generator: Callable[[list[dict]], str], k: int = TOP_K, reranker: Scorer | None = None) -> DataFrame:
    """(q, text, failed): search, prompt, generation and sources in one."""
    made = prompts(search(index, chunks, questions, k, reranker), questions)
    asked, empty = made.where("sources <> ''"), made.where("sources = ''")
    blank = F.lit(None).cast("string")
    return answers(generate(asked, generator).unionByName(empty.withColumns({"answer": blank, "error": blank})))


def warm_up(index: SearchIndex) -> bool:
    """One search, so that the first question finds workers and files ready; False, with a warning, if it fails."""
    try:
        index.lexical(index.spark.createDataFrame([(0, "warm up")], "q int, question string"), 1).collect()
        return True
    except Exception as e:
        warnings.warn(f"warm-up failed: {type(e).__name__}: {e}"[:500], stacklevel=2)
        return False
