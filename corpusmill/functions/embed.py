"""Embeddings: a local feature-hashing embedder, and the hook for any other.

The default needs no model: each token of the identifier tokenizer adds its sign
to one of DIM buckets, both taken from its MD5; the vector is scaled to length 1.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusmill.functions.text import TOKEN, tokens

DIM = 64
_TOKEN = re.compile(TOKEN)
#: Texts to a batch and batches at once of the embedding service.
BATCH, WORKERS = 32, 8


def token_bucket(token: Column) -> Column:
    return F.conv(F.substring(F.md5(token), 1, 4), 16, 10).cast("int") % DIM


def token_sign(token: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(token), 5, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)


class HashEmbedder:
    """Texts -> unit vectors (a row of zeros for a text without words); each distinct word is hashed once per worker."""

    dim = DIM
    #: Distinct words remembered before the memory is emptied; the vectors do not depend on it.
    MEMO = 1_000_000

    def __init__(self):
        self.memo: dict[str, tuple[int, float]] = {}

    def _feature(self, word: str) -> tuple[int, float]:
        if word not in self.memo:
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            code = hashlib.md5(word.encode()).hexdigest()
            self.memo[word] = int(code[:4], 16) % DIM, 1.0 if int(code[4], 16) % 2 == 0 else -1.0
        return self.memo[word]

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """The vectors before they are scaled: whole numbers, which a short float holds exactly."""
        return self.sums_of([Counter(_TOKEN.findall(text or "")) for text in texts])

    def sums_of(self, counts: list[Counter]) -> np.ndarray:
        """The same of texts whose words are counted already, in any case."""
        at, add = [], []
        for row, count in enumerate(counts):
            for word, n in count.items():
                bucket, sign = self._feature(word.lower())
                at.append(row * DIM + bucket)
                add.append(sign * n)
        return np.bincount(np.array(at, np.int64), np.array(add, float), len(counts) * DIM).reshape(len(counts), DIM)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = self.sums(texts)
        norm = np.sqrt(np.einsum("ij,ij->i", out, out))
        return out / np.where(norm > 0, norm, 1.0)[:, None]


def hash_vector(text: Column) -> Column:
    """The same vector as an array of DIM floats, computed inside the row."""
    zero = F.array_repeat(F.lit(0.0), DIM)
    hits = F.transform(tokens(text), lambda t: F.struct(token_bucket(t).alias("b"), token_sign(t).alias("s")))
    sums = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda k: F.aggregate(F.filter(hits, lambda h: h["b"] == k), F.lit(0.0), lambda a, h: a + h["s"]))
    norm = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(sums, lambda x: (x / norm).cast("float"))).otherwise(zero.cast("array<float>"))


def dimension(backend: Callable[[list[str]], list[list[float]]]) -> int:
    """Length of a backend's vectors, by one probe."""
    return len(backend(["dimension probe"])[0])


def embed(rows: DataFrame, text: str, backend: Callable[[list[str]], list[list[float]]], batch: int = BATCH, workers: int = WORKERS) -> DataFrame:
    """Adds vector and error: batches go to the backend, `workers` at once, a failed batch is tried text by text, a failed text is an error row."""
    columns = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])

    def one_batch(group: list[str]) -> list[tuple]:
        try:
            got = backend(group)
            if len(got) != len(group):
                raise ValueError("as many vectors as texts are needed")
            return [(v, None) for v in got]
        except Exception:
            return [one_text(t) for t in group]

    def one_text(one: str) -> tuple:
        try:
            return backend([one])[0], None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"[:500]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for frame in frames:
                texts = frame[text].tolist()
                done = [x for part in pool.map(one_batch, [texts[at : at + batch] for at in range(0, len(texts), batch)]) for x in part]
                yield frame[columns].assign(vector=[v for v, _ in done], error=[e for _, e in done])

    return rows.mapInPandas(run, schema)
