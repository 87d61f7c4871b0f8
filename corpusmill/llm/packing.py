"""Texts packed into containers of fixed capacity.

Sizes are tokens of a public tokenizer. The histogram over sizes (bounded by the
capacity, whatever the corpus) is packed on the driver by its configuration
linear program: multiplicative weights over the sizes, patterns priced by a
knapsack dynamic program. The fractional solution is rounded: each pattern is used
as often as the program says, at least once, as far as its items are still there;
then the program is solved again for what is left. Only when no pattern of a
solution fits any more is the residue packed best fit. That is so at every size
of the corpus. Every item is then given its container by arithmetic on its rank
within its size, so no group is collected.

Defined results: a null or empty text has no tokens and is not placed; a text
over the capacity becomes full containers and a rest, all others stay whole;
repeated rows are placed each on their own; an empty table gives no containers.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corpusmill.session import checkpointed, spread

#: Container size in tokens.
CAPACITY = 2048
#: Public tokenizer file; another path may be given.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Items of one size that are ranked by one task.
PART_ITEMS = 100_000
#: Knapsack programs of one solution, patterns taken from each, how far these may be from the best, and the step size.
STEPS, PATTERNS, NEAR, EPSILON = 24, 8, 0.03, 0.25
#: A pattern is used if it fills at least this share of what the fullest of its solution fills.
WELL_FILLED = 1.0
#: Share of all tokens that is kept from the program, in the smallest items, to fill the residue's containers.
HELD = 0.01
#: A text longer than this is given to the tokenizer in stretches.
STRETCH = 200_000
_CUT = re.compile(r"\w(?=[ \n])")


def _tokenizer(path: str):
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: sum(len(encoding.encode_ordinary(part)) for part in _stretches(text))
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def _stretches(text: str) -> Iterator[str]:
    """Cut before a blank or line break that follows a letter or digit, where no token of this vocabulary's pattern goes on: the counts add up to that of the whole."""
    at = 0
    while len(text) - at > STRETCH and (m := _CUT.search(text, at + STRETCH)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every document; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _tokenizer(tokenizer)
        for batch in batches:
            sizes = [count(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, n_tokens bigint")


class _Pricing:
    """Best patterns for given values: a knapsack program over all sizes."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity

    def best(self, values: np.ndarray) -> list[dict[int, int]]:
        """The best pattern and others of nearly its value, each place of a size with its number."""
        # a size is of use only if no smaller one has as much value
        use = np.flatnonzero(values > np.concatenate([[0.0], np.maximum.accumulate(values)[:-1]]))
        if not len(use):
            return []
        sizes, worth, capacity = self.sizes[use], values[use], self.capacity
        upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes[0]), capacity + 1):
            k = upto[c]
            gain = best[c - sizes[:k]] + worth[:k]
            j = int(gain.argmax())
            if gain[j] > best[c - 1] + 1e-15:
                best[c], pick[c] = gain[j], j
            else:
                best[c] = best[c - 1]
        # every first item with the best rest is a pattern; those near the best are as good for the weights
        first = worth + best[capacity - sizes]
        found: dict[tuple, dict[int, int]] = {}
        for j in np.argsort(-first, kind="stable"):
            if first[j] < (1 - NEAR) * best[capacity] or len(found) == PATTERNS:
                break
            pattern: dict[int, int] = defaultdict(int)
            pattern[int(use[j])] += 1
            c = capacity - int(sizes[j])
            while c > 0:
                i = int(pick[c])
                if i < 0:
                    c -= 1
                    continue
                pattern[int(use[i])] += 1
                c -= int(sizes[i])
            found.setdefault(tuple(sorted(pattern.items())), pattern)
        return list(found.values())


def _weights(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int) -> list[tuple[dict[int, int], float]]:
    """Patterns with their fractional uses, from multiplicative weights on the covering program."""
    pricing = _Pricing(sizes, capacity)
    # the start is the size itself: then the first patterns are the fullest
    weight = sizes.astype(float) * demand
    found: dict[tuple, float] = defaultdict(float)
    total = float((sizes * demand).sum()) / capacity
    for _ in range(steps):
        patterns = pricing.best(weight / demand / max(weight.max(), 1e-300))
        for pattern in patterns:
            js = np.fromiter(pattern, int)
            counts = np.fromiter(pattern.values(), int)
            # one step uses a share of the containers, but no size more than there is of it
            use = min(total / steps / len(patterns), float((demand[js] / counts).min()))
            found[tuple(sorted(pattern.items()))] += use
            weight[js] *= np.exp(-EPSILON * use * counts / demand[js] * steps)
    return [(dict(p), x) for p, x in found.items()]


def _repaired(items: dict[int, int], left: dict[int, int], sizes: list[int], capacity: int) -> dict[int, int]:
    """A pattern cut to the items that are there, its free room filled with the largest that fit."""
    out = {s: min(c, left[s]) for s, c in items.items() if left.get(s)}
    room = capacity - sum(s * c for s, c in out.items())
    at = bisect_right(sizes, room)
    while at > 0:
        s = sizes[at - 1]
        take = min(room // s, left.get(s, 0) - out.get(s, 0))
        if take > 0:
            out[s] = out.get(s, 0) + take
            room -= s * take
        at = bisect_right(sizes, room, 0, at - 1)
    return out


def _best_fit(sizes: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, containers) of the residue, largest first into the fullest container that still takes it; equal containers are handled together."""
    groups: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(capacity + 1)]
    for size in sorted(sizes, reverse=True):
        n = sizes[size]

        def put(pattern: dict[int, int], times: int, room: int, each: int) -> None:
            groups[room - size * each].append(({**pattern, size: pattern.get(size, 0) + each}, times))

        moved: list[tuple[dict[int, int], int, int, int]] = []
        for room in range(size, capacity + 1):
            each = room // size
            while n and groups[room]:
                pattern, times = groups[room].pop()
                full = min(times, n // each)
                if full:
                    moved.append((pattern, full, room, each))
                    n -= full * each
                rest = times - full
                if rest and n:
                    moved.append((pattern, 1, room, n))
                    rest, n = rest - 1, 0
                if rest:
                    groups[room].append((pattern, rest))
            if not n:
                break
        for one in moved:
            put(*one)
        each = capacity // size
        if n // each:
            put({}, n // each, capacity, each)
        if n % each:
            put({}, 1, capacity, n % each)
    return [x for g in groups for x in g]


class Plan(NamedTuple):
    """What one pattern (size -> items) is used for, and whether the linear program gave it."""

    pattern: dict[int, int]
    containers: int
    by_program: bool


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Plan]:
    """Patterns with their numbers of containers, that hold exactly the histogram's items."""
    left = {s: n for s, n in histogram.items() if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("a size is not within the capacity")
    out: dict[tuple, int] = defaultdict(int)

    def use(items: dict[int, int], times: int) -> None:
        out[tuple(sorted(items.items()))] += times
        for s, c in items.items():
            left[s] -= times * c
            if not left[s]:
                del left[s]

    if capacity in left:
        use({capacity: 1}, left[capacity])
    # the smallest items fill what gaps the residue leaves
    spare = HELD * sum(s * n for s, n in left.items())
    held: dict[int, int] = {}
    for s in sorted(left):
        if (n := min(left[s], int(spare // s))) > 0:
            held[s], left[s], spare = n, left[s] - n, spare - n * s
    left = {s: n for s, n in left.items() if n}
    while left:
        sizes = np.array(sorted(left))
        demand = np.array([left[s] for s in sizes], float)
        fill = lambda items: sum(s * c for s, c in items.items())
        solved = [({int(sizes[j]): c for j, c in p.items()}, x) for p, x in _weights(sizes, demand, capacity, STEPS)]
        solved.sort(key=lambda x: sorted(x[0].items(), reverse=True), reverse=True)
        least, placed, ordered = WELL_FILLED * max(fill(p) for p, _ in solved), 0, sizes.tolist()
        for items, uses in solved:
            times = min([max(1, int(uses)), *(left.get(s, 0) // c for s, c in items.items())])
            if not times:
                items, times = _repaired(items, left, ordered, capacity), 1
            if items and fill(items) >= least:
                use(items, times)
                placed += times
        if not placed:
            break
    for s, n in held.items():
        left[s] = left.get(s, 0) + n
    rest = [Plan(p, n, False) for p, n in _best_fit(left, capacity)]
    return [Plan(dict(p), n, True) for p, n in out.items()] + rest


def packed(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(container, doc_id, piece, token_start, n_tokens, by_program): where every document, or piece of an oversized one, goes.

    by_program: whether the linear program, not the best fit of the residue, gave the container.
    """
    spark = documents.sparkSession
    counted = checkpointed(token_counts(documents, tokenizer)).where("n_tokens > 0")
    # pieces of texts over the capacity: full ones and a rest
    pieces = F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int"))
    items = counted.select("doc_id", "n_tokens", F.explode(pieces).alias("piece")).select(
        "doc_id", "piece",
        (F.col("piece").cast("bigint") * capacity).alias("token_start"),
        F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece").cast("bigint") * capacity).alias("size"),
    )
    # at most capacity rows, whatever the corpus
    histogram = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    solution = plan(histogram, capacity)
    # a size is ranked in as many parts as its items need
    split = [(s, -(-n // PART_ITEMS)) for s, n in histogram.items()]
    parts = F.broadcast(spark.createDataFrame(split, "size bigint, parts int"))
    items = items.join(parts, "size").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts")).cast("int"))
    counts = items.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n")).collect()  # capacity + items / PART_ITEMS rows
    # where each part's ranks begin, and which ranks of a size each pattern takes
    offsets: dict[int, dict[int, int]] = defaultdict(dict)
    running: dict[int, int] = defaultdict(int)
    for r in sorted(counts, key=lambda r: (r["size"], r["part"])):
        offsets[r["size"]][r["part"]] = running[r["size"]]
        running[r["size"]] += r["n"]
    ranges: dict[int, list[tuple[int, int, int, bool]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    first = 0
    for pattern, times, by_program in sorted(solution, key=lambda x: (sorted(x[0].items()), x[2])):
        for size, c in pattern.items():
            ranges[size].append((used[size], c, first, by_program))
            used[size] += times * c
        first += times
    shared = spark.sparkContext.broadcast((dict(offsets), dict(ranges)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, by_size = shared.value
        lows = {s: [x[0] for x in r] for s, r in by_size.items()}
        for batch in batches:
            where, planned = [], []
            for size, part, local in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5))):
                rank = starts[size][part] + local - 1
                low, c, begin, by_program = by_size[size][bisect_right(lows[size], rank) - 1]
                where.append(begin + (rank - low) // c)
                planned.append(by_program)
            arrays = [pa.array(where, pa.int64()), *(batch.column(k) for k in (0, 1, 2, 3)), pa.array(planned, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["container", "doc_id", "piece", "token_start", "n_tokens", "by_program"])

    ranked = items.withColumn("local", F.row_number().over(Window.partitionBy("size", "part").orderBy("doc_id", "piece")))
    return ranked.select("doc_id", "piece", "token_start", "size", "part", "local").mapInArrow(
        place, "container bigint, doc_id bigint, piece int, token_start bigint, n_tokens bigint, by_program boolean"
    )


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens, the share of all capacity that is used, and the share of items that the linear program placed."""
    per = placed.groupBy("container").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("items"), F.sum(F.col("by_program").cast("int")).alias("planned"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"),
        F.round(F.sum("tokens") / (F.count(F.lit(1)) * capacity), 6).alias("fill"), F.round(F.sum("planned") / F.sum("items"), 6).alias("by_program"),
    )
