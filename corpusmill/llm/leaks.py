"""Evaluation texts inside documents.

A generalised suffix automaton over the words of the test items is built once on
the driver, as flat arrays, and broadcast; the items are a stated query set, taken
in blocks of bounded size, one pass over the documents each. Every document's
words are streamed through it; the longest matching length at each word finds
items by a run of words, and shorter runs give alignments at which the whole item
is compared word by word. The spans so found can be removed from the documents.

Defined results: null or empty texts hold nothing; repeated documents and items
give the same pair once; an item whose words are all in stock sentences is never
held; stock sentences inside an item keep their places but do not count.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.session import broadcast_if_small, checkpointed, spread

#: A run of so many consecutive words of an item gives it away.
RUN = 15
#: Or the whole item with at most one word in so many exchanged.
EXCHANGED = 6
#: Sentences in so many items are stock.
STOCK = 3
#: A document of whose words more than this share lies in leaked spans is not kept.
DROP_SHARE = 0.5
#: Characters of items in one automaton; each further block is another pass.
BLOCK_CHARS = 2_000_000

_MARKS = re.compile(r"(?m)^[ \t]*(?:[>|#*+%;/\\-]+[ \t]*)+")
_NOT_WORD = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+")


def words(text: str) -> list[str]:
    """Lower-case words of letters and digits only, split at white space."""
    drop = _NOT_WORD.sub
    return [w for w in (drop("", x) for x in _MARKS.sub(" ", text).casefold().split()) if w]


def places(text: str) -> list[tuple[int, int]]:
    """Where each of the words stands in the text."""
    plain = _MARKS.sub(lambda m: " " * len(m.group()), text)
    # what casefold and split leave of a piece decides whether it is a word
    return [m.span() for m in re.finditer(r"\S+", plain) if _NOT_WORD.sub("", m.group().casefold())]


def sentences(text: str) -> list[list[str]]:
    return [w for w in (words(s) for s in _SENTENCE.split(text)) if w]


class Automaton:
    """Generalised suffix automaton over word numbers, with the places of each state's words in the items."""

    def __init__(self, items: list[tuple[int, list[list[str]], list[bool]]]):
        """items: id, the words of each sentence, and whether it is stock."""
        self.number: dict[str, int] = {}
        self.items: list[tuple[int, list[int], list[bool]]] = []
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for k, parts, stock in items:
            body = [self.number.setdefault(w, len(self.number)) for s in parts for w in s]
            self._versions(k, body, [not x for s, x in zip(parts, stock) for _ in s])
        self.own: list[tuple[int, int, int]] = []  # (state, item, place of the word it ends at)
        for at, (_, body, counted) in enumerate(self.items):
            last = 0
            for pos, (w, good) in enumerate(zip(body, counted)):
                last = self._extend(last, w) if good else 0
                if good:
                    self.own.append((last, at, pos))

    def _versions(self, k: int, body: list[int], counted: list[bool]) -> None:
        if not any(counted):
            return
        while counted and not counted[-1]:
            body, counted = body[:-1], counted[:-1]
        while counted and not counted[0]:
            body, counted = body[1:], counted[1:]
        self.items.append((k, body, counted))
        if not all(counted):
            self.items.append((k, [w for w, c in zip(body, counted) if c], [True] * sum(counted)))

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            if length[last] + 1 == length[q]:
                return q
            return self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[p] + 1 == length[q] else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        link[q] = new
        return new

    def arrays(self) -> dict:
        """All that matching needs, flat. The places of a state's words are those of the states below it in the tree of links, so one range of the tree's order."""
        n, wide = len(self.next), max(1, len(self.number))
        link, length = np.array(self.link, np.int64), np.array(self.length, np.int64)
        # longer states lie below shorter ones: sizes of subtrees from the leaves up, places in order from the root down
        size = [1] * n
        by_length = np.argsort(-length, kind="stable").tolist()
        for v in by_length:
            if v:
                size[self.link[v]] += size[v]
        first, free = [0] * n, [1] * n
        for v in reversed(by_length):
            if v:
                up = self.link[v]
                first[v] = first[up] + free[up]
                free[up] += size[v]
        keys = np.fromiter((v * wide + w for v, t in enumerate(self.next) for w in t), np.int64)
        goals = np.fromiter((q for t in self.next for q in t.values()), np.int64)
        own = sorted((first[v], at, pos) for v, at, pos in self.own)
        ends = np.array(own, np.int64).reshape(-1, 3)
        return {
            "words": list(self.number), "keys": keys, "goals": goals, "link": link, "length": length, "first": np.array(first, np.int64), "size": np.array(size, np.int64), "ends": ends,
            "ids": [k for k, _, _ in self.items], "bodies": [np.array(b, np.int64) for _, b, _ in self.items], "counted": [np.array(c, bool) for _, _, c in self.items],
        }


def seed(n: int) -> int:
    """The longest run of equal words that n words with their exchanges must have."""
    wrong = n // EXCHANGED
    return max(1, -(-(n - wrong) // (wrong + 1)))


class Matcher:
    """Streams documents through an automaton's arrays."""

    def __init__(self, a: dict):
        self.number = {w: k for k, w in enumerate(a["words"])}
        self.wide = max(1, len(self.number))
        self.goal = dict(zip(a["keys"].tolist(), a["goals"].tolist()))
        self.link, self.length, self.first, self.size = (a[c].tolist() for c in ("link", "length", "first", "size"))
        self.ids, self.bodies, self.counted = a["ids"], a["bodies"], a["counted"]
        self.order, self.at, self.pos = (a["ends"][:, c].tolist() for c in range(3))
        # items that need runs of equal length are looked up together
        seeds = [seed(int(c.sum())) for c in self.counted]
        self.classes = [(s, *([x for x, at in zip(column, self.at) if seeds[at] == s] for column in (self.order, self.at, self.pos))) for s in sorted(set(seeds))]
        self._runs: dict[int, tuple[int, ...]] = {}
        self._seeds: dict[tuple[int, int], tuple[tuple[int, int], ...]] = {}

    def _above(self, v: int, least: int) -> int:
        """The shortest suffix state of v that still has words of the given length."""
        while self.link[v] > 0 and self.length[self.link[v]] >= least:
            v = self.link[v]
        return v

    def _items(self, v: int) -> tuple[int, ...]:
        if v not in self._runs:
            u = self._above(v, RUN)
            lo, hi = bisect_left(self.order, self.first[u]), bisect_left(self.order, self.first[u] + self.size[u])
            self._runs[v] = tuple(sorted({self.ids[at] for at in self.at[lo:hi]}))
        return self._runs[v]

    def _alignments(self, v: int, c: int) -> tuple[tuple[int, int], ...]:
        if (v, c) not in self._seeds:
            least, order, at, pos = self.classes[c]
            u = self._above(v, least)
            lo, hi = bisect_left(order, self.first[u]), bisect_left(order, self.first[u] + self.size[u])
            self._seeds[v, c] = tuple(zip(at[lo:hi], pos[lo:hi]))
        return self._seeds[v, c]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, first word, word after the last) of what the text gives away, each run as far as it goes."""
        number, goal, link, length, wide = self.number, self.goal, self.link, self.length, self.wide
        doc = [number.get(w, -1) for w in words(text)]
        found: dict[int, list[list[int]]] = {}
        starts: set[tuple[int, int]] = set()
        state = size = 0
        least = self.classes[0][0] if self.classes else 0
        for pos, w in enumerate(doc):
            if w < 0:
                state = size = 0
                continue
            step = goal.get(state * wide + w)
            if step is not None:
                size += 1
            else:
                while state >= 0 and step is None:
                    state = link[state]
                    step = goal.get(state * wide + w) if state >= 0 else None
                if step is None:
                    state = size = 0
                    continue
                size = length[state] + 1
            state = step
            if size < least:
                continue
            if size >= RUN:
                for k in self._items(state):
                    mine = found.setdefault(k, [])
                    if mine and pos - RUN + 1 <= mine[-1][1]:
                        mine[-1][1] = pos + 1
                    else:
                        mine.append([pos - RUN + 1, pos + 1])
            for c, (need, *_) in enumerate(self.classes):
                if size < need:
                    break
                for at, end in self._alignments(state, c):
                    starts.add((at, pos - end))
        whole = np.array(doc, np.int64)
        for at, start in starts:
            body, counted = self.bodies[at], self.counted[at]
            if start < 0 or start + len(body) > len(doc):
                continue
            n = int(counted.sum())
            equal = int((counted & (body == whole[start : start + len(body)])).sum())
            if n - equal <= n // EXCHANGED:
                found.setdefault(self.ids[at], []).append([start, start + len(body)])
        return [(k, a, b) for k in sorted(found) for a, b in sorted(found[k])]


def prepared(items: DataFrame) -> DataFrame:
    """(item_id, sentences, stock): the words of each distinct item's sentences, and which of them stand in too many items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, code, t in zip(*(batch.column(c).to_pylist() for c in range(3))):
                rows += [(k, code, n, " ".join(s)) for n, s in enumerate(sentences(t))]
            columns = [[r[c] for r in rows] for c in range(4)]
            types = (pa.int64(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["item_id", "code", "n", "sentence"])

    rows = items.where("item_id is not null and text is not null").select("item_id", F.md5("text").alias("code"), "text").distinct()
    parts = checkpointed(rows.mapInArrow(cut, "item_id bigint, code string, n int, sentence string"))
    # an id with two texts counts once for a sentence, as two ids do twice
    often = parts.select("item_id", "code", "sentence").distinct().groupBy("sentence").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= STOCK)
    marked = parts.join(often.select("sentence", F.lit(True).alias("stock")), "sentence", "left")
    ordered = F.array_sort(F.collect_list(F.struct("n", F.split("sentence", " ").alias("words"), F.coalesce("stock", F.lit(False)).alias("stock"))))
    return marked.groupBy("item_id", "code").agg(ordered.alias("s")).select("item_id", "code", F.col("s.words").alias("sentences"), F.col("s.stock").alias("stock"))


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, list[list[str]], list[bool]]]]:
    """The query set in blocks, one on the driver at a time."""
    block, size = [], 0
    for r in prepared(items).orderBy("item_id", "code").toLocalIterator():
        chars = sum(len(w) + 1 for s in r["sentences"] for w in s)
        if block and size + chars > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["sentences"], r["stock"]))
        size += chars
    if block:
        yield block


#: The matcher of the block that this worker has last matched.
_last: dict[str, Matcher] = {}


def _matcher(name: str, shared) -> Matcher:
    if name not in _last:
        _last.clear()
        _last[name] = Matcher(shared.value)
    return _last[name]


def leak_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, digest, item_id, start, stop): the leaked spans of each text, in its words; the digest tells texts of one id apart."""
    spark = documents.sparkSession
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("digest"), "text")
    schema = "doc_id bigint, digest bigint, item_id bigint, start int, stop int"
    out = None
    for block in _blocks(items):
        shared = spark.sparkContext.broadcast(Automaton(block).arrays())
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, shared)
            for batch in batches:
                found = []
                for doc, digest, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                    found += [(doc, digest, *s) for s in matcher.spans(text)]
                columns = [[r[c] for r in found] for c in range(5)]
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "digest", "item_id", "start", "stop"])

        one = spread(rows).mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], schema) if out is None else out


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id), distinct, of the documents that give items away."""
    return leak_spans(documents, items).select("doc_id", "item_id").distinct()


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents per leaked item."""
    return leaked(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


def cleaned(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text, n_spans, removed, kept): each document without its leaked spans.

    removed is the share of its words in them (0 without words); over DROP_SHARE the document is not kept.
    """
    spans = checkpointed(leak_spans(documents, items))
    # one text's spans are at most a run at each of its words for each item
    of_text = spans.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, shares = [], [], []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not text or not marks:
                    texts.append(text)
                    counts.append(0)
                    shares.append(0.0)
                    continue
                where, merged = places(text), []
                for m in marks:
                    if merged and m["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], m["stop"])
                    else:
                        merged.append([m["start"], m["stop"]])
                parts, at = [], 0
                for a, b in merged:
                    parts.append(text[at : where[a][0]])
                    at = where[b - 1][1]
                texts.append("".join([*parts, text[at:]]))
                counts.append(len(merged))
                shares.append(sum(b - a for a, b in merged) / len(where))
            arrays = [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(shares, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "n_spans", "removed"])

    rows = documents.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("digest"))
    joined = rows.join(broadcast_if_small(of_text), ["doc_id", "digest"], "left").select("doc_id", "text", "spans")
    out = joined.mapInArrow(cut, "doc_id bigint, text string, n_spans int, removed double")
    return out.withColumn("removed", F.round("removed", 6)).withColumn("kept", F.col("removed") <= DROP_SHARE)
