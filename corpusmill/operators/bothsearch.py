"""Hybrid search of a whole question set over a corpus and a part of it at once, without an index.

Each text is read once, into the words that any question asks for and a vector.
A pass over these answers a block of questions for both corpora: a partition is
streamed in sorted order, and each question's running k best decide what of a
batch is looked at; a sample of the documents, searched first, gives them a start.
A score is a sum of what the question's words, or the dimensions of its vector,
add to each document of a batch. These columns are kept in whole numbers, rounded
up; questions with common words stand together, so that most of a sum is that of
the question before. Whatever reaches the k-th best is scored again exactly.

Defined results: those of SearchIndex.lexical and dense, over all documents and
over the kept ones with weights and lengths of their own; as in the SQL, vectors
without a common dimension are no hit.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.functions.embed import DIM, HashEmbedder
from corpusmill.functions.text import tokens
from corpusmill.operators import bm25, dense, fusion
from corpusmill.operators.searchindex import DENSE_PLACES, META, documents_of
from corpusmill.operators.topk import blocks, union
from corpusmill.session import broadcast_if_small, checkpoint_folder, checkpointed

#: Questions that one pass over the documents answers.
BLOCK = 40_000
#: Documents of the first and of the largest batch of a partition, and the most of a partition.
FIRST, MOST, PART = 32, 16_384, 500_000
#: Documents whose scores tell what a question's best have at least, on the driver and in each task for a short time.
SAMPLE = 8192
#: Questions whose sums are looked through at once, and documents of one sum.
TILE_QUESTIONS, TILE_DOCUMENTS = 64, 16_384
#: A word of more documents of a batch, or of a larger share of them, has a column of all; of others they are listed.
LISTED, MOST_OF_ALL = 400, 0.2
#: Columns that are kept at once, and pairs that are scored at once.
COLUMNS, SCORED = 2000, 50_000
#: What short floats and rounding may be off: of a cosine, and of a BM25 score in parts of it.
COSINE_SLACK, SCORE_SLACK = 1e-5, 2e-6
LEGS = ("dense_all", "lexical_all", "dense_kept", "lexical_kept")


class Top:
    """The k best (score, place) of each question, of those that reach its floor if given; ties go to the larger place."""

    def __init__(self, questions: int, k: int, floor: np.ndarray | None = None):
        self.k, self.floor = k, np.full(questions, -np.inf) if floor is None else floor
        self.score, self.place = np.full((questions, k), -np.inf), np.full((questions, k), -1, np.int64)

    def least(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, q: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        """Distinct pairs."""
        near = score >= self.least()[q]
        q, place, score = q[near], place[near], score[near]
        if not len(q):
            return
        some = np.unique(q)
        q = np.concatenate([q, np.repeat(some, self.k)])
        place, score = np.concatenate([place, self.place[some].ravel()]), np.concatenate([score, self.score[some].ravel()])
        order = np.lexsort((-place, -score, q))
        q, place, score = q[order], place[order], score[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        at = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        best = at < self.k
        self.score[q[best], at[best]], self.place[q[best], at[best]] = score[best], place[best]


class Walk:
    """Questions as sets of items, in an order in which questions that begin with the same items stand together."""

    def __init__(self, items: list[list]):
        often = Counter(x for own in items for x in own)
        # the items that most questions have come first, so sums of them are kept from question to question
        paths = [sorted(own, key=lambda x: (-often[x], x)) for own in items]
        self.order = sorted((q for q, path in enumerate(paths) if path), key=lambda q: [(-often[x], x) for x in paths[q]])
        self.paths = [paths[q] for q in self.order]
        self.shared = [0]
        for one, two in zip(self.paths, self.paths[1:]):
            self.shared.append(next((d for d, (x, y) in enumerate(zip(one, two)) if x != y), min(len(one), len(two))))
        self.deepest = max(map(len, self.paths), default=0)
        self.order = np.array(self.order, np.int64)

    def reach(self, room: np.ndarray, least: np.ndarray, kind: type, rows: int, column: Callable) -> tuple[np.ndarray, np.ndarray]:
        """(question, row) whose items add up to the question's least.

        room: up to how many steps to 1 a question's sums stay in range of the whole
        numbers of this kind. column(item, steps) gives what an item adds at each row, in
        steps rounded up; or (rows, values) of the few where it adds something.
        """
        sizes, high = np.floor(np.log2(np.maximum(room, 1e-30)) / 4), np.iinfo(kind).max
        found = []
        for size in np.unique(sizes[self.order]):
            steps, mine = 2.0 ** (4 * size), sizes[self.order] == size
            levels = np.clip(np.floor(least[self.order] * steps), -high - 1 if kind is np.int16 else 1, high).astype(kind)
            for d in range(0, rows, TILE_DOCUMENTS):
                tile = slice(d, min(d + TILE_DOCUMENTS, rows))
                for q, row in self._tile(mine, levels, kind, tile.stop - d, lambda x: column(x, steps, tile)):
                    found.append((q, row + d))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))

    def _tile(self, mine: np.ndarray, levels: np.ndarray, kind: type, rows: int, column: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own, sums = np.empty((self.deepest + 1, rows), kind), [np.zeros(rows, kind)] + [None] * self.deepest
        # looked through eight at once
        hit, asked, columns, same = np.zeros((TILE_QUESTIONS, -(-rows // 8) * 8), bool), [], {}, 0
        add, reached = np.add, np.greater_equal
        for at, (path, shared) in enumerate(zip(self.paths, self.shared)):
            same = min(same, shared)
            if not mine[at]:
                continue
            for d in range(same, len(path)):
                x = path[d]
                if x not in columns:
                    if len(columns) >= COLUMNS:
                        columns.clear()
                    columns[x] = column(x)
                one = columns[x]
                if type(one) is not tuple:
                    sums[d + 1] = add(sums[d], one, out=own[d + 1]) if d else one
                elif len(one[0]):
                    own[d + 1] = sums[d]
                    own[d + 1][one[0]] += one[1]
                    sums[d + 1] = own[d + 1]
                else:
                    sums[d + 1] = sums[d]
            same = len(path)
            reached(sums[same], levels[at : at + 1], out=hit[len(asked), :rows])
            asked.append(at)
            if len(asked) == TILE_QUESTIONS:
                yield self._hits(hit, asked)
                asked = []
        if asked:
            yield self._hits(hit[: len(asked)], asked)

    def _hits(self, hit: np.ndarray, asked: list[int]) -> tuple[np.ndarray, np.ndarray]:
        eights = np.flatnonzero(hit.reshape(-1).view(np.uint64) != 0)
        one, of = np.divmod(np.flatnonzero(hit.reshape(-1, 8)[eights]), 8)
        at, row = np.divmod(eights[one] * 8 + of, hit.shape[1])
        return self.order[np.array(asked)[at]], row


class Vectors:
    """The dense leg of a block of questions."""

    def __init__(self, texts: list[str], k: int):
        sums = HashEmbedder().sums(texts)
        self.norm, self.k = np.sqrt(np.einsum("ij,ij->i", sums, sums)), k
        self.unit = sums / np.where(self.norm > 0, self.norm, 1.0)[:, None]
        items: list[list] = [[] for _ in texts]
        for q, b in zip(*(x.tolist() for x in np.nonzero(sums))):
            items[q].append((b, int(sums[q, b])))
        self.walk, self.terms = Walk(items), np.array([len(x) for x in items])

    def add(self, column: pa.Array, kept: np.ndarray, first: int, every: Top, part: Top) -> None:
        at, unit = dense.unit_rows(column, DIM)
        if not len(at):
            return
        by_dimension = np.ascontiguousarray(unit.T)
        least = (np.minimum(every.least(), part.least()) - COSINE_SLACK) * np.maximum(self.norm, 1e-30)
        # no sum of a question's items is longer than its vector
        room = (np.iinfo(np.int16).max - 1.0 - self.terms) / np.maximum(self.norm, 1e-30)
        asked, near = self.walk.reach(room, least, np.int16, len(at), lambda x, steps, tile: np.ceil(by_dimension[x[0], tile] * (x[1] * steps)).astype(np.int16))
        for c in range(0, len(asked), SCORED):
            q, row = asked[c : c + SCORED], near[c : c + SCORED]
            a, b = self.unit[q], unit[row]
            scores = np.round(np.einsum("ij,ij->i", a, b), DENSE_PLACES) + 0.0
            good = np.ones(len(q), bool)
            none = np.flatnonzero(scores == 0)
            good[none] = ((a[none] != 0) & (b[none] != 0)).any(axis=1)
            every.add(q[good], first + at[row[good]], scores[good])
            good &= kept[at[row]]
            part.add(q[good], first + at[row[good]], scores[good])


class Words:
    """The lexical leg of a block of questions over one of the two corpora."""

    def __init__(self, counts: list[Counter], n: int, avgdl: float, df: dict[str, int], k: int):
        self.counts, self.n, self.df, self.k, self.mean = counts, n, df, k, avgdl or 1.0

    def idf(self, word: str) -> float:
        df = self.df.get(word, 0)
        return math.log(1 + (self.n - df + 0.5) / (df + 0.5)) if df else 0.0

    def add(self, batch: pa.RecordBatch, rows: np.ndarray, first: int, top: Top) -> None:
        """Some rows of a batch with dl, terms and tfs."""
        if not hasattr(self, "alone"):
            self.alone = Lexical([self])
        there = np.zeros(batch.num_rows, bool)
        there[rows] = True
        self.alone.add(batch, [there], first, [top])


class Lexical:
    """The lexical legs of a block of questions, whose candidates are found together."""

    def __init__(self, sides: list[Words]):
        counts = sides[0].counts
        names = sorted({t for c in counts for t in c if any(w.df.get(t) for w in sides)})
        place = {t: at for at, t in enumerate(names)}
        self.sides, self.names, self.none = sides, pa.array(names, pa.string()), len(names)
        self.idf = np.array([[w.idf(t) for t in names] + [0.0] for w in sides])
        own = [[(place[t], m) for t, m in c.items() if t in place] for c in counts]
        width = max(map(len, own), default=0)
        # places that are left name no word
        self.term, self.times = np.full((len(own), width), self.none, np.int64), np.zeros((len(own), width))
        for row, times, words in zip(self.term, self.times, own):
            for at, (t, m) in enumerate(words):
                row[at], times[at] = t, m
        self.walk, self.terms = Walk(own), (self.times > 0).sum(axis=1)

    def _parts(self, side: int, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * dl / self.sides[side].mean))

    def add(self, batch: pa.RecordBatch, there: list[np.ndarray], first: int, tops: list[Top]) -> None:
        """there: for each side, which rows of the batch it has."""
        rows, terms = batch.num_rows, batch.column("terms")
        if not rows or not self.none:
            return
        term = pc.fill_null(pc.index_in(terms.flatten(), value_set=self.names), self.none).to_numpy(zero_copy_only=False).astype(np.int64)
        tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(float)
        row = np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
        dl = batch.column("dl").to_numpy(zero_copy_only=False).astype(float)
        hit = term < self.none
        if not hit.any():
            return
        term, tf, row = term[hit], tf[hit], row[hit]
        order = np.argsort(term * rows + row)
        term, tf, row = term[order], tf[order], row[order]
        most, worth = np.zeros(self.none + 1), np.zeros(len(term))
        for side, here in enumerate(there):
            worth = np.maximum(worth, np.where(here[row], self.idf[side][term] * self._parts(side, tf, dl[row]), 0.0))
        np.maximum.at(most, term, worth)
        begins = np.searchsorted(term, np.arange(self.none + 2))
        df = np.diff(begins)
        # a word of many documents has a table row, the others their list
        wide = np.flatnonzero((df > LISTED) | (df > MOST_OF_ALL * rows))
        line = np.full(self.none + 1, -1, np.int64)
        line[wide] = np.arange(len(wide))
        table, values = np.zeros((len(wide), rows), np.int32), np.zeros((len(wide), rows), np.float32)
        tall = line[term] >= 0
        table[line[term[tall]], row[tall]] = tf[tall]
        # a little over, so that a short float is no less
        values[line[term[tall]], row[tall]] = worth[tall] * (1 + SCORE_SLACK)

        def column(item, steps, tile):
            t, m = item
            if line[t] >= 0:
                return np.ceil(values[line[t], tile] * np.float32(m * steps)).astype(np.uint16)
            a, b = begins[t], begins[t + 1]
            if (tile.start, tile.stop) != (0, rows):
                a, b = a + np.searchsorted(row[a:b], [tile.start, tile.stop])
            return row[a:b] - tile.start, np.ceil(worth[a:b] * (m * steps)).astype(np.uint16)

        high = (self.times * most[self.term]).sum(axis=1) * (1 + 2 * SCORE_SLACK)
        room = (np.iinfo(np.uint16).max - 1.0 - self.terms) / np.maximum(high, 1e-3)
        least = np.min([top.least() for top in tops], axis=0) - 1e-8
        asked, near = self.walk.reach(room, least, np.uint16, rows, column)
        keys = term[~tall] * rows + row[~tall]
        few = np.r_[tf[~tall], 0.0]
        for c in range(0, len(asked), SCORED):
            q, at = asked[c : c + SCORED], near[c : c + SCORED]
            scores = np.zeros((len(self.sides), len(q)))
            for j in range(int(self.terms[q].max(initial=0))):
                t = self.term[q, j]
                count = np.zeros(len(q))
                listed = line[t] < 0
                some = np.flatnonzero(~listed)
                count[some] = table[line[t[some]], at[some]]
                if len(keys):
                    some = np.flatnonzero(listed & (t < self.none))
                    key = t[some] * rows + at[some]
                    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    count[some] = np.where(keys[place] == key, few[place], 0.0)
                some = np.flatnonzero(count)
                for side in range(len(self.sides)):
                    scores[side, some] += self.times[q[some], j] * self.idf[side][t[some]] * self._parts(side, count[some], dl[at[some]])
            for score, here, top in zip(np.round(scores, bm25.PLACES), there, tops):
                good = (score > 0) & here[at]
                top.add(q[good], first + at[good], score[good])


def _growing(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            some = batch.slice(0, size - rows)
            batch = batch.slice(some.num_rows)
            held.append(some)
            rows += some.num_rows
            if rows == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                size, held, rows = min(2 * size, MOST), [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _searched(batches: Iterator[pa.RecordBatch], texts: list[str], totals: dict, df: dict, k: int, floors: np.ndarray | None = None) -> tuple[dict[str, Top], list]:
    """The k best of each question and leg, and the documents that their places are of."""
    counts = [Counter(bm25.words(t)) for t in texts]
    vectors, words = Vectors(texts, k), Lexical([Words(counts, *totals[side], df[side], k) for side in ("all", "kept")])
    tops, docs, first = {leg: Top(len(texts), k, None if floors is None else floors[:, at]) for at, leg in enumerate(LEGS)}, [], 0
    for batch in _growing(batches, FIRST if floors is None else MOST // 4):
        kept = batch.column("kept").to_numpy(zero_copy_only=False)
        vectors.add(batch.column("vector"), kept, first, tops["dense_all"], tops["dense_kept"])
        words.add(batch, [np.ones(len(kept), bool), kept], first, [tops["lexical_all"], tops["lexical_kept"]])
        docs.append(batch.column("doc"))
        first += batch.num_rows
    return tops, docs


def _floors(sample: pa.Table, spark: SparkSession, texts: list[str], totals: dict, df: dict, k: int) -> np.ndarray:
    """What each leg's k-th best has at least, by question: that of some documents, the questions dealt out over all tasks."""
    like = np.array(sorted(range(len(texts)), key=texts.__getitem__))
    parts = spark.sparkContext.defaultParallelism
    dealt = spark.sparkContext.broadcast((sample, texts, totals, df))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, texts, totals, df = dealt.value
        for batch in batches:
            for part in batch.column(0).to_pylist():
                mine = np.array_split(like, parts)[part]
                tops, _ = _searched(iter(sample.to_batches()), [texts[q] for q in mine], totals, df, k)
                yield pa.RecordBatch.from_arrays([pa.array(mine), *[pa.array(tops[leg].least()) for leg in LEGS]], names=["at", *LEGS])

    found = spark.range(0, parts, 1, parts).mapInArrow(run, "at bigint, " + ", ".join(f"{leg} double" for leg in LEGS)).toArrow()
    out = np.empty((len(texts), len(LEGS)))
    out[found.column("at").to_numpy()] = np.stack([found.column(leg).to_numpy() for leg in LEGS], axis=1)
    dealt.unpersist()
    return out - COSINE_SLACK


def _best(documents: DataFrame, asked: list, q_type: T.DataType, totals: dict, df: dict, k: int, floors: np.ndarray | None = None) -> DataFrame:
    """(q, legs): of each partition the k best of each question and leg, as (score, doc)."""
    names, texts = [r[0] for r in asked], [r[1] for r in asked]
    item = pa.struct([("score", pa.float64()), ("doc", pa.string())])
    arrow_q = to_arrow_type(q_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, docs = _searched(batches, texts, totals, df, k, floors)
        if not docs:
            return
        doc = pa.chunked_array(docs)
        for c in range(0, len(names), 4096):
            columns = [pa.array(names[c : c + 4096], arrow_q)]
            for top in tops.values():
                place, score = top.place[c : c + 4096], top.score[c : c + 4096]
                there = place >= 0
                ends = np.r_[0, np.cumsum(there.sum(axis=1))].astype(np.int32)
                text = doc.take(pa.array(place[there])).combine_chunks()
                text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(score[there]), text.cast(pa.string())], fields=list(item))))
            yield pa.RecordBatch.from_arrays(columns, names=["q", *LEGS])

    schema = T.StructType([T.StructField("q", q_type), *T._parse_datatype_string(", ".join(f"{leg} array<struct<score: double, doc: string>>" for leg in LEGS)).fields])
    return documents.mapInArrow(run, schema)


class BothSearch:
    """A corpus and the part of it that meets a condition on its metadata, read for a question set (q, question)."""

    def __init__(self, chunks: DataFrame, kept: Column, questions: DataFrame):
        spark = chunks.sparkSession
        self.questions = bm25.question_rows(questions, "q", "question").where("question is not null")
        wanted = [r[0] for r in self.questions.select(F.explode(tokens(F.col("question")))).distinct().collect()]  # the language of the questions
        path = f"{checkpoint_folder(spark)}/both-search-{uuid.uuid4().hex}"
        documents_of(chunks, HashEmbedder, spark.sparkContext.broadcast(set(wanted))).withColumn("kept", kept).write.parquet(path)
        self.documents = spark.read.parquet(path)

    def legs(self, k: int, block: int = BLOCK) -> dict[str, DataFrame]:
        """(q, doc, rank) of each leg over both corpora, written once."""
        best = checkpointed(self.best(k, block))
        return {leg: best.select("q", F.posexplode(leg).alias("at", "best")).select("q", "best.doc", (F.col("at") + 1).alias("rank")) for leg in LEGS}

    def best(self, k: int, block: int = BLOCK) -> DataFrame:
        """(q, legs): the k best of each question and leg in order, as (score, doc)."""
        sums = self.documents.groupBy("kept").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl")).collect()
        counts = self.documents.select("kept", F.explode("terms").alias("t")).groupBy("kept", "t").agg(F.count(F.lit(1)).alias("n")).collect()  # the questions' words
        sides, totals, df = {"all": (True, False), "kept": (True,)}, {}, {}
        for name, side in sides.items():
            n = sum(r["n"] for r in sums if r["kept"] in side)
            totals[name] = n, (sum(r["dl"] for r in sums if r["kept"] in side) / n if n else 0.0)
            df[name] = Counter()
            for r in counts:
                df[name][r["t"]] += r["n"] if r["kept"] in side else 0
        rows = self.documents.select("doc", "kept", "dl", "terms", "tfs", "vector")
        parts = max(rows.sparkSession.sparkContext.defaultParallelism, 1 + totals["all"][0] // PART)
        rows, found, q_type = rows.coalesce(parts).sortWithinPartitions("doc"), [], self.questions.schema["q"].dataType
        sample = self._sample(totals["all"][0])
        for asked in blocks(self.questions, block):
            words = {t for r in asked for t in bm25.words(r[1])}
            own = {side: {t: d[t] for t in words if t in d} for side, d in df.items()}
            floors = None if sample is None else _floors(sample, rows.sparkSession, [r[1] for r in asked], totals, own, k)
            found.append(_best(rows, asked, q_type, totals, own, k, floors))
        if not found:
            found = [_best(rows.limit(0), [], q_type, totals, df, k)]
        best = lambda leg: F.slice(F.sort_array(F.flatten(F.collect_list(leg)), False), 1, k).alias(leg)  # noqa: E731  k of each partition
        return union(found).groupBy("q").agg(*[best(leg) for leg in LEGS])

    def _sample(self, n: int) -> pa.Table | None:
        """Some documents, if they are few of all."""
        if n < 4 * SAMPLE:
            return None
        rows = self.documents.select("doc", "kept", "dl", "terms", "tfs", "vector")
        return rows.where(F.pmod(F.xxhash64("doc"), F.lit(1_000_003)) < F.lit(1_000_003 * SAMPLE // n)).limit(2 * SAMPLE).toArrow()

    def metadata(self, ids: DataFrame) -> DataFrame:
        """(doc, file, symbol, start_line, end_line, language) of some documents."""
        return self.documents.select("doc", *META).join(broadcast_if_small(ids.select("doc").distinct()), "doc", "left_semi")

    def hybrid(self, k: int, pool: int = fusion.POOL) -> tuple[DataFrame, DataFrame]:
        """(q, doc, file, symbol) over the whole corpus and over the part: both legs, fusion, one row per file and symbol, written once."""
        fused = _fused(self.best(pool)).select(F.struct("q", "kept").alias("q"), "doc", "rank")
        # dealt out by question, which serves the choice within a file and symbol, too
        rows = fused.join(self.documents.select("doc", "file", "symbol"), "doc").repartition("q")
        found = fusion.diverse_rows(rows, k).select("q.q", "q.kept", "doc", "file", "symbol")
        found = checkpointed(found)
        return found.where("not kept").drop("kept"), found.where("kept").drop("kept")


def _fused(best: DataFrame) -> DataFrame:
    """(q, kept, doc, rank): fusion.fuse where a question's legs stand in one row."""
    schema = T.StructType([best.schema["q"], *T._parse_datatype_string("kept boolean, doc string, rank int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = lambda rank: 1.0 / (fusion.RRF_K + rank) if rank else 0.0
        for batch in batches:
            at, kept, docs, ranks = [], [], [], []
            for side, names in ((False, LEGS[:2]), (True, LEGS[2:])):
                legs = [batch.column(leg).to_pylist() for leg in names]
                for row, (a, b) in enumerate(zip(*legs)):
                    a, b = ({x["doc"]: r for r, x in enumerate(leg, 1)} for leg in (a, b))
                    order = sorted(a | b, key=lambda d: (-(part(a.get(d)) + part(b.get(d))), a.get(d, math.inf), b.get(d, math.inf)))
                    at += [row] * len(order)
                    kept += [side] * len(order)
                    docs += order
                    ranks += range(1, len(order) + 1)
            columns = [batch.column(0).take(pa.array(at, pa.int32())), pa.array(kept, pa.bool_()), pa.array(docs, pa.string()), pa.array(ranks, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return best.mapInArrow(run, schema)
