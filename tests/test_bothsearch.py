import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions.embed import HashEmbedder
from corpusmill.operators import bothsearch
from corpusmill.operators.bothsearch import BothSearch, Top, Vectors, Words
from corpusmill.operators.searchindex import SearchIndex, build_index
from corpusmill.schema import CHUNK
from corpusmill.sources.store import IndexStore

K = 5


def texts(seed, n, longest):
    """A few words in most texts, many in few; some texts twice, so that scores are equal."""
    r = np.random.default_rng(seed)
    names = np.array(["".join(chr(97 + int(c)) for c in f"{k:03}") for k in range(150)])
    share = 1 / np.arange(1, 151)
    made = [" ".join(r.choice(names, r.integers(0, longest), p=share / share.sum())) for _ in range(n * 3 // 4)]
    return made + made[: n - len(made)]


@pytest.mark.parametrize("listed, most, tile", [(4000, 0.7, 2048), (0, 0.7, 50), (10**9, 9.0, 50), (0, 0.0, 2048), (0, 9.0, 50)])
def test_best_equal_all_scores(monkeypatch, listed, most, tile):
    for name, value in (("LISTED", listed), ("MOST_OF_ALL", most), ("TILE_DOCUMENTS", tile), ("TILE_QUESTIONS", 7)):
        monkeypatch.setattr(bothsearch, name, value)
    docs, asked = texts(1, 1200, 40), [*texts(2, 60, 12), "", "absent words"]
    kept = np.arange(len(docs)) % 3 > 0
    counts, questions = [Counter(t.split()) for t in docs], [Counter(t.split()) for t in asked]
    sums = HashEmbedder().sums(docs).astype(np.float32)
    batches, at = [], 0
    for size in (16, 32, 64, 128, 256, 512, 1200):
        some = slice(at, min(at + size, len(docs)))
        columns = [[sum(c.values()) for c in counts[some]], [list(c) for c in counts[some]], [list(c.values()) for c in counts[some]], list(sums[some])]
        kinds = (pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.float32()))
        batches.append((at, pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["dl", "terms", "tfs", "vector"])))
        at += size

    def best(scores, rows, positive):
        return [[p for s, p in sorted(((s, p) for p, s in zip(rows, q) if s > (0 if positive else -np.inf)), reverse=True)[:K]] for q in scores]

    found = lambda top: [[int(p) for p in row if p >= 0] for row in top.place]
    for rows in (np.arange(len(docs)), np.flatnonzero(kept)):
        n, df = len(rows), Counter(t for r in rows for t in counts[r])
        mean = sum(sum(counts[r].values()) for r in rows) / n
        one = lambda q, d: sum(m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * sum(d.values()) / mean)) for t, m in q.items() if d[t])
        words, top = Words(questions, n, mean, df, K), Top(len(asked), K)
        for at, batch in batches:
            words.add(batch, rows[(rows >= at) & (rows < at + batch.num_rows)] - at, at, top)
        assert found(top) == best([[round(one(q, counts[r]), 9) for r in rows] for q in questions], rows, True)
    every, part, vectors = Top(len(asked), K), Top(len(asked), K), Vectors(asked, K)
    for at, batch in batches:
        vectors.add(batch.column("vector"), kept[at : at + batch.num_rows], at, every, part)
    unit, mine = (v / np.where((n := np.sqrt((v**2).sum(axis=1))) > 0, n, 1)[:, None] for v in (sums.astype(float), HashEmbedder().sums(asked)))
    cosine = np.round(mine @ unit.T, 6) + 0.0
    for top, side in ((every, np.ones(len(docs), bool)), (part, kept)):
        rows = np.flatnonzero(side & sums.any(axis=1))
        common = (mine[:, None, :] != 0) & (unit[None, rows, :] != 0)
        assert found(top) == best([np.where(m.any(axis=1), c, -np.inf) for m, c in zip(common, cosine[:, rows])], rows, False)


def test_equals_two_searches_of_the_index(spark, tmp_path):
    docs = texts(3, 300, 30)
    rows = [(f"d{k % 280:03}", f"r/{'Views' if k % 4 else 'Kept'}/f{k % 50}.cc", 1, 2, f"s{k % 9}", None, t) for k, t in enumerate(docs)]
    chunks = spark.createDataFrame(rows, CHUNK)
    asked = spark.createDataFrame([*enumerate([*texts(4, 40, 9), ""]), (99, None)], "q bigint, question string")
    kept = F.contains("file", F.lit("Kept"))
    store = IndexStore(spark, str(tmp_path / "index"), "code")
    build_index(chunks, store, "a" * 12)
    index, both = SearchIndex.open(spark, store), BothSearch(chunks, kept, asked)
    for one, found in zip((index, index.restricted(kept)), both.hybrid(4)):
        want = {tuple(r) for r in one.hybrid(chunks, asked, 4).select("q", "doc", "file", "symbol").collect()}
        assert {tuple(r) for r in found.collect()} == want and want
    # blocks of few questions
    few, many = both.legs(10, block=7), both.legs(10)
    assert all({tuple(r) for r in few[leg].collect()} == {tuple(r) for r in many[leg].collect()} for leg in many)


def test_sums_reach_what_they_should():
    r = np.random.default_rng(6)
    columns = r.random((12, 100))
    items = [[(int(b), m + 1) for m, b in enumerate(r.choice(12, r.integers(0, 6), replace=False))] for _ in range(50)]
    exact = np.array([sum((columns[b] * m for b, m in own), np.zeros(100)) for own in items])
    least = np.full(50, 4.0)
    least[7] = -np.inf
    walk = bothsearch.Walk(items)
    room = np.where(np.arange(50) % 2 > 0, 60_000, 600) / np.maximum(exact.max(axis=1), 1)  # fine and coarse steps

    def column(x, steps, tile):
        if x[0] % 3:
            return np.ceil(columns[x[0], tile] * (x[1] * steps)).astype(np.uint16)
        return np.arange(tile.stop - tile.start), np.ceil(columns[x[0], tile] * (x[1] * steps)).astype(np.uint16)

    got = set(zip(*(a.tolist() for a in walk.reach(room, least, np.uint16, 100, column))))
    want = {(q, d) for q, d in zip(*np.nonzero(exact >= least[:, None])) if items[q]}
    assert want <= got and all(exact[q, d] > least[q] - 1 for q, d in got)
    # sums are kept from question to question
    assert sum(len(p) - s for p, s in zip(walk.paths, walk.shared)) < sum(map(len, items))


def test_sample_changes_nothing(spark, monkeypatch):
    rows = [(f"d{k:03}", f"r/{'Views' if k % 4 else 'Kept'}/f{k % 50}.cc", 1, 2, f"s{k % 9}", None, t) for k, t in enumerate(texts(7, 300, 30))]
    asked = spark.createDataFrame([*enumerate([*texts(8, 40, 9), ""])], "q bigint, question string")
    both = BothSearch(spark.createDataFrame(rows, CHUNK), F.contains("file", F.lit("Kept")), asked)
    plain = {tuple(map(str, r)) for r in both.best(10).collect()}
    monkeypatch.setattr(bothsearch, "SAMPLE", 40)
    assert both._sample(300).num_rows < 150 and {tuple(map(str, r)) for r in both.best(10, block=15).collect()} == plain
