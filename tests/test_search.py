import json
import subprocess
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions.embed import DIM, HashEmbedder, dimension, embed, hash_vector
from corpusmill.functions.text import module
from corpusmill.operators import abtest, bm25, dense, fusion, loadtest, sessions
from corpusmill.operators.searchindex import SearchIndex, build_index
from corpusmill.plans import answer
from corpusmill.schema import CHUNK
from corpusmill.sources import build, files
from corpusmill.sources.paths import Folder
from corpusmill.sources.store import IndexStore

TEXTS = {"a": "merge hits of a wire", "b": "merge tracks and hits", "c": "board noise", "d": "merge merge merge", "e": ""}


def corpus(spark, texts=TEXTS, file="r/{}.cc"):
    return spark.createDataFrame([(k, file.format(k), 1, 2, f"sym_{k}", None if k == "c" else "cpp", t) for k, t in texts.items()], CHUNK)


@pytest.fixture
def store(spark, tmp_path):
    return IndexStore(spark, str(tmp_path / "index"), "code")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "q int, question string")


def test_index_equals_scan(spark, store):
    chunks = corpus(spark).unionAll(corpus(spark).limit(2)).withColumn("doc", F.lit("clashing"))
    build_index(chunks, store, "a" * 12)
    index, q = SearchIndex.open(spark, store), asked(spark, "merge hits", "noise Board", None, "absent", "")
    text = F.concat_ws(" ", "text", "symbol")
    want = {tuple(r) for r in bm25.search(chunks, "id", text, q, "q", "question", 3).collect()}
    assert {tuple(r) for r in index.lexical(q, 3).collect()} == want and want
    # a block of one question each, and many term buckets
    assert {tuple(r) for r in index.lexical(q, 3, block=1).collect()} == want
    vectors = {r["doc"]: np.array(r["vector"], float) for r in index.documents().collect()}
    mine = HashEmbedder()(["merge hits"])[0]
    got = {r["doc"]: r["score"] for r in index.dense(q, 9).where("q = 0").collect()}
    assert got == {k: round(float(v @ mine / np.sqrt(v @ v)), 6) for k, v in vectors.items() if v.any()}
    # the words of a part of the corpus weigh as in that part alone
    part = {tuple(r) for r in index.restricted(F.col("file") != "r/d.cc").lexical(q, 3).collect()}
    assert part == {tuple(r) for r in bm25.search(chunks.where("id <> 'd'"), "id", text, q, "q", "question", 3).collect()} != want


def test_buckets_change_nothing(spark, tmp_path, monkeypatch):
    from corpusmill.operators import searchindex

    got = []
    chunks = corpus(spark).unionAll(corpus(spark, {"a": "another text", "d": "merge"})).unionAll(corpus(spark, {"b": TEXTS["b"]}))
    for size, few in ((100_000, 200_000), (1, 200_000), (1, 0)):
        monkeypatch.setattr(searchindex, "DOCS_PER_BUCKET", size)
        monkeypatch.setattr(searchindex, "BROADCAST_ROWS", few)
        store = IndexStore(spark, str(tmp_path / f"{size}-{few}"), "code")
        build_index(chunks, store, "a" * 12)
        index = SearchIndex.open(spark, store)
        assert index.documents().count() == 5
        got.append(({tuple(r) for r in index.lexical(asked(spark, "merge hits", "noise"), 5).collect()}, {tuple(r) for r in index.dense(asked(spark, "merge hits"), 5).collect()}))
    assert got[0] == got[1] == got[2] and all(got[0])


def test_versions(spark, store):
    old = build_index(corpus(spark), store, "a" * 12)
    new = build_index(corpus(spark, {"z": "merge"}), store, "b" * 12)
    q = asked(spark, "merge")
    assert [r["doc"] for r in SearchIndex.open(spark, store).lexical(q).collect()] == ["z"]
    assert len(SearchIndex.open(spark, store, old).lexical(q).collect()) == 3 and old != new
    with pytest.raises(LookupError):
        SearchIndex.open(spark, IndexStore(spark, str(store.root.path), "other"))


def test_empty_corpus_and_questions(spark, store):
    build_index(corpus(spark).limit(0), store, "a" * 12)
    index = SearchIndex.open(spark, store)
    assert index.lexical(asked(spark, "merge")).count() == 0 and index.dense(asked(spark, "merge")).count() == 0
    assert index.hybrid(corpus(spark).limit(0), asked(spark, "merge").limit(0)).count() == 0


def test_partial_collection_of_its_own(spark, tmp_path):
    chunks = corpus(spark, file="r/{}/x.cc")
    kept = abtest.partial_corpus(chunks, ["a", "b"], module(F.col("file"), "r"))
    assert {r["id"] for r in kept.collect()} == {"c", "d", "e"}
    store = IndexStore(spark, str(tmp_path), "partial")
    build_index(kept, store, "c" * 12)
    assert [r["doc"] for r in SearchIndex.open(spark, store).lexical(asked(spark, "merge")).collect()] == ["d"]


def test_a_failing_leg_is_left_out(spark, store, monkeypatch):
    build_index(corpus(spark), store, "a" * 12)
    index, q = SearchIndex.open(spark, store), asked(spark, "merge hits")
    both = [r["doc"] for r in index.hybrid(corpus(spark), q).orderBy("rank").collect()]
    monkeypatch.setattr(SearchIndex, "dense", lambda *a, **k: 1 / 0)
    with pytest.warns(UserWarning, match="dense leg"):
        only = [r["doc"] for r in index.hybrid(corpus(spark), q).orderBy("rank").collect()]
    assert only == [r["doc"] for r in index.lexical(q).orderBy("rank").collect()] and set(only) <= set(both)
    monkeypatch.setattr(SearchIndex, "lexical", lambda *a, **k: 1 / 0)
    with pytest.warns(UserWarning):
        assert index.hybrid(corpus(spark), q).count() == 0


def test_rerankers(spark):
    rows = spark.createDataFrame([(q, d, "what hits", p) for q in (1, 2, 3) for d, p in (("a", "long text"), ("b", "hits"), ("c", ""))], "q int, doc string, question string, passage string")

    def scorer(question, passages):
        return [float(len(p)) for p in passages]

    got = {(r["q"], r["doc"]): r["rerank_score"] for r in fusion.rerank_scores(rows, scorer).collect()}
    assert got[1, "a"] == 9.0 and len(got) == 9
    for bad in (lambda q, p: 1 / 0, lambda q, p: [1.0]):
        failed = fusion.rerank_scores(rows, bad)
        assert all(r["rerank_score"] is None and r["error"] for r in failed.collect())
        fused = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.4, 2), (1, "c", 0.3, 3)], "q int, doc string, score double, rank int")
        assert [r["doc"] for r in fusion.rerank(fused, failed).orderBy("rank").collect()] == ["a", "b", "c"]
    assert fusion.word_overlap("hits of hits", ["Hits", "", "of hits"]) == [0.5, 0.0, 1.0] and fusion.word_overlap("", ["x"]) == [None]
    assert fusion.logit_scorer(lambda q, ps: [(0.0, 0.0), (900.0, 0.0), (0.0, 900.0)])("q", ["x"] * 3) == [0.5, pytest.approx(0.0), 1.0]
    sizes = []
    assert fusion.class_scorer(lambda pairs: sizes.append(len(pairs)) or [float(len(p)) for _, p in pairs], 2)("q", ["a", "bb", "ccc"]) == [1.0, 2.0, 3.0] and sizes == [2, 1]


def test_search_and_ask(spark, store):
    build_index(corpus(spark), store, "a" * 12)
    index, q = SearchIndex.open(spark, store), asked(spark, "merge hits", None)
    rows = answer.search(index, corpus(spark), q, 2, fusion.word_overlap).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2] and rows[0]["text"] == TEXTS[rows[0]["id"]] and rows[0]["language"] == "cpp"
    got = {r["q"]: r for r in answer.ask(index, corpus(spark), q, lambda messages: f"{len(messages)} messages").collect()}
    assert got[0]["text"].startswith("2 messages\n\nSources:\n  r/") and got[1]["text"] == "No relevant chunks found."
    assert answer.warm_up(index)
    with pytest.warns(UserWarning):
        assert not answer.warm_up(SearchIndex(spark, store.root / "nowhere"))


def test_nearest_ties_and_dirty_vectors(spark):
    rows = [(k, [1.0, 0.0]) for k in range(50)] + [(50, [1.0, None]), (51, [float("nan"), 1.0]), (52, [1.0]), (53, []), (54, None), (None, [1.0, 0.0]), (55, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "k int, v array<double>").repartition(3)
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [1.0]), (4, [])], "q int, v array<double>")
    got = [tuple(r) for r in dense.nearest(df, "k", "v", q, "q", "v", 3).orderBy("q", "rank").collect()]
    assert got == [(1, 0, 1, 1.0), (1, 1, 2, 1.0), (1, 2, 3, 1.0), (3, 52, 1, 1.0)]
    assert [r["doc"] for r in dense.nearest(df, "k", "v", q, "q", "v", 3, larger=True).where("q = 1").orderBy("rank").collect()] == [49, 48, 47]


def test_embedders_agree(spark):
    texts = ["GetHits from wire", "", "a b a 12 Ab"]
    inside = [r["v"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", hash_vector(F.col("t")).alias("v")).orderBy("k").collect()]
    assert np.allclose(np.array(inside), HashEmbedder()(texts), atol=1e-6)
    assert dimension(lambda ts: [[0.0] * 7 for _ in ts]) == 7 and HashEmbedder().dim == DIM


def test_embed_errors_are_written(spark, tmp_path):
    def backend(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [[1.0] for _ in texts]

    rows = embed(corpus(spark, {"a": "good", "b": "bad text", "c": "fine"}), "text", backend, 2, 3)
    assert rows.where("error is null").count() == 2
    files.write_embed_errors(rows, str(tmp_path / "errors.jsonl"))
    got = files.read_jsonl(spark, str(tmp_path / "errors.jsonl"), "index bigint, id string, file string, chars int, error string").collect()
    assert [(r["id"], r["file"], r["chars"], r["error"]) for r in got] == [("b", "r/b.cc", 8, "ValueError: no")]


def test_published_rows_and_long_reports(spark, tmp_path):
    path = str(tmp_path / "chunks.jsonl")
    files.write_jsonl(corpus(spark), path)
    before = files.read_jsonl(spark, path)
    files.write_jsonl(corpus(spark, {"z": "new"}), path)
    # a reader of the old version still has its files
    assert before.count() == 5 and [r["id"] for r in files.read_jsonl(spark, path).collect()] == ["z"]
    with pytest.raises(Exception):
        files.write_jsonl(corpus(spark).select(F.raise_error(F.lit("stop")).alias("id")), path)
    assert [r["id"] for r in files.read_jsonl(spark, path).collect()] == ["z"]
    js, md = files.write_report(spark.range(10_500), str(tmp_path), "long", "Long")
    assert len(json.load(open(js))["rows"]) == 10_500 and sum(1 for _ in open(md)) == 10_504
    folder = Folder(spark, str(tmp_path / "f"))
    folder.write("x", "é1")
    folder.write("x", "é2")
    assert folder.read("x") == "é2" and folder.read("y") is None and folder.names() == ["x"]


def test_corpus_of_several_repositories(spark, tmp_path):
    def repository(name, **texts):
        root = tmp_path / "origin" / name
        root.mkdir(parents=True)
        for f, t in texts.items():
            (root / f.replace("_", ".")).write_text(t)
        subprocess.run("git init -q . && git add -A && git -c user.name=x -c user.email=x@x commit -qm x", shell=True, cwd=root, check=True)
        return str(root)

    one, two, none = repository("one", a_py="def f():\n    pass\n", b_cc="class A { A() {} };\n"), repository("two", a_py="def f():\n    pass\n"), repository("none", x_txt="-")
    out = str(tmp_path / "all.jsonl")
    counts = {r["repo"]: r["chunks"] for r in build.build_corpus(spark, [one, two, none], str(tmp_path / "clones"), out).collect()}
    ids = {r["id"] for r in files.read_jsonl(spark, out).collect()}
    assert counts == {"one": 3, "two": 1, "none": 0} and ids == {"one/a.py_f_1", "one/b.cc_A_1", "one/b.cc_A_1#2", "two/a.py_f_1"}
    (tmp_path / "origin" / "two" / "c.py").write_text("def g(): pass\n")
    subprocess.run("git add -A && git -c user.name=x -c user.email=x@x commit -qm y", shell=True, cwd=two, check=True)
    again = {r["repo"]: r["chunks"] for r in build.build_corpus(spark, [one, two], str(tmp_path / "clones"), out).collect()}
    assert again == {"one": 3, "two": 2}
    # the same name twice gives the same ids: refused, and what is published stays
    with pytest.raises(build.CorpusError):
        build.build_corpus(spark, [one, one], str(tmp_path / "clones"), out)
    assert files.read_jsonl(spark, out).count() == 5


def test_ramp_and_monitor(spark):
    watch = loadtest.Monitor(0.05, ("echo", "12, 34"))
    rows, summary = loadtest.ramp(spark, lambda q: "fine" if q == "ok" else 1 / 0, ["ok", "bad"], (1, 3), 5.0, watch)
    got = {r["level"]: r for r in summary.collect()}
    assert got[1]["ok"] == 1 and (got[3]["n"], got[3]["ok"], got[3]["peak_mem_mb"]) == (3, 2, 12) and got[3]["wall_s"] > 0 and rows.count() == 4
    assert watch.samples and watch.frame(spark).where("error is null").count() == len(watch.samples)
    with loadtest.Monitor(0.05, ("no-such-command",)) as broken:
        pass
    assert broken.peak() is None and broken.samples[0][3]
    assert spark.range(1).select(loadtest.answer_seconds(F.lit(1_500_000_000), F.lit(500_000_000)).alias("s")).first()["s"] == 2.0


def test_session_files(spark, tmp_path):
    at = datetime(2026, 7, 13, 15, 30)
    assert sessions.session_path("jane", at, "/x/") == ("/x/jane", "20260713_153000.json")
    for n in (1, 2):
        path = sessions.save_session(spark, {"researcher": "jane", "turns": [n]}, "jane", at, str(tmp_path))
    assert json.load(open(tmp_path / "jane" / "20260713_153000.json"))["turns"] == [2] and path.endswith("jane/20260713_153000.json")
    assert [p.name for p in (tmp_path / "jane").iterdir()] == ["20260713_153000.json"]
    t = spark.createDataFrame([(1, k, f"q{k}", None if k in (3, 7) else f"a{k}") for k in range(14)], "c int, t int, question string, answer string")
    got = {r["t"]: [m["content"] for m in r["messages"]] for r in sessions.messages(t, "c", "t", "question", "answer").collect()}
    answered = [k for k in range(14) if k not in (3, 7)]
    assert got == {k: [x for a in [a for a in answered if a < k][-8:] for x in (f"q{a}", f"a{a}")] for k in range(14)}


def test_best_model(spark):
    rows = [(1, "a", 0.5, 0.2, 0.3, 0.9), (1, "b", 0.5, 0.4, 0.3, 0.1)]
    from corpusmill.operators import metrics

    got = {r["metric"]: (r["model"], r["value"]) for r in metrics.best(spark.createDataFrame(rows, "k int, model string, recall double, precision double, ndcg double, mrr double")).collect()}
    assert got == {"recall": ("a", 0.5), "precision": ("b", 0.4), "ndcg": ("a", 0.3), "mrr": ("a", 0.9)}
