import math
import os
import random
import re
import subprocess
import uuid

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.embed import embed, hash_vector
from corpusmill.functions.hashing import corpus_digest, fingerprint, uuid5
from corpusmill.functions.text import TOKEN, extension, line_count, slug, tokens, without_mentions
from corpusmill.operators import abtest, bm25, corpus, dense, fusion, loadtest, metrics, sessions
from corpusmill.operators.skew import join_counted, join_split
from corpusmill.plans import answer
from corpusmill.schema import CHUNK, chunk_errors, chunk_id
from corpusmill.sources import files as sources
from corpusmill.sources.store import IndexStore, orphans, parse_name, physical_name
from corpusmill.streaming import index as stream_index
from corpusmill.streaming import sessions as stream_sessions


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()["x"]


def test_chunk_schema(spark):
    good = ("i", "src/RecoBase/Hit.cc", 42, 60, "CalibrateHits", "cpp", "t")
    rows = [good, (*good[:5], "rust", "t"), (*good[:2], 42, 1, *good[4:])]
    rows += [tuple(None if k == j else v for k, v in enumerate(good)) for j in range(7)]
    got = [r["e"] for r in spark.createDataFrame(rows, CHUNK).select(chunk_errors().alias("e")).collect()]
    assert got[0] == [] and got[1] == ["bad language: rust"] and got[2] == ["end_line before start_line"]
    names = [f.name for f in CHUNK.fields]
    assert [g for g in got[3:]] == [[f"missing field: {n}"] for n in names]
    assert one(spark, chunk_id(F.col("f"), F.col("s"), F.col("l")), f="src/RecoBase/Hit.cc", s="CalibrateHits", l=42) == "src/RecoBase/Hit.cc_CalibrateHits_42"


def test_tokens(spark):
    rng = random.Random(1)
    texts = ["GetHits", "ABCAnaUtils", "", "a1B2 xY_zZ", "µs-scale ÄÖ"] + ["".join(rng.choice("abXYZ09_ .é") for _ in range(30)) for _ in range(200)]
    got = [r["t"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tokens(F.col("t")).alias("t")).collect()]
    assert got[0] == ["get", "hits"] and got[1] == ["abc", "ana", "utils"]
    assert sorted(map(tuple, got)) == sorted(tuple(x.lower() for x in re.findall(TOKEN, t)) for t in texts)


def test_text_functions(spark):
    for path in ("a/b.cc", "a/.hidden", "x.tar.gz", "noext", "a.b/c", "a/b.", ".x.y"):
        assert one(spark, extension(F.col("p")), p=path) == os.path.splitext(path)[1], path
    assert one(spark, line_count(F.col("t")), t="a\nb\n") == 3
    assert one(spark, slug(F.col("n")), n="  Dr. O'Neil-Smith! ") == "dr_o_neil_smith" and one(spark, slug(F.col("n")), n=" !! ") == "researcher"
    assert one(spark, without_mentions(F.col("t")), t="<@U1> what  is <@U2>it") == "what  is it" and one(spark, without_mentions(F.col("t")), t="<@U1>") == ""


def test_hashes(spark):
    for name in ("", "a", "src/Ä.cc_f_1"):
        assert one(spark, uuid5(F.col("n")), n=name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))
    rows = [("b", "two"), ("a", "one"), ("a", "other")]
    f = lambda r: fingerprint(spark.createDataFrame(r, "id string, text string")).first()[0]
    g = lambda r: tuple(corpus_digest(spark.createDataFrame(r, "id string, text string")).first())
    assert f(rows) == f(rows[::-1]) != f([*rows[:2], ("a", "changed")])
    assert g(rows) == g(rows[::-1]) != g([*rows[:2], ("a", "changed")])


def brute_bm25(docs, question):
    toks = {k: [x.lower() for x in re.findall(TOKEN, t)] for k, t in docs.items()}
    avg = sum(map(len, toks.values())) / len(toks)
    out = {}
    for k, ts in toks.items():
        s = 0.0
        for q in (x.lower() for x in re.findall(TOKEN, question)):
            f = ts.count(q)
            if f:
                df = sum(q in t for t in toks.values())
                s += math.log(1 + (len(toks) - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(ts) / avg))
        if s > 0:
            out[k] = round(s, 9)
    return sorted(out.items(), key=lambda x: (-x[1], -x[0]))


def test_bm25_against_brute_force(spark):
    rng = random.Random(3)
    words = "hit track wire GetHits noise board".split()
    docs = {k: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) for k in range(40)}
    docs[40] = docs[39]
    asked = {1: "hit hit GetHits", 2: "board noise", 3: "unknown", 4: ""}
    # repeated rows are one document
    d = spark.createDataFrame([*docs.items(), *list(docs.items())[:7], *list(docs.items())[:3]], "id int, text string")
    q = spark.createDataFrame(list(asked.items()), "q int, text string")
    got = bm25.search(d, "id", F.col("text"), q, "q", "text", 7).collect()
    for k, text in asked.items():
        mine = [(r["doc"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["q"] == k]
        want = brute_bm25(docs, text)[:7]
        assert [m[0] for m in mine] == [w[0] for w in want] and all(abs(a[1] - b[1]) < 1e-8 for a, b in zip(mine, want))


def test_bm25_empty(spark):
    d = spark.createDataFrame([], "id int, text string")
    q = spark.createDataFrame([(1, "x")], "q int, text string")
    assert bm25.search(d, "id", F.col("text"), q, "q", "text").count() == 0


def test_nearest_in_blocks(spark):
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(60)] + [(60, None), (61, [0.0] * 8)]
    df = spark.createDataFrame(rows, "k int, v array<float>")
    some = df.where("k % 10 = 0")
    a = {tuple(r) for r in dense.nearest(df, "k", "v", some, "k", "v", 5).collect()}
    b = {tuple(r) for r in dense.nearest(df, "k", "v", some, "k", "v", 5, block=2).collect()}
    assert a == b and len(a) == 30 and all(d == q for q, d, r, _ in a if r == 1)


def test_fusion(spark):
    ranked = lambda xs: spark.createDataFrame([(1, x, k + 1) for k, x in enumerate(xs)], "q int, doc string, rank int")
    got = [r["doc"] for r in fusion.fuse(ranked("abx"), ranked("bc")).orderBy("rank").collect()]
    assert got == ["b", "a", "c", "x"] or got[0] == "b" and got.index("a") < got.index("x")
    assert [r["doc"] for r in fusion.fuse(ranked(""), ranked("bc")).orderBy("rank").collect()] == ["b", "c"]
    scores = spark.createDataFrame([(1, "x", 0.9), (1, "a", 0.1), (1, "c", None)], "q int, doc string, rerank_score double")
    assert [r["doc"] for r in fusion.rerank(fusion.fuse(ranked("abx"), ranked("bc")), scores).orderBy("rank").collect()][:2] == ["x", "a"]
    meta = spark.createDataFrame([("a", "f", "s"), ("b", "f", "s"), ("c", "g", "s")], "doc string, file string, symbol string")
    kept = [r["doc"] for r in fusion.diverse(ranked("abc"), meta, 5).orderBy("final_rank").collect()]
    assert kept == ["a", "c"]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, x, k + 1) for k, x in enumerate("abcd")] + [(2, "a", 1)], "q int, doc string, rank int")
    gold = spark.createDataFrame([(1, x) for x in "bdz"], "q int, doc string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "q int")
    got = {(r["q"], r["k"]): r for r in metrics.per_query(ranked, gold, asked, (1, 2, 4, 10)).collect()}
    assert [round(got[1, k]["recall"], 6) for k in (1, 2, 4)] == [0, 0.333333, 0.666667]
    assert [got[1, k]["precision"] for k in (1, 2, 4, 10)] == [0, 0.5, 0.5, 0.5]
    ideal = 1 + 1 / math.log2(3) + 0.5
    assert got[1, 4]["mrr"] == 0.5 and abs(got[1, 4]["ndcg"] - (1 / math.log2(3) + 1 / math.log2(5)) / ideal) < 1e-8
    assert all(got[q, k][c] == 0 for q in (2, 3) for k in (1, 10) for c in ("recall", "precision", "ndcg", "mrr"))


def test_percentiles_and_summary(spark):
    p = lambda vs, q: spark.createDataFrame([(float(v),) for v in vs], "v double").agg(loadtest.nearest_rank("v", q)).first()[0]
    assert [p(range(1, 11), q) for q in (50, 95, 100)] == [5, 10, 10] and p([42], 95) == 42 and p([], 50) is None
    rows = [("a", 10.0, True), ("a", 20.0, True), ("a", 30.0, True), ("a", 99.0, False), ("b", 1.0, False)]
    got = {r["lv"]: r for r in loadtest.summary(spark.createDataFrame(rows, "lv string, latency double, success boolean"), ["lv"]).collect()}
    assert (got["a"]["rate"], got["a"]["p50"], got["a"]["max"], got["a"]["mean"]) == (0.75, 20, 30, 20)
    assert got["b"]["rate"] == 0 and got["b"]["p50"] is None and got["b"]["mean"] is None
    assert one(spark, loadtest.speed(F.col("n"), F.col("t")), n=100, t=2_000_000_000) == 50
    assert one(spark, loadtest.p_yes(F.col("a"), F.col("b")), a=1000.0, b=1000.0) == 0.5


def test_sessions(spark):
    assert sessions.merge(["a", "b"], ["b", "c", "d"], 3) == ["a", "b", "c"] and sessions.merge([], ["x"]) == ["x"] and sessions.merge(["x"], []) == ["x"]
    rng = random.Random(6)
    rows = [(c, t, None if rng.random() < 0.2 else [rng.choice("abcdefgh") for _ in range(rng.randrange(4))]) for c in range(6) for t in range(9)]
    df = spark.createDataFrame(rows, "conv bigint, turn bigint, fresh array<string>")
    for mode in ("all", "last_turn"):
        want, state = {}, {}
        for c, t, f in rows:
            got = sessions.merge(state.get(c, []), f or [], 5)
            if f:
                state[c] = got if mode == "all" else f
            want[c, t] = got
        assert {(r[0], r[1]): r[2] for r in sessions.carry_forward(df, 5, mode).collect()} == want
    h = sessions.history(spark.createDataFrame([(1, k) for k in range(12)], "c int, t int"), "c", "t", F.col("t")).where("t = 11").first()["history"]
    assert h == list(range(3, 11))
    assert one(spark, sessions.reasons(F.col("t")), t="3, 1,9,x,3") == ["missing_incomplete_info", "inaccurate_hallucinated"]


def test_verdicts(spark):
    rows = [(False, False, False, False), (True, True, True, True), (True, True, False, True), (True, True, False, False), (False, True, True, False), (False, True, False, False)]
    got = [r[0] for r in spark.createDataFrame(rows, "e boolean, c boolean, p boolean, u boolean").select(abtest.verdict(*map(F.col, "ecpu"))).collect()]
    assert got == ["complete_retrieval_miss", "leak", "hallucination_suspected", "declined_correctly", "ok", "partial_retrieval_miss"]


def test_skewed_join(spark, monkeypatch):
    from corpusmill.operators import skew

    monkeypatch.setattr(skew, "HOT", 5)
    rows = spark.createDataFrame([("h" if k < 40 else str(k), k) for k in range(60)], "g string, id int")
    groups = rows.groupBy("g").agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("n"))
    got = join_counted(rows, groups, "g", "n", "id")
    assert got.count() == 60 and got.where("g = 'h' and m = 0").count() == 40
    want = {tuple(r) for r in join_split(rows, groups, "g", "n", "id").collect()}
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 2)
    assert {tuple(r) for r in join_split(rows, groups, "g", "n", "id").select("g", "id", "m").collect()} == want and len(want) == 60


def test_embedding(spark):
    def backend(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([("a",), ("bad",), ("ccc",)], "t string").coalesce(1)
    got = {r["t"]: (r["vector"], r["error"]) for r in embed(df, "t", backend, 2).collect()}
    assert got["a"] == ([1.0], None) and got["ccc"] == ([3.0], None) and got["bad"][0] is None and "no" in got["bad"][1]
    v = one(spark, hash_vector(F.col("t")), t="GetHits from wire")
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-5


def test_reuse(spark):
    chunk = lambda *rows: spark.createDataFrame([(i, "f", 1, 1, "s", "cpp", t) for i, t in rows], CHUNK)
    old = chunk(("o", "old text"))
    points = spark.createDataFrame([("p", "o", [1.0], "m"), ("q", "o", [2.0], "other")], "id string, chunk_id string, vector array<float>, embed_model string")
    new = chunk(("1", "old text"), ("2", "new"), ("3", "old text"), ("4", None))
    live = dense.live_inputs(points, old, "m")
    assert dense.to_embed(new, live).count() == 1 and {(r["id"], r["vector"][0]) for r in dense.fan_out(new, live.select("key", "vector")).collect()} == {("1", 1.0), ("3", 1.0)}
    assert dense.to_embed(new, dense.live_inputs(points, old, "none")).count() == 2
    stats = dense.embed_statistics(chunk(*[(str(k), t) for k, t in enumerate("TATBT")])).first()
    assert tuple(stats) == (5, 3, 2)
    long = chunk(("a", "x" * 6000 + "1"), ("b", "x" * 6000 + "2"))
    assert dense.embed_inputs(long).count() == 1


def test_store(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path), "code")
    write = lambda n: lambda path: spark.range(n).write.parquet(f"{path}/t")
    a = store.rebuild("a" * 12, write(3))
    assert store.read(spark, "t").count() == 3 and store.rebuild("a" * 12, write(9)) == a
    with pytest.raises(RuntimeError):
        store.rebuild("b" * 12, lambda path: (_ for _ in ()).throw(RuntimeError("stop")))
    assert store.live()["name"] == a and len([p for p in tmp_path.iterdir() if p.is_dir()]) == 1
    b = store.rebuild("b" * 12, write(5))
    assert store.read(spark, "t").count() == 5 and store.read(spark, "t", a).count() == 3
    assert store.collect(now=parse_name(a, "code")[1] + 10) == [] and store.collect(now=parse_name(a, "code")[1] + 99_999) == [a]
    assert store.live()["name"] == b
    assert parse_name(physical_name("code", "0a1b2c3d4e5f", 7), "code") == ("0a1b2c3d4e5f", 7) and parse_name("code__0a1b2c3d4e5f__7", "code") == ("0a1b2c3d4e5f", 7)
    assert parse_name("code", "code") is None and parse_name("other__0a1b2c3d4e5f__7", "code") is None
    df = spark.createDataFrame([("code__0a1b2c3d4e5f__1", False), ("code__0a1b2c3d4e5f__2", True), ("x", False)], "name string, live boolean")
    assert [r["name"] for r in orphans(df, "code", 9999).collect()] == ["code__0a1b2c3d4e5f__1"]


def test_extract_from_git(spark, tmp_path):
    root = tmp_path / "r"
    put = lambda p, t: ((root / p).parent.mkdir(parents=True, exist_ok=True), (root / p).write_bytes(t.encode() if isinstance(t, str) else t))
    put("a.py", "def f():\n    return 1\n")
    put("b.cc", "class A { A() {} };\nint g() { return 1; }\n")
    put("c.fcl", "x: { a: 1 }\n")
    put("d.fcl", "# only a comment\n# more")
    put("h.h", "int h() { return 2; }\n")
    put("u.txt", "unknown")
    put("bad.py", b"x = '\xff\n")
    rules = (("tests", r"(^|/)test/"), ("outside", r"(^|/)deps/"), ("tables", r"/tables/"), ("jobs", r"/prod[^/]*\.fcl$"))
    for p in ("test/t.cc", "x/deps/v.cc", "fcl/y/tables/c.fcl", "z/prod_a.fcl"):
        put(p, "x: 1\n")
    put("untracked.py", "def no(): pass\n")
    subprocess.run("git init -q . && git add -A && git rm -q --cached untracked.py", shell=True, cwd=root, check=True)
    files = sources.source_files(spark, str(root), sources.git_files(str(root)))
    got = corpus.numbered(corpus.extract(files, rules), [F.col("ord")]).collect()
    by = {(r["file"], r["symbol"]): r for r in got}
    assert {k for k in by} == {("a.py", "f"), ("b.cc", "A"), ("b.cc", "g"), ("c.fcl", "x"), ("d.fcl", "__WHOLE_FILE__"), ("h.h", "h"), ("bad.py", "__WHOLE_FILE__")}
    assert by["d.fcl", "__WHOLE_FILE__"]["end_line"] == 2 and by["d.fcl", "__WHOLE_FILE__"]["fallback"]
    ids = [r["id"] for r in got]
    assert len(ids) == len(set(ids)) and "b.cc_A_1#2" in ids and all(r["id"].startswith(r["file"]) for r in got)
    counts = {r["rule"]: r["files"] for r in corpus.exclusion_counts(files.withColumnRenamed("path", "file"), rules).collect()}
    assert counts == {"tests": 1, "outside": 1, "tables": 1, "jobs": 1} and corpus.extract(files).count() == corpus.extract(files, rules).count() + 4
    named = sources.source_files(spark, str(root), ["a.py"], repo="one")
    assert [r["path"] for r in named.collect()] == ["one/a.py"]


def test_jsonl_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("i", "f", 1, 2, "s", "cpp", "t")], CHUNK)
    path = str(tmp_path / "chunks.jsonl")
    sources.write_jsonl(rows, path)
    sources.write_jsonl(rows.unionAll(rows), path)
    assert sources.read_jsonl(spark, path).count() == 2
    assert sources.ensure_chunks(spark, str(tmp_path / "new.jsonl"), lambda: rows).count() == 1
    with pytest.warns(UserWarning):
        assert sources.ensure_chunks(spark, str(tmp_path / "no.jsonl"), lambda: 1 / 0) is None
    js, md = sources.write_report(spark.createDataFrame([(1, "x|y")], "k int, v string"), str(tmp_path), "bench", "Bench", 0)
    assert js.endswith("bench_19700101_000000.json") and "x\\|y" in open(md).read()
    assert sources.read_reports(spark, {"m": js, "n": js}).select("model").distinct().count() == 2


def test_answers(spark):
    hits = spark.createDataFrame([(1, 2, "b.cc", 3, 4, "g", "cpp", "y" * 5000), (1, 1, "a.cc", 1, 2, "f", None, "x")], "q int, rank int, file string, start_line int, end_line int, symbol string, language string, text string")
    asked = spark.createDataFrame([(1, "why"), (2, "none")], "q int, question string")
    made = answer.prompts(hits, asked)
    row = {r["q"]: r for r in made.collect()}
    user = row[1]["messages"][-1]["content"]
    assert user.index("### a.cc L1-2  (f)\n```\nx\n```") < user.index("### b.cc L3-4  (g)\n```cpp\ny") and user.count("y") - "why".count("y") == 2000
    assert row[1]["sources"] == "  a.cc  L1-2  f\n  b.cc  L3-4  g" and row[2]["sources"] == ""

    def model(messages):
        if "fail" in messages[-1]["content"]:
            raise RuntimeError("down")
        return "because"

    more = answer.prompts(hits.unionByName(hits.withColumn("q", F.lit(3))), asked.unionByName(spark.createDataFrame([(3, "fail")], "q int, question string")))
    got = {r["q"]: r for r in answer.answers(answer.generate(more, model)).collect()}
    assert got[1]["text"].startswith("because\n\nSources:\n  a.cc") and got[3]["failed"] and got[3]["text"].startswith("[generation unavailable] RuntimeError: down\n\nSources:\n  a.cc")
    assert got[2]["text"] == "No relevant chunks found." and not got[2]["failed"]


def test_streams(spark, tmp_path):
    chunk = lambda *rows: spark.createDataFrame([(i, "f", 1, 1, "s", "cpp", t) for i, t in rows], CHUNK)
    incoming, index, check = (str(tmp_path / x) for x in ("in", "index", "check"))
    chunk(("1", "GetHits"), ("2", "other")).write.json(incoming)
    stream_index.maintain(spark, incoming, index, check).awaitTermination()
    chunk(("3", "GetHits"), ("1", "changed text"), ("4", None)).write.mode("append").json(incoming)
    stream_index.maintain(spark, incoming, index, check).awaitTermination()
    got = {r["chunk_id"]: r for r in stream_index.live_points(spark, index).collect()}
    assert set(got) == {"1", "2", "3"} and len(got["3"]["vector"]) == 64 and got["1"]["batch"] == 1

    turns = str(tmp_path / "turns")
    schema = "conv bigint, turn bigint, fresh array<string>"
    spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, []), (1, 3, ["b", "c"]), (2, 1, ["z"])], schema).coalesce(1).write.json(turns)
    q = stream_sessions.carried(spark.readStream.schema(schema).json(turns), 2).writeStream.format("memory").queryName("carried").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r[0], r[1]): r[2] for r in spark.table("carried").collect()} == {(1, 1): ["a", "b"], (1, 2): ["a", "b"], (1, 3): ["a", "b"], (2, 1): ["z"]}


def test_session_state_stream(spark, tmp_path):
    folder, schema = str(tmp_path / "turns"), "conv bigint, turn bigint, question string, answer string, fresh array<string>"
    rows = [(1, 1, "q1", "a1", ["a", "b"]), (1, 2, "q2", None, ["x"]), (1, 3, "q3", "a3", ["b", "c"]), (1, 4, "q4", "a4", None), (2, 1, "p1", "b1", [])]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(folder)

    def run():
        s = stream_sessions.session_state(spark.readStream.schema(schema).json(folder), 3, 1)
        s.writeStream.foreachBatch(lambda b, n: got.update({(r[0], r[1]): tuple(r[2:]) for r in b.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    got = {}
    run()
    assert got == {(1, 1): (1, ["a", "b"], []), (1, 2): (1, ["a", "b", "x"], ["q1", "a1"]), (1, 3): (2, ["a", "b", "c"], ["q1", "a1"]), (1, 4): (3, ["a", "b", "c"], ["q3", "a3"]), (2, 1): (1, [], [])}
    spark.createDataFrame([(1, 5, "q5", "a5", ["d"])], schema).coalesce(1).write.mode("append").json(folder)
    run()
    assert got[1, 5] == (4, ["a", "b", "c"], ["q4", "a4"])


def test_monitor_stream(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    folder = tmp_path / "ev"
    folder.mkdir()
    os.symlink(f"{sf_dir}/events.parquet", folder / "events.parquet")
    s = stream_sessions.monitor(spark.readStream.schema(schema).parquet(str(folder)))
    q = s.writeStream.format("memory").queryName("monitor").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("monitor").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_levels(spark):
    import time

    def ask(q):
        if q == "slow":
            time.sleep(2)
        if q == "bad":
            raise ValueError("no")
        return "[generation unavailable: x]" if q == "down" else "fine"

    rows = loadtest.run_level(spark, ask, ["ok", "bad", "down", "slow"], 5, timeout=0.7).orderBy("idx").collect()
    assert [r["error_type"] for r in rows] == [None, "ValueError", "unavailable", "timeout", None] and rows[0]["answer_chars"] == 4
    assert loadtest.sample_device(("no-such-command",))[3] and loadtest.sample_device(("echo", "12, 34"))[1:] == (12, 34, None)
    loadtest.preflight(spark.range(1), "dense")
    with pytest.raises(RuntimeError):
        loadtest.preflight(spark.range(0), "dense")
