import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import formatting, layout, leaks, packing, pairs, pii, queries, split, syntax
from tests.oracle import same

CHUNKS = "id string, file string, start_line int, end_line int, symbol string, language string, text string"


def chunks(spark, rows):
    """(id, file, symbol, text) rows, with lines, and columns of clashing names."""
    df = spark.createDataFrame([(i, f, 1, (t or "").count("\n") + 1, s, None, t) for i, f, s, t in rows], CHUNKS)
    return df.withColumns({c: F.lit("extra") for c in ("valid", "key", "group", "record", "kind", "n_rows", "shape", "digest")})


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({c: F.lit("extra") for c in ("key", "digest", "start", "kind", "size", "part", "n_tokens", "item_id")})


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf_dir, name):
    same(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, sf_dir, name):
    rows = queries.queries()[name](spark, sf_dir)
    assert rows.count() > 0 or name in ("p5_pieces", "p8_found", "p8_items")  # the smallest tables have no such case
    if name.endswith("_found"):
        assert rows.count() == rows.distinct().count()


def test_columns(spark, sf_dir):
    q = queries.queries()
    want = {"p2_found": ["file"], "p3_found": ["file"], "p4_found": ["first_id", "other_id"], "p5_found": ["id"], "p6_found": ["id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "kind", "found"]}
    assert {k: q[k](spark, sf_dir).columns for k in want} == want


def test_empty_tables(spark):
    c, d, i = chunks(spark, []), documents(spark, []), spark.createDataFrame([], "item_id bigint, text string")
    assert syntax.invalid_files(c).count() == 0 and layout.machine_files(c).count() == 0 and formatting.copies(c).count() == 0
    assert split.pieces(c).count() == 0 and pairs.pairs(c).count() == 0
    assert packing.packed(d).count() == 0 and leaks.leaked(d, i).count() == 0 and pii.found_values(d).count() == 0 and pii.masked(d).count() == 0


# ------------------------------------------------------------------ p2, p3


def test_syntax_by_file_and_rates(spark):
    rows = [
        ("1", "r/a.py", "f", "def f():\n    return 1\n"), ("2", "r/a.py", "g", "def g(:\n"), ("3", "r/b.cc", "__WHOLE_FILE__", "import os\n\ndef f(x):\n    return x\n"),
        ("4", "r/c.fcl", "__WHOLE_FILE__", None), ("5", "q/d.jsonnet", "a", "a: { b: 1 }"), ("5", "q/d.jsonnet", "a", "a: { b: 1 }"), ("6", None, "x", "}{"), ("7", "q/e.h", None, "int x"),
        ("8", "q/f.py", "__WHOLE_FILE__", "x = 1\n" * 20_000),
    ]
    c = chunks(spark, rows)
    assert {r[0] for r in syntax.invalid_files(c).collect()} == {"r/a.py", "r/b.cc", "q/e.h"}
    state = {r["file"]: (r["state"], r["parses_as"]) for r in syntax.checked_files(c).collect()}
    assert state["r/b.cc"] == ("wrong_extension", "python") and state["r/a.py"] == ("corrupt", None) and state["r/c.fcl"][0] == "valid"
    rates = {(r["repo"], r["language"]): (r["files"], r["invalid_files"], r["invalid_rate"]) for r in syntax.invalid_rates(c).collect()}
    assert rates["r", "python"] == (1, 1, 1.0) and rates["q", "jsonnet"] == (1, 0, 0.0)


def test_layout_kinds(spark):
    rng = random.Random(1)
    numbers = "const float t[90] = {\n" + "\n".join(", ".join(f"{rng.random():.4f}f" for _ in range(10)) + "," for _ in range(9)) + "\n};\n"
    hand = "int f(int a) {\n  // a table {1, 2, 3} is printed\n  log(\"// Generated by x 1.0. DO NOT EDIT.\");\n  return a + 12;\n}\n"
    rows = [
        ("1", "r/gen.cc", "f", "// Generated by tool 1.2 on 2020-01-01. DO NOT EDIT.\n\n" + hand), ("2", "r/hand.cc", "f", hand), ("3", "r/lib.cc", "f", "// Imported unchanged from nanolib 1.2.3; report bugs upstream\n\n" + hand),
        ("4", "r/vendor/x/y.cc", "f", hand), ("5", "r/data.cc", "__WHOLE_FILE__", numbers), ("6", "r/own.cc", "f", "// Copyright (c) 2020 the project developers. See LICENSE at the top of this repository.\n\n" + hand),
        ("7", "r/not.cc", "f", "// Written by hand; edit freely. The mask list is not generated any more.\n" + hand), ("8", "r/works.cc", "f", "// Works on generated hits, as they come from the hit generator.\n" + hand),
        ("9", "r/dict.py", "__WHOLE_FILE__", "from rt import d\n" + "".join(f"X_RUN_{k:03} = d({k}, 'run_{k:03}', {8 * k})\n" for k in range(30))),
        ("10", "r/min.cc", "__WHOLE_FILE__", "namespace q{" + "".join(f"double f{k}(double v){{double z={k}.5*v;for(int i=0;i<8;++i){{z+=2.5;}}return z;}}" for k in range(12)) + "}\n"),
        ("11", "r/blob.py", "__WHOLE_FILE__", "B = (\n" + "".join("    '" + "".join(rng.choice("ABCDefgh0123456789xyzXYZ+/") for _ in range(76)) + "'\n" for _ in range(6)) + ")\n"),
        ("12", "r/text.cc", "help", "std::string help()\n{\n  return \"" + "hit wire track " * 200 + "\";\n}\n"), ("13", "r/bad.cc", "__WHOLE_FILE__", "// @generated x\nint f( {"), ("14", None, "f", "// @generated x\nint f() {}"),
        ("15", "r/hand.cc", "g", None), ("16", "r/rule.cc", "f", "//" + "=" * 5000 + "\n" + hand), ("17", "r/vendor_id.cc", "f", hand),
    ]
    got = {r["file"]: r["kind"] for r in layout.machine_files(chunks(spark, rows + rows)).collect()}
    assert got == {
        "r/gen.cc": "generated", "r/lib.cc": "vendored", "r/vendor/x/y.cc": "vendored", "r/data.cc": "data", "r/dict.py": "generated", "r/min.cc": "minified", "r/blob.py": "data",
    }


def test_origin_by_header_slots(spark):
    """No marker and no known folder: only the places that ever other names fill tell."""
    rng = random.Random(5)
    hand = lambda k: f"int f{k}(int a) {{\n  return a + {k};\n}}\nint stage(int wire) {{ return slice(wire); }}\n"
    tools, libraries = [f"mk{x}" for x in ("alpha", "beta", "gamma", "delta")], [f"tiny{x}" for x in ("one", "two", "three", "four")]
    rows, want = [], set()

    def add(file, text, found):
        rows.append((str(len(rows)), file, "f", text))
        if found:
            want.add(file)

    for k in range(40):
        add(f"r/src/own{k}.cc", f"// Tools of the {rng.choice(['wire', 'stage', 'slice'])} group, kept here.\n" + hand(k), False)
    for k in range(12):
        add(f"r/src/g{k}_pb2.cc", f"// Spun out of frames.xml with {tools[k % 4]}, kept here.\n" + hand(k), True)
        add(f"q/odd/{libraries[k % 4]}/l{k}.cc", (f"// Release 1.{k} of {libraries[k % 4]} as it is.\n" if k < 8 else "") + hand(k), True)
    for k in range(6):
        add(f"r/src/n{k}_pb2.cc", "// MADE ELSEWHERE, AND LOST at the next build.\n" + hand(k), True)
        add(f"r/src/u{k}_pb2.cc", hand(k), False)
    add("r/src/n.cc", "// MADE ELSEWHERE, AND LOST at the next build.\n" + hand(1), True)
    add("q/odd/unnamed/x.cc", hand(2), True)  # beside folders with foreign names
    add("r/src/mentions.cc", hand(3) + f"// not made by {tools[0]}\n", False)
    got = {r["file"]: (r["kind"], r["by"]) for r in layout.machine_files(chunks(spark, rows)).collect()}
    assert set(got) == want
    assert got["r/src/g1_pb2.cc"] == ("generated", "slot") and got["q/odd/tinytwo/l1.cc"] == ("vendored", "folder") and got["r/src/n.cc"] == ("generated", "opening")


def test_shape_of_all_rows_decides(spark):
    # the commonest shape of the file is second in one of its rows
    line, other = (lambda k: f"X_RUN_{k:03} = d({k}, 'r')\n"), (lambda k: f"other_value({k})\n")
    rows = [("1", "r/a.py", "__WHOLE_FILE__", "".join(map(line, range(40)))), ("2", "r/a.py", "b", "".join(map(other, range(5))) + "".join(map(line, range(4))))]
    rows += [("3", "r/b.py", "__WHOLE_FILE__", "".join(map(line, range(40)))), ("4", "r/b.py", "b", "".join(map(other, range(9))))]
    got = {r["file"]: r["kind"] for r in layout.machine_files(chunks(spark, rows)).collect()}
    assert got == {"r/a.py": "generated"}


# ------------------------------------------------------------------ p4


def test_formatting(spark):
    rows = [
        ("a", "x.cc", "f", "int f( int a )\n{ return a; }"), ("b", "y.cc", "f", "INT F(int a){return a;}"), ("b", "y.cc", "f", "INT F(int a){return a;}"), ("c", "z.cc", "f", "int f(int b){return b;}"),
        ("t1", "x.fcl", "t", "t: { a: 1 b: { c: 'q' d: [1, 2] } }"), ("t2", "y.jsonnet", "t", 't: { b: { d: [1,2], c: "Q" }, a: 1 },'), ("t3", "y.fcl", "t", "t: { a: 1 b: { c: q d: [2, 1] } }"),
        ("t4", "y.fcl", "t", "t: { b: 1 a: { c: q d: [1, 2] } }"), ("t5", "z.fcl", "t", "# note\nt: { b: { c: q d: [1, 2] } a: 1 }"),
        ("m1", "x.py", "f", "μ-scale Straße ΑΣ"), ("m2", "x.py", "f", "Μ SCALE STRAẞE, ας"), ("m3", "x.py", "f", "µ-scale Straße ασ"), ("m4", "x.py", "f", "μ-scale Strasse ασ"), ("e1", "x.py", "f", ""), ("e2", "x.py", "f", " -- "), ("n", "x.py", "f", None), (None, "x.py", "f", "int f( int a )\n{ return a; }"),
    ]
    got = {tuple(r) for r in formatting.copies(chunks(spark, rows)).collect()}
    assert got == {("a", "b"), ("t1", "t2"), ("m1", "m2"), ("e1", "e2")}
    sizes = {r["first_id"]: (r["n_ids"], r["n_rows"]) for r in formatting.records(chunks(spark, rows)).collect()}
    assert sizes["a"] == (2, 3) and sizes["t1"] == (2, 2) and sizes["c"] == (1, 1)


def test_formatting_chain(spark):
    # equal letters with different structure are one group with each one's reorderings
    rows = [("1", "a.fcl", "t", "t: { a: { b: 1 } c: 2 }"), ("2", "a.fcl", "t", "t: { a: { b: 1 c: 2 } }"), ("3", "a.fcl", "t", "t: { c: 2 a: { b: 1 } }"), ("4", "a.fcl", "t", "t: { a: { c: 2 b: 1 } }")]
    assert {tuple(r) for r in formatting.copies(chunks(spark, rows)).collect()} == {("1", "2"), ("1", "3"), ("1", "4")}


def test_formatting_hot_group(spark, monkeypatch):
    from corpusmill.operators import skew

    monkeypatch.setattr(skew, "HOT", 20)
    rows = [(f"h{k:03}", "a.cc", "f", "int  f" + " " * k) for k in range(90)] + [(f"x{k:03}", "a.cc", "f", f"int g{k // 2}") for k in range(180)]
    got = {tuple(r) for r in formatting.copies(chunks(spark, rows)).collect()}
    assert got == {("h000", f"h{k:03}") for k in range(1, 90)} | {(f"x{k:03}", f"x{k + 1:03}") for k in range(0, 180, 2)}


def test_formatting_against_brute_force(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/chunks.parquet")
    groups = defaultdict(set)
    for r in c.where("id is not null and text is not null").select("id", "text").collect():
        groups[re.sub(r"[\W_]+", "", r["text"].lower())].add(r["id"])
    got = {frozenset(x) for x in map(tuple, formatting.copies(c).collect())}
    member = {}
    for r in formatting.copies(c).collect():
        member[r["other_id"]] = r["first_id"]
    for ids in groups.values():
        assert len({member.get(i, i) for i in ids}) == 1
    assert got


# ------------------------------------------------------------------ p5


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .\n;{}é\r\t界"), max_size=400), st.integers(2, 60), st.integers(0, 59))
def test_cuts(text, limit, overlap):
    overlap %= limit
    spans = split.cuts(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    whole, reached = text[: spans[0][1]], spans[0][1]
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and b - c <= overlap and d - c <= limit
        whole += text[reached:d]
        reached = d
    assert whole == text and all(b - a <= limit for a, b in spans)


def test_pieces(spark):
    text = "\n".join(f"line {k} of the text;" for k in range(900))
    rows = [("a", "f.cc", "s", text), ("b", "f.cc", "s", "x" * 6000), ("c", "f.cc", "s", "é" * 6001), ("d", "f.cc", "s", None), ("e", "f.cc", None, "")]
    c = chunks(spark, rows).withColumn("start_line", F.when(F.col("id") == "a", 11))
    got = split.pieces(c).orderBy("id", "piece").collect()
    mine = [r for r in got if r["id"] == "a"]
    assert mine[0]["start_line"] == 11 and mine[-1]["end_line"] == 11 + text.count("\n") and {r["symbol"] for r in mine} == {"s"}
    for r in mine:
        assert r["text"] == text[r["char_start"] : r["char_end"]] and r["start_line"] == 11 + text.count("\n", 0, r["char_start"])
        assert r["end_line"] == r["start_line"] + r["text"][:-1].count("\n") and len(r["text"]) <= 6000
    assert all(r["text"].endswith("\n") for r in mine[:-1])
    assert {r[0] for r in split.oversized_ids(c).collect()} == {"a", "c"}
    assert split.pieces(c, only_oversized=False).where("id = 'b'").count() == 1


# ------------------------------------------------------------------ p6

DOC = "Walks every hit of the wire and keeps those above nine ticks"


@pytest.mark.parametrize(
    ("file", "symbol", "text", "want"),
    [
        ("a.cc", "A::f", f"// {DOC}\nint A::f(int x) const {{ return x; }}", True),
        ("a.cc", "A::f", f"/**\n * @brief {DOC}\n * @param x the x\n */\nint A::f(int x)\n{{\n  if (x) {{ }}\n  return '}}';\n}}", True),
        ("a.cc", "A::f", f"// {DOC}\n\nint A::f(int x) {{ return x; }}", False),
        ("a.cc", "A::f", f"int A::f(int x) {{\n  // {DOC}\n  return x; }}", False),
        ("a.cc", "A", f"// {DOC}\nclass A {{ int f(); }}", False),
        ("a.cc", "f", f"// {DOC}\nint f[3] = {{ 1, 2, 3 }};", False),
        ("a.cc", "f", "// TODO: document what this function does some day soon\nint f() { }", False),
        ("a.cc", "f", "// ---------- helpers of the module ----------\n// x = compute(y, z);\nint f() { }", False),
        ("a.cc", "mergeHitTrack", "// merge hit track the merge of hit track\nint mergeHitTrack() { }", False),
        ("a.cc", "f", "// Copyright (c) 2022 the long list of all developers of this project\nint f() { }", False),
        ("a.cc", "f", f"// Copyright (c) 2022 somebody\n\n// {DOC}\nint f() {{ }}", True),
        ("a.cc", "f", "/// clusterFlash = stripTrack * 55.149 + other;\n/// if (a > b) return c(d, e);\nint f() { }", False),
        ("a.cc", "f", "/// @param alpha beta\n/// @return gamma delta\nint f() { }", False),
        ("a.py", "f", f'def f(x):\n    """{DOC}"""\n    return x\n', True),
        ("a.py", "f", f"# {DOC}\nasync def f(x, y={{1: 2}}):\n    return x\n", True),
        ("a.py", "f", f"def f(x):\n    s = 1\n    '''{DOC}'''\n", False),
        ("a.py", "A", f'class A:\n    """{DOC}"""\n', False),
        ("a.py", "f", 'def f(x):\n    """TODO: document"""\n', False),
        ("a.jsonnet", "f", f"// {DOC}\nlocal f(x) = x + 1;", True),
        ("a.jsonnet", "f", f"// {DOC}\nlocal f = 1;", False),
        ("a.jsonnet", "f", f"// {DOC}\nf: {{ a: 1 }}", False),
        ("a.fcl", "f", f"# {DOC}\nf: {{ a: 1 }}", False),
        ("a.cc", "__WHOLE_FILE__", f"// {DOC}\nint f() {{ }}", False),
        ("a.cc", "f", f"// {DOC}\r\nint f() {{ }}\r\n", True),
        ("a.cc", "f", None, False),
        (None, "f", "", False),
        ("a.cc", None, f"// {DOC}\nint f() {{ }}", False),
    ],
)
def test_documented(file, symbol, text, want):
    found = pairs.extract(file, symbol, text)
    assert bool(found and found[1] and pairs.useful(found[1], symbol)) is want


def test_pairs(spark):
    rows = [("1", "a.cc", "f", f"// {DOC}\nint f() {{ }}"), ("1", "a.cc", "f", f"// {DOC}\nint f() {{ }}"), ("2", "a.cc", "g", "int g() { }"), (None, "a.cc", "f", f"// {DOC}\nint f() {{ }}"), ("3", "a.cc", None, None)]
    got = pairs.pairs(chunks(spark, rows)).collect()
    assert [(r["id"], r["code"], r["description"]) for r in got] == [("1", "int f() { }", DOC)]
    assert pairs.extract("a.cc", "f", "// " + "x" * 200_000 + "\nint f() { }")[0] == "int f() { }"


@pytest.mark.parametrize(
    ("file", "code", "rest"),
    [
        ("a.jsonnet", "local f(x) = x + 1;", " local other = 5; {a: 1}"),
        ("a.jsonnet", "local f(x) = local y = [x, ';']; y + x;", "\nlocal g(x) = x;"),
        ("a.py", "def f(x):\n    if x:\n        return '''\nZ\n'''\n    return 2", "\n\nZ = 3\nprint(Z)\n"),
        ("a.py", "def f(self):\n            return 1", "\n        # next\n    def g(self):\n        pass\n"),
        ("a.py", "@dec(1)\nasync def f(x): return (1,\n 2)", "\nZ = 3\n"),
        ("a.py", "def f(x):\n    return [1,\n", ""),
        ("a.cc", "A::A(int x) : B{x}, c{1}, d(2)\n{\n  e();\n}", "\nint other() { return 1; }"),
        ("a.cc", "int f(int x) {\n  return '}';\n}", ";\n// end"),
        ("a.cc", "int f(int x) {\n  return (x;", ""),
    ],
)
def test_code_ends_with_the_function(file, code, rest):
    mark = "#" if file.endswith(".py") else "//"
    assert pairs.extract(file, "f", f"{mark} {DOC}\n{code}{rest}") == (code, f"{mark} {DOC}")


def test_python_code_against_the_parser(spark, sf_dir):
    import ast
    import textwrap

    checked = 0
    for r in pairs.pairs(spark.read.parquet(f"{sf_dir}/chunks.parquet")).where("language = 'python'").collect():
        try:
            tree = ast.parse(textwrap.dedent(r["code"]))
        except SyntaxError:
            continue
        assert len(tree.body) == 1 and isinstance(tree.body[0], (ast.FunctionDef, ast.AsyncFunctionDef))
        checked += 1
    assert checked


# ------------------------------------------------------------------ p7


def check_plan(histogram, capacity):
    solution = packing.plan(dict(histogram), capacity)
    used = Counter()
    for pattern, n, _ in solution:
        assert sum(s * c for s, c in pattern.items()) <= capacity
        for s, c in pattern.items():
            used[s] += c * n
    assert used == Counter({s: n for s, n in histogram.items() if n})
    return sum(n for _, n, _ in solution)


def test_plan_is_exact_and_tight():
    rng = random.Random(2)
    for capacity in (50, 200):
        for n in (0, 1, 30, 20_000):
            histogram = Counter(min(capacity, 1 + int(rng.expovariate(1 / 30))) for _ in range(n))
            bins = check_plan(histogram, capacity)
            least = -(-sum(s * c for s, c in histogram.items()) // capacity)
            assert bins <= 1.03 * least + 2
    # items just over a third: two to a container is the best there is
    assert check_plan({34: 30_000}, 100) == 15_000
    with pytest.raises(ValueError):
        packing.plan({101: 1}, 100)


@pytest.mark.parametrize("n", [60, 1_000, 8_000, 10_000, 60_000])
def test_linear_program_at_every_size(monkeypatch, n):
    calls = []
    real = packing._weights
    monkeypatch.setattr(packing, "_weights", lambda *a: calls.append(1) or real(*a))
    rng = random.Random(n)
    histogram = Counter(min(500, 1 + int(rng.lognormvariate(3.5, 1))) for _ in range(n))
    bins = check_plan(histogram, 500)
    least = -(-sum(s * c for s, c in histogram.items()) // 500)
    solution = packing.plan(dict(histogram), 500)
    planned = sum(p.containers * sum(s * c for s, c in p.pattern.items()) for p in solution if p.by_program)
    assert calls and bins <= 1.005 * least + 1
    # by tokens nearly everything comes from the program
    assert planned >= (0.9 if n > 100 else 0.5) * sum(s * c for s, c in histogram.items())


def test_stretches_change_no_count(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["hit", " ", "  ", "\n", "\n\n", "\t", "'s", "42", "-- ", "é", "\u3000", "_x"]) for _ in range(400)) for _ in range(30)] + ["x" * 900, " " * 900]
    count = packing._tokenizer(packing.TOKENIZER)
    whole = [count(t) for t in texts]
    monkeypatch.setattr(packing, "STRETCH", 40)
    assert [count(t) for t in texts] == whole and max(len(list(packing._stretches(t))) for t in texts) > 5


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ITEMS", 7)
    d = documents(spark, [(k, "hit wire track noise " * (1 + k % 3)) for k in range(120)] + [(500, "hit wire " * 900)])
    got = packing.packed(d, 64).collect()
    fill, seen = Counter(), Counter((r["doc_id"], r["piece"]) for r in got)
    for r in got:
        fill[r["container"]] += r["n_tokens"]
    assert max(fill.values()) <= 64 and set(fill) == set(range(len(fill))) and max(seen.values()) == 1
    assert {r["doc_id"] for r in got} == {*range(120), 500}


def test_packed(spark):
    word = "hit wire track noise "
    rows = [(k, word * (k % 17)) for k in range(300)] + [(300, word * 400), (301, ""), (302, None), (5, word * 5)]
    d = documents(spark, rows)
    counts = Counter()
    for r in packing.token_counts(d).collect():
        counts[r["doc_id"]] += r["n_tokens"]
    placed = packing.packed(d, 128)
    got = placed.collect()
    fill = Counter()
    for r in got:
        fill[r["container"]] += r["n_tokens"]
    assert max(fill.values()) <= 128 and set(fill) == set(range(len(fill)))
    per = Counter()
    for r in got:
        per[r["doc_id"]] += r["n_tokens"]
    assert per == Counter({k: n for k, n in counts.items() if n})
    assert all(r["n_tokens"] == 128 for r in got if r["doc_id"] == 300 and r["token_start"] + 128 <= counts[300])
    assert {r["doc_id"] for r in got if r["piece"] > 0} == {300}
    assert packing.fill_report(placed, 128).first()["fill"] > 0.95


# ------------------------------------------------------------------ p8


def brute_leaks(docs, items):
    seen = Counter(s for _, t in items for s in {" ".join(x) for x in leaks.sentences(t)})
    out = set()
    for k, t in items:
        body = [w for s in leaks.sentences(t) if seen[" ".join(s)] < leaks.STOCK for w in s]
        runs = {tuple(body[j : j + leaks.RUN]) for j in range(len(body) - leaks.RUN + 1)}
        for d, text in docs:
            w = leaks.words(text)
            if any(tuple(w[j : j + leaks.RUN]) in runs for j in range(len(w))):
                out.add((d, k))
            elif body and any(sum(a != b for a, b in zip(body, w[j:])) <= len(body) // leaks.EXCHANGED for j in range(len(w) - len(body) + 1)):
                out.add((d, k))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(25)]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    stock = " Use only the indexed sources and cite at least one line range for every single claim you make."
    items = [(k, item(rng.choice([3, 5, 8, 12, 20, 40])) + "." + (stock if k % 2 else "")) for k in range(30)]
    docs = []
    for k in range(150):
        text = item(rng.randrange(0, 40))
        if k % 3:
            body = items[rng.randrange(30)][1].split()
            if k % 3 == 1:
                a = rng.randrange(len(body))
                body = body[a : a + rng.randrange(1, 25)]
            body = [rng.choice(["zzz", w]) if rng.random() < 0.15 else w.upper() for w in body]
            text += "\n> " + " ".join(body).replace(" ", rng.choice([" ", "\n> ", ", "])) + " " + item(5)
        docs.append((k, text))
    docs += [(900, stock), (901, ""), (902, None), (0, docs[0][1])]
    got = {tuple(r) for r in leaks.leaked(documents(spark, docs), spark.createDataFrame(items + items[:3] + [(99, None), (98, "")], "item_id bigint, text string")).collect()}
    assert got == brute_leaks([d for d in docs if d[1]], items)
    assert got and not any(d == 900 for d, _ in got)


def test_leaks_in_blocks(spark, monkeypatch):
    items = [(k, " ".join(f"q{k}x{j}" for j in range(20))) for k in range(12)]
    docs = [(k, "before " + items[k % 12][1] + " after") for k in range(24)]
    i = spark.createDataFrame(items, "item_id bigint, text string")
    whole = {tuple(r) for r in leaks.leaked(documents(spark, docs), i).collect()}
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 300)
    assert {tuple(r) for r in leaks.leaked(documents(spark, docs), i).collect()} == whole == {(k, k % 12) for k in range(24)}


def test_stock_sentences_in_blocks(spark, monkeypatch):
    # a stock sentence in the middle of each item, and every item whole with one word in ten exchanged
    part = lambda k, c: " ".join(f"q{k}{c}{j}" for j in range(10))
    items = [(k, f"{part(k, 'a')}. Give your answer as one number. {part(k, 'b')}.") for k in range(6)]
    docs = [(k, t.replace(f"q{k}a5", "other").replace(f"q{k}b5", "other")) for k, t in items]
    i = spark.createDataFrame(items, "item_id bigint, text string")
    whole = {tuple(r) for r in leaks.leaked(documents(spark, docs), i).collect()}
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 300)
    assert {tuple(r) for r in leaks.leaked(documents(spark, docs), i).collect()} == whole == {(k, k) for k in range(6)}


def test_leak_spans_are_removed(spark):
    item = " ".join(f"q{k}" for k in range(30))
    short = "alpha beta gamma delta epsilon zeta"
    items = spark.createDataFrame([(1, item), (2, short)], "item_id bigint, text string")
    shown = "\n> ".join([" ".join(item.upper().split()[4:12]), " ".join(item.split()[12:24])])
    docs = [(1, f"Before it, all is kept.\n> {shown}. After it too, all of it is kept as it was, word for word."), (2, f"- {item}\n- end"), (3, "nothing (of this) here"), (4, None), (5, ""), (3, "nothing (of this) here"), (6, f"so; {short.replace('gamma', 'other')}! and more of the words that stay here")]
    got = {}
    for r in leaks.cleaned(documents(spark, docs), items).collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["n_spans"], r["kept"]))
    assert got[1] == [("Before it, all is kept.\n>  After it too, all of it is kept as it was, word for word.", 1, False)]
    assert got[2][0][2] is False and "q5" not in got[2][0][0]
    assert got[3] == [("nothing (of this) here", 0, True)] * 2 and got[4] == [(None, 0, True)] and got[5] == [("", 0, True)]
    assert got[6] == [("so;  and more of the words that stay here", 1, True)]


def test_places_are_those_of_the_words():
    rng = random.Random(11)
    for _ in range(200):
        text = "".join(rng.choice(["hit", "İx", "ß", " ", "\n", "\r\n", "> ", "- ", "--", ".", "é_", "\x1c", "\u3000", "(a)"]) for _ in range(30))
        pieces = [text[a:b] for a, b in leaks.places(text)]
        assert [re.sub(r"[\W_]+", "", p.casefold()) for p in pieces] == leaks.words(text)


# ------------------------------------------------------------------ p9

GIVEN = "Greta Milan Oskar Elif Noor Tariq Hana Viktor".split()
FAMILY = "Zellitsch Dravumbra Haskmere Corbistad Fennosk Wexavel".split()


def pii_documents():
    rng = random.Random(3)
    name = lambda: f"{rng.choice(GIVEN)} {rng.choice(FAMILY)}"
    rows, want = [], set()

    def add(template, kind, value):
        k = len(rows)
        rows.append((k, template.format(value) + " The hit is lost."))
        want.add((k, kind, value))

    for _ in range(30):
        add("We met Dr. {} yesterday.", "name", name())
        add("Reported by {} during the shift.", "name", name())
        add("Dr. {} said so.", "name", name().upper())
        add("Call me at {}, please.", "phone", f"+1 555 555 {rng.randrange(1000, 9999)}")
        add("The desk is at extension desk {} today.", "phone", f"+44 20 7946 {rng.randrange(1000, 9999)}")
        add("The desk is at extension desk {} today.", "phone", f"020 7946 {rng.randrange(1000, 9999)}")
        add("passport no. {} was seen.", "id_number", f"{rng.randrange(900, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}")
    for k in range(10):
        add("Thanks, {}, for that.", "name", f"{FAMILY[k % 6]}, {GIVEN[k % 8]}")
    add("Write to {}.", "email", "a.b+lists@uni-karl.example")
    add("Write to {} now.", "email", "a.b (at) uni-karl [dot] example")
    add("Ship it to {}.", "address", "433 Old Cannery Drive\nSundvik, QX 41542")
    add("Ship it to {}, please.", "address", "73 rue des Corbelles, 64918 Keldby")
    add("Ship it to {}, please.", "address", "Ziegelstraße 61, 87783 Quillport")
    clean = ["git clone git@code.invalid:a/b.git", "shifter@daq:~$ run", "run 932-88-5590 has a problem", "event 5557994717 in subrun 210 crashed", "Channel 144 East Crate, slot 8, pin 73911 is dead.", "The Kalman Filter and the Hough Transform agree.", "# Clean Lifetime\n\ntext", "@local::tower_grid", "v1.2.3 at 10.5281.1234"]
    return rows + [(10_000 + k, t) for k, t in enumerate(clean * 3)] + [(20_000, None), (20_001, "")], want


def test_personal_data(spark):
    rows, want = pii_documents()
    got = {tuple(r) for r in pii.found_values(documents(spark, rows)).collect()}
    assert got == want


def test_patterns_find_what_no_form_or_label_tells(spark):
    rows, want = [], set()

    def add(template, kind, value, found=True):
        rows.append((len(rows), template.format(value)))
        if found:
            want.add((len(rows) - 1, kind, value))

    for k in range(20):
        add("Please write to {} today.", "email", f"who{k}@lab.example")
        add("The parcel goes over to {} by noon.", "address", f"{k + 1} Old Cannery Drive, Sundvik, QX 4154{k % 10}")
        add("We met Dr. {} there.", "name", f"Greta Wexavel{chr(97 + k)}")
        add("Call me at {} now.", "phone", f"+1 555 555 {1000 + k}")
    # disguised or of a form without a street's word, in these contexts
    add("Please write to {} today.", "email", "who at lab dot example")
    add("The parcel goes over to {} by noon.", "address", "12 Greenmere, Sundvik 41549")
    add("It was slot {} then.", "address", "12 Greenmere, Sundvik 41549", False)
    # words of the calendar as names, behind a title; elsewhere they are none
    add("We met Dr. {} there.", "name", "April Wexford")
    add("We met on {} there.", "name", "Monday Kalman", False)
    # numbers of few and of many digits behind a label
    add("Call me at {} now.", "phone", "12 34 56")
    add("passport no. {} was seen.", "id_number", "123456-123456-123456-123456")
    add("The run {} is bad.", "phone", "12 34 56", False)
    got = {tuple(r) for r in pii.found_values(documents(spark, rows)).collect()}
    assert got == want


def test_pattern_graph_without_broadcasts(spark, monkeypatch):
    from corpusmill.operators import skew

    rows, want = pii_documents()
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(skew, "HOT", 3)
    assert {tuple(r) for r in pii.found_values(documents(spark, rows)).collect()} == want


def test_masking_keeps_the_rest(spark):
    rows, want = pii_documents()
    d = documents(spark, rows)
    masked = {r["doc_id"]: r["text"] for r in pii.masked(d).collect()}
    assert len(masked) == len(rows)
    by_doc = {k: (kind, v) for k, kind, v in want}
    for k, text in rows:
        assert masked[k] == (text.replace(by_doc[k][1], f"[{by_doc[k][0].upper()}]", 1) if k in by_doc else text)
