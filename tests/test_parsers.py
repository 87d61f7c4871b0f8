from corpusmill.parsers import fhicl, jsonnet
from corpusmill.parsers.chunkers import cpp_chunks, python_chunks
from corpusmill.parsers.languages import claimed

FCL = """#include "a.fcl"
BEGIN_PROLOG
standard_x:
{
  module_type: "X"
  sub: { a: 1 b: [1, 2.5e-3, {c: d}, @local::y.z[0],] }
  @table::other
}
END_PROLOG
scalar: 12.5  // tail
physics.producers.x @protect_ignore: @local::standard_x
v[0]: @erase
w: @nil
"""


def test_fhicl():
    assert fhicl.validate(FCL)
    assert [c["symbol"] for c in fhicl.definitions(FCL)] == ["standard_x", "scalar", "physics.producers.x", "v[0]", "w"]
    first = fhicl.definitions(FCL)[0]
    assert (first["start_line"], first["end_line"]) == (3, 8) and first["text"].startswith("standard_x:\n{") and first["text"].endswith("}")
    assert fhicl.definitions(FCL)[1]["text"] == "scalar: 12.5"
    for bad in ("a: ", "a: {", "a: [1 2]", "a = 1", "a: 1 }", "BEGIN_PROLOG\na: 1", "a: [1,,2]", 'a: "x'):
        assert not fhicl.validate(bad), bad
    assert fhicl.validate("# nothing {\n") and not fhicl.validate("# nothing\n", whole=False)
    assert fhicl.definitions("a: {") == []


JSONNET = """local lib = import 'lib.libsonnet';
local f(x, y=2) = x + y;
{
  a: { inner: 1, other:: [i * 2 for i in std.range(0, 3) if i != 1] },
  'q-r'+: { t: |||
    text }
  ||| },
  [lib.name]: if true then f(1) else null,
  m(x):: x { z: 1 },
  local hidden = 3,
  assert hidden > 2 : 'no',
}
"""


def test_jsonnet():
    assert jsonnet.validate(JSONNET)
    assert [c["symbol"] for c in jsonnet.definitions(JSONNET)] == ["lib", "f", "a", "'q-r'", "[lib.name]", "m"]
    assert jsonnet.validate("local f(x) = x;", False) and jsonnet.validate("a: { b: 1 }", False) and jsonnet.validate("// c\na:: 1,", False)
    assert jsonnet.validate("(import 'a') + (import 'b')") and jsonnet.validate("[1, 2,]") and jsonnet.validate("{ }")
    for bad in ("", "{ a: 1", "{ a: 1 b: 2 }", "local x = 1", "{ a 1 }", "[1 2]", "1 +", "#!/bin/bash\nset -e\nfor f in $(ls); do\n  echo 1\ndone\n", "{ a: 'x }"):
        assert not jsonnet.validate(bad), bad
    assert jsonnet.definitions("{a: 1} + {b: 2}") == []
    chunk = jsonnet.definitions("local a = 1;\n{\n  b: {\n    c: 1,\n  },\n}\n")[1]
    assert (chunk["symbol"], chunk["start_line"], chunk["end_line"]) == ("b", 3, 5)


def test_python_chunks():
    text = "def f():\n    return 1\n\n\nclass A:\n    @dec\n    async def m(self):\n        pass\n"
    got = [(c["symbol"], c["start_line"], c["end_line"]) for c in python_chunks(text)]
    assert got == [("f", 1, 2), ("A", 5, 8), ("m", 7, 8)]
    assert python_chunks("def f(:") == []


def test_cpp_chunks():
    text = "int top(int x) {\n  return x;\n}\nnamespace n {\nclass A : public B<int> {\n  A() : y(1) {}\n  int m();\n  int inl() { return 2; }\n};\n}\nint n::A::m() { if (y) { z(); } return 1; }\nclass Fwd;\nA::~A() {}\nbool operator==(A const& a, A const& b) { return true; }\nstruct S { int x; };\n"
    got = [c["symbol"] for c in cpp_chunks(text)]
    assert got == ["top", "A", "A", "n::A::m", "Fwd", "A::~A", "operator=="]
    assert "inl" in [c["symbol"] for c in cpp_chunks(text, inline_methods=True)]
    assert cpp_chunks(text)[0]["start_line"] == 1 and cpp_chunks(text)[0]["end_line"] == 3


def test_jsonnet_nests_as_deep_as_it_likes():
    for n in (170, 190, 20_000):
        assert jsonnet.validate("[" * n + "1" + "]" * n) and not jsonnet.validate("[" * n + "1" + "]" * (n - 1))
        assert jsonnet.validate("{ a: " * n + "1" + " }" * n) and jsonnet.validate("a: " + "{ a: " * n + "1" + " }" * n, False)
        flat = "".join(f"local v{k} = {k};\n" for k in range(n)) + "v0"
        assert jsonnet.validate(flat) and not jsonnet.validate(flat + ";") and len(jsonnet.definitions(flat)) == n
    assert jsonnet.validate("if a then 1 else " * 5000 + "2")


def test_jsonnet_bind_end():
    for text in ("local f(x) = x + 1", "local f(x) = local y = [x, {a: ';'}]; y + x", "local f(x) = |||\n  a; b\n|||"):
        assert jsonnet.bind_end(text + "; local other = 5; {a: 1}") == len(text) == jsonnet.bind_end(text)
    assert jsonnet.bind_end("local f(x) = ") is None and jsonnet.bind_end("f(x)") is None


def test_functions_that_return_references():
    text = "int& f() { return x; }\nstd::vector<int> const& A::g(int& y) { return z; }\nA& A::operator=(A const& o) { return *this; }\nint* h(int& y) { return p; }\nint k(int& y) { return y; }\n"
    assert [c["symbol"] for c in cpp_chunks(text)] == ["h", "k"]
    assert [c["symbol"] for c in cpp_chunks(text, strict_reference_names=False)] == ["f", "A::g", "A::operator=", "h", "k"]


def test_claimed_language():
    assert claimed("a/b.py") == "python" and claimed("a/b.tcc") == "cpp" and claimed(None) == "cpp"
