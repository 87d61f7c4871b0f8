import pytest

from corpusmill.llm import cpp, tables
from corpusmill.llm.grammars import validate_python, verdict
from corpusmill.parsers.languages import claimed

GOOD_CPP = [
    "",
    "// only a comment {",
    "#pragma once\n#include <vector>\n",
    "int f(int a, std::vector<std::pair<int, double>> const& b = {}) { return a < b.size() ? 1 : 2; }",
    "namespace a { class B : public C<int>, private D { public: B() : x(1), y{2} {} virtual ~B() = default; int operator()(int) const; private: int x, y; enum class E { k1 = 3, k2 }; }; }",
    "template <typename T, int N = 3> struct S { T data[N]; static constexpr int n = N; };",
    "auto g = [&](auto const& x) -> int { return x + 1; };",
    "void h() { for (auto& [k, v] : m) { v++; } do { --i; } while (i > 0); switch (x) { case 1: break; default: y(); } try { z(); } catch (std::exception const& e) { throw; } }",
    "#ifdef A\nint f() {\n#else\nint f(int) {\n#endif\n  return 1;\n}\n",
    "#if 0\n this is ) not code\n#endif\nint x;",
    'const char* s = R"x(a ) " b)x"; int y = 0x1F + 1\'000;',
    "constexpr int t[3] = {\n1, 2,\n-3,\n};",
    "DEFINE_ART_MODULE(Foo)\n",
    "std::unique_ptr<A> p = std::make_unique<A>(1, 2); using X = std::function<void(int, double)>;",
    "int A::f() const noexcept { return static_cast<int>(x) * (y - 1) >> 2; }",
    "void f() { if (a) b(); else if (c) { d(); } else e(); }",
    "extern \"C\" { int f(void); }",
    "struct P { int x : 3; P& operator=(P const&) = delete; friend std::ostream& operator<<(std::ostream& o, P const& p); };",
]
BAD_CPP = [
    "int f() { return 1;",
    "int f() { g(1, 2; }",
    "int f() {{ return 1; }",
    "int f() { return 1; }}",
    "<<<<<<< HEAD\nint x;\n=======\nint y;\n>>>>>>> b\n",
    "int f() {\n@@ -1,4 +1,6 @@\n+ int x;\n}",
    "import os\n\ndef f(x):\n    return x\n",
    "<html><body>not here</body></html>",
    "version https://x.invalid/spec/v1\noid sha256:aa\nsize 3\n",
    "#ifdef A\nint x;\n",
    "int f() { if (a > ) b(); }",
    "int f() { x = ; }",
    "class A { int x }",
    'int f() { s = "abc; }',
    "int f() { return 1 /* never closed ; }",
]


@pytest.mark.parametrize("text", GOOD_CPP)
def test_good_cpp(text):
    assert cpp.validate(text)


@pytest.mark.parametrize("text", BAD_CPP)
def test_bad_cpp(text):
    assert not cpp.validate(text)


def test_cpp_definition_rows():
    assert cpp.validate("class A : public B {\npublic:\n  int f();\n}", whole=False)
    assert not cpp.validate("class A {\n  int f();\n}", whole=True)
    assert cpp.validate("A() {}", whole=False)
    assert not cpp.validate("", whole=False)


def test_python_validator():
    assert validate_python("def f(self):\n        return 1\n", False)
    assert validate_python("# above\n    def f(self):\n        return 1\n", False)
    assert not validate_python("with open(x as fh:\n    pass\n")
    assert not validate_python("if x:\n<<<<<<< ours\n    y = 1\n=======\n    y = 2\n>>>>>>> theirs\n")
    assert validate_python("x = '\\d'\nreturn 3\n"), "only syntax counts"
    assert not validate_python("x = 1\0")


def test_fhicl_leaves_in_any_order():
    a = tables.fhicl_leaves("x: { a: 1 b: { c: [1, 2] d: {} } }")
    assert sorted(a) == sorted(tables.fhicl_leaves("x: { b: { d: {} c: [1, 2] } a: 1 }"))
    assert sorted(a) != sorted(tables.fhicl_leaves("x: { a: 1 b: { c: [2, 1] d: {} } }"))
    with pytest.raises(tables.TableError):
        tables.fhicl_leaves("x: 1")
    with pytest.raises(tables.TableError):
        tables.fhicl_leaves("x: { a: 1 } y: { }")


def test_verdicts():
    assert claimed("a/b.py") == "python" and claimed("a/b.tcc") == "cpp" and claimed(None) == "cpp"
    assert verdict("a.cc", "__WHOLE_FILE__", "def f(x):\n    return x\n") == (False, "python")
    assert verdict("a.py", "__WHOLE_FILE__", "}{") == (False, None)
    assert verdict("a.fcl", "__WHOLE_FILE__", None) == (True, None)
    assert verdict("a.jsonnet", "__WHOLE_FILE__", "")[0] is False
    assert verdict("a.cc", "f", " ")[0] is False


def test_every_branch_of_a_conditional_counts():
    group = "#if A\nint a;\n#elif B\nint {};\n#elif C\nint c;\n#endif\n"
    assert cpp.validate(group.format("b")) and not cpp.validate(group.format("b = (")) and not cpp.validate(group.replace("int c;", "int );").format("b"))
    assert cpp.validate("#if 0\n ) not code\n#elif A\nint a;\n#else\nint b;\n#endif\n") and not cpp.validate("#if 0\n ) not code\n#elif A\nint a;\n#else\nint ;;(\n#endif\n")
    assert cpp.validate("#ifdef A\nint f() {\n#else\nint f(int) {\n#endif\n  return 1;\n}\n")


@pytest.mark.parametrize("n", [240, 260, 5000])
def test_cpp_nests_as_deep_as_it_likes(n):
    assert cpp.validate("void f() {" + "if (a) {" * n + "b();" + "}" * n + "}") and not cpp.validate("void f() {" + "if (a) {" * n + "b();" + "}" * (n - 1) + "}")
    assert cpp.validate("int x = " + "(" * n + "1" + ")" * n + ";") and not cpp.validate("int x = " + "(" * n + "1" + ")" * (n - 1) + ";")
    assert cpp.validate("int t[] = " + "{" * n + "1" + "}" * n + ";")


def test_table_leaves():
    n = 5000
    deep = tables.table_leaves("t: " + "{ a: " * n + "1" + " }" * n, "x.jsonnet")
    assert deep and len(deep) == n + 1 and deep == tables.table_leaves("t: " + "{ a: " * n + "1" + " }" * n, "x.fcl")
    assert tables.table_leaves("t: { a: 1 }", "x.cc") is None and tables.table_leaves("t: { a: 1 } # no", "x.fcl") is None and tables.table_leaves("t: {", "x.fcl") is None
    assert tables.table_leaves("t: { b: [1, 2], a: 1 },", "x.jsonnet")[0] == ("t", "{")
