"""Jsonnet: a full expression parser used for validation and chunks."""

from __future__ import annotations

import re

from corpusmill.parsers.depth import deep

_BLOCK = re.compile(r"\|\|\|-?[ \t]*\r?\n(?:[ \t]*\r?\n)*([ \t]+)[^\n]*\n(?:(?:\1[^\n]*|[ \t\r]*)\n)*[ \t]*\|\|\|")
_TOKEN = re.compile(
    r"""[\s﻿]*(?:(?:(?:\#|//)[^\n]*|/\*.*?\*/)[\s]*)*
    ("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|@"(?:[^"]|"")*"|@'(?:[^']|'')*'
    |\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?
    |[A-Za-z_]\w*
    |:::|::|\+:::|\+::|\+:|\.\.\.|&&|\|\||==|!=|<=|>=|<<|>>
    |[-{}\[\](),.;:$+*/%&|^!~<>=]|.|$)""",
    re.X | re.A | re.S,
)
#: The reserved words of the language.
KEYWORDS = frozenset("assert else error false for function if import importstr importbin in local null tailstrict then true self super".split())
_BINARY = {"*": 12, "/": 12, "%": 12, "+": 11, "-": 11, "<<": 10, ">>": 10, "<": 9, ">": 9, "<=": 9, ">=": 9, "in": 9, "==": 8, "!=": 8, "&": 7, "^": 6, "|": 5, "&&": 4, "||": 3}
_FIELD_MARKS = frozenset((":", "::", ":::", "+:", "+::", "+:::"))
_ATOMS = frozenset(("null", "true", "false", "self", "$"))


class JsonnetError(ValueError):
    pass


def _spans(text: str) -> list[tuple[str, int, int]]:
    out, pos = [], 0
    match = _TOKEN.match
    while True:
        m = match(text, pos)
        token = m.group(1)
        if not token:
            return out
        if token == "||" and text.startswith("|||", m.start(1)):
            if not (block := _BLOCK.match(text, m.start(1))):
                raise JsonnetError("text block")
            out.append(('"', block.start(), block.end()))
            pos = block.end()
            continue
        out.append((token, m.start(1), m.end(1)))
        pos = m.end(1)


def _tokens(text: str) -> list[str]:
    if "|||" in text:
        return [t for t, _, _ in _spans(text)]
    found = _TOKEN.findall(text)
    while found and not found[-1]:
        found.pop()
    return found


_IDENT = re.compile(r"[A-Za-z_]\w*\Z", re.A)


class Parser:
    """Recursive descent over a token list; raises JsonnetError."""

    def __init__(self, tokens: list[str]):
        self.t = tokens
        self.t.append("")
        self.i = 0

    def fail(self):
        raise JsonnetError(f"token {self.i}: {self.t[self.i]!r}")

    def want(self, token: str):
        if self.t[self.i] != token:
            self.fail()
        self.i += 1

    def name(self) -> str:
        token = self.t[self.i]
        if token in KEYWORDS or not _IDENT.match(token):
            self.fail()
        self.i += 1
        return token

    def done(self) -> bool:
        return self.t[self.i] == ""

    def expr(self, least: int = 0):
        self.unary()
        while True:
            op = self.t[self.i]
            power = _BINARY.get(op)
            if power is None or power < least or not power:
                break
            self.i += 1
            if op == "in" and self.t[self.i] == "super":
                self.i += 1
                continue
            self.expr(power + 1)

    def unary(self):
        t = self.t
        token = t[self.i]
        while token in ("-", "+", "!", "~"):
            self.i += 1
            token = t[self.i]
        if token == "local":
            self.i += 1
            self.binds()
            self.want(";")
            self.expr()
            return
        if token == "if":
            self.i += 1
            self.expr()
            self.want("then")
            self.expr()
            if t[self.i] == "else":
                self.i += 1
                self.expr()
            return
        if token == "function":
            self.i += 1
            self.params()
            self.expr()
            return
        if token == "assert":
            self.assertion()
            self.want(";")
            self.expr()
            return
        if token == "error":
            self.i += 1
            self.expr()
            return
        if token in ("import", "importstr", "importbin"):
            self.i += 1
            if t[self.i][:1] not in ("'", '"', "@"):
                self.fail()
            self.i += 1
            return
        self.primary()
        while True:
            token = t[self.i]
            if token == ".":
                self.i += 1
                self.name()
            elif token == "[":
                self.i += 1
                self.index()
            elif token == "(":
                self.i += 1
                self.args()
                if t[self.i] == "tailstrict":
                    self.i += 1
            elif token == "{":
                self.object()
            else:
                return

    def index(self):
        t = self.t
        seen = colons = 0
        while t[self.i] != "]":
            if t[self.i] == ":":
                colons += 1
                self.i += 1
            elif t[self.i] == "::":
                colons += 2
                self.i += 1
            else:
                self.expr()
                seen += 1
                if t[self.i] not in ("]", ":", "::"):
                    self.fail()
        if colons > 2 or not (seen or colons):
            self.fail()
        self.i += 1

    def primary(self):
        token = self.t[self.i]
        first = token[:1]
        if first in ("'", '"') or (first == "@" and len(token) > 1):
            if len(token) == 1 and token != '"':
                self.fail()
            self.i += 1
        elif first.isdigit():
            self.i += 1
        elif token in _ATOMS:
            self.i += 1
        elif token == "super":
            self.i += 1
            if self.t[self.i] not in (".", "["):
                self.fail()
        elif token == "(":
            self.i += 1
            self.expr()
            self.want(")")
        elif token == "[":
            self.array()
        elif token == "{":
            self.object()
        else:
            self.name()

    def array(self):
        t = self.t
        self.i += 1
        if t[self.i] == "]":
            self.i += 1
            return
        self.expr()
        if t[self.i] == ",":
            if t[self.i + 1] == "for":
                self.i += 1
        if t[self.i] == "for":
            self.comprehension()
            self.want("]")
            return
        while t[self.i] == ",":
            self.i += 1
            if t[self.i] == "]":
                break
            self.expr()
        self.want("]")

    def comprehension(self):
        while self.t[self.i] in ("for", "if"):
            kind = self.t[self.i]
            self.i += 1
            if kind == "for":
                self.name()
                self.want("in")
            self.expr()

    def args(self):
        t = self.t
        while t[self.i] != ")":
            if t[self.i + 1] == "=" and _IDENT.match(t[self.i]):
                self.name()
                self.i += 1
            self.expr()
            if t[self.i] != ",":
                break
            self.i += 1
        self.want(")")

    def params(self):
        t = self.t
        self.want("(")
        while t[self.i] != ")":
            self.name()
            if t[self.i] == "=":
                self.i += 1
                self.expr()
            if t[self.i] != ",":
                break
            self.i += 1
        self.want(")")

    def bind(self):
        self.name()
        if self.t[self.i] == "(":
            self.params()
        self.want("=")
        self.expr()

    def binds(self):
        self.bind()
        while self.t[self.i] == ",":
            self.i += 1
            self.bind()

    def assertion(self):
        self.i += 1
        self.expr()
        if self.t[self.i] == ":":
            self.i += 1
            self.expr()

    def field(self):
        t = self.t
        token = t[self.i]
        if token == "[":
            self.i += 1
            self.expr()
            self.want("]")
        elif token[:1] in ("'", '"', "@") and token:
            self.i += 1
        else:
            self.name()
        if t[self.i] == "(":
            self.params()
            if t[self.i] not in (":", "::", ":::"):
                self.fail()
        elif t[self.i] == "+" and t[self.i + 1] in (":", "::", ":::"):
            self.i += 1
        if t[self.i] not in _FIELD_MARKS:
            self.fail()
        self.i += 1
        self.expr()

    def object(self):
        t = self.t
        self.i += 1
        while t[self.i] != "}":
            if t[self.i] == "local":
                self.i += 1
                self.bind()
            elif t[self.i] == "assert":
                self.assertion()
            else:
                self.field()
            if t[self.i] == "for":
                self.comprehension()
                break
            if t[self.i] != ",":
                break
            self.i += 1
            if t[self.i] == "for":
                self.comprehension()
                break
        self.want("}")


def validate(text: str, whole: bool = True) -> bool:
    """Whether the text is a Jsonnet file, or, if not whole, one local bind or field."""
    try:
        tokens = _tokens(text)
    except JsonnetError:
        return False
    with deep(len(tokens)):
        return _valid(tokens, whole)


def _valid(tokens: list[str], whole: bool) -> bool:
    try:
        p = Parser(list(tokens))
        if whole:
            p.expr()
            return p.done()
        if p.t[0] == "local":
            p.i = 1
            p.binds()
            if p.t[p.i] == ";":
                p.i += 1
            if p.done():
                return True
            p.expr()
            return p.done()
        if p.t[0] == "assert":
            p.assertion()
        else:
            try:
                p.field()
            except JsonnetError:
                p = Parser(list(tokens))
                p.expr()
                return p.done()
        if p.t[p.i] in (",", ";"):
            p.i += 1
        return p.done()
    except (JsonnetError, IndexError):
        return False


def bind_end(text: str) -> int | None:
    """Where the first bind of a text that begins with local ends (before its ; or ,), None if it does not parse so far."""
    try:
        spans = _spans(text)
        p = Parser([t for t, _, _ in spans])
        with deep(len(spans)):
            p.want("local")
            p.bind()
        return spans[p.i - 1][2]
    except (JsonnetError, IndexError):
        return None


def definitions(text: str) -> list[dict]:
    """Top-level local binds and the direct fields of a root object."""
    if not validate(text):
        return []
    spans = _spans(text)
    with deep(len(spans)):
        return _definitions(text, spans)


def _definitions(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    p = Parser([t for t, _, _ in spans])
    cuts: list[tuple[str, int, int]] = []
    while p.t[p.i] == "local":
        p.i += 1
        while True:
            start, symbol = p.i, p.name()
            if p.t[p.i] == "(":
                p.params()
            p.want("=")
            p.expr()
            cuts.append((symbol, start, p.i))
            if p.t[p.i] != ",":
                break
            p.i += 1
        p.want(";")
    root = p.i
    p.expr()
    if p.t[root] == "{" and p.t[p.i - 1] == "}" and p.done():
        p.i = root
        p.object()
        if p.done():
            p.i = root + 1
            found = []
            while p.t[p.i] != "}":
                start = p.i
                if p.t[p.i] in ("local", "assert"):
                    if p.t[p.i] == "local":
                        p.i += 1
                        p.bind()
                    else:
                        p.assertion()
                else:
                    close = p.i + 1
                    if p.t[p.i] == "[":
                        p.i += 1
                        p.expr()
                        close = p.i + 1
                    symbol = text[spans[start][1] : spans[close - 1][2]]
                    p.i = start
                    p.field()
                    found.append((symbol, start, p.i))
                if p.t[p.i] == "for":
                    found = []
                    break
                if p.t[p.i] == ",":
                    p.i += 1
            cuts += found
    out = []
    for symbol, first, last in cuts:
        start, end = spans[first][1], spans[last - 1][2]
        line = text.count("\n", 0, start) + 1
        out.append({"symbol": symbol, "start_line": line, "end_line": line + text.count("\n", start, end), "text": text[start:end]})
    return out
