"""Symbol-level chunks of one file, by language.

Each chunker gives dicts of symbol, start_line, end_line and text; a file it
cannot parse gives none, and the caller then keeps the whole file. Rows come in
document order.
"""

from __future__ import annotations

import ast
import re
import warnings

from corpusmill.parsers import fhicl, jsonnet

_C_LEX = re.compile(
    r'(?:u8|[uUL])?R"([^()\s\\]{0,16})\(.*?\)\1"|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'|//[^\n]*|/\*.*?\*/|^[ \t]*\#(?:[^\n\\]|\\\r?\n|\\.)*'
    r"|(?P<w>[A-Za-z_$\u0080-\U0010ffff][\w$]*)|(?P<m>::|[{}()\[\];:=~<>,])|(?P<o>[^\s\w])",
    re.S | re.M,
)
_CONTROL = frozenset("if for while switch catch return sizeof do else new delete throw case".split())


def python_chunks(text: str) -> list[dict]:
    """Every function and class, nested ones too, without decorators."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text.removeprefix("﻿"))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
    lines = text.split("\n")
    found = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first, last = node.lineno, node.end_lineno
            body = lines[first - 1 : last]
            body[0] = body[0].encode("utf-8")[node.col_offset :].decode("utf-8", "replace")
            found.append({"symbol": node.name, "start_line": first, "end_line": last, "text": "\n".join(body)})
    return sorted(found, key=lambda c: (c["start_line"], -c["end_line"]))


def cpp_chunks(text: str, inline_methods: bool = False, strict_reference_names: bool = True) -> list[dict]:
    """Function definitions that have a name, and classes.

    As in the usual grammar-based chunkers, methods defined inside a class are
    left out unless they are constructors, destructors or operators, and functions
    that return a reference have no name; with inline_methods the former come too,
    without strict_reference_names the latter.
    """
    tokens = [(m.group("w") or m.group("m") or m.group("o") or '"', m.start(), m.end()) for m in _C_LEX.finditer(text) if m.lastgroup in ("w", "m", "o") or m.group()[:1] in "\"'"]
    out: list[dict] = []
    # for each open brace: kind, symbol, first token, names of the enclosing class
    stack: list[tuple[str, str | None, int, str | None]] = []
    head = k = 0
    depth = 0
    while k < len(tokens):
        t = tokens[k][0]
        if t in "([":
            depth += 1
        elif t in ")]":
            depth = max(0, depth - 1)
        elif t == "{" and depth == 0:
            inside = stack[-1][0] if stack else "file"
            kind, symbol = ("block", None) if inside in ("function", "block") else _head(tokens, head, k)
            enclosing = stack[-1][1] if stack and stack[-1][0] == "class" else None
            if kind == "function" and enclosing and not inline_methods:
                own = symbol == enclosing or symbol.startswith("~") or symbol.startswith("operator")
                symbol = symbol if own else None
            if kind == "function" and strict_reference_names and _returns_reference([x[0] for x in tokens[head:k]]):
                symbol = None
            stack.append((kind, symbol, head, enclosing))
            head = k + 1
        elif t == "}" and depth == 0 and stack:
            kind, symbol, first, _ = stack.pop()
            if symbol and kind in ("function", "class"):
                start, end = tokens[first][1], tokens[k][2]
                line = text.count("\n", 0, start) + 1
                out.append({"symbol": symbol, "start_line": line, "end_line": line + text.count("\n", start, end), "text": text[start:end]})
            if kind != "init":
                head = k + 1
        elif t == ";" and depth == 0:
            if not stack or stack[-1][0] in ("class", "namespace"):
                words = [x[0] for x in tokens[head:k]]
                # a forward declaration is a class without a body
                if len(words) == 2 and words[0] == "class" and words[1].isidentifier():
                    start, end = tokens[head][1], tokens[k - 1][2]
                    line = text.count("\n", 0, start) + 1
                    out.append({"symbol": words[1], "start_line": line, "end_line": line, "text": text[start:end]})
            head = k + 1
        elif t == ":" and depth == 0 and k - head == 1 and tokens[head][0] in ("public", "private", "protected"):
            head = k + 1
        k += 1
    return sorted(out, key=lambda c: (c["start_line"], -c["end_line"]))


def _returns_reference(words: list[str]) -> bool:
    """Whether the declared name of a function stands behind a reference mark."""
    level = 0
    for i, w in enumerate(words):
        if w == "<" and i and words[i - 1].isidentifier() and words[i - 1] != "operator":
            level += 1
        elif w == ">" and level:
            level -= 1
        elif w == "(" and level <= 0 and i:
            j = next((x for x in range(max(0, i - 4), i) if words[x] == "operator"), i - 1)
            while j >= 2 and words[j - 1] == "::":
                j -= 2
            return j > 0 and words[j - 1] == "&"
    return False


def _head(tokens: list, head: int, k: int) -> tuple[str, str | None]:
    """What the brace at k opens, and the symbol's name."""
    words = [t[0] for t in tokens[head:k]]
    at = 0
    while at < len(words) and words[at] == "template":
        level = 0
        at += 1
        while at < len(words):
            level += (words[at] == "<") - (words[at] == ">")
            at += 1
            if level == 0:
                break
    words = words[at:]
    if not words:
        return "block", None
    if "namespace" in words[:2] or words[0] == "extern" and len(words) == 2:
        return "namespace", None
    if words[0] in ("class", "struct", "union", "enum") and "(" not in words[: words.index(":") if ":" in words else len(words)]:
        names = [w for w in words[1 : words.index(":") if ":" in words else len(words)] if w.isidentifier() and w != "final"]
        return ("class", names[-1] if words[0] == "class" and names else None) if words[0] != "enum" else ("block", None)
    if words[-1] in ("=", ",", "return"):
        return "init", None
    level = 0
    for i, w in enumerate(words):
        if w == "<" and i and words[i - 1].isidentifier() and words[i - 1] != "operator":
            level += 1
        elif w == ">" and level:
            level -= 1
        elif w == "(" and level <= 0 and i:
            j = i
            if "operator" in words[max(0, i - 4) : i]:
                j = max(x for x in range(max(0, i - 4), i) if words[x] == "operator")
                name = "".join(words[j:i]) or "operator()"
                if i == j + 1 and words[i : i + 3] == ["(", ")", "("]:
                    name = "operator()"
            else:
                name = words[i - 1]
                j = i - 1
                if not name.isidentifier() or name in _CONTROL:
                    return "block", None
                if j and words[j - 1] == "~":
                    name, j = "~" + name, j - 1
            while j >= 2 and words[j - 1] == "::" and words[j - 2].isidentifier():
                name, j = f"{words[j - 2]}::{name}", j - 2
            return "function", name
    return "init" if words[-1].isidentifier() and "=" not in words else "block", None


def chunks_of(language: str, text: str) -> list[dict]:
    if language == "python":
        return python_chunks(text)
    if language == "fcl":
        return fhicl.definitions(text)
    if language == "jsonnet":
        return jsonnet.definitions(text)
    return cpp_chunks(text)
