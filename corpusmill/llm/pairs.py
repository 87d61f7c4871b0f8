"""Functions paired with their documentation.

A state machine that knows strings and comments lexes each row; matching braces
delimit the function (the dedent of its body in Python, its complete bind in
Jsonnet), and what stands behind it is left out; the comment that ends on the line
directly above it, and in Python the docstring, is its documentation. Empty or
trivial documentation drops the function.

Defined results: a function whose end is missing goes on to the end of its text; a row that is no single function, has a null or empty text or a
null symbol gives nothing; equal rows give one pair; a Python function with both
a comment and a docstring has both, joined by a newline.
"""

from __future__ import annotations

import io
import re
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.parsers import jsonnet
from corpusmill.parsers.languages import WHOLE_FILE, claimed
from corpusmill.session import spread

#: Least words beyond those of the symbol.
LEAST_WORDS = 5

# One match per string, comment or mark that matters.
_C_LEX = re.compile(r'(?:u8|[uUL])?R"([^()\s\\]{0,16})\(.*?\)\1"|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'|(?P<c>//[^\n]*|/\*.*?\*/)|(?P<m>[{}()\[\];=:])', re.S)
_REST = re.compile(r"(?:[\s;]|//[^\n]*|/\*.*?\*/)*+\Z", re.S)
_PY_HEAD = re.compile(r"(?:@[^\n]*\n[ \t]*)*(?:async[ \t]+)?def[ \t]+\w+[ \t]*(?:\[[^\]]*\][ \t]*)?\(")
_PY_STRING = re.compile(r"""[rRuU]?("{3}|'{3}|"|')""")
_TYPE_WORD = re.compile(r"^\s*(?:template\s*<.*?>\s*)?(?:typedef\s+)?(?:class|struct|union|enum|namespace|using|extern\s*\"C\")\b", re.S)


def _leading(text: str, line_mark: str, block: bool) -> tuple[int, list[tuple[int, int]]]:
    """Where the code begins, and the spans of the comments before it."""
    at, spans = 0, []
    n = len(text)
    while at < n:
        while at < n and (text[at].isspace() or text[at] == "﻿"):
            at += 1
        if block and text.startswith("/*", at):
            end = text.find("*/", at + 2)
            if end < 0:
                break
            spans.append((at, end + 2))
            at = end + 2
        elif any(text.startswith(m, at) for m in line_mark.split()):
            end = text.find("\n", at)
            end = n if end < 0 else end
            spans.append((at, end))
            at = end
        else:
            break
    return at, spans


def _directly_above(text: str, code: int, spans: list[tuple[int, int]]) -> str:
    """The last comment, if it ends on the line above the code; line comments on lines one after another are one comment."""
    if not spans:
        return ""
    start, end = spans[-1]
    if text.count("\n", end, code) != 1:
        return ""
    if text.startswith("/*", start):
        return text[start:end]
    k = len(spans) - 1
    while k > 0 and text.count("\n", spans[k - 1][1], spans[k][0]) == 1 and not text.startswith("/*", spans[k - 1][0]):
        k -= 1
    return text[spans[k][0] : end]


def _cpp(text: str) -> tuple[int, int, str] | None:
    code, spans = _leading(text, "//", True)
    if _TYPE_WORD.match(text, code) or code >= len(text):
        return None
    depth = braces = 0
    called = listed = member = False
    for m in _C_LEX.finditer(text, code):
        mark = m.group("m")
        if not mark:
            continue
        at = m.start()
        if braces == 0:
            if mark in "([":
                depth += 1
                called = called or mark == "("
            elif mark in ")]":
                depth -= 1
            elif mark == "{":
                if not called or depth:
                    return None
                braces = 1
                # behind the colon of a constructor a name before the brace is a member's
                before = text[code:at].rstrip()[-1:]
                member = listed and (before.isalnum() or before in "_>")
            elif mark == ":" and called and not depth and text[at - 1] != ":" and text[at + 1 : at + 2] != ":":
                listed = True
            elif mark in ";=" and depth == 0 and "operator" not in text[code:at]:
                return None
        elif mark == "{":
            braces += 1
        elif mark == "}":
            braces -= 1
            if braces == 0 and not member:
                if not listed and not _REST.match(text, at + 1):
                    return None
                return code, at + 1, _directly_above(text, code, spans)
    # a body that never closes is still one function's text, cut short
    return (code, len(text), _directly_above(text, code, spans)) if braces or member else None


def _python(text: str) -> tuple[int, int, str] | None:
    code, spans = _leading(text, "#", False)
    m = _PY_HEAD.match(text, code)
    if not m:
        return None
    notes = [_directly_above(text, code, spans)]
    doc = _docstring(text, m.end() - 1)
    if doc:
        notes.append(doc)
    return code, -1, "\n".join(x for x in notes if x)


def _python_end(text: str, code: int) -> int:
    """Where the function that begins at a place ends: with its last line before the dedent."""
    body = text[code:]
    starts = [0]
    for line in body.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    depth, seen, end = 0, False, None
    try:
        for t in tokenize.generate_tokens(io.StringIO(body, newline="").readline):
            if t.type == tokenize.INDENT:
                depth += 1
            elif t.type == tokenize.DEDENT:
                depth -= 1
                if depth == 0:
                    break
            elif t.type in (tokenize.NL, tokenize.COMMENT):
                continue
            elif depth == 0 and end is not None:
                break  # the body was on the line of the def
            elif t.type == tokenize.NEWLINE:
                if seen:
                    end = starts[t.start[0] - 1] + t.start[1]
            elif t.string == "def" and not depth:
                seen = True
    except IndentationError:
        pass  # a dedent to between two depths ends the function too
    except (tokenize.TokenError, SyntaxError, IndexError):
        return len(text)
    return len(text) if end is None else code + end


def _docstring(text: str, at: int) -> str:
    """The string that is the first statement of the body after the parameters opened at a place."""
    depth, n = 0, len(text)
    while at < n:
        c = text[at]
        if c in "\"'":
            m = _PY_STRING.match(text, at)
            at = _string_end(text, m.end(), m.group(1)) if m else at + 1
            continue
        if c == "#":
            at = text.find("\n", at)
            if at < 0:
                return ""
            continue
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth == 0:
            break
        at += 1
    at += 1
    while at < n:
        while at < n and text[at].isspace():
            at += 1
        if at < n and text[at] == "#":
            at = text.find("\n", at)
            if at < 0:
                return ""
            continue
        break
    m = _PY_STRING.match(text, at)
    if not m:
        return ""
    end = _string_end(text, m.end(), m.group(1))
    tail = text[end : end + 40].lstrip(" \t")
    if tail[:1] in (".", "%", "+", "[", "("):
        return ""
    return text[m.end() : end - len(m.group(1))]


def _string_end(text: str, at: int, quote: str) -> int:
    n = len(text)
    while at < n:
        if text[at] == "\\":
            at += 2
        elif text.startswith(quote, at):
            return at + len(quote)
        elif len(quote) == 1 and text[at] == "\n":
            return at
        else:
            at += 1
    return n


_J_HEAD = re.compile(r"local\s+[A-Za-z_]\w*\s*\(")


def _jsonnet(text: str) -> tuple[int, int, str] | None:
    code, spans = _leading(text, "// #", True)
    if not _J_HEAD.match(text, code):
        return None
    return code, -1, _directly_above(text, code, spans)


def _jsonnet_end(text: str, code: int) -> int:
    end = jsonnet.bind_end(text[code:])
    if end is None:
        return len(text)
    # its semicolon belongs to it
    rest = _SEMICOLON.match(text, code + end)
    return rest.end() if rest else code + end


_EXTRACT = {"cpp": _cpp, "python": _python, "jsonnet": _jsonnet}
_END = {"python": _python_end, "jsonnet": _jsonnet_end}
_SEMICOLON = re.compile(r"\s*;")


def _place(file: str | None, symbol: str | None, text: str | None) -> tuple[str, str, int, int, str] | None:
    """(language, text, first place of the code, its end or -1 if not yet known, documentation) if the row is one function or method."""
    if not text or not symbol or symbol == WHOLE_FILE:
        return None
    language = claimed(file)
    if language not in _EXTRACT:
        return None
    text = text.replace("\r\n", "\n")
    found = _EXTRACT[language](text)
    return (language, text, *found) if found else None


def _code(language: str, text: str, start: int, end: int) -> str:
    return text[start : end if end >= 0 else _END[language](text, start)]


def extract(file: str | None, symbol: str | None, text: str | None) -> tuple[str, str] | None:
    """(code, documentation as written) if the row is one function or method."""
    found = _place(file, symbol, text)
    return (_code(*found[:4]), found[4]) if found else None


_EDGE = re.compile(r"^[ \t]*(?:///?[!<]*|//[!<]*|/\*+[!<]*|\*+/?|#+[!:]?)|\*+/[ \t]*$", re.M)
_RULE = re.compile(r"[-=*~_#+.]{3,}|-\*-")
_TAG_NAME = re.compile(r"[@\\](?:param|tparam|arg|exception|throws?|retval|raises?)(?:\s*\[[^\]]*\])?\s+[\w.:*&]+|:(?:param|parameter|arg|argument|key|type|raises?|var|ivar)(?:\s+[\w.\[\], ]+?)?\s+\w+\s*:|:\w+:", re.I)
_TAG = re.compile(r"[@\\]\w+(?:\[[^\]]*\])?")
_SECTION_NAME = re.compile(r"^[ \t]*\*{0,2}\w+(?:[ \t]*\([^)]*\))?[ \t]*:(?=[ \t]+\S)", re.M)
_SECTIONS = re.compile(r"^[ \t]*(?:args?|arguments|parameters|params|returns?|yields?|raises|throws|notes?|examples?)[ \t]*:?[ \t]*$", re.M | re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_PART = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")
# Words that only hold a place.
_PLACEHOLDER = re.compile(
    r"^\W*(?:(?:todo|fixme|xxx|tbd|tba|wip|n/?a|none|placeholder|undocumented)\b|(?:to be (?:documented|written|done|filled))\b|(?:no|missing|insert|add|write|fill in)\b[\w ]{0,20}\b(?:documentation|docs?|description|docstring|comment)\b"
    r"|(?:documentation|description|docstring|comment) (?:goes here|to follow|missing|pending|needed)\b|(?:please )?document (?:me|this)\b|lorem ipsum\b|auto-?generated (?:stub|docstring|method stub))",
    re.I,
)
# Words of licence lines.
_LICENCE = re.compile(r"copyright|\(c\)\s*\d{4}|spdx-license|licen[cs]ed? under|all rights reserved|see licen[cs]e|redistribut|warrant|permission is hereby|GNU (?:lesser )?general public", re.I)
_CODE_LINE = re.compile(
    r"[;{}]\s*$|^\s*(?:return\b.*[;(\[=]|(?:if|for|while|elif|else|switch|with|try|except)\b.*[:{]\s*$|(?:from\s+[\w.]+\s+)?import\s+\w|#\s*(?:include|define|if|endif)|local\s+\w+.*=|def\s+\w+\(|class\s+\w+.*[:{])"
    r"|^\s*[\w.:\[\]>*&, -]+\s*(?:[-+*/|&]?=)\s*\S|^\s*[\w.:]+(?:->\w+)?\(.*\)\s*,?\s*$|^\s*(?:[\w.]+|[\"'][^\"']*[\"'])\s*:{1,3}\s*(?:\{|\[|[\d\"'].*,?\s*$)|^\s*[\])}]+[,;]?\s*$"
)


def plain(doc: str) -> str:
    """The documentation without comment marks, tags and the argument names after tags."""
    text = _EDGE.sub(" ", doc)
    lines = [x.strip() for x in text.split("\n")]
    text = "\n".join(lines).strip()
    text = _TAG_NAME.sub(" ", text)
    text = _TAG.sub(" ", text)
    text = _SECTIONS.sub(" ", text)
    return "\n".join(x for x in (" ".join(y.split()) for y in text.split("\n")) if x)


def useful(doc: str, symbol: str) -> bool:
    text = plain(doc)
    lines = [x for x in text.split("\n") if not _LICENCE.search(x)]
    code = [x for x in lines if _CODE_LINE.search(x)]
    prose = [x for x in lines if not _CODE_LINE.search(x)] if len(code) >= max(1, 0.5 * len(lines)) else lines
    body = "\n".join(prose)
    if not body or _PLACEHOLDER.match(body):
        return False
    own = {p.casefold() for p in _PART.findall(symbol)} | {p.casefold() for p in re.findall(r"\w+", symbol)}
    count = 0
    for word in _WORD.findall(_RULE.sub(" ", body)):
        parts = {p.casefold() for p in _PART.findall(word)} | {word.casefold()}
        if word.casefold() not in own and not parts <= own | {word.casefold()} or (len(parts) == 1 and word.casefold() not in own):
            count += 1
    return count >= LEAST_WORDS


_PAIRS = "id string, file string, symbol string, language string, code string, description string"


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _PAIRS.split(", ")]
    for batch in batches:
        rows = []
        for id_, file, symbol, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            found = _place(file, symbol, text)
            if found and found[4] and useful(found[4], symbol):
                rows.append((id_, file, symbol, found[0], _code(*found[:4]), plain(found[4])))
        columns = zip(*rows) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=names)


def _rows(chunks: DataFrame) -> DataFrame:
    rows = chunks.where("id is not null and text is not null and symbol is not null")
    rows = rows.where((F.col("symbol") != WHOLE_FILE) & ~F.coalesce(F.col("file").endswith(".fcl"), F.lit(False)))
    return spread(rows.select("id", "file", "symbol", "text"))


def pairs(chunks: DataFrame) -> DataFrame:
    """(id, file, symbol, language, code, description) of documented functions, distinct."""
    return _rows(chunks).mapInArrow(_pair_batches, _PAIRS).distinct()


def _id_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = []
        for id_, file, symbol, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            found = _place(file, symbol, text)
            if found and found[4] and useful(found[4], symbol):
                ids.append(id_)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string())], names=["id"])


def documented_ids(chunks: DataFrame) -> DataFrame:
    """(id) of the rows that pairs gives, without cutting their code out."""
    return _rows(chunks).mapInArrow(_id_batches, "id string").distinct()
