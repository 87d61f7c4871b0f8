"""FHiCL: validation and top-level definition chunks.

Validation works on a string with one class letter per token, reduced from the
inside out by regular expressions, so the work per token stays in C.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""[\s﻿]*(?:(?:\#|//)[^\n]*[\s]*)*   # blanks and comments
    ("(?:[^"\\\n]|\\.)*"|'[^'\n]*'             # strings
    |@[A-Za-z_]+(?:::[\w.]+(?:\[\d+\])*)?      # directives
    |[+-]?(?:\d[\w.]*(?:(?<=[eE])[+-]\d+)?|\.\d[\w.]*(?:(?<=[eE])[+-]\d+)?)
    |[A-Za-z_][\w]*(?:\.\w+|\[\d+\])*          # names
    |[{}\[\]:,()]|.|$)""",
    re.X | re.A | re.S,
)
_NAME = re.compile(r"[A-Za-z_]\w*(?:\.\w+|\[\d+\])*\Z", re.A)
_NUMBER = re.compile(r"[+-]?(?:0x[0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|\d\w*)\Z", re.A)
_REDUCE = re.compile(r"\[(?:[NAVS](?:,[NAVS])*,?)?\]|\{(?:N[P]?:[NAVS]|T)*\}|\([NA],[NA]\)")
_DOCUMENT = re.compile(r"(?:N[P]?:[NAVS]|[BE]|T)*\Z")
_PUNCT = dict.fromkeys("{}[]:,()")


def _classify(token: str) -> str:
    if token in _PUNCT:
        return token
    first = token[0]
    if first in "\"'":
        return "A" if len(token) > 1 else "!"
    if first == "@":
        word = token.partition("::")[0]
        if word in ("@protect_ignore", "@protect_error"):
            return "P"
        if token in ("@nil", "@erase"):
            return "A"
        if word == "@table" and "::" in token:
            return "T"
        return "A" if word in ("@local", "@sequence", "@id", "@db") and "::" in token else "!"
    if token == "BEGIN_PROLOG":
        return "B"
    if token == "END_PROLOG":
        return "E"
    if _NAME.match(token):
        return "N"
    return "A" if _NUMBER.match(token) else "!"


class _Classes(dict):
    def __missing__(self, token: str) -> str:
        if len(self) > 200_000:
            self.clear()
        self[token] = kind = _classify(token)
        return kind


_classes = _Classes()


def _tokens(text: str) -> list[str]:
    found = _TOKEN.findall(text)
    while found and not found[-1]:
        found.pop()
    return found


def _reduced(classes: str) -> str:
    before = None
    while before != classes:
        before = classes
        # a table reference is also a value
        classes = _REDUCE.sub("V", classes.replace(":T", ":V"))
    return classes


def validate(text: str, whole: bool = True) -> bool:
    """Whether the text is a FHiCL document; a row cut from a file is one too."""
    classes = "".join([_classes[t] for t in _tokens(text)])
    if "!" in classes:
        return False
    depth = 0
    for mark in re.findall("[BE]", classes):
        depth += 1 if mark == "B" else -1
        if depth not in (0, 1):
            return False
    reduced = _reduced(classes)
    if not whole and not reduced:
        return False
    return depth == 0 and _DOCUMENT.match(reduced) is not None


def definitions(text: str) -> list[dict]:
    """Top-level definitions with their lines; [] if the text does not parse."""
    text = text.removeprefix("﻿")
    if not validate(text):
        return []
    spans = [(m.group(1), m.start(1), m.end(1)) for m in _TOKEN.finditer(text) if m.group(1)]
    out, k = [], 0
    while k < len(spans):
        kind = _classes[spans[k][0]]
        if kind != "N":
            k += 1
            continue
        first, symbol = k, spans[k][0]
        k += 1
        while spans[k][0] != ":":
            k += 1
        k += 1
        depth = 0
        while True:
            mark = spans[k][0]
            depth += (mark in "{[(") - (mark in "}])")
            k += 1
            if depth == 0:
                break
        start, end = spans[first][1], spans[k - 1][2]
        line = text.count("\n", 0, start) + 1
        out.append({"symbol": symbol, "start_line": line, "end_line": line + text.count("\n", start, end), "text": text[start:end]})
    return out
