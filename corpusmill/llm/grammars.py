"""Which grammars a text parses by, and how far its tokens speak for a language."""

from __future__ import annotations

import re
import symtable
import warnings

from corpusmill.llm import cpp
from corpusmill.parsers import fhicl, jsonnet
from corpusmill.parsers.languages import LANGUAGES, WHOLE_FILE, claimed


def _indented(text: str) -> str | None:
    """The text inside an if, for a definition cut out of a deeper block; None if its code starts at the margin."""
    lines = text.split("\n")
    for k, line in enumerate(lines):
        bare = line.lstrip()
        if bare and not bare.startswith("#"):
            gap = line[: len(line) - len(bare)]
            if not gap:
                return None
            return "if 1:\n" + "\n".join([*(gap + x.lstrip() for x in lines[:k]), *lines[k:]])
    return None


def _parses(text: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            # the symbol table is the cheapest full parse; its own complaints are not about syntax
            symtable.symtable(text, "<row>", "exec")
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
            pass
        try:
            import ast

            ast.parse(text)
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False


def validate_python(text: str, whole: bool = True) -> bool:
    if text[:1] == "﻿":
        text = text[1:]
    if _parses(text):
        return True
    if whole:
        return False
    inner = _indented(text)
    return inner is not None and _parses(inner)


VALIDATORS = {"cpp": cpp.validate, "fcl": fhicl.validate, "python": validate_python, "jsonnet": jsonnet.validate}

# Tokens that speak for a language, each with a weight in the ranking.
_SIGNS = {
    "cpp": re.compile(r"#include\b|::|;[ \t]*\r?$|\b(?:const|void|double|std|class|namespace|auto|template)\b|//", re.M),
    "python": re.compile(r"^[ \t]*(?:def|class|import|from|elif|with|for|if|while|try)\b[^{;]*:?[ \t]*\r?$|\bself\b|\bNone\b", re.M),
    "fcl": re.compile(r"^[ \t]*[\w.]+[ \t]*:[ \t]*(?:\{|\[|[\w.\"'@+-]+)[^,;]*\r?$|@(?:local|table|sequence)::|BEGIN_PROLOG", re.M),
    "jsonnet": re.compile(r"^[ \t]*[\w'\"\[\]]+[ \t]*:{1,3}[ \t]*.*,[ \t]*\r?$|^[ \t]*local\b|\bstd\.|\bimport[ \t]+['\"]|\$\.", re.M),
}


def ranking(text: str) -> list[str]:
    """All languages, the one with most tokens that speak for it first; ties in a fixed order."""
    counts = {k: len(v.findall(text)) for k, v in _SIGNS.items()}
    return sorted(LANGUAGES, key=lambda k: (-counts[k], LANGUAGES.index(k)))


def verdict(file: str | None, symbol: str | None, text: str | None) -> tuple[bool, str | None]:
    """(valid in the claimed language, the first other language in ranked order that parses it, if not)."""
    language = claimed(file)
    whole = symbol == WHOLE_FILE
    text = text or ""
    if not text.strip():
        # nothing at all is a valid file but no definition
        return (whole and language != "jsonnet"), None
    if VALIDATORS[language](text, whole):
        return True, None
    for other in ranking(text):
        if other != language and VALIDATORS[other](text, whole):
            return False, other
    return False, None
