"""Texts that are one FHiCL or Jsonnet table, as the leaves of their trees."""

from __future__ import annotations

import re

from corpusmill.parsers import fhicl, jsonnet
from corpusmill.parsers.depth import deep


class TableError(ValueError):
    """The text is not one table definition."""


_FHICL_COMMENT = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'[^\'\n]*\'|(\#|//)')


def fhicl_comment(text: str) -> bool:
    return any(m.group(1) for m in _FHICL_COMMENT.finditer(text))


def fhicl_leaves(text: str) -> list[tuple[str, str]]:
    """(path, value) of every leaf of a text that is one table definition.

    Elements of lists have their position in the path, tables add a leaf of
    their own, so the multiset of leaves is the table up to entry order.
    """
    tokens = fhicl._tokens(text)
    if len(tokens) < 4 or tokens[1] != ":" or tokens[2] != "{":
        raise TableError
    out: list[tuple[str, str]] = []
    pos = _fhicl_value(tokens, 2, tokens[0], out)
    if pos != len(tokens):
        raise TableError
    return out


def _fhicl_value(tokens: list[str], pos: int, path: str, out: list) -> int:
    # (path, closing mark, position in a list or -1) of the open tables and lists
    stack: list[list] = []
    try:
        while True:
            token = tokens[pos]
            pos += 1
            if token == "{":
                out.append((path, "{"))
                stack.append([path, "}", -1])
            elif token == "[":
                out.append((path, "["))
                stack.append([path, "]", 0])
            elif token in ("}", "]", ":", ",", "(", ")"):
                raise TableError
            else:
                out.append((path, token))
            while stack:
                top = stack[-1]
                token = tokens[pos]
                if token == top[1]:
                    pos += 1
                    stack.pop()
                    continue
                if top[2] < 0:
                    if tokens[pos + 1] != ":" or not fhicl._NAME.match(token):
                        raise TableError
                    path = f"{top[0]}/{token}"
                    pos += 2
                else:
                    if top[2] > 0 or token == ",":
                        if token != "," or top[2] == 0:
                            raise TableError
                        pos += 1
                        if tokens[pos] == "]":
                            continue
                    path = f"{top[0]}/{top[2]}"
                    top[2] += 1
                break
            if not stack:
                return pos
    except IndexError:
        raise TableError from None


_JSONNET_COMMENT = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|(\#|//|/\*)', re.S)


def jsonnet_comment(text: str) -> bool:
    return any(m.group(1) for m in _JSONNET_COMMENT.finditer(text))


def jsonnet_leaves(text: str) -> list[tuple[str, str]]:
    """(path, value) of every leaf of a text that is one field or local bind with an object literal.

    Values other than objects and arrays are their tokens as they stand. Raises
    TableError if the text is anything else.
    """
    tokens = jsonnet._tokens(text)
    bind = len(tokens) >= 5 and tokens[0] == "local" and tokens[2] == "=" and tokens[3] == "{"
    if not bind and not (len(tokens) >= 4 and tokens[1] in jsonnet._FIELD_MARKS and tokens[2] == "{"):
        raise TableError
    p = jsonnet.Parser(tokens)
    out: list[tuple[str, str]] = []
    with deep(len(tokens)):
        _jsonnet_value(p, 3 if bind else 2, f"local/{tokens[1]}" if bind else tokens[0], out)
    if p.t[p.i] == (";" if bind else ","):
        p.i += 1
    if not p.done():
        raise TableError
    return out


def _jsonnet_value(p: jsonnet.Parser, at: int, path: str, out: list) -> None:
    p.i = at
    t = p.t
    if t[at] == "{":
        out.append((path, "{"))
        p.i += 1
        while t[p.i] != "}":
            key, mark = t[p.i], t[p.i + 1]
            if mark not in jsonnet._FIELD_MARKS or key in jsonnet.KEYWORDS:
                raise TableError
            _jsonnet_value(p, p.i + 2, f"{path}/{key}", out)
            if t[p.i] != ",":
                break
            p.i += 1
        p.want("}")
    elif t[at] == "[":
        start = len(out)
        out.append((path, "["))
        p.i += 1
        k = 0
        while t[p.i] != "]":
            _jsonnet_value(p, p.i, f"{path}/{k}", out)
            k += 1
            if t[p.i] != ",":
                break
            p.i += 1
        if t[p.i] != "]":
            # a comprehension: its tokens are the value
            del out[start:]
            p.i = at
            p.array()
            out.append((path, " ".join(t[at : p.i])))
        else:
            p.i += 1
    else:
        p.expr()
        out.append((path, " ".join(t[at : p.i])))
        return
    if t[p.i] not in (",", "}", "]", "", ";"):
        # an object or array that only begins a longer expression
        raise TableError


def table_leaves(text: str, file: str | None) -> list[tuple[str, str]] | None:
    """The leaves of a text that is one table without comments in a FHiCL or Jsonnet file, else None."""
    if not file or not file.endswith((".fcl", ".jsonnet")):
        return None
    comment, leaves = (fhicl_comment, fhicl_leaves) if file.endswith(".fcl") else (jsonnet_comment, jsonnet_leaves)
    if comment(text):
        return None
    try:
        return leaves(text)
    except (TableError, jsonnet.JsonnetError, IndexError):
        return None
