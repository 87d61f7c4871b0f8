"""Recursion as deep as a text nests."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager


@contextmanager
def deep(tokens: int, frames: int = 12) -> Iterator[None]:
    """Lets recursive descent over so many tokens go on to the end.

    Calls from Python to Python take heap, not C stack, so that depth costs memory only.
    """
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 1000 + frames * tokens))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)
