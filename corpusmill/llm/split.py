"""Oversized texts cut at natural boundaries.

A text is a row of tokens (runs of letters and digits, or single other marks
with the blanks behind them); prefix sums give each token's offset. The sorted
ends of tokens are the boundaries, graded: before a blank line or a definition at
the margin, at a line end, after a sentence, at a blank. A piece ends at the last
boundary of the best grade within the limit (binary search per grade, good
grades only in the last half of the piece), the next begins one overlap earlier
at a boundary, and where nothing fits the cut is hard.

Defined results: null or empty texts and texts within the limit give one piece
(null: none); all pieces have 1 to limit code points, consecutive pieces share
exactly the text between the second's start and the first's end, and the pieces
without the overlaps are the text again.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from corpusmill.session import spread

#: The reference's cut-off for embedding input, in Unicode code points.
LIMIT = 6000
OVERLAP = 200
_TOKEN = re.compile(r"\w+[^\S\n]*|\n|[^\w\n]", re.S)
_PIECES = "id string, file string, symbol string, language string, piece int, n_pieces int, start_line int, end_line int, char_start int, char_end int, text string"


def boundaries(text: str) -> tuple[list[int], list[list[int]]]:
    """Ends of all tokens, and sorted boundary offsets by grade, the best first."""
    ends: list[int] = []
    blank, line, sentence = [], [], []
    at = 0
    for token in _TOKEN.findall(text):
        at += len(token)
        ends.append(at)
        if token == "\n":
            line.append(at)
            if at < len(text) and text[at] in "\r\n" or (at < len(text) and not text[at].isspace() and text[at] not in "})]"):
                blank.append(at)
        elif token in ".!?;" and text[at : at + 1].isspace():
            sentence.append(at)
    return ends, [blank, line, sentence]


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    ends, grades = boundaries(text)
    out = []
    start = reached = 0
    while True:
        if n - start <= limit:
            out.append((start, n))
            return out
        top, end = start + limit, 0
        # every piece gets past what the last one reached
        low = max(reached, start + limit // 2)
        for marks in grades:
            k = bisect_right(marks, top) - 1
            if k >= 0 and marks[k] > low:
                end = marks[k]
                break
        if not end:
            k = bisect_right(ends, top) - 1
            end = ends[k] if k >= 0 and ends[k] > max(reached, start) else top
        out.append((start, end))
        reached = end
        back = end - overlap
        if overlap:
            # the step back never goes further than the overlap: it ends at the first boundary from there on
            k = bisect_left(grades[1], back)
            if k < len(grades[1]) and grades[1][k] < end:
                back = grades[1][k]
            else:
                k = bisect_left(ends, back)
                if k < len(ends) and ends[k] < end:
                    back = ends[k]
        start = max(back, start + 1)


def _split_batches(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PIECES.split(", ")]
        types = [pa.string()] * 4 + [pa.int32()] * 6 + [pa.string()]
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            rows, size = [], 0
            for id_, file, symbol, language, first, text in zip(*columns):
                spans = cuts(text, limit, overlap)
                line, at = first if first is not None else 1, 0
                for k, (start, end) in enumerate(spans):
                    line += text.count("\n", at, start)
                    at = start
                    last = line + text.count("\n", start, end - 1 if end > start else end)
                    rows.append((id_, file, symbol, language, k, len(spans), line, last, start, end, text[start:end]))
                size += len(text)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, only_oversized: bool = True) -> DataFrame:
    """The pieces of every row (of the rows over the limit), each with its own lines and the symbol it came from."""
    rows = chunks.where("text is not null").select("id", "file", "symbol", "language", "start_line", "text")
    if only_oversized:
        rows = rows.where(F.char_length("text") > limit)
    return spread(rows).mapInArrow(_split_batches(limit, overlap), _PIECES)


def oversized_ids(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Ids whose text came out in more than one piece."""
    return pieces(chunks, limit, overlap).where("n_pieces > 1 and id is not null").select("id").distinct()
