"""Generated, minified, vendored and data files, by statistics per file.

Layout: each row gives counts that add up over a file: code characters without
comments and strings, white space, letters and digits, the longest line, lines,
words, numeric literals, encoded runs and the lines that equal one another but
for digits. Thresholds per language decide on the sums.

Origin: code that a tool wrote or that was taken over often looks like any other,
and only the comment at the top of the file tells. No list of phrases decides
there. The corpus shows which places of its file headers are filled with ever
other names that stand nowhere in code ("output of NAME", "NAME 1.2"): such a
place is a slot, and a header with a foreign name in a slot tells an origin.
Folders named after such names are copies of them, as is what stands beside these
folders; endings of file names that mostly go with an origin (_pb2) make headers
without a name trusted. A few markers that tools agree on add to that.
Files that do not parse are left out.

Defined results: a null or empty text adds nothing; a null file is left out;
repeated rows count once; a header that starts below line 1 is none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.llm.syntax import invalid_files
from corpusmill.parsers.languages import claimed
from corpusmill.session import BROADCAST_ROWS, broadcast_if_small, checkpointed, spread

# Markers by which tools and copies of outside libraries name themselves by convention.
MARKERS = {
    "generated": re.compile(r"@generated\b|<auto-?generated>|\bgenerated (?:by|from|with) \S+.{0,80}\bdo not (?:edit|modify)\b|\bdo not (?:edit|modify)\b.{0,80}\bgenerated (?:by|from)\b", re.I | re.S),
    "vendored": re.compile(r"\b(?:imported|copied|vendored)(?: \w+)? from \S+ v?\d", re.I),
}
# Folders that hold outside code by convention.
VENDOR_DIRS = ("vendor", "vendored", "third_party", "thirdparty", "third-party", "3rdparty", "external", "externals", "extern", "extlib", "extlibs", "deps", "node_modules")

#: Least different names in a slot, the largest share that one name may have of it, and their least share together.
SLOT_NAMES, SLOT_ONE, SLOT_ALL = 3, 1 / 3, 0.5
#: Least foreign names among the folders below one folder, that all its folders are foreign.
FOLDER_NAMES = 3
#: Least files and share: of a trusted ending those with an origin, of a trusted opening of a header those with a trusted ending.
TRUST_FILES, TRUST_SHARE = 5, 0.5
#: Words of a header's opening.
OPENING = 5

_C_LIKE = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.){1,400}+\'', re.S)
_PY_LIKE = re.compile(r'#[^\n]*|"""(?:[^"\\]|\\.|"(?!""))*+"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*+\'\'\'|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'', re.S)
_BOTH = re.compile(r'//[^\n]*|#[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'', re.S)
_STRIP = {"cpp": _C_LIKE, "python": _PY_LIKE, "fcl": _BOTH, "jsonnet": _BOTH}
_WORD = re.compile(r"(?<![\w.])[A-Za-z_]\w*")
_NUMBER = re.compile(r"(?<![\w.])[+-]?\.?\d[\w.]*(?:(?<=[eE])[+-]\d+)?")
_ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{40,}")
_DIGITS = re.compile(r"\d+")
_NOT_ALNUM = re.compile(r"[\W_]+")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_NAME = re.compile(r"[a-z]{3,}\d?")
_PLAIN = re.compile(r"[A-Za-z]+\d?")
_ENDING = r"[_.]([a-z]+[0-9]?)\.[^./]+$"
_LEADING = re.compile(r"(?:﻿?\s*(?:#![^\n]*\n)?\s*)((?:(?://[^\n]*|#(?!\s*(?:include|if|ifdef|ifndef|define|pragma)\b)[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|'''.*?''')\s*)+)", re.S)
_MARKS = re.compile(r"^[ \t]*(?://[/!]*|#+|/\*+!?|\*+/?)|\*/|\"\"\"|'''", re.M)

#: An encoded run counts if it has at least this many different characters.
ENCODED_VARIETY = 20
_COLUMNS = ("file string, language string, digest bigint, shape bigint, shape_lines long, lines long, chars long, code long, space long, longest long, alnum long, solid long, "
            "separators long, words long, numbers long, encoded long, marker string, seen array<string>")  # fmt: skip


def _split(text: str) -> tuple[str, str]:
    """The comment block at the top, without comment marks, in one line, and the rest."""
    m = _LEADING.match(text)
    return (" ".join(_MARKS.sub(" ", m.group(1)).split()), text[m.end() :]) if m else ("", text)


def header(text: str) -> str:
    return _split(text)[0]


def _lines(text: str, language: str) -> tuple[str, list[str]]:
    """The code without comments and strings, and its lines that are not empty."""
    code = _STRIP[language].sub(lambda m: '""' if m.group()[0] in "\"'" else " ", text)
    lines = [x.strip() for x in code.split("\n")]
    return code, [x for x in lines if x and x != '""']


def _shapes(lines: list[str]) -> Counter:
    return Counter(_hash(_DIGITS.sub("9", x)) for x in lines if len(x) > 12)


def row_statistics(text: str, language: str) -> tuple:
    code, lines = _lines(text, language)
    shapes = Counter(_DIGITS.sub("9", x) for x in lines if len(x) > 12)
    shape, times = max(shapes.items(), key=lambda x: (x[1], x[0]), default=("", 0))
    runs = [m for m in _ENCODED.findall(text) if len(set(m)) >= ENCODED_VARIETY]
    return (
        _hash(shape), times, len(lines), len(text), sum(map(len, lines)),
        sum(len(x) - sum(map(len, x.split())) for x in lines), max(map(len, lines), default=0),
        len(_NOT_ALNUM.sub("", code)), sum(len(x) for x in code.split()),
        code.count(";") + code.count(",") + code.count("{"),
        len(_WORD.findall(code)), len(_NUMBER.findall(code)), sum(map(len, runs)),
    )


def _hash(shape: str) -> int:
    return xxhash.xxh64_intdigest(shape.encode("utf-8", "surrogatepass")) - (1 << 63)


def _tops(chunks: DataFrame) -> DataFrame:
    """The rows that may hold a file's header."""
    return spread(chunks.where("file is not null and text is not null and start_line <= 1").select("file", "text"))


def contexts(chunks: DataFrame) -> DataFrame:
    """(file, word, pattern, fits): each word of the headers with the words around it; whether it may be a foreign name by its form.

    Numbers count as one word; words of the file's own name are no foreign ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                top = header(text)
                if not top:
                    continue
                named = set(_PLAIN.findall(file.rpartition("/")[2].lower()))
                t = ["^", "^", *("9" if x[0].isdigit() else x for x in _TOKEN.findall(top)), "$", "$"]
                for k in range(2, len(t) - 2):
                    w = t[k]
                    fits = _NAME.fullmatch(w) is not None and w not in named
                    rows += [(file, w, f"{t[k - 2]} {t[k - 1]} _ {t[k + 1]}", fits), (file, w, f"{t[k - 1]} _ {t[k + 1]} {t[k + 2]}", fits)]
            columns = [[r[c] for r in rows] for c in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.bool_()))], names=["file", "word", "pattern", "fits"])

    return _tops(chunks).mapInArrow(run, "file string, word string, pattern string, fits boolean")


def pattern_counts(chunks: DataFrame) -> DataFrame:
    """(pattern, word, n, fits) over all headers; the names of projects, first parts of paths, are no foreign ones."""
    counts = contexts(chunks).groupBy("pattern", "word").agg(F.count(F.lit(1)).alias("n"), F.max("fits").alias("fits"))
    projects = checkpointed(chunks.where("file is not null").select(F.substring_index("file", "/", 1).alias("word")).distinct())
    marked = counts.join(broadcast_if_small(projects.withColumn("own", F.lit(True))), "word", "left")
    return marked.select("pattern", "word", "n", (F.col("fits") & F.col("own").isNull()).alias("fits"))


def slots(counts: DataFrame) -> DataFrame:
    """(pattern, word) of the names in the patterns that are slots, from (pattern, word, n, fits)."""
    total = counts.groupBy("pattern").agg(F.sum("n").alias("total"))
    rows = counts.join(total, "pattern").withColumn("name", F.col("fits") & (F.col("n") <= SLOT_ONE * F.col("total")))
    good = rows.where("name").groupBy("pattern", "total").agg(F.count(F.lit(1)).alias("names"), F.sum("n").alias("named"))
    good = good.where((F.col("names") >= SLOT_NAMES) & (F.col("named") >= SLOT_ALL * F.col("total"))).select("pattern")
    return rows.where("name").join(good, "pattern", "left_semi").select("pattern", "word")


def _statistics(words: frozenset):
    """The statistics of rows; seen: which of the words stand in the row outside its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _COLUMNS.split(", ")]
        types = [pa.string(), pa.string(), *[pa.int64()] * 14, pa.string(), pa.list_(pa.string())]
        for batch in batches:
            rows = []
            for file, start, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                language, text = claimed(file), text or ""
                top, rest = _split(text) if start is not None and start <= 1 else ("", text)
                marker = next((k for k, m in MARKERS.items() if m.search(top)), None) if top else None
                seen = list(words.intersection(_PLAIN.findall(rest.lower()))) if words else []
                digest = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
                rows.append((file, language, digest, *row_statistics(text, language), marker, seen))
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    return run


_SUMS = ["lines", "chars", "code", "space", "alnum", "solid", "separators", "words", "numbers", "encoded"]


def row_table(chunks: DataFrame, words: frozenset = frozenset()) -> DataFrame:
    """The statistics of each distinct row of a file."""
    rows = spread(chunks.where("file is not null").select("file", "start_line", "text")).mapInArrow(_statistics(words), _COLUMNS)
    return rows.dropDuplicates(["file", "digest", "marker"])


def file_statistics(rows: DataFrame) -> DataFrame:
    """One row per file: the sums over its rows, and its commonest line shape by the commonest of each row."""
    by_shape = rows.groupBy("file", "language", "shape").agg(
        F.sum("shape_lines").alias("shape_lines"), *[F.sum(c).alias(c) for c in _SUMS], F.max("longest").alias("longest"), F.min("marker").alias("marker")
    )
    return by_shape.groupBy("file", "language").agg(
        F.max(F.struct("shape_lines", "shape")).alias("top"), *[F.sum(c).alias(c) for c in _SUMS], F.max("longest").alias("longest"), F.min("marker").alias("marker")
    ).select("*", "top.shape", "top.shape_lines").drop("top")


def _exact_shapes(chunks: DataFrame, undecided: DataFrame) -> DataFrame:
    """(file, shape_lines): how often undecided files have their commonest shape, counted in all their rows."""
    rows = chunks.select("file", "text").where("text is not null").join(broadcast_if_small(undecided.select("file", "shape")), "file").dropDuplicates(["file", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [_shapes(_lines(text, claimed(file))[1])[shape] for file, text, shape in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["file", "shape_lines"])

    return rows.select("file", "text", "shape").mapInArrow(run, "file string, shape_lines bigint").groupBy("file").agg(F.sum("shape_lines").alias("exact"))


#: By language. Of squeezed files: the least mean and longest line, the white space and the share of letters and digits below which they lie.
MEAN_LINE = {"cpp": 200, "python": 150, "jsonnet": 120, "fcl": 150}
LONGEST_LINE = {"cpp": 400, "python": 300, "jsonnet": 200, "fcl": 300}
SQUEEZED_SPACE = {"cpp": 0.12, "python": 0.08, "jsonnet": 0.08, "fcl": 0.065}
SQUEEZED_ALNUM = {"cpp": 0.87, "python": 0.75, "jsonnet": 0.70, "fcl": 0.85}
#: The least share of numeric literals among words of a data table.
DATA_SHARE = {"cpp": 0.8, "python": 0.8, "jsonnet": 0.9, "fcl": 0.8}
#: The least share of lines equal but for digits, of templated output.
TEMPLATE_SHARE = {"cpp": 0.8, "python": 0.85, "jsonnet": 0.8, "fcl": 0.85}
#: Least code characters and separators of a squeezed file, literals of a data table, lines of templated output.
SQUEEZED_CODE, SQUEEZED_SEPARATORS, DATA_NUMBERS, TEMPLATE_LINES = 150, 6, 20, 12
#: Least share of a file's characters in encoded runs of a blob.
ENCODED_SHARE = 0.5
#: A shape with TEMPLATE_SHARE of a file's lines is the commonest of rows with at least this share of them.
SHAPE_FLOOR = 0.6


def _by_language(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in (kv[0], float(kv[1]))])[F.col("language")]


def layout_kind() -> Column:
    """minified, data, generated, or null, from the columns of file_statistics."""
    one = F.lit(1)
    space, alnum = F.col("space") / F.greatest(F.col("code"), one), F.col("alnum") / F.greatest(F.col("solid"), one)
    mean = F.col("code") / F.greatest(F.col("lines"), one)
    numbers = F.col("numbers") / F.greatest(F.col("words") + F.col("numbers"), one)
    return (
        F.when((F.col("numbers") >= DATA_NUMBERS) & (numbers >= _by_language(DATA_SHARE)), "data")
        .when((F.col("encoded") >= ENCODED_SHARE * F.col("chars")) & (F.col("encoded") > 0), "data")
        .when((F.col("lines") >= TEMPLATE_LINES) & (F.col("shape_lines") >= _by_language(TEMPLATE_SHARE) * F.col("lines")), "generated")
        .when(
            (F.col("code") >= SQUEEZED_CODE) & (F.col("separators") >= SQUEEZED_SEPARATORS) & (mean >= _by_language(MEAN_LINE))
            & (F.col("longest") >= _by_language(LONGEST_LINE)) & (space < _by_language(SQUEEZED_SPACE)) & (alnum < _by_language(SQUEEZED_ALNUM)),
            "minified",
        )
    )


def origins(chunks: DataFrame, found: DataFrame, counts: DataFrame, common: DataFrame | None) -> DataFrame:
    """(file, kind, by) of the files whose header or folder tells an origin; by: slot, folder or opening.

    found: files that layout or a marker found; counts: (pattern, word, n, fits); common: words that code has too often to be names.
    """
    if common is not None:
        counts = counts.join(common.withColumn("common", F.lit(True)), "word", "left").withColumn("fits", F.col("fits") & F.col("common").isNull())
    names = checkpointed(slots(counts))
    words = broadcast_if_small(checkpointed(names.select("word").distinct()))
    files = chunks.where("file is not null").select("file").distinct()
    parts = F.split("file", "/")
    steps = files.select("file", F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))).alias("at", "folder"), parts.alias("parts"))
    steps = steps.select("file", F.element_at("parts", F.col("at") + 1).alias("above"), "folder", "at")
    foreign = steps.join(words.withColumnRenamed("word", "folder"), "folder", "left_semi")
    # folders of which several hold foreign names below them hold outside code only; the project's own folder, at the top, is none
    outside = foreign.where("at > 0").groupBy("above").agg(F.countDistinct("folder").alias("n")).where(F.col("n") >= FOLDER_NAMES).select("above")
    in_folder = foreign.select("file").unionByName(steps.where("at > 0").join(broadcast_if_small(checkpointed(outside)), "above", "left_semi").select("file"))
    in_folder = in_folder.unionByName(steps.where(F.col("above").isin(*VENDOR_DIRS)).select("file")).distinct()
    # a slot that libraries with folders stand in tells of copies, any other of tools
    libraries = foreign.select(F.col("folder").alias("word")).distinct()
    labels = names.join(libraries.withColumn("library", F.lit(1)), "word", "left").groupBy("pattern").agg(F.max("library").alias("library"))
    slot = contexts(chunks).where("fits").join(broadcast_if_small(names), ["pattern", "word"]).join(broadcast_if_small(labels), "pattern")
    by_slot = slot.groupBy("file").agg(F.when(F.max("library").isNotNull(), "vendored").otherwise("generated").alias("kind"))
    told = checkpointed(in_folder.select("file", F.lit("vendored").alias("kind"), F.lit("folder").alias("by")).unionByName(by_slot.select("file", "kind", F.lit("slot").alias("by"))))
    return told.unionByName(_by_opening(chunks, files, told.select("file").unionByName(found.select("file")).distinct()))


def _openings(chunks: DataFrame) -> DataFrame:
    """(file, opening): the first words of each file's header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [["9" if x[0].isdigit() else x for x in _TOKEN.findall(header(t))] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(h[:OPENING]) for h in heads], pa.string())], names=["file", "opening"])

    return _tops(chunks).mapInArrow(run, "file string, opening string").where("opening <> ''").distinct()


def _by_opening(chunks: DataFrame, files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose header opens as those mostly do whose ending mostly goes with an origin."""
    ends = files.withColumn("ending", F.regexp_extract("file", _ENDING, 1)).where("ending <> ''")
    flag = F.lit(1).alias("k")
    trusted = lambda rows, key: rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("k", F.lit(0))).alias("has")).where((F.col("n") >= TRUST_FILES) & (F.col("has") >= TRUST_SHARE * F.col("n"))).select(key)
    known = checkpointed(known)
    endings = broadcast_if_small(checkpointed(trusted(ends.join(known.select("file", flag), "file", "left"), "ending")))
    hinted = ends.join(endings, "ending", "left_semi").select("file")
    opened = checkpointed(_openings(chunks))
    openings = broadcast_if_small(checkpointed(trusted(opened.join(hinted.select("file", flag), "file", "left"), "opening")))
    return opened.join(openings, "opening", "left_semi").select("file", F.lit("generated").alias("kind"), F.lit("opening").alias("by"))


def evidence(chunks: DataFrame) -> DataFrame:
    """(file, kind, by): all that tells a file is not hand-written; by: layout, marker, slot, folder or opening."""
    counts = checkpointed(pattern_counts(chunks))
    names = checkpointed(slots(counts).select("word").distinct())
    # the names of tools and libraries; their number is checked before they go along with the scan
    few = names.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = checkpointed(row_table(chunks, frozenset(r[0] for r in names.collect()) if few else frozenset()))
    if few:
        bodies = rows.select(F.explode("seen").alias("word"))
    else:
        spelled = chunks.where("file is not null").select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_PLAIN.pattern), F.lit(0)), F.lower))).alias("word"))
        bodies = spelled.join(names, "word", "left_semi")
    heads = counts.groupBy("word").agg((F.sum("n") / 2).alias("heads"))
    common = bodies.groupBy("word").agg(F.count(F.lit(1)).alias("bodies")).join(heads, "word").where("bodies > heads").select("word")
    stats = checkpointed(file_statistics(rows))
    undecided = stats.where((F.col("lines") >= TEMPLATE_LINES) & (F.col("shape_lines") >= SHAPE_FLOOR * F.col("lines")) & (F.col("shape_lines") < _by_language(TEMPLATE_SHARE) * F.col("lines")))
    undecided = checkpointed(undecided.select("file", "shape"))
    stats = stats.join(_exact_shapes(chunks, undecided), "file", "left").withColumn("shape_lines", F.coalesce("exact", "shape_lines")).drop("exact")
    layout = stats.withColumn("kind", layout_kind()).where("kind is not null").select("file", "kind", F.lit("layout").alias("by"))
    marked = stats.where("marker is not null").select("file", F.col("marker").alias("kind"), F.lit("marker").alias("by"))
    sure = checkpointed(layout.unionByName(marked))
    return sure.unionByName(origins(chunks, sure, counts, checkpointed(common)))


def machine_files(chunks: DataFrame) -> DataFrame:
    """(file, kind, by) of the files that are not hand-written and that parse; what tells most surely first: layout, folder, slot, marker, opening."""
    order = F.create_map(*[F.lit(x) for k, v in enumerate(("layout", "folder", "slot", "marker", "opening")) for x in (v, k)])[F.col("by")]
    found = checkpointed(evidence(chunks).groupBy("file").agg(F.min(F.struct(order.alias("o"), "kind", "by")).alias("e")).select("file", "e.kind", "e.by"))
    rows = chunks.select("file", "symbol", "text").join(broadcast_if_small(found.select("file")), "file", "left_semi")
    return found.join(invalid_files(rows), "file", "left_anti")
