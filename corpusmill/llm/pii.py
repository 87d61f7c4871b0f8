"""Personal information in free text, by bootstrapped contextual extraction.

Candidates are pieces of the right shape. Some are seeds: a number behind a
label, a name behind a title or before an address in angle brackets, an email
address with its sign, a postal address with state and code. Seeds induce lexical
patterns (the words before and after); pattern and instance scores are computed in
turn over the pattern-instance graph by Spark, so that trusted patterns find
identifiers that nothing labels: disguised email addresses, postal addresses of
other countries and of streets without a street's name, plain numbers. The given
and family names and the forms found in them find more in contexts never seen. What
scores high enough comes out with its exact place and can be replaced by a typed
placeholder.

Defined results: null or empty texts hold nothing; documents that come again
under another id are listed under each; overlapping finds keep the best, then
the longest, then the first.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.operators.skew import join_split
from corpusmill.session import BROADCAST_ROWS, checkpointed, spread

KINDS = ("name", "email", "phone", "id_number", "address")
#: Rounds of scoring, and the least score of a find.
ROUNDS = 5
ACCEPT = 0.5

_GAP = r"(?:[ \t]+|[ \t]*\r?\n[ \t]*)"
_CAP = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:['’-][^\W\d_]+)*"
_AT = r"(?:@|[ \t]*(?:\(at\)|\[at\]|\{at\}|<at>)[ \t]*|[ \t]+AT[ \t]+|[ \t]+at[ \t]+(?=[\w-]+(?:[ \t]+dot[ \t]+|[ \t]*[\[(]dot)))"
_DOT = r"(?:\.|[ \t]*(?:\(dot\)|\[dot\]|\{dot\}|<dot>)[ \t]*|[ \t]+(?:dot|DOT)[ \t]+)"
EMAIL = re.compile(rf"(?<![\w.+/@-])[A-Za-z0-9][\w+-]*(?:\.[\w+-]+)*{_AT}[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}\b(?!\.?[\w-]*[:/][\w~/])", re.I)
NUMBER = re.compile(
    r"(?<![\w.,/+-])(?:(?:\+|00)\d{1,3}[ .\-/]?)?(?:\(\d{1,5}\)[ \t]?)?\d[\d .\-/]{4,}\d(?:-[A-Z]\b)?(?:[ \t]*(?:,[ \t]*)?(?:ext(?:ension|n)?\.?|x)[ \t]*\d{1,6})?(?![\w/-]|\.\d)"
    r"|(?<![\w.,/+-])\(\d{2,5}\)[ \t]?\d[\d .\-/]{4,}\d(?:[ \t]*(?:,[ \t]*)?(?:ext(?:ension|n)?\.?|x)[ \t]*\d{1,6})?(?![\w/-]|\.\d)"
    r"|(?<![\w.,/+-])[A-Z]{1,3}[ -]?\d{6,10}[A-Z]?(?![\w/-]|\.\d)",
    re.I,
)
NAME = re.compile(rf"(?<![\w@/.'’-])(?=({_CAP})(?:({_GAP}[^\W\d_a-z]\.)?({_GAP})({_CAP})|,{_GAP}({_CAP})({_GAP}[^\W\d_a-z]\.)?)(?![\w'’@]|-\w))")
# Words that streets end in.
_STREET = r"(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Boulevard|Blvd|Court|Ct|Place|Pl|Square|Sq|Terrace|Way|Close|Crescent|Parkway|Highway|Hwy|Row|Walk|Hill|Gardens)"
_STREET_DE = r"(?:stra(?:ß|ss)e|str\.|weg|allee|platz|gasse|ufer|damm|ring|steig|pfad|markt|graben|chaussee|hof|berg)"
_STREET_FR = r"(?:rue|avenue|boulevard|place|chemin|all[ée]e|impasse|quai|cours|route|square|calle|avenida|plaza|paseo|camino|via|viale|piazza|corso)"
_PREFIX_DE = r"(?:Alte[rs]?|Neue[rs]?|Obere[rs]?|Untere[rs]?|Kleine[rs]?|Gro(?:ß|ss)e[rs]?|Lange[rs]?|Breite[rs]?|Hohe[rs]?|Am|An der|Im|In der|Zum|Zur|Auf dem|Auf der|Hinter dem|Vor dem)"
_SEP = rf"(?:,{_GAP}?|[ \t]*\r?\n[ \t]*)"
_TOWN = r"(?:(?:Bad|Sankt|St\.|Saint|New|San|Santa|Los|Las|La|Le|Les|El)[ \t]+)?[^\W\d_a-z][^\W\d_]+(?:[-'’][^\W\d_]+)*"
ADDRESS = re.compile(
    rf"(?<![\w.,-])\d{{1,5}}[a-zA-Z]?{_GAP}(?:[^\W\d_a-z][\w'’-]*{_GAP}){{1,4}}?(?P<us>{_STREET}\b\.?){_SEP}(?:(?:Apt|Apartment|Suite|Unit|Floor|Flat)\.?[ \t]*#?\w+{_SEP})?{_TOWN}(?:{_GAP}[^\W\d_a-z][a-z]+)?(?:,?{_GAP}[A-Z]{{2}}\.?)?{_GAP}\d{{5}}(?:-\d{{4}})?\b"
    rf"|(?<![\w.,-])\d{{1,5}}(?:[ \t]*(?:bis|ter|[a-z]))?,?{_GAP}(?P<fr>{_STREET_FR})\b{_GAP}(?:[\w'’-]+{_GAP}){{0,4}}?[\w'’-]+{_SEP}\d{{4,5}}{_GAP}{_TOWN}"
    rf"|(?<![\w-])(?:{_PREFIX_DE}[ \t]+)?(?P<de>[^\W\d_a-z][^\W\d_]*(?:-[^\W\d_]+)*{_STREET_DE}|[^\W\d_a-z][^\W\d_]+-?(?:Stra(?:ß|ss)e|Str\.|Weg|Allee|Platz|Gasse)){_GAP}\d{{1,4}}[ \t]?[a-z]?\b{_SEP}(?:D-|A-|CH-)?\d{{4,5}}{_GAP}{_TOWN}"
)
# Weaker forms, without a word that streets have: only their contexts tell.
WEAK_ADDRESS = re.compile(
    rf"(?<![\w.,-])\d{{1,5}}[a-zA-Z]?{_GAP}(?:[^\W\d_a-z][\w'’-]*{_GAP}){{0,3}}[^\W\d_a-z][\w'’-]*{_SEP}{_TOWN}(?:,?{_GAP}[A-Z]{{2}}\.?)?{_GAP}\d{{5}}(?:-\d{{4}})?\b"
    rf"|(?<![\w-])(?:{_PREFIX_DE}[ \t]+)?[^\W\d_a-z][^\W\d_]+(?:[ -][^\W\d_a-z][^\W\d_]+)?{_GAP}\d{{1,4}}[ \t]?[a-z]?\b{_SEP}(?:D-|A-|CH-)?\d{{4,5}}{_GAP}{_TOWN}"
)
# Every form has a code of four or five digits next to a town, every number a run of six digits and marks: what is looked for is looked for there.
_CODE = re.compile(r"\d{4,5}\s+[^\W\d_a-z]|\d{5}(?![\d.])|\d{5}\.(?!\d)")
_FRACTION = re.compile(r"\d+\.\d+")
_DIGITS = re.compile(r"\d[\d .\-/()]{4,}\d")
_AT_SIGN = re.compile(r"@|[(\[{<]at[)\]}>]|[ \t]at[ \t]+[A-Z0-9-]+(?:\.|[ \t]*[(\[{<]dot|[ \t]+dot[ \t])", re.I)
_TITLE = re.compile(r"(?:\b(?:Mrs?|Ms|Miss|Mx|Dr|Prof|Professor|Herr|Frau|Mme|M|Sra?|Señora?)\.?(?:[ \t]+(?:Dr|Prof)\.)?)[ \t]+$")
_PHONE_LABEL = re.compile(r"(?:\b(?:tel(?:ephone)?|phone|mobile|cell|fax|call(?: me)?(?: at| on)?|handy|t[ée]l[ée]phone|tel[ée]fono)\b)[ \t]*(?:number|no\.?|nr\.?|:|\.|is)*[ \t:.]*$", re.I)
_ID_LABEL = re.compile(
    r"\b(?:passport|passeport|reisepass|pasaporte|identity card|id card|personalausweis|social security|ssn|social insurance|national insurance|tax id|driver'?s licen[cs]e|id number|id no)\b[ \t]*(?:number|no|nr|card|id|is|#|:|\.)*[ \t:.#]*$",
    re.I,
)
_CONTEXT = re.compile(r"\x02|[^\W\d_]+|\d+|\n|[^\w\s]")
_CALENDAR = frozenset("january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split())

_COLUMNS = ("doc_id bigint, digest bigint, start int, stop int, hint string, found string, seed string, shape string, left_words string, left_caps string, "
            "right_words string, around string, given string, family string, reversed boolean")  # fmt: skip


def _words(text: str) -> list[str]:
    """Words, numbers, marks and line breaks; an email address is one word."""
    if _AT_SIGN.search(text):
        text = EMAIL.sub(" \x02 ", text.replace("\x02", " "))
    return _CONTEXT.findall(text)


def _context(text: str, start: int, end: int, marks: bool = False) -> tuple[str, str, str, str]:
    """The contexts of a place; with marks, those that consist of marks and capitals only say something too."""
    before, after = text[max(0, start - 90) : start], text[end : end + 90]
    left, right = _words(before)[-2:], _words(after)[:2]

    def plain(t: str) -> str:
        return "<email>" if t == "\x02" else "NL" if t == "\n" else "9" if t.isdigit() else t.casefold()

    def caps(t: str) -> str:
        return "Cap" if t[:1].isupper() else plain(t)

    def telling(tokens: list[str]) -> bool:
        return any(t == "\x02" or t[:1].isalpha() for t in tokens)

    # marks and line breaks alone say nothing about what stands between them
    return (
        " ".join(map(plain, left)) if telling(left) else "",
        " ".join(map(caps, left)) if marks or telling([t for t in left if not t[:1].isupper()]) else "",
        " ".join(map(plain, right)) if telling(right) else "",
        " ".join([*map(plain, left[-1:]), "_", *map(plain, right[:1])]) if telling(left[-1:] + right[:1]) else "",
    )


def _shape(found: str) -> str:
    return re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", " ".join(found.split())))


def _form(found: str) -> str:
    """The marks of an email address, whatever its words are."""
    return "@" if "@" in found else re.sub(r"[\w+-]+", "", re.sub(r"(?i)\b(at|dot)\b", lambda m: {"at": "%", "dot": "&"}[m.group().lower()], found)).replace(" ", "")


def _around(text: str, sign: re.Pattern, before: int, after: int) -> list[tuple[int, int]]:
    """The parts of a text around its signs, joined where they meet; what is looked for holds a sign and goes no further from it than that."""
    out: list[tuple[int, int]] = []
    for m in sign.finditer(text):
        low = m.start() - before
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], m.end() + after)
        else:
            out.append((max(0, low), m.end() + after))
    return out


def candidates(text: str) -> list[tuple]:
    """(start, stop, hint, found, seed, shape, contexts, given, family, reversed) of all pieces of a fitting shape."""
    out: list[tuple] = []
    taken: list[tuple[int, int]] = []
    # no part before the sign is longer than 64 characters, none behind than 255
    for m in (m for part in _around(text, _AT_SIGN, 90, 260) for m in EMAIL.finditer(text, *part)):
        if m.group().casefold().startswith("git@") or text[max(0, m.start() - 6) : m.start()].endswith(("ssh://", "git://")):
            continue
        form = _form(m.group())
        out.append((m.start(), m.end(), "email", m.group(), "email" if form == "@" else None, form, *_context(text, m.start(), m.end(), True), None, None, False))
        taken.append(m.span())
    near = _around(text, _CODE, 400, 200)
    for m in (m for part in near for m in ADDRESS.finditer(text, *part)):
        kind = "us" if m.group("us") else "fr" if m.group("fr") else "de"
        out.append((m.start(), m.end(), "address", m.group(), "address" if kind == "us" else None, kind, *_context(text, m.start(), m.end(), True), None, None, False))
        taken.append(m.span())
    weak = [m.span() for part in near for m in WEAK_ADDRESS.finditer(text, *part)]
    taken.sort()
    starts = [a for a, _ in taken]

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return not (k and any(taken[j][1] > a for j in range(max(0, k - 3), k)))

    for a, b in weak:
        if free(a, b):
            out.append((a, b, "address", text[a:b], None, "weak", *_context(text, a, b), None, None, False))
    for m in (m for part in _around(text, _DIGITS, 12, 80) for m in NUMBER.finditer(text, *part)):
        found = m.group()
        # a decimal fraction is a measure
        if _FRACTION.fullmatch(found) or not free(*m.span()):
            continue
        before = text[max(0, m.start() - 60) : m.start()]
        seed = None
        if _ID_LABEL.search(before):
            seed = "id_number"
        elif _PHONE_LABEL.search(before) or found.startswith("+"):
            seed = "phone"
        out.append((m.start(), m.end(), "number", found, seed, _shape(found), *_context(text, m.start(), m.end()), None, None, False))
    for m in NAME.finditer(text):
        first, middle, _, second, given, initial = m.groups()
        stop = m.end(initial and 6 or given and 5 or 4)
        turned = given is not None
        if turned:
            family = first
        else:
            given, family = first, second
        if len(given) < 2 or len(family) < 2 or given.casefold().rstrip(".") in _TITLES:
            continue
        upper = [w.isupper() for w in (given, family)]
        if upper[0] != upper[1] or not all(u or _PROPER.fullmatch(w) for u, w in zip(upper, (given, family))):
            continue
        start = m.start()
        if not free(start, stop):
            continue
        before, after = text[max(0, start - 24) : start], text[stop : stop + 3]
        seed = "name" if (_TITLE.search(before) or re.search(r"@author[ \t]+$", before) or re.match(r"[ \t]<\S", after)) else None
        # the words of the calendar are names too, but no evidence by themselves
        known = given.casefold() not in _CALENDAR and family.casefold() not in _CALENDAR
        out.append((start, stop, "name", text[start:stop], seed, "" if known else "calendar", *_context(text, start, stop), given.casefold() if known else None, family.casefold() if known else None, turned))
    return out


_PROPER = re.compile(r"[^\W\d_a-z][^\W\d_A-Z]+(?:['’-][^\W\d_a-z]?[^\W\d_A-Z]+)*")
# Titles, which are no part of a name.
_TITLES = frozenset("mr mrs ms miss mx dr prof professor herr frau mme sr sra señor señora".split())


def _candidate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 10, pa.bool_()]
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            digest = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
            rows += [(doc, digest, *c) for c in candidates(text)]
        columns = zip(*rows) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


#: Weight of each sign of an instance; given and family are one sign together.
_SIGNS = {"left_words": 1.0, "left_caps": 0.8, "around": 1.0, "right_words": 0.4}
_EDGES = [*_SIGNS, "shape", "given", "family"]
_FEATURES = ["hint", "seed", "shape", *_SIGNS, "given", "family", "reversed"]
#: How much an instance that is not yet known to be right counts against its pattern.
DOUBT = 0.15
#: What remains of a context's score for a number of a shape not yet seen as its kind.
UNSEEN_SHAPE = 0.6
#: Weight of the form of an email or postal address, and what remains of a calendar word's score as a name.
FORM, CALENDAR = 0.9, 0.75
#: What the form of an email or postal address says by itself: not enough without a context.
FORM_ALONE = 0.45
#: What a known given name says by itself, before a family name never seen: not enough without a context.
GIVEN_ALONE = 0.45


def _edges(state: DataFrame) -> DataFrame:
    """(key, n, a, b, sign, pattern): the signs of each feature row, with its scores as far as it is taken as right; each part of a double family name is one by itself."""
    # only instances that are taken as right speak for a pattern
    right = [F.when(F.col(c) >= ACCEPT, F.col(c)).otherwise(0.0).alias(x) for c, x in (("first", "a"), ("second", "b"))]
    edge = lambda sign, p: F.struct(F.lit(sign).alias("sign"), p.alias("pattern"))
    signs = F.array(*[edge(e, F.col(e)) for e in _EDGES])
    parts = F.transform(F.array_except(F.split("family", "-"), F.array("family")), lambda p: edge("family", p))
    rows = state.select("key", "hint", "n", *right, F.explode(F.concat(signs, F.coalesce(parts, F.array_repeat(edge("family", F.lit("")), 0)))).alias("e"))
    return rows.where("e.pattern is not null and e.pattern <> ''").select("key", "n", "a", "b", F.col("e.sign").alias("sign"), _pattern(F.col("e.sign"), F.col("e.pattern")).alias("pattern"))


def _pattern(sign: Column, value: Column) -> Column:
    return F.concat_ws("\x01", F.col("hint"), sign, value)


def _felt(state: DataFrame, patterns: DataFrame) -> DataFrame:
    """The state with the scores that each sign gives its rows, <sign>_pa and <sign>_pb, 0 without one.

    Few patterns go to the rows, sign by sign, so that no row is shuffled; many are
    joined with the rows' signs, hot ones dealt out.
    """
    scores = [f"{e}_{c}" for e in _EDGES for c in ("pa", "pb")]
    if patterns.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        felt = join_split(_edges(state).select("key", "sign", "pattern"), patterns.drop("sign"), "pattern", "rows", "key")
        each = felt.groupBy("key").agg(*[F.max(F.when(F.col("sign") == e, F.col(c))).alias(f"{e}_{c}") for e in _EDGES for c in ("pa", "pb")])
        out = state.join(each, "key", "left")
    else:
        out = state
        for e in _EDGES:
            of_sign = F.broadcast(patterns.where(F.col("sign") == e).select(F.col("pattern").alias("_p"), F.col("pa").alias(f"{e}_pa"), F.col("pb").alias(f"{e}_pb")))
            out = out.join(of_sign, _pattern(F.lit(e), F.col(e)) == F.col("_p"), "left").drop("_p")
        # a double family name takes the best of its parts and of itself; there are no more such names than patterns
        double = state.where("family like '%-%'").select("hint", "family", F.explode(F.split("family", "-")).alias("part"))
        parts = double.withColumn("_p", _pattern(F.lit("family"), F.col("part"))).join(F.broadcast(patterns.select(F.col("pattern").alias("_p"), "pa", "pb")), "_p")
        best = F.broadcast(parts.groupBy("hint", "family").agg(F.max("pa").alias("_a"), F.max("pb").alias("_b")))
        out = out.join(best, ["hint", "family"], "left").withColumns({"family_pa": F.greatest("family_pa", "_a"), "family_pb": F.greatest("family_pb", "_b")}).drop("_a", "_b")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in scores})


def scored(found: DataFrame) -> DataFrame:
    """(key, first, second, n): for each distinct feature row of the candidates the score as name, email, address or phone, and as id_number."""
    rows = found.groupBy(*_FEATURES).agg(F.count(F.lit(1)).alias("n")).withColumn("key", _key())
    state = checkpointed(rows.withColumns({
        "first": F.when(F.col("seed").isin("name", "phone", "email", "address"), 1.0).otherwise(0.0),
        "second": F.when(F.col("seed") == "id_number", 1.0).otherwise(0.0),
    }))
    columns = state.columns
    for _ in range(ROUNDS):
        doubt = F.sum(F.col("n") * (1 - F.greatest("a", "b"))) * DOUBT + 0.5
        share = lambda mine, other: F.sum(F.col(mine) * F.col("n")) / (F.sum(F.col(mine) * F.col("n")) + F.sum(F.col(other) * F.col("n")) + doubt)
        patterns = checkpointed(_edges(state).groupBy("sign", "pattern").agg(share("a", "b").alias("pa"), share("b", "a").alias("pb"), F.count(F.lit(1)).alias("rows")))

        def combined(c: str) -> Column:
            miss = F.lit(1.0)
            for e, w in _SIGNS.items():
                miss = miss * (1 - w * F.col(f"{e}_{c}"))
            # a weak form says nothing, however many of it are right
            written = F.col("hint").isin("email", "address") & (F.col("shape") != "weak")
            miss = miss * (1 - F.when(written, F.greatest(F.lit(FORM_ALONE if c == "pa" else 0.0), FORM * F.col(f"shape_{c}"))).otherwise(0.0))
            known = F.sqrt(F.col(f"given_{c}") * F.col(f"family_{c}"))
            return 1 - miss * (1 - F.greatest(known, GIVEN_ALONE * F.col(f"given_{c}")))

        # a number of a shape that is never of the kind is damped
        damp = {c: F.when(F.col("hint") == "number", F.least(F.lit(1.0), UNSEEN_SHAPE + 3 * F.col(f"shape_{c}"))).when(F.col("shape") == "calendar", CALENDAR).otherwise(1.0) for c in ("pa", "pb")}
        one = {c: combined(c) * damp[c] for c in ("pa", "pb")}
        seeded = F.col("seed").isNotNull()
        new = _felt(state, patterns).withColumns({"first": F.when(seeded, F.col("first")).otherwise(one["pa"]), "second": F.when(seeded, F.col("second")).otherwise(one["pb"])})
        state = checkpointed(new.select(*columns))
    return state.select("key", "first", "second", "n")


def _key() -> Column:
    """128 bits that tell feature rows apart, nulls from empty strings too."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in _FEATURES]
    return F.unhex(F.md5(F.concat_ws("\x01", *parts)))


_FINDS = "doc_id bigint, digest bigint, kind string, start int, stop int, found string"


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best of overlapping finds of each text."""
    names = [c.split()[0] for c in _FINDS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    for batch in batches:
        rows = []
        for doc, digest, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
            taken: list[tuple[int, int]] = []
            for s in sorted(spans, key=lambda s: (-s["score"], s["start"] - s["stop"], s["start"], s["kind"])):
                if not any(a < s["stop"] and s["start"] < b for a, b in taken):
                    taken.append((s["start"], s["stop"]))
                    rows.append((doc, digest, s["kind"], s["start"], s["stop"], s["found"]))
        columns = zip(*rows) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def finds(documents: DataFrame) -> DataFrame:
    """(doc_id, digest, kind, start, stop, found) of all personal data; places are in code points, stop exclusive."""
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    found = checkpointed(spread(rows).mapInArrow(_candidate_batches, _COLUMNS))
    scores = scored(found)
    number_kind = F.when(F.col("first") >= F.col("second"), "phone").otherwise("id_number")
    name_score = F.round("first", 2) - F.when(F.col("reversed"), 0.005).otherwise(0.0)
    kind = F.when(F.col("hint") == "number", number_kind).otherwise(F.col("hint"))
    # an address that is sure goes before the names and numbers inside it
    score = F.when(F.col("hint") == "name", name_score).when(F.col("hint") == "number", F.greatest("first", "second")).otherwise(F.col("first") + F.when(F.col("shape") == "weak", 0.0).otherwise(1.0))
    guessed = (
        join_split(found.withColumn("key", _key()), scores, "key", "n", "doc_id")
        .withColumn("kind", kind)
        .withColumn("score", score)
        .where(F.col("score") >= ACCEPT + F.when(F.col("hint").isin("email", "address") & (F.col("shape") != "weak"), 1.0).otherwise(0.0))
        .select("doc_id", "digest", "kind", "start", "stop", "found", "score")
    )
    # one text's finds are together no larger than the text
    of_text = guessed.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "stop", "kind", "found", "score")).alias("spans"))
    return of_text.mapInArrow(_resolve, _FINDS)


def found_values(documents: DataFrame) -> DataFrame:
    return finds(documents).select("doc_id", "kind", "found").distinct()


def masked(documents: DataFrame) -> DataFrame:
    """(doc_id, text, n_found): each text with its personal data replaced by [NAME], [EMAIL] and so on."""
    spans = (
        finds(documents)
        .groupBy("doc_id", "digest")
        .agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind"))).alias("spans"))
    )

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            digests = [None if t is None else xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.int64())], names=["doc_id", "text", "digest"])

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if text is None:
                    texts.append(None)
                    continue
                parts, at = [], 0
                for s in marks or ():
                    parts += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
                    at = s["stop"]
                texts.append("".join([*parts, text[at:]]))
            counts = [len(s or ()) for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "text", "n_found"])

    rows = spread(documents.where("doc_id is not null").select("doc_id", "text")).mapInArrow(digested, "doc_id bigint, text string, digest bigint")
    joined = rows.join(spans, ["doc_id", "digest"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(replaced, "doc_id bigint, text string, n_found int")
