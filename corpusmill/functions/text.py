"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: the words inside identifiers.
TOKEN = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
#: Code points of an embedding's input and of a prompt's snippet.
EMBED_CHARS, SNIPPET_CHARS = 6000, 2000


def tokens(text: Column) -> Column:
    """Lower-case words of identifiers: capitals before a word, words, capitals, digits; ASCII only."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def extension(path: Column) -> Column:
    """From the last dot of the base name; '' without one or for a dot file."""
    return F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def slug(name: Column, default: str = "researcher") -> Column:
    plain = F.regexp_replace(F.lower(F.trim(name)), "[^a-zA-Z0-9]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(plain, "^_+|_+$", ""), F.lit("")), F.lit(default))


def without_mentions(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<@[^>]+>", ""))


def embed_input(text: Column) -> Column:
    return F.substring(text, 1, EMBED_CHARS)


def snippet(text: Column) -> Column:
    return F.substring(text, 1, SNIPPET_CHARS)


def module(path: Column, repo: str) -> Column:
    """The second part of the path if the first is the repository."""
    parts = F.split(path, "/")
    return F.when((F.size(parts) > 1) & (parts[0] == repo), parts[1])


def symbol_of_id(id_: Column, file: Column) -> Column:
    """The id without its file before and its line behind."""
    return F.regexp_replace(F.substr(id_, F.length(file) + 2), "_[^_]*$", "")
