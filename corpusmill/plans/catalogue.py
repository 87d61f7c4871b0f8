"""All queries of the core and their SQL."""

from __future__ import annotations

from corpusmill.plans import chat, corpus, evals, references, search

MODULES = [references, corpus, search, evals, chat]


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLE.items()}
