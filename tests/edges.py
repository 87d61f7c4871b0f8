"""Data directories with empty tables, and with null and repeated rows and columns of clashing names."""

import os

import duckdb

CLASHING = ("doc", "q", "rank", "score", "term", "tf", "dl", "key", "code", "hour", "kind", "t", "_p", "conv")


def empty_tables(sf_dir: str, out: str) -> str:
    os.makedirs(out, exist_ok=True)
    for f in os.listdir(sf_dir):
        duckdb.sql(f"copy (select * from '{sf_dir}/{f}' limit 0) to '{out}/{f}' (format parquet)")
    return out


def dirty_tables(sf_dir: str, out: str, rows: int = 40) -> str:
    """Some rows twice, and for each column a row in which it is null."""
    os.makedirs(out, exist_ok=True)
    for f in os.listdir(sf_dir):
        columns = [c[0] for c in duckdb.sql(f"describe select * from '{sf_dir}/{f}'").fetchall()]
        some = f"(select * from '{sf_dir}/{f}' limit {rows})"
        parts = [f"select * from {some}"] * 2 + [f"(select * replace (null as {c}) from {some} limit 3)" for c in columns] + [f"(select * replace ({', '.join(f'null as {c}' for c in columns)}) from {some} limit 2)"]
        new = "".join(f", 'x' as {c}" for c in CLASHING if c not in columns)
        duckdb.sql(f"copy (select *{new} from ({' union all '.join(parts)})) to '{out}/{f}' (format parquet)")
    return out
