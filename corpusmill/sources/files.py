"""Files, JSON lines, reports and sinks."""

from __future__ import annotations

import json
import os
import subprocess
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpusmill.schema import CHUNK
from corpusmill.sources.store import IndexStore


def git_files(root: str, subdirs: list[str] | None = None) -> list[str]:
    """Tracked paths that are present on disk, relative to the root."""
    out = subprocess.run(["git", "-C", root, "ls-files", "-z", "--", *(subdirs or [])], check=True, capture_output=True).stdout
    return [p for p in out.decode("utf-8", "surrogateescape").split("\0") if p and os.path.isfile(os.path.join(root, p))]


def sync_repository(url: str, dest: str, pull: bool = True) -> None:
    """A shallow clone, or a fetch and hard reset of one that is there."""
    if not os.path.isdir(os.path.join(dest, ".git")):
        subprocess.run(["git", "clone", "--depth", "1", url, dest], check=True)
    elif pull:
        subprocess.run(["git", "-C", dest, "fetch", "--depth", "1", "origin", "HEAD"], check=True)
        subprocess.run(["git", "-C", dest, "reset", "--hard", "FETCH_HEAD"], check=True)


def source_files(spark: SparkSession, root: str, paths: list[str] | None = None, repo: str | None = None) -> DataFrame:
    """(path, text) of the files under a root; bad UTF-8 is replaced, paths are relative, behind the repository's name if given.

    With paths (the tracked files) only those stay.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = Path(root).resolve().as_uri().rstrip("/") + "/"
    relative = F.url_decode(F.replace(F.replace(F.regexp_replace("path", "^file:/+", "file:///"), F.lit(base), F.lit("")), F.lit("+"), F.lit("%2B")))
    rows = files.select(relative.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")).where(~F.col("path").startswith(".git/"))
    if paths is not None:
        tracked = spark.createDataFrame([(p,) for p in paths], "path string")
        rows = rows.join(tracked, "path", "left_semi")
    return rows.withColumn("path", F.concat(F.lit(repo + "/"), "path")) if repo else rows


def _published(spark: SparkSession, path: str) -> IndexStore:
    parent, _, name = path.rstrip("/").rpartition("/")
    return IndexStore(spark, parent or ".", name)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = CHUNK) -> DataFrame:
    """One object per line, blank lines skipped; absent fields are null. A path that write_jsonl published is its last version."""
    store = _published(spark, path)
    return spark.read.schema(schema).json(store.path() if store.live() else path)


def read_reports(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Reports (a JSON object per file), tagged with their models."""
    out = None
    for model, path in paths.items():
        one = spark.read.option("multiLine", "true").json(path).withColumn("model", F.lit(model))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no reports")
    return out


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in a fresh folder beside the path, whose pointer is replaced when it is complete: readers find the old or the new rows."""
    _published(df.sparkSession, path).rebuild(uuid.uuid4().hex[:12], lambda folder: df.write.mode("overwrite").json(folder), force=True)


def write_report(rows: DataFrame, folder: str, name: str, title: str, now: float | None = None) -> tuple[str, str]:
    """A timestamped pair of JSON and Markdown files, all rows of a result table, a row at a time on the driver."""
    stamp = time.strftime("%Y%m%d_%H%M%S", time.gmtime(now))
    Path(folder).mkdir(parents=True, exist_ok=True)
    as_json, as_text = os.path.join(folder, f"{name}_{stamp}.json"), os.path.join(folder, f"{name}_{stamp}.md")
    columns = rows.columns
    with open(as_json, "w", encoding="utf-8") as j, open(as_text, "w", encoding="utf-8") as t:
        j.write(f'{{"title": {json.dumps(title)}, "rows": [')
        t.write(f"# {title}\n\n| " + " | ".join(columns) + " |\n|" + " - |" * len(columns) + "\n")
        for n, r in enumerate(rows.toLocalIterator()):
            j.write((",\n" if n else "\n") + json.dumps(r.asDict(recursive=True), default=str))
            t.write("| " + " | ".join("" if r[c] is None else str(r[c]).replace("|", "\\|") for c in columns) + " |\n")
        j.write("\n]}\n")
    return as_json, as_text


def write_embed_errors(rows: DataFrame, path: str) -> None:
    """(index, id, file, chars, error) of the chunks that could not be embedded, as JSON lines; rows: id, file, text, error, and index if there is one."""
    index = F.col("index") if "index" in rows.columns else F.lit(None).cast("bigint")
    failed = rows.where("error is not null").select(index.alias("index"), "id", "file", F.length("text").alias("chars"), "error")
    write_jsonl(failed, path)


def ensure_chunks(spark: SparkSession, path: str, build) -> DataFrame | None:
    """The chunk file at path, built from build() if it is missing; None, with a warning, if that fails."""
    if not os.path.exists(path) and not _published(spark, path).live():
        try:
            write_jsonl(build(), path)
        except Exception as e:
            import warnings

            warnings.warn(f"chunk file could not be built: {e}", stacklevel=2)
            return None
    return read_jsonl(spark, path)
