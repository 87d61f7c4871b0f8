"""The corpus of several repositories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.operators import corpus
from corpusmill.schema import chunk_errors
from corpusmill.session import checkpointed
from corpusmill.sources.files import git_files, source_files, sync_repository, write_jsonl


class CorpusError(ValueError):
    """The corpus breaks a rule; nothing is published."""


def repeated_ids(chunks: DataFrame) -> DataFrame:
    """(id, n) of ids that stand on more than one row."""
    return chunks.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def repository_chunks(spark: SparkSession, root: str, repo: str, rules: corpus.Rules = ()) -> DataFrame:
    """The numbered chunks of one repository's tracked files; paths and ids begin with its name, a #n stays."""
    files = source_files(spark, root, git_files(root), repo=repo)
    rows = corpus.numbered(corpus.extract(files, rules), [F.col("ord")])
    return rows.select("id", "file", "start_line", "end_line", "symbol", "language", "text")


def build_corpus(spark: SparkSession, urls: Sequence[str], folder: str, out: str, pull: bool = True, rules: corpus.Rules = ()) -> DataFrame:
    """Syncs each repository below a folder, extracts and unites them, and publishes the union if all ids differ and all chunks are valid.

    Gives (repo, chunks) for every repository, those without any too.
    """
    parts, names = None, []
    for url in urls:
        name = url.rstrip("/").rpartition("/")[2].removesuffix(".git")
        sync_repository(url, f"{folder}/{name}", pull)
        one = repository_chunks(spark, f"{folder}/{name}", name, rules).withColumn("repo", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
        names.append((name,))
    if parts is None:
        raise CorpusError("no repositories")
    rows = checkpointed(parts)
    if bad := repeated_ids(rows).first():
        raise CorpusError(f"chunk id {bad['id']} stands on {bad['n']} rows")
    if bad := rows.withColumn("errors", chunk_errors()).where("size(errors) > 0").first():
        raise CorpusError(f"chunk {bad['id']}: {bad['errors']}")
    write_jsonl(rows.drop("repo"), out)
    counted = rows.groupBy("repo").agg(F.count(F.lit(1)).alias("chunks"))
    return spark.createDataFrame(names, "repo string").join(counted, "repo", "left").select("repo", F.coalesce("chunks", F.lit(0)).alias("chunks"))
