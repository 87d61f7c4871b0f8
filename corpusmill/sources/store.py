"""Versioned index tables with an atomic pointer.

A build goes into a fresh directory <alias>__<fingerprint>__<epoch>_<random>; the
pointer file of the alias is replaced only when it is complete, so readers see
the old or the new version and never a part. Equal fingerprints are not built
again. A failed build is removed. Old versions are collected when they are
neither live nor young.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.sources.paths import Folder

#: Fixed value: seconds that an unreferenced version is kept.
MIN_AGE = 3600


def physical_name(alias: str, fingerprint: str, now: float | None = None) -> str:
    return f"{alias}__{fingerprint}__{int(time.time() if now is None else now)}_{uuid.uuid4().hex[:8]}"


def parse_name(name: str, alias: str) -> tuple[str, int] | None:
    """(fingerprint, epoch) of one of the alias's own versions, else None."""
    m = re.fullmatch(rf"{re.escape(alias)}__([0-9a-f]{{12}})__(\d+)(?:_[0-9a-f]{{8}})?", name)
    return (m[1], int(m[2])) if m else None


def orphans(versions: DataFrame, alias: str, now: int, min_age: int = MIN_AGE) -> DataFrame:
    """Of (name, live): the alias's own versions that are not live and old enough to be removed."""
    pattern = rf"^{re.escape(alias)}__([0-9a-f]{{12}})__([0-9]+)(_[0-9a-f]{{8}})?$"
    own = versions.where(F.col("name").rlike(pattern) & ~F.col("live"))
    parsed = own.select("name", F.regexp_extract("name", pattern, 1).alias("fingerprint"), F.regexp_extract("name", pattern, 2).cast("bigint").alias("created"))
    return parsed.where(F.lit(now) - F.col("created") >= min_age)


class IndexStore:
    """Versions of one alias under a root folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, alias: str):
        self.root, self.alias = Folder(spark, root), alias
        self.pointer = f"{alias}.pointer.json"

    def live(self) -> dict | None:
        """The pointer's content: name and fingerprint."""
        text = self.root.read(self.pointer)
        return json.loads(text) if text else None

    def path(self, version: str | None = None) -> str:
        """The folder of the live version, or of a named older one."""
        name = version or (self.live() or {}).get("name")
        if name is None:
            raise LookupError(f"{self.alias} has no version")
        return self.root / name

    def read(self, spark: SparkSession, table: str, version: str | None = None) -> DataFrame:
        """A table of the live version, or of a named older one."""
        return spark.read.parquet(f"{self.path(version)}/{table}")

    def rebuild(self, fingerprint: str, build: Callable[[str], None], force: bool = False) -> str:
        """Builds a version with build(path) and points to it; gives the live name. Equal fingerprints are skipped."""
        now = self.live()
        if now and now["fingerprint"] == fingerprint and not force:
            return now["name"]
        name = physical_name(self.alias, fingerprint)
        try:
            self.root.make(name)
            build(self.root / name)
            self.root.write(self.pointer, json.dumps({"name": name, "fingerprint": fingerprint}))
        except BaseException:
            if (self.live() or {}).get("name") != name:
                self.root.remove(name)
            raise
        self.collect()
        return name

    def collect(self, min_age: int = MIN_AGE, now: float | None = None) -> list[str]:
        """Removes versions that are not live and old enough; what cannot be removed is left for the next time."""
        live, at, gone = (self.live() or {}).get("name"), time.time() if now is None else now, []
        for name in self.root.names():
            parsed = parse_name(name, self.alias)
            if parsed and name != live and at - parsed[1] >= min_age:
                try:
                    if self.root.remove(name):
                        gone.append(name)
                except Exception:
                    pass
        return sorted(gone)
