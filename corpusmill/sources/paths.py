"""Small files and folders on any file system that Spark reads, by its own file system layer."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder that driver and executors share: local, mounted or of any scheme Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        given = self._jvm.org.apache.hadoop.fs.Path(str(path))
        self._fs = given.getFileSystem(self._conf)
        self.path = self._fs.makeQualified(given).toString()
        self._fs.mkdirs(given)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def __truediv__(self, name: str) -> str:
        return f"{self.path}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("")))

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._at(name))

    def remove(self, name: str) -> bool:
        return self._fs.delete(self._at(name), True)

    def read(self, name: str) -> str | None:
        """The text of a file, None if it is not there."""
        if not self.exists(name):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replaces a file at once: readers see the old or the new text."""
        temporary = f".{name}.{uuid.uuid4().hex}.tmp"
        if self.path.startswith("file:"):
            base = self._jvm.java.net.URI(self.path).getPath()
            with open(os.path.join(base, temporary), "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(os.path.join(base, temporary), os.path.join(base, name))
            return
        stream = self._fs.create(self._at(temporary), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        over = spark_array(self._jvm, options, options.OVERWRITE)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf).rename(self._at(temporary), self._at(name), over)


def spark_array(jvm, kind, *values):
    """A Java array of a few values."""
    from pyspark import SparkContext

    array = SparkContext._gateway.new_array(kind, len(values))
    for k, v in enumerate(values):
        array[k] = v
    return array
