"""Small files and folders in the store that holds the tables, through the file system that Spark itself uses."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

A = TypeVar("A")


def retried(act: Callable[[], A], attempts: int = 3, wait: float = 0.5) -> A:
    """The act's result; what fails in the store is tried again, after a wait that doubles."""
    for k in range(1, attempts):
        try:
            return act()
        except (Py4JJavaError, OSError):
            time.sleep(wait * 2 ** (k - 1))
    return act()


class Files:
    def __init__(self, spark: SparkSession):
        self.gateway, self.jvm, self.conf = spark.sparkContext._gateway, spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):  # noqa: ANN202
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def read_text(self, path: str) -> str | None:
        """A small file's text; null if it isn't there."""
        p, fs = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """A small file in the place of what was there: a reader sees the old one or the new one whole."""
        p, fs = self._at(path)
        beside = self.jvm.org.apache.hadoop.fs.Path(f"{path}.next")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        modes = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(modes, 1)
        how[0] = modes.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), self.conf).rename(beside, p, how)

    def children(self, path: str) -> list[str]:
        """The names in a folder; none if it isn't there."""
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)
