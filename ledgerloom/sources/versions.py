"""Small shared tables with versions: each save is a whole table of its own, made visible by one exclusive file.

A save writes its rows first, then claims the next number by moving a one-line file that names them to ``versions/<number>``,
where a move onto a taken name is refused. So readers see whole versions only, of two writers one is refused, and a lost
executor or driver leaves nothing but unnamed rows. File systems that replace silently (object stores) need one writer.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Somebody else saved first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._p = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        self._fs = self._p().getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last save; 0 before the first."""
        at = self._p("versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def load(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, by default of the last; None if there are none yet."""
        version = version or self.version()
        if not version:
            return None
        name = self.spark.read.text(self._p("versions", f"{version:09d}").toString()).first()["value"]
        return self.spark.read.parquet(f"{self.path}/rows/{name}")

    def save(self, rows: DataFrame, expected: int | None = None) -> int:
        """Stores rows as the next version and returns its number.

        ``expected``: the version that the rows were made from, by default the last one. ``Conflict`` if another followed it."""
        base = self.version() if expected is None else expected
        if self.version() != base:
            raise Conflict(f"version {self.version()} was saved after version {base}")
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/rows/{name}")
        if not self._claim(f"{base + 1:09d}", name):
            self._fs.delete(self._p("rows", name), True)
            raise Conflict(f"version {base + 1} was saved by another writer")
        return base + 1

    def _claim(self, number: str, name: str) -> bool:
        self._fs.mkdirs(self._p("versions"))
        draft = self._p("drafts", name)
        out = self._fs.create(draft, False)
        out.write(bytearray(name.encode()))
        out.close()
        if self._fs.getUri().getScheme() != "file":
            return self._fs.rename(draft, self._p("versions", number))
        local = urlparse(self.path).path  # a local move replaces silently, a link doesn't
        try:
            os.link(f"{local}/drafts/{name}", f"{local}/versions/{number}")
        except FileExistsError:
            return False
        finally:
            self._fs.delete(draft, False)
        return True
