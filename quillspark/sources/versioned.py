"""Small tables that runs update in place: whole versions, and one pointer that is swapped.

A commit writes a new version beside the others and then renames a new pointer over the old one, which Hadoop's file
contexts do in one step. A reader follows the pointer, so it sees the version before or after, and never half of one; a run that
dies before the swap leaves a folder that nobody points to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspark.sources import files


class VersionedTable:
    """A table at path, on any file system that Spark knows; empty before its first commit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs

    def _at(self, name: str):
        return self._fs.Path(f"{self.path}/{name}")

    def _context(self):
        return self._fs.FileContext.getFileContext(self._at("CURRENT").toUri(), self.spark._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        """The folder of the version that the pointer names."""
        pointer = self._at("CURRENT")
        if not pointer.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(pointer):
            return None
        return f"{self.path}/{self.spark.read.text(f'{self.path}/CURRENT').first()['value']}"

    def read(self) -> DataFrame:
        """The current version; later commits don't change what this frame reads."""
        now = self.current()
        if now is None:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(now)

    def write_version(self, df: DataFrame) -> str:
        """Writes df aside; nobody reads it before point_to."""
        name = f"version-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def point_to(self, name: str) -> None:
        """Makes a written version the current one, in one rename."""
        fs, aside = self._at("CURRENT").getFileSystem(self.spark._jsc.hadoopConfiguration()), self._at(f".pointer-{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray(name.encode()))
        out.close()
        options = self.spark._sc._gateway.new_array(self._fs.Options.Rename, 1)
        options[0] = self._fs.Options.Rename.OVERWRITE
        self._context().rename(aside, self._at("CURRENT"), options)

    def upsert(self, new: DataFrame, key: str, retired: tuple[str, ...] = ()) -> None:
        """The current rows without the keys of new and the retired ones, and new, as the next version. One writer at a time."""
        rows = files.upsert(self.read(), new, key, retired) if self.current() else new
        self.point_to(self.write_version(rows))
