"""Files of a table through Hadoop's file system interface: names and moves only, no content but small notes."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Files:
    """Paths may lie in any store that Spark reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm, self.conf = spark, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """Names in a folder, sorted; none when there is no such folder."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def move(self, source: str, target: str) -> None:
        """Rename; the target's folder is made when missing."""
        fs, p = self._at(source)
        t = self.jvm.org.apache.hadoop.fs.Path(target)
        fs.mkdirs(t.getParent())
        if not fs.rename(p, t):
            raise OSError(f"could not move {source} to {target}")

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def write_note(self, path: str, note: dict) -> None:
        """A small JSON file that is either there whole or not at all."""
        fs, p = self._at(path + ".tmp")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(note).encode()))
        out.close()
        self.move(path + ".tmp", path)

    def read_note(self, path: str) -> dict:
        fs, p = self._at(path)
        source = fs.open(p)
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source)))
        finally:
            source.close()
