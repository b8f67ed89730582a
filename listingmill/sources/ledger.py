"""Numbered JSON entries in a folder: a new one appears whole, under a name that must be free, and never changes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str = ""):
        """A path below the folder and its file system, any that Hadoop opens."""
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self._conf)

    def names(self, name: str = "") -> list[str]:
        path, files = self.path(name)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.names() if n.endswith(".json") and not n.startswith("."))

    def read(self, number: int) -> dict:
        path, files = self.path(f"{number}.json")
        stream = files.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, number: int, entry: dict) -> None:
        """Written aside, then given its name; a second writer of the number fails."""
        path, files = self.path(f"{number}.json")
        aside, _ = self.path(f".{number}-{uuid.uuid4().hex}")
        out = files.create(aside, False)
        try:
            out.write(bytearray(json.dumps(entry), "utf-8"))
        finally:
            out.close()
        if files.exists(path) or not files.rename(aside, path):
            files.delete(aside, False)
            raise RuntimeError(f"entry {number} of {self.folder} was made by another writer")

    def delete(self, name: str) -> bool:
        path, files = self.path(name)
        return bool(files.delete(path, True))
