"""Tables that streams keep up to date: versioned snapshots behind one pointer, and batches that take effect once.

A table is a folder. Each version is a Parquet folder of its own name, written whole before anyone reads it; the file ``current``
names the version in force and, for each stream, the last batch that is in it. It is replaced by an atomic rename, so a reader sees the
version before or after a write and never half of one, and a batch that is delivered again changes nothing. A crash between writing
and the rename leaves a version nobody points to; the batch is then delivered again and written under another name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class SnapshotTable:
    """``keep`` versions stay readable after the one that replaced them, for readers that have begun. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 2):
        self.spark, self.path, self.schema, self.keep = spark, path.rstrip("/"), schema, keep

    def _hadoop(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def state(self) -> dict:
        """version (None at first), done (stream -> last batch), old (versions that may still be read)."""
        path, fs = self._hadoop("current")
        if not fs.exists(path):
            return {"version": None, "done": {}, "old": []}
        lines = self.spark.read.text(path.toString()).collect()  # one short line
        return json.loads(lines[0].value)

    def read(self) -> DataFrame:
        version = self.state()["version"]
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{version}")

    def _point(self, state: dict) -> None:
        """The file's content is one line; it is written aside and renamed over the old one."""
        jvm, aside = self.spark._jvm, f"next-{uuid.uuid4().hex[:12]}"
        path, fs = self._hadoop(aside)
        out = fs.create(path, True)
        out.write(bytearray((json.dumps(state) + "\n").encode()))
        out.close()
        target, _ = self._hadoop("current")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(path, target, overwrite)

    def write(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
        """``rows`` become the table; False, and nothing happens, if ``batch`` of ``stream`` is in it already."""
        state = self.state()
        if stream is not None and state["done"].get(stream, -1) >= batch:
            return False
        version = f"v-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.path}/{version}")
        old = [v for v in [*state["old"], state["version"]] if v]
        done = state["done"] | ({stream: batch} if stream is not None else {})
        self._point({"version": version, "done": done, "old": old[-self.keep :] if self.keep else []})
        for gone in old[: -self.keep] if self.keep else old:
            path, fs = self._hadoop(gone)
            fs.delete(path, True)
        return True

    def apply(self, stream: str, step: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: the table becomes step(table, batch), once for each batch of ``stream``."""

        def one(batch: DataFrame, number: int) -> None:
            if self.state()["done"].get(stream, -1) < number:
                self.write(step(self.read(), batch), stream, number)

        return one
