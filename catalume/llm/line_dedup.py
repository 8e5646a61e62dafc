"""Line deduplication against levelled sorted runs of line hashes.

A run is a table of 128-bit hashes of line keys, hash-bucketed and sorted inside each bucket. A batch of documents is
merge-anti-joined with all runs: keys that a run holds are repeats, the others become a run of level 0. When a level has
``fanout`` runs they are compacted into one of the next level, so a batch meets only a logarithmic number of runs, and the
runs, being bucketed, are not shuffled again.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased; keys under ``least`` code points are left
alone. Batches come in ascending doc_id, so of the documents that hold a key the smallest doc_id keeps its lines (all of
them, should it repeat the line) and the others lose theirs.

Defined results: a null or empty text is one empty line; a null doc_id neither owns nor loses lines; rows with one doc_id are
one document; ties do not arise; texts of any length are read whole, a bounded run of texts at a time; an empty table gives
an empty result; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.llm.common import SPACES, Scratch, fresh, load, quantile_bounds, range_bucket, shared_folder, slices, task_count

HASH = ["h1", "h2"]


def line_key(line: bytes, least: int) -> bytes | None:
    """The hash of a line's key, or None if the key is too short."""
    key = line.strip(SPACES).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode()) < least:
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, h1, h2: each key once for each row of ``docs`` (doc_id, text)."""

    def task(batches):
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            counts, found = [], []
            for text in texts:
                own = {line_key(x, least) for x in text.split(b"\n")}
                own.discard(None)
                counts.append(len(own))
                found += own
            pair = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), counts).astype("i8")
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["doc_id", *HASH])

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return known.where("doc_id is not null and text is not null").mapInArrow(task, "doc_id long, h1 long, h2 long")


class LevelledRuns:
    """The runs seen so far. ``add`` takes a batch of line_keys() and returns those that are repeats."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout, self.levels = spark, fanout, []
        self.buckets = buckets or task_count(spark)
        self.name = f"line_runs_{uuid.uuid4().hex[:12]}"
        self.root = shared_folder(spark, "line-runs")
        self.made = 0

    def _write(self, keys: DataFrame) -> str:
        self.made += 1
        table = f"{self.name}_{self.made}"
        dealt = keys.select(*HASH).repartition(self.buckets, *HASH)
        (
            dealt.write.bucketBy(self.buckets, *HASH).sortBy(*HASH)
            .option("path", f"{self.root}/{self.made:03d}").saveAsTable(table)
        )
        return table

    def add(self, keys: DataFrame, scratch: Scratch) -> DataFrame:
        """``keys``: doc_id, h1, h2 of a batch, saved. Returns the rows whose lines go."""
        first = keys.groupBy(*HASH).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
        runs = [t for level in self.levels for t in level]
        old = F.lit(False)
        for i, table in enumerate(runs):
            first = first.join(self.spark.table(table).withColumn(f"in_{i}", F.lit(True)), HASH, "left")
            old = old | F.coalesce(F.col(f"in_{i}"), F.lit(False))
        marked = scratch.save(first.select(*HASH, "owner", "last", old.alias("old")), "marked")
        gone = marked.where("old or last > owner")
        drops = scratch.save(keys.join(gone, HASH).where("old or doc_id > owner").select("doc_id", *HASH), "drops")
        self._push(self._write(marked.where("not old")), 0)
        scratch.drop(marked)
        return drops

    def _push(self, table: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            whole = self.spark.table(merged[0])
            for other in merged[1:]:
                whole = whole.unionByName(self.spark.table(other))
            self._push(self._write(whole), level + 1)
            for used in merged:
                self._forget(used)

    def _forget(self, table: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{int(table.rpartition('_')[2]):03d}")
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        for level in self.levels:
            for table in level:
                self._forget(table)
        self.levels = []


def repeated_lines(docs: DataFrame, least: int = 10, batches: int = 3, fanout: int = 2) -> DataFrame:
    """doc_id, gone_1, gone_2 (parallel arrays of hash halves): the line keys each document loses."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    cuts = quantile_bounds(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", batches)
    keys = line_keys(docs, least).withColumn("batch", range_bucket(F.col("doc_id"), cuts))
    keys = scratch.save(keys, "keys")
    runs, drops = LevelledRuns(spark, fanout), []
    for i in range(len(cuts) + 1):
        drops.append(runs.add(keys.where(F.col("batch") == i).drop("batch"), scratch))
    runs.close()
    scratch.drop(keys)
    gone = drops[0]
    for more in drops[1:]:
        gone = gone.unionByName(more)
    return gone.distinct().groupBy("doc_id").agg(F.collect_list("h1").alias("gone_1"), F.collect_list("h2").alias("gone_2"))


def strip_lines(docs: DataFrame, gone: DataFrame, make, fields: str, columns: list[str]) -> DataFrame:
    """Joins each document with the lines it loses; ``make(batch, kept, n_lines, n_dropped)`` gives the output columns."""

    def task(batches, least=10):
        for batch in slices(batches):
            kept, lines, dropped = [], [], []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, a, b in zip(texts, batch.column(first), batch.column(second), strict=True):
                parts = (text or b"").split(b"\n")
                rest = parts
                if a.is_valid:
                    pair = np.stack([a.values.to_numpy(), b.values.to_numpy()], 1).astype("<i8")
                    own = {p.tobytes() for p in pair}
                    rest = [x for x in parts if line_key(x, least) not in own]
                kept.append(b"\n".join(rest))
                lines.append(len(parts))
                dropped.append(len(parts) - len(rest))
            yield make(batch, kept, lines, dropped)

    key, first, second = fresh(docs, "_id", "_gone_1", "_gone_2")
    gone = gone.select(F.col("doc_id").alias(key), F.col("gone_1").alias(first), F.col("gone_2").alias(second))
    found = docs.select(*columns).join(gone, F.col("doc_id").cast("long") == F.col(key), "left").drop(key)
    return found.mapInArrow(task, fields)


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, text, ...) with repeated lines taken out of the texts; n_chars, if there, follows; null stays null."""
    names = docs.columns

    def make(batch, kept, lines, dropped):
        text = batch.column("text")
        fresh = pa.array([k.decode() if t.is_valid else None for k, t in zip(kept, text, strict=True)], text.type)
        columns = {n: fresh if n == "text" else batch.column(n) for n in names}
        if "n_chars" in columns:
            changed = [len(f) if d else n for f, d, n in zip(fresh.to_pylist(), dropped, columns["n_chars"].to_pylist(), strict=True)]
            columns["n_chars"] = pa.array(changed, columns["n_chars"].type)
        return pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return strip_lines(docs, repeated_lines(docs, **options), make, docs.schema, docs.columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "doc_id", "text")

    def make(batch, kept, lines, dropped):
        sums = [hashlib.sha256(k).hexdigest() for k in kept]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sums)],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )

    fields = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    return strip_lines(docs, repeated_lines(docs), make, fields, ["doc_id", "text"])


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
marked AS (
  SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
