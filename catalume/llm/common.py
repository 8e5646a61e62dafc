"""What the operators share: the shared scratch folder, word splitting and word hashing.

Words are maximal runs of characters outside ``[\\x20\\x09-\\x0D]``, which is what ``bytes.split()`` yields.
"""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SPACES = b" \t\n\v\f\r"


def load(spark: SparkSession, sf_dir: str, *columns: str, table: str = "documents") -> DataFrame:
    """The whole table, cut to ``columns``."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which executors and driver share; a local one if unset and Spark is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def free_shuffles(spark: SparkSession) -> None:
    """Has the driver see which shuffles no step needs any more; Spark deletes their files then, and else when the driver's heap is full.
    Python's tables, which stand for those of the driver, go first; the driver hears of that a moment later."""
    gc.collect()
    time.sleep(1)
    spark._jvm.System.gc()


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Deletes at its end what operators called inside have put into the shared folder; their results must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder; it goes with the scope around it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    if _scopes:
        _scopes[-1].append(path)
    return path


class Scratch:
    """Parquet tables in the shared folder. They cut lineage, survive lost executors and are dropped when used up."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, shared_folder(spark, label), 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables that no later step reads."""
        for table in tables:
            if table is not None:
                delete(self.spark, table.scratch_path)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores before those that ``docs`` has already."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches, limit: int = 8 << 20, rows: int = 1 << 20):
    """The record batches, cut so that each has at most ``limit`` bytes of ``text``, or one row, and at most ``rows`` rows."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text").cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            done = int(ends[lo - 1]) if lo else 0
            hi = min(lo + rows, max(lo + 1, int(np.searchsorted(ends, done + limit, "right"))))
            yield batch.slice(lo, hi - lo)
            lo = hi


def ascii_lower(column):
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_caches: dict[str, object] = {}


def cached(name: str, make):
    """The Python worker's cache ``name``; all others are dropped, so a worker that serves several operators holds one."""
    if name not in _caches:
        _caches.clear()
        _caches[name] = make()
    return _caches[name]


class WordHash(dict):
    """word bytes -> 64-bit hash; forgets all words beyond ``limit``, so memory is bounded."""

    def __init__(self, limit: int = 120_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hash() -> WordHash:
    return cached("words", WordHash)


def scramble(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing function, on unsigned integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; of the whole sequence if it is shorter (empty if there is none)."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = np.zeros(n - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out + hashes[i : n - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return scramble(out + np.uint64(width))


def task_count(spark: SparkSession) -> int:
    """Partitions for an explicit repartitioning: the session's shuffle setting, which is how a user sizes a cluster."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def quantile_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts`` - 1 rising integers that cut ``column`` into ranges of about equal row counts (all rows counted)."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(column, shares, max(10_000, 20 * parts)).alias("q")).first()["q"] or []
    return sorted(set(found))


def range_bucket(column, bounds: list[int]):
    """0 for values below bounds[0] (and null), i for values from bounds[i - 1] on. Two short scans instead of a long one."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.lit(bounds[::step])
    at = F.size(F.filter(coarse, lambda x: x <= column))
    fine = F.slice(F.lit(bounds), (at - 1) * step + 1, F.lit(step))
    inner = F.size(F.filter(fine, lambda x: x <= column))
    return F.when(column.isNull() | (at <= 0), 0).otherwise((at - 1) * step + inner).cast("int")


def lots(rows: int, each: int = 100_000, least: int = 256) -> int:
    """How many hash lots, a power of two, hold about ``each`` of ``rows`` rows or fewer: what a sort task gets does not grow."""
    return 1 << max(least - 1, rows // each).bit_length()


def running_start(df: DataFrame, group: list[str], bucket: str, order: list, size, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``size`` over the rows of the same group that come earlier by (bucket, order).

    No group is ever sorted in one task: rows are ordered within (group, bucket), and the buckets' totals, one row each,
    carry the sums across. ``bucket`` must rise with ``order`` and be null-free; group keys must be null-free as well.
    """
    keys = [*group, bucket]
    totals = df.groupBy(*keys).agg(F.sum(size).alias("_total"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_inside", F.sum(size).over(inside) - size).join(bases, keys)
    return out.withColumn(name, F.col("_inside") + F.col("_base")).drop("_inside", "_base")


def source_key(column):
    """A null-free key that keeps null apart from every text."""
    return F.when(column.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), column))
