"""Vector compression by product codebooks of integers.

A vector's components become integers floor(scale * x) and are cut into equal consecutive parts; each part is written as the
index of its nearest codebook entry. Codebooks, one for each part, have at most ``entries`` rows of integers: their size does
not depend on the number of vectors, so they are broadcast. A task reads Arrow batches, computes all squared distances as
|x|^2 - 2 x.c + |c|^2 with 64-bit integer matrix products and takes the first smallest. In a training round each task keeps
one sum for each part, entry and position; those of all tasks are merged by a grouped shuffle and the driver gets one number
for each component of the codebooks. Sums of errors by label are merged before they are shuffled; they go back to the rows by
broadcast while there are at most ``few`` labels, else by a join on salted labels.

Defined results: null vectors and those that hold a null, NaN or infinite component are dropped; the length of the vectors is
that of the smallest vec_id (null last) that is kept, and a vector of another length keeps its row with null code and error; a
length that the parts do not divide, or components beyond +-2**27 after scaling, raise ValueError; rows with one vec_id are
separate vectors, and of equal ids the smaller vector comes first; with fewer kept rows than ``entries`` codebooks are shorter; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.llm.common import Scratch, load

LARGEST = 1 << 27


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector has finite components only."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vector").isNotNull() & finite)


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(values.astype(np.float64) * scale)
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST / scale:g} cannot be coded exactly")
    return scaled.astype(np.int64)


class Codebooks:
    """``tables``: parts x entries x width integers."""

    def __init__(self, tables: np.ndarray):
        self.tables, self.norms = tables, (tables * tables).sum(2)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.tables.reshape(-1).tolist())).encode()).hexdigest()

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """parts x rows: the first nearest entry of each part of each vector, and its squared distance."""
        parts, _, width = self.tables.shape
        at, far = np.zeros((parts, len(vectors)), np.int64), np.zeros((parts, len(vectors)), np.int64)
        for p in range(parts):
            x = vectors[:, p * width : (p + 1) * width]
            found = self.norms[p] - 2 * (x @ self.tables[p].T)
            at[p] = found.argmin(1)
            far[p] = (x * x).sum(1) + found[np.arange(len(x)), at[p]]
        return at, far


def matrices(batch: pa.RecordBatch, length: int, scale: int, rows: int = 8192):
    """Runs of the batch: which rows have ``length`` components, and these as a matrix of integers."""
    for lo in range(0, batch.num_rows, rows):
        run = batch.slice(lo, rows)
        lists = run.column("vector")
        fits = np.diff(lists.offsets.to_numpy()) == length
        yield run, fits, integers(lists.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False), scale).reshape(int(fits.sum()), length)


def first_codebooks(rows: DataFrame, parts: int, entries: int, scale: int) -> Codebooks | None:
    """From the vectors of the smallest vec_ids; None if there are no vectors."""
    found = [r.vector for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()]
    if not found:
        return None
    length = len(found[0])
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    whole = integers(np.array([v for v in found if len(v) == length], float), scale)
    return Codebooks(np.ascontiguousarray(whole.reshape(len(whole), parts, length // parts).transpose(1, 0, 2)))


def improved(rows: DataFrame, books: Codebooks, scale: int) -> Codebooks:
    """One round: each entry becomes the mean, rounded down, of the parts that are nearest to it."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.tables.shape

    def task(batches):
        own = shared.value
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, _, vectors in matrices(batch, parts * width, scale):
                at, _ = own.nearest(vectors)
                for p in range(parts):
                    order = np.argsort(at[p], kind="stable")
                    used, start, n = np.unique(at[p][order], return_index=True, return_counts=True)
                    if width:
                        sums[p, used] += np.add.reduceat(vectors[order, p * width : (p + 1) * width], start, axis=0) if len(used) else 0
                    counts[p, used] += n
        p, e = np.nonzero(counts)
        for i in range(width):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (p, e, np.full(len(p), i), sums[p, e, i], counts[p, e])], ["part", "entry", "position", "total", "n"])

    found = rows.select("vector").mapInArrow(task, "part long, entry long, position long, total long, n long")
    merged = found.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    tables = books.tables.copy()
    for r in merged.collect():  # parts x entries x width rows at most
        tables[r.part, r.entry, r.position] = r.total // r.n
    return Codebooks(tables)


def train(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """Codebooks of ``rows`` (vec_id, vector); None if no vector is usable."""
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hex digits, so entries must be 1 to 256")
    rows = usable(rows)
    books = first_codebooks(rows, parts, entries, scale)
    for _ in range(rounds if books else 0):
        books = improved(rows, books, scale)
    return books


def encode(rows: DataFrame, books: Codebooks, scale: int = 256) -> DataFrame:
    """``rows`` (vec_id, vector, label) that are usable, as vec_id, label, code (hex), error."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, _, width = books.tables.shape
    digits = np.array([f"{i:02x}" for i in range(256)], "S2")

    def task(batches):
        own = shared.value
        for batch in batches:
            for run, fits, vectors in matrices(batch, parts * width, scale):
                at, far = own.nearest(vectors)
                text = np.ascontiguousarray(digits[at.T]).view(f"S{2 * parts}").reshape(-1).astype(str).tolist()
                place = np.where(fits, np.cumsum(fits) - 1, -1)
                codes = [text[i] if i >= 0 else None for i in place]
                errors = far.sum(0)
                yield pa.RecordBatch.from_arrays(
                    [run.column("vec_id"), run.column("label"), pa.array(codes, pa.string()), pa.array([int(errors[i]) if i >= 0 else None for i in place], pa.int64())],
                    ["vec_id", "label", "code", "error"],
                )

    label = rows.schema["label"].dataType.simpleString()
    return usable(rows).select("vec_id", "label", "vector").mapInArrow(task, f"vec_id long, label {label}, code string, error long")


def decode(codes: DataFrame, books: Codebooks, scale: int = 256) -> DataFrame:
    """``codes`` (code, ...) with ``vector``: the middles of what the entries' integers stand for."""
    shared = codes.sparkSession.sparkContext.broadcast(books)
    names = codes.columns

    def task(batches):
        tables = shared.value.tables
        for batch in batches:
            out = []
            for code in batch.column("code").to_pylist():
                at = np.frombuffer(bytes.fromhex(code), np.uint8) if code is not None else None
                out.append(None if at is None else ((tables[np.arange(len(at)), at].reshape(-1) + 0.5) / scale).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.list_(pa.float64()))], [*names, "vector"])

    return codes.mapInArrow(task, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in codes.schema)}, vector array<double>")


def with_label_error(coded: DataFrame, few: int = 10_000, salts: int = 32) -> DataFrame:
    """``coded`` (label, error, ...), saved, with the sum of error over equal labels; nulls are one label."""
    names = coded.columns
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    if coded.select("label").distinct().limit(few + 1).count() <= few:
        return coded.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("_label"))).select(*names, "label_error")
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int"))
    copies = totals.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_at"))
    return salted.join(copies, on).select(*names, "label_error")


def compress(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of ``rows`` (vec_id, vector, label)."""
    books = train(rows, parts, entries, rounds, scale)
    if books is None:
        return rows.select("vec_id", F.lit(None).cast("string").alias("code"), *(F.lit(None).cast(t).alias(n) for n, t in (("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string")))).limit(0)
    coded = Scratch(rows.sparkSession, "vector-codes").save(encode(rows, books, scale), "codes")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "vec_id", "embedding", "label", table="embeddings")
    return compress(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), "label"))


def _rounds(n: int) -> str:
    """SQL of ``n`` rounds after book0, and of the last assignment."""
    out = []
    for i in range(n + 1):
        out.append(f"""
far{i} AS (SELECT r, x.part, entry, sum((x.v - b.v) * (x.v - b.v))::BIGINT AS d
  FROM cut x JOIN book{i} b ON x.part = b.part AND x.pos = b.pos GROUP BY r, x.part, entry),
near{i} AS (SELECT r, part, entry, d FROM far{i} QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1)""")
        if i < n:
            out.append(f"""
book{i + 1} AS (SELECT b.part, b.entry, b.pos, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN
  (SELECT x.part, entry, pos, ((sum(x.v) - ((sum(x.v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS v
   FROM cut x JOIN near{i} n ON x.r = n.r AND x.part = n.part GROUP BY x.part, entry, pos) m
  ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)""")
    return ",".join(out)


OP11_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
spread AS (
  SELECT r, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // 16 AS w FROM kept),
cut AS MATERIALIZED (SELECT r, i // w AS part, i % w AS pos, floor(256 * x::DOUBLE)::BIGINT AS v FROM spread),
book0 AS (SELECT part, r AS entry, pos, v FROM cut WHERE r < 64),{_rounds(2)},
whole AS (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book2) AS codebooks_sha256
FROM whole JOIN kept USING (r)
"""
