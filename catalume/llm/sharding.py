"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Within each source the rows are shuffled by a seeded hash and ranked; a row's place in the output is its fractional rank
(rank - 0.5) / (rows of the source). Sorting all rows by that fraction interleaves the sources evenly, so any contiguous
cut has the mixture of the whole. Law ``rows``: shard sizes differ by one row at most.

No source is sorted in one task: both rankings run inside hash or fraction buckets, whose number follows the rows, and bucket
totals carry the ranks.

Defined results: null texts have size 1 and the checksum of no bytes; null sources form a source of their own; groups of
equal texts are spread like other rows, as the law counts rows; a null doc_id is placed like any other; rows that are equal
in every column may swap places among themselves; texts of any length are measured whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.llm.common import load, lots, running_start, source_key


def interleave(docs: DataFrame, shards: int = 8, seed: int = 7, buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of ``docs`` (doc_id, text, source)."""
    buckets = buckets or lots(docs.count())
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        source_key(F.col("source")).alias("_source"),
    )
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_crc32"), F.col("size"))
    rows = rows.withColumn("_draw", draw).withColumn("_lot", F.shiftright("_draw", 64 - (buckets - 1).bit_length()))
    one = F.lit(1).cast("long")
    order = ["_draw", "doc_id", "text_crc32", "size"]
    ranked = running_start(rows, ["_source"], "_lot", order, one, "_rank")
    counts = rows.groupBy("_source").agg(F.count("*").alias("_n"))
    placed = ranked.join(F.broadcast(counts) if _few(counts) else counts, "_source")
    placed = placed.withColumn("_at", (F.col("_rank") + F.lit(0.5)) / F.col("_n"))
    placed = placed.withColumn("_band", F.floor(F.col("_at") * buckets))
    placed = running_start(placed, [], "_band", ["_at", *order, "_source"], one, "_place")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_all"))
    placed = placed.crossJoin(F.broadcast(total))  # one row
    shard = F.expr(f"cast(_place * {shards} div _all as int)")
    first = F.expr(f"(cast(shard as bigint) * _all + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_place") - first).cast("long").alias("slot")
    )


def _few(counts: DataFrame, limit: int = 10_000) -> bool:
    """True if there are at most ``limit`` sources, so that their counts may be broadcast."""
    return counts.limit(limit + 1).count() <= limit


def op7_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(load(spark, sf_dir, "doc_id", "text", "source"))
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)
