"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text is a bag of lower-cased words, weighted by their counts. For each of ``samples`` draws every word has its own random
r, c (Gamma(2, 1)) and b (uniform), all functions of its hash: with t = floor(ln(weight) / r + b) and
ln a = ln c - r * (t - b + 1), the word of least a, with its t, is the sample. Two texts' samples agree with a probability
equal to their generalised Jaccard similarity, sum of least weights over sum of greatest; likeness is the share that agrees.
The random values come from a table of Gamma quantiles, so a sample costs a hash, look-ups and a product.

Words are counted and sampled inside tasks: documents are dealt once, by small ranges of doc_id, and both the counting and
the minima are grouped within a range. A sample is one long, its a in the upper bits, so minima stay in plain columns.

Defined results: null and blank texts hold one empty word; equal texts have equal fingerprints; the next document of the last
is the first; a null doc_id comes before all others; rows with one doc_id follow each other by text, and equal rows may swap;
an only document is its own next; texts of any length are read whole; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalume.llm.common import GAP, load, quantile_bounds, range_bucket, task_count

TABLE = 1024
LANE = 4  # samples computed side by side; more make methods that the JVM no longer compiles
PART_BYTES = 2 << 20


def gamma_quantiles(n: int = TABLE) -> list[float]:
    """The (i + 1/2) / n quantiles of Gamma(2, 1), by bisection of 1 - (1 + x) e^-x."""

    def quantile(p: float) -> float:
        lo, hi = 0.0, 60.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if 1 - (1 + mid) * math.exp(-mid) < p else (lo, mid)
        return (lo + hi) / 2

    return [quantile((i + 0.5) / n) for i in range(n)]


def ranged(docs: DataFrame) -> DataFrame:
    """part, edge, doc_id, _tie, text: dealt by ranges of doc_id; each range also has the first row of the next (``edge``).
    The number of ranges follows the size of the texts, so that what a task counts fits into its memory.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(task_count(docs.sparkSession), size // PART_BYTES)
    rows = rows.withColumn("part", range_bucket(F.col("doc_id"), quantile_bounds(rows, "doc_id", parts))).withColumn("_tie", F.xxhash64("text"))
    first = rows.groupBy("part").agg(F.min(F.struct("doc_id", "_tie")).alias("f"))  # at most ``parts`` rows
    turn = Window.orderBy("part")
    before = F.coalesce(F.lag("part").over(turn), F.max("part").over(Window.partitionBy()))
    edges = first.select("part", "f.doc_id", "f._tie", before.alias("before")).select(*[F.col(c).alias(f"{c}_") for c in ("part", "doc_id", "_tie")], "before")
    own = (F.col("part") == F.col("part_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("_tie") == F.col("_tie_"))
    found = rows.join(F.broadcast(edges), own, "left")
    both = F.array_compact(F.array(F.struct("part", F.lit(False).alias("edge")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("part"), F.lit(True).alias("edge")))))
    dealt = found.withColumn("_to", F.explode(both)).select("_to.part", "_to.edge", "doc_id", "_tie", "text")
    return dealt.repartition(parts, "part")


def samples(words: DataFrame, keys: list[str], count: int, seed: int, lane: int = LANE) -> DataFrame:
    """sig (count longs: ln a, then 16 bits of the sample's hash) for each group of ``keys`` of ``words`` (keys, h, w: a word's hash and its count).

    One 64-bit hash of sample and word gives the quantiles of r and c (10 bits each), b (20 bits) and, with t, the mark.
    """
    quantile = F.array(*[F.lit(x) for x in gamma_quantiles()])
    log_quantile = F.array(*[F.lit(math.log(x)) for x in gamma_quantiles()])
    lanes = words.select(*keys, "h", F.log("w").alias("lw"), F.explode(F.array(*[F.lit(seed + i) for i in range(0, count, lane)])).alias("lane"))
    lanes = lanes.select(*keys, "lane", "lw", *[F.xxhash64(F.col("lane") + i, "h").alias(f"u{i}") for i in range(lane)])
    packed = []
    for i in range(lane):
        u = F.col(f"u{i}")
        r = F.get(quantile, u.bitwiseAND(TABLE - 1).cast("int"))
        c = F.get(log_quantile, F.shiftrightunsigned(u, 10).bitwiseAND(TABLE - 1).cast("int"))
        b = F.shiftrightunsigned(u, 20).bitwiseAND(0xFFFFF) * F.lit(1 / (1 << 20))
        t = F.floor(F.col("lw") / r + b)
        height = F.floor((c - r * (t - b + 1) + 60.0) * F.lit(float(1 << 24)))  # -60 < ln a < 3
        mark = (F.shiftrightunsigned(u, 40) + t * 40503).bitwiseAND(0xFFFF)
        packed.append(F.shiftleft(height, 16).bitwiseOR(mark).alias(f"s{i}"))
    least = lanes.select(*keys, "lane", *packed).groupBy(*keys, "lane").agg(*[F.min(f"s{i}").alias(f"s{i}") for i in range(lane)])
    whole = least.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lane", F.array(*[f"s{i}" for i in range(lane)]).alias("x")))).alias("x"))
    return whole.select(*keys, F.flatten("x.x").alias("sig"))


def likeness(a, b, count: int):
    """The share of equal samples of two signature columns."""
    return F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] == x["b"])) / F.lit(float(count))


def fingerprint(docs: DataFrame, count: int = 128, seed: int = 3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of ``docs`` (doc_id, text)."""
    dealt = ranged(docs)
    turn = Window.partitionBy("part").orderBy("edge", "doc_id", "_tie")
    half = F.floor(F.char_length("text") / 2).cast("int")
    new = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.lead("text").over(turn), F.lit(1), half))
    rows = dealt.select("part", F.row_number().over(turn).alias("row"), "edge", "doc_id", "text", new.alias("edited"))
    texts = rows.select("part", "row", F.posexplode(F.array("text", "edited")).alias("version", "t")).where("t is not null")
    split = F.filter(F.split(F.lower("t"), GAP), lambda w: w != "")
    split = F.when(F.size(split) > 0, split).otherwise(F.array(F.lit("")))
    words = texts.select("part", "row", "version", F.explode(split).alias("word")).select("part", "row", "version", F.xxhash64("word").alias("h"))
    counts = words.groupBy("part", "row", "h").agg(F.count_if(F.col("version") == 0).alias("w0"), F.count_if(F.col("version") == 1).alias("w1"))
    # a word with one count in both texts (which 3) is sampled once for both
    shared, entry = F.col("w0") == F.col("w1"), lambda w, which: F.struct(F.col(w).alias("w"), F.lit(which).alias("which"))
    entries = F.array_compact(F.array(F.when(shared, entry("w0", 3)), F.when(~shared & (F.col("w0") > 0), entry("w0", 1)), F.when(~shared & (F.col("w1") > 0), entry("w1", 2))))
    counts = counts.select("part", "row", "h", F.explode(entries).alias("x")).select("part", "row", "x.which", "h", "x.w")
    signed = samples(counts, ["part", "row", "which"], count, seed).groupBy("part", "row").agg(
        *[F.max(F.when(F.col("which") == i, F.col("sig"))).alias(f"sig{i}") for i in (1, 2, 3)]
    )

    def least(one: str):
        return F.zip_with(F.coalesce(one, "sig3"), F.coalesce("sig3", one), lambda a, b: F.least(a, b).bitwiseAND(0xFFFF).cast("int"))

    signed = signed.select("part", "row", least("sig1").alias("own"), least("sig2").alias("new"))
    said = rows.select("part", "row", "edge", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    after = Window.partitionBy("part").orderBy("row")
    out = signed.withColumn("next", F.lead("own").over(after)).join(said, ["part", "row"]).where("not edge")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", text("own").alias("fingerprint"), text("new").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new"), count).alias("near_edited"), likeness(F.col("own"), F.col("next"), count).alias("near_next"),
    )


def op2_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(load(spark, sf_dir, "doc_id", "text"))
