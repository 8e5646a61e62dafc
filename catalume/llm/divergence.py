"""Audit of how the sources of a language differ in their words.

Each (language, source) group has a vector of term counts; a language keeps the terms of at least ``least`` of its documents.
With N the group's count over the V kept terms, a term's share is p = 1 + floor(10**9 (count + 1) / (N + V)), and two groups
differ by floor((p - q)^2 / q) summed over all kept terms, each group being measured against each other one of its language. A
term marks a group if its share there is above the language's.

Groups meet by systolic rotation. The terms of a language are dealt by hash into lots of bounded size, its groups into
blocks, and what a block holds of a lot is one compressed row. These rows stay where they are, in a table bucketed by
(language, lot, block). In each round of a round-robin tournament of the blocks, every block has one opponent: one of the two
rows travels to the other's partition and both directions of all their groups are evaluated there. A first meeting is that
of each block with itself, and one more is with the language's own vector, where a heap for each group and lot keeps
its ``top`` terms. Only sums and those terms leave a meeting, so no task holds a whole vector or all groups.

A term that neither group has adds the same value whichever it is, so a meeting looks only at terms of one of the two and
counts the others. All arithmetic is on 64-bit integers: shares by long division in steps of 1,000, which is exact for N + V
under 9 * 10**15; differences stay below 2**62.

Defined results: null text, lang and source are read as ''; every group that occurs is listed, also without terms; a language
without kept terms gives pairs of value 0 and no terms; repeated rows are separate documents; ties are ordered by the UTF-8 of the item;
texts of any length are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalume.llm.common import Scratch, load, shared_folder, slices, task_count

#: Bytes that end a term become spaces, A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
UNIT = 1000


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(10**9 (count + 1) / (total + kept)), exactly."""
    whole = np.int64(max(1, total + kept))
    out, rest = np.divmod(counts.astype(np.int64) + 1, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * UNIT, whole)
        out = out * UNIT + digit
    return out + 1


def differs(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // q


ONCE = 1 << 40  # a document more, above the occurrences


def counted(docs: DataFrame, limit: int = 800_000) -> DataFrame:
    """lang, source, term, n (occurrences), docs: sums over what a task holds until it has ``limit`` of them."""

    def rows(held: dict):
        for (lang, source), own in held.items():
            found, sums = list(own), np.fromiter(own.values(), np.int64, len(own))
            for i in range(0, len(found), 50_000):
                part = sums[i : i + 50_000]
                names = [pa.repeat(pa.scalar(x, pa.string()), len(part)) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(found[i : i + 50_000], pa.binary()), pa.array(part % ONCE), pa.array(part // ONCE)], ["lang", "source", "term", "n", "docs"])

    def task(batches):
        held, size = {}, 0
        for batch in slices(batches, 4 << 20):
            for text, lang, source in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
                own = held.setdefault((lang, source), {})
                before, known = len(own), own.get
                for term, n in Counter(terms(text)).items():
                    own[term] = known(term, 0) + n + ONCE
                size += len(own) - before
                if size >= limit:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    sums = docs.select("text", "lang", "source").mapInArrow(task, "lang string, source string, term binary, n long, docs long")
    return sums.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each of ``keys``: ``held``, an array of (source, total, at, n): the places in the lot, rising, and counts."""
    one = rows.groupBy(*keys, "source", "total").agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "n")))).alias("own"))
    held = F.struct("source", "total", F.col("own.at").alias("at"), F.col("own.n").alias("n"))
    return one.select(*keys, held.alias("held")).groupBy(*keys).agg(F.array_sort(F.collect_list("held")).alias("held"))


class Member:
    """A group's part of a lot: places of its terms, their shares, and the share of a term that it lacks."""

    def __init__(self, held: dict, kept: int, size: int):
        self.source, self.size = held["source"], size
        self.at, self.n = np.array(held["at"], np.int64), np.array(held["n"], np.int64)
        self.share = shares(self.n, held["total"], kept)
        self.none = int(shares(np.zeros(1, np.int64), held["total"], kept)[0])

    def dense(self) -> np.ndarray:
        out = np.full(self.size, self.none, np.int64)
        out[self.at] = self.share
        return out


def meeting(here: list[Member], there: list[Member] | None) -> tuple[list, list, list]:
    """(source, item, value) of both directions of all pairs; ``there`` is None for a block's meeting with itself."""
    out = [], [], []
    mine = [m.dense() for m in here]
    theirs = mine if there is None else [m.dense() for m in there]
    for i, a in enumerate(here):
        for j, b in enumerate(there or here):
            if there is None and j <= i:
                continue
            if 2 * (len(a.at) + len(b.at)) < a.size:
                seen = np.union1d(a.at, b.at)
                p, q = mine[i][seen], theirs[j][seen]
            else:
                p, q = mine[i], theirs[j]
            rest = a.size - len(p)
            for x, y, px, qx, nx, ny in ((a, b, p, q, a.none, b.none), (b, a, q, p, b.none, a.none)):
                out[0].append(x.source)
                out[1].append(y.source)
                out[2].append(int(differs(px, qx).sum()) + rest * ((nx - ny) * (nx - ny) // ny))
    return out


def opponent(block, blocks, turn: int):
    """The block that ``block`` of 0 .. ``blocks`` - 1 meets in round ``turn``, by the circle method; ``blocks`` or more: none."""
    last = blocks + blocks % 2 - 1
    other = F.pmod(F.lit(2 * turn) - block, last)
    return F.when(block == last, F.lit(turn)).when(other == block, last).otherwise(other)


def pair_values(blocks: DataFrame, rounds: int) -> list[DataFrame]:
    """lang, source, item, value by lot: of each block with itself, then of each round. ``blocks`` is the bucketed table."""
    fields = "lang string, source string, item string, value long"

    def evaluate(batches):
        for batch in batches:
            own = batch.column("held")
            other = batch.column("visitor") if "visitor" in batch.schema.names else None
            for i, (lang, kept, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "kept", "size")), strict=True)):
                here = [Member(h, kept, size) for h in own[i].as_py()]
                there = [Member(h, kept, size) for h in other[i].as_py()] if other is not None else None
                source, item, value = meeting(here, there)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "item", "value"])

    out = [blocks.select("lang", "kept", "size", "held").mapInArrow(evaluate, fields)]
    for turn in range(rounds):
        other = opponent(F.col("block"), F.col("blocks"), turn)
        meets = (turn < F.col("blocks") + F.col("blocks") % 2 - 1) & (other < F.col("blocks"))
        # of the two, the higher block travels where both are even or both odd, else the lower one
        travels = F.when((F.col("block") + other) % 2 == 0, F.col("block") > other).otherwise(F.col("block") < other)
        visitors = blocks.where(meets & travels).select("lang", "lot", other.alias("block"), F.col("held").alias("visitor"))
        met = blocks.join(visitors.hint("merge"), ["lang", "lot", "block"])
        out.append(met.select("lang", "kept", "size", "held", "visitor").mapInArrow(evaluate, fields))
    return out


def marking_terms(blocks: DataFrame, lots: DataFrame, top: int) -> DataFrame:
    """lang, source, item, value: for each group and lot its ``top`` terms whose share is above the language's."""

    def task(batches):
        for batch in batches:
            own, words = batch.column("held"), batch.column("terms")
            for i, (lang, kept, total, counts) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "kept", "lang_total", "counts")), strict=True)):
                q, out = shares(np.array(counts, np.int64), total, kept), ([], [], [])
                for held in own[i].as_py():
                    member = Member(held, kept, len(counts))
                    base = q[member.at]
                    above = np.flatnonzero(member.share > base)
                    values = differs(member.share[above], base[above])
                    if len(values) > top:  # those that may be among the first, with their ties
                        some = values >= np.partition(values, len(values) - top)[len(values) - top]
                        above, values = above[some], values[some]
                    found = zip((-values).tolist(), (words[i][int(k)].as_py() for k in member.at[above]), strict=True)
                    for value, term in heapq.nsmallest(top, found):
                        out[0].append(member.source)
                        out[1].append(term)
                        out[2].append(-value)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out[0]), pa.string()), pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], ["lang", "source", "item", "value"])

    met = blocks.join(lots.hint("merge"), ["lang", "lot"]).select("lang", "kept", "lang_total", "held", "terms", "counts")
    return met.mapInArrow(task, "lang string, source string, item binary, value long")


def ranked(rows: DataFrame, part: str, top: int | None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    out = rows.withColumn("rank", F.row_number().over(order))
    out = out if top is None else out.where(F.col("rank") <= top)
    return out.select("lang", "source", F.lit(part).alias("part"), F.col("item").cast("string").alias("item"), "value", "rank")


def audit(docs: DataFrame, least: int = 3, top: int = 200, lot_terms: int = 8192, block_groups: int = 64) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank of ``docs`` (text, lang, source)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "divergence")
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts = scratch.save(counted(docs), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least)
    kept = scratch.save(kept.select("lang", "term", "lang_n"), "kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    largest = sizes.agg(F.max("kept")).first()[0] or 0
    lots_ = 1 << max(0, -(-largest // lot_terms) - 1).bit_length()
    lot = F.pmod(F.xxhash64("term"), F.lit(lots_)).cast("int")
    place = F.row_number().over(Window.partitionBy("lang", "lot").orderBy("term")) - 1
    known = scratch.save(kept.withColumn("lot", lot).withColumn("at", place), "known")
    lots = known.groupBy("lang", "lot").agg(F.array_sort(F.collect_list(F.struct("at", "term", "lang_n"))).alias("own"))
    lots = lots.select("lang", "lot", F.size("own").alias("size"), F.col("own.term").alias("terms"), F.col("own.lang_n").alias("counts"))

    # groups, their blocks and totals: about the square root of the language's groups to a block, in the order of names
    own = counts.join(known, ["lang", "term"]).select("lang", "source", "lot", "at", "n")
    own = scratch.save(own, "own")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("rows")).join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = scratch.save(groups.na.fill(0, ["total", "kept", "lang_total"]).drop("rows"), "groups")
    of_lang = Window.partitionBy("lang")
    wide = F.least(F.lit(block_groups), F.greatest(F.lit(2), F.ceil(F.sqrt(F.count("*").over(of_lang))))).cast("int")
    number = F.row_number().over(of_lang.orderBy("source")) - 1
    dealt = groups.withColumn("wide", wide).withColumn("block", F.floor(number / F.col("wide")).cast("int"))
    dealt = dealt.withColumn("blocks", F.max("block").over(of_lang) + 1).drop("wide")
    dealt = scratch.save(dealt, "dealt")
    rounds = dealt.agg(F.max(F.col("blocks") + F.col("blocks") % 2 - 1)).first()[0] or 0

    # every group is in every lot of its language, with or without terms; a language without terms has one lot of size 0
    places = dealt.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots_ - 1)))).join(lots.select("lang", "lot", "size"), ["lang", "lot"], "left")
    places = places.where("size is not null or lot = 0").na.fill(0, ["size"])
    held = places.join(own, ["lang", "source", "lot"], "left")
    keys = ["lang", "lot", "block", "blocks", "kept", "lang_total", "size"]
    table = f"divergence_{uuid.uuid4().hex[:12]}"
    buckets, on = task_count(spark), ["lang", "lot", "block"]
    (
        packed(held, keys).repartition(buckets, *on).write.bucketBy(buckets, *on).sortBy(*on).option("compression", "zstd")
        .option("path", shared_folder(spark, "divergence-blocks")).saveAsTable(table)
    )
    try:
        blocks = spark.table(table)
        values = [scratch.save(v.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), f"round-{i}") for i, v in enumerate(pair_values(blocks, rounds))]
        marks = scratch.save(marking_terms(blocks, lots, top), "marks")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    pairs = values[0]
    for more in values[1:]:
        pairs = pairs.unionByName(more)
    return ranked(pairs, "pair", None).unionByName(ranked(marks, "term", top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(load(spark, sf_dir, "text", "lang", "source"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
whole AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n::HUGEINT AS lang_n, s.v::HUGEINT AS v, s.total::HUGEINT AS total,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS own
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes s ON g.lang = s.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + 1000000000 * (n + 1) // (own + v) AS p, 1 + 1000000000 * (lang_n + 1) // (total + v) AS q FROM whole),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
paired AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
marks AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM paired UNION ALL SELECT * FROM marks) QUALIFY part = 'pair' OR rank <= 200
"""
