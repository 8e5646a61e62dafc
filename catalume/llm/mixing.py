"""Mixing sources to target weights, by blocks of words.

Each source's documents, shuffled by a seeded hash, are one stream of words that is cut into fixed-length blocks. Output
shards draw how many slots each source gets, multinomially from what its target still lacks, so that after the last shard
every source has its quota of blocks. A source's slots are numbered through; each pass over its blocks maps slot numbers
through a pseudorandom permutation of block numbers of its own, and blocks are joined by number. As a quota is at most twice
the source's blocks, no block, and so no word, is taken more than twice.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share ``share`` of all words; a target stops at
``cap`` times its source's words, and the excess is shared again by weight. The driver sees one row for each source.

Defined results: null and empty texts have size 0 and are never taken; equal rows are separate documents; a null doc_id is
kept; of a text longer than a block every block is taken or left by itself; an empty table gives an empty result; other
columns, whatever their names, are ignored by ``mix`` and pass through ``apply_mix``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalume.llm.common import WORD, Scratch, fresh, load, lots, running_start, scramble, slices, source_key, task_count


def targets(sizes: list[tuple[str | None, int]], weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Words to take from each source, by water-filling."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    size, out, left = dict(ordered), {}, share * sum(n for _, n in ordered)
    free = [s for s, _ in ordered]
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > cap * size[s]]
        if not over:
            return out | {s: unit * weight[s] for s in free}
        for s in over:
            out[s] = cap * size[s]
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def draws(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Slots of each source in each shard: multinomial by what the quotas still lack, never more than that."""
    left, made, rng = np.array(quotas, np.int64), [], np.random.default_rng(seed)
    for i in range(shards):
        room = int(left.sum()) // (shards - i)
        got = np.minimum(rng.multinomial(room, left / max(1, left.sum())), left) if room else np.zeros_like(left)
        for s in np.argsort(got - left, kind="stable"):  # what a full source could not give comes from the fullest others
            more = min(room - int(got.sum()), int(left[s] - got[s]))
            got[s] += more
        left = left - got
        made.append(got.tolist())
    return made


def permuted(index: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of range(size) at ``index``: four Feistel rounds, repeated while outside the range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low, keys = np.uint64((1 << half) - 1), scramble(np.arange(4, dtype=np.uint64) + np.uint64(seed * 4 + 1))
    out, open_ = index.astype(np.uint64), np.arange(len(index))
    while len(open_):
        a, b = out[open_] >> np.uint64(half), out[open_] & low
        for key in keys:
            a, b = b, a ^ (scramble(b ^ key) & low)
        out[open_] = (a << np.uint64(half)) | b
        open_ = open_[out[open_] >= np.uint64(size)]
    return out.astype(np.int64)


def takes(sized: DataFrame, plan: list[tuple[str, int, int]], block: int, shards: int, seed: int) -> DataFrame:
    """_source, block, times: how often each block is taken. plan: source key, blocks, quota of slots."""
    spark, rows, given = sized.sparkSession, [], [0] * len(plan)
    for shard, got in enumerate(draws([q for _, _, q in plan], shards, seed)):
        for i, n in enumerate(got):
            if n:
                rows.append((plan[i][0], i, plan[i][1], shard, given[i], n))
                given[i] += n

    def task(batches):
        for batch in batches:
            for key, i, blocks, shard, first, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slots = np.arange(first, first + n)
                turn, found = slots // blocks, np.empty(n, np.int64)
                for t in np.unique(turn):
                    at = turn == t
                    found[at] = permuted(slots[at] % blocks, blocks, (seed * 1_000_003 + i) * 8 + int(t))
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.string()), pa.array(found), pa.array([shard] * n, pa.int32())], ["_source", "block", "shard"])

    fields = "_source string, i int, blocks long, shard int, first long, n long"
    runs = spark.createDataFrame(rows, fields)
    step = 65_536  # slots of one shard and source are made by as many tasks as they need
    runs = runs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))))
    runs = runs.withColumn("n", F.least(F.lit(step), F.col("n") - F.col("part"))).withColumn("first", F.col("first") + F.col("part"))
    runs = runs.select("_source", "i", "blocks", "shard", "first", "n").repartition(task_count(spark), "_source", "shard", "first")
    slots = runs.mapInArrow(task, "_source string, block long, shard int")
    return slots.groupBy("_source", "block").agg(F.count("*").alias("times"))


def mix(docs: DataFrame, block: int = 64, shards: int = 16, seed: int = 11, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, start (in its source's stream), pieces of ``docs`` (doc_id, text, source).

    ``pieces``: array of (from, upto, times), the word ranges of the document that blocks took, in order.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixing")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", "source", source_key(F.col("source")).alias("_source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", text).alias("_draw"),
    )
    rows = scratch.save(rows, "sizes")
    found = rows.groupBy("source", "_source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()  # one row for each source
    rows = rows.withColumn("_lot", F.shiftright("_draw", 65 - lots(sum(r["rows"] for r in found)).bit_length()))
    wanted = targets([(r["source"], r["n"]) for r in found], **how)
    plan, goal = [], []
    for r in sorted(found, key=lambda r: (r["source"] is None, r["source"] or "")):
        blocks = -(-r["n"] // block)
        mean = r["n"] / max(1, blocks)  # words of a block, the last one being short
        plan.append((r["_source"], blocks, min(round(wanted[r["source"]] / mean) if mean else 0, 2 * blocks)))
        goal.append((r["_source"], r["n"], float(wanted[r["source"]])))
    rows = running_start(rows, ["_source"], "_lot", ["_draw", "doc_id", "size"], F.col("size"), "start")
    rows = scratch.save(rows, "streams")
    spans = rows.where("size > 0").select(
        "doc_id", "_source", "start", "size",
        F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"),
    )
    times = takes(rows, plan, block, shards, seed)
    cut = spans.join(times, ["_source", "block"])
    cut = cut.withColumn("from", F.greatest(F.lit(0), F.col("block") * block - F.col("start")))
    cut = cut.withColumn("upto", F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start")))
    taken = cut.groupBy("_source", "start").agg(
        F.sum((F.col("upto") - F.col("from")) * F.col("times")).alias("taken"),
        F.sort_array(F.collect_list(F.struct("from", "upto", "times"))).alias("pieces"),
    )
    named = spark.createDataFrame(goal, "_source string, source_size long, target double")
    out = rows.withColumn("_at", F.when(F.col("size") > 0, F.col("start")))
    out = out.join(taken.withColumnRenamed("start", "_at"), ["_source", "_at"], "left").join(named, "_source")
    taken = F.coalesce(F.col("taken"), F.lit(0)).alias("taken")
    return out.select("doc_id", "source", "size", "source_size", "target", taken, "start", "pieces", "_draw")


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix takes them: a document keeps the words taken once or more and, on a further line, those taken twice.

    A document that is taken as a whole keeps its text as it is; otherwise its words are joined by single spaces.
    Documents of which nothing is taken go. Equal rows each get pieces of their own. n_chars, if there, follows.
    """
    names, seed = docs.columns, how.get("seed", 11)
    key, draw, own, turn, pieces = fresh(docs, "_id", "_draw", "_own", "_turn", "_pieces")

    def task(batches):
        for batch in slices(batches):
            texts = []
            for text, parts_ in zip(batch.column("text").to_pylist(), batch.column(pieces).to_pylist(), strict=True):
                words, parts = text.encode().split(), []
                for times in (1, 2):
                    got = [w for p in parts_ if p["times"] >= times for w in words[p["from"] : p["upto"]]]
                    if got:
                        parts.append(text if len(got) == len(words) else b" ".join(got).decode())
                texts.append("\n".join(parts))
            columns = {n: pa.array(texts, batch.column(n).type) if n == "text" else batch.column(n) for n in names}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(f) for f in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([*columns.values()], names)

    # rows of equal doc_id and text stand in one list, and each takes the entry of its own number
    found = mix(docs, **how).where("size > 0").groupBy(F.col("doc_id").cast("long").alias(key), F.col("_draw").alias(draw)).agg(
        F.sort_array(F.collect_list(F.struct("start", "pieces"))).alias(pieces)
    )
    found = found.where(F.exists(pieces, lambda x: x["pieces"].isNotNull()))
    mark = F.xxhash64(F.lit(seed), "doc_id", F.coalesce(F.col("text"), F.lit("")))
    rows = docs.withColumn(own, mark).join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(draw)))
    several = rows.withColumn(turn, F.row_number().over(Window.partitionBy(key, draw).orderBy(F.xxhash64(*names))))
    taken = several.withColumn(pieces, F.get(F.col(pieces), F.col(turn) - 1)["pieces"]).where(F.col(pieces).isNotNull())
    return taken.select(*names, pieces).mapInArrow(task, docs.schema)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(load(spark, sf_dir, "doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
