"""Choosing rows: firsts, latest, top-k, pages, ranked lists with fill. Ties are broken by the order given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_one(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return keep_first(df, keys, order, 1)


def keep_first(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key. Spark filters ranks before the shuffle, so a hot key does not move as a whole."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row of greatest ``by`` of each key, by a combinable maximum instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_row"))
    return found.select(*keys, "_row.*")


def first_seen(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Each key once, at the position of its first occurrence."""
    return df.groupBy(*keys).agg(F.min(position).alias(position))


def running_totals(df: DataFrame, keys: list[str], bucket: Column, order: list, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same keys up to and including this one, in ``order``.

    No key is sorted in one task: rows are summed within (keys, bucket), and the buckets' totals, one row each, carry the sums
    across. ``bucket`` must rise with the order; it and the keys must be null-free. Finer buckets make smaller tasks.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_bucket", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_inside", F.sum("_value").over(inside)).join(totals, [*keys, "_bucket"])
    return out.withColumn(name, F.col("_inside") + F.col("_base")).drop("_inside", "_base", "_bucket", "_value")


def page(df: DataFrame, order: list, bucket: Column, number: int, size: int) -> DataFrame:
    """A page of ``df`` with ``total``, ``pages`` and ``page``; the number is clamped to 1..pages. Places are counted in buckets of
    the order, so a page far back costs what the first one does, and nothing runs before the result is asked for.
    """
    totals = df.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))
    totals = totals.withColumn("page", F.greatest(F.lit(1).cast("long"), F.least(F.lit(number).cast("long"), "pages")))
    ranked = running_totals(df, [], bucket, order, F.lit(1).cast("long"), "_place")
    placed = ranked.crossJoin(F.broadcast(totals))  # one row
    return placed.where((F.col("_place") > (F.col("page") - 1) * size) & (F.col("_place") <= F.col("page") * size)).drop("_place")


def ranked_then_fill(ranked: DataFrame, fill: DataFrame, key: str, cap: int, least: int) -> DataFrame:
    """Rows of ``ranked`` (key, pos), then of ``fill`` (key, pos), each key once, ``cap`` at most; nothing if fewer than ``least``."""
    both = ranked.select(key, F.struct(F.lit(0).alias("s"), F.col("pos").alias("p")).alias("at"))
    both = both.unionByName(fill.select(key, F.struct(F.lit(1).alias("s"), F.col("pos").alias("p")).alias("at")))
    top = both.groupBy(key).agg(F.min("at").alias("at")).orderBy("at", key).limit(cap)
    whole = Window.orderBy("at", key)  # at most ``cap`` rows
    numbered = top.withColumn("place", F.row_number().over(whole)).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    return numbered.where(F.col("n") >= least).select(key, "place")


def unique_maximum(df: DataFrame, keys: list[str], value: str, item: str) -> DataFrame:
    """Each key's item of greatest value and whether it alone has it."""
    best = df.groupBy(*keys).agg(F.max(value).alias("best"))
    tied = df.join(best, keys).where(F.col(value) == F.col("best"))
    return tied.groupBy(*keys, "best").agg(F.min(item).alias(item), (F.count("*") == 1).alias("is_unique"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, bucket: Column, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles: the value at place int(n * share), 1 at least, of each key. Equal values are counted first, and
    places are counted in buckets of the value."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    placed = running_totals(counts, keys, bucket, [value], F.col("c"), "up").join(counts.groupBy(*keys).agg(F.sum("c").alias("n")), keys)
    wanted = [F.min(F.when(F.col("up") >= F.greatest(F.lit(1), F.floor(F.col("n") * s)), F.col(value))).alias(name) for name, s in shares.items()]
    return placed.groupBy(*keys).agg(*wanted)


def chunks(df: DataFrame, keys: list[str], bucket: Column, order: list, size: int, name: str = "chunk") -> DataFrame:
    """Numbers batches of ``size`` rows within each key, counted in buckets of the order."""
    out = running_totals(df, keys, bucket, order, F.lit(1).cast("long"), "_place")
    return out.withColumn(name, F.floor((F.col("_place") - 1) / size)).drop("_place")


def seeded_sample(df: DataFrame, cells: list[str], key: str, seed: int, each: int) -> DataFrame:
    """``each`` rows of every cell in the order of a seeded hash of the key: the same rows at every run."""
    return keep_first(df, cells, [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)], each)


def congruential_order(items: Column, seed: int) -> Column:
    """An array shuffled from its end by a linear congruential generator (x * 1664525 + 1013904223 modulo 2^32), as a fold over columns."""
    start = F.struct(F.lit(seed).cast("long").alias("x"), items.alias("a"))

    def step(state: Column, i: Column) -> Column:
        x = (state["x"] * 1664525 + 1013904223) % (1 << 32)
        j = F.floor(x / float(1 << 32) * (i + 1))
        a = state["a"]
        swapped = F.transform(a, lambda v, k: F.when(k == i, F.get(a, j.cast("int"))).when(k == j, F.get(a, i)).otherwise(v))
        return F.struct(x.cast("long").alias("x"), swapped.alias("a"))

    places = F.when(F.size(items) > 1, F.sequence(F.size(items) - 1, F.lit(1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step)["a"]


def budget_packs(items: Column, most_items: int, most_tokens: int) -> Column:
    """The pack number of each element of an ordered array of token counts: a pack closes at ``most_items`` or before it would pass
    ``most_tokens``. A fold in order, as what is packed decides what comes next; for arrays of one unit of work.
    """
    start = F.expr("named_struct('pack', 0, 'n', 0, 'tokens', 0L, 'out', cast(array() as array<int>))")

    def step(s: Column, tokens: Column) -> Column:
        full = (s["n"] > 0) & ((s["n"] >= most_items) | (s["tokens"] + tokens > most_tokens))
        pack = F.when(full, s["pack"] + 1).otherwise(s["pack"])
        return F.struct(
            pack.alias("pack"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"),
            F.when(full, tokens.cast("long")).otherwise(s["tokens"] + tokens).alias("tokens"), F.concat(s["out"], F.array(pack)).alias("out"),
        )

    return F.aggregate(items, start, step)["out"]


def having(df: DataFrame, keys: list[str], **tests: Column) -> DataFrame:
    """Keys for which every aggregate test holds."""
    found = df.groupBy(*keys).agg(*[t.alias(n) for n, t in tests.items()])
    for n in tests:
        found = found.where(F.col(n))
    return found.select(*keys)
