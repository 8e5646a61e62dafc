"""Entity matching: blocked similarity, one-to-one pairing, waterfalls, consensus of claims, components."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.functions.scalars import dice
from catalume.operators.tables import cut


def candidate_sets(left: DataFrame, right: DataFrame, block: list[str], words: str, least: float) -> DataFrame:
    """block, l, r: pairs of distinct word sets of a block, one of each side, whose Dice similarity may be ``least`` (over 0) or more.

    Sets meet only by their prefixes: with words in one order, rarest of the block first, two sets that similar share one of their first
    n - ceil(n * least / (2 - least)) + 1 words, n the set's size, and neither is smaller than that share of the other. A word that all rows of
    a block hold comes last and is in a prefix only of sets that need it; such sets differ in sizes and rarer words, or are equal and one.
    Null and empty sets have no partners.
    """
    share = least / (2 - least)
    of = lambda df, n: df.select(*block, F.array_sort(F.array_distinct(words)).alias("set"), F.lit(n == "l").alias("inl"), F.lit(n == "r").alias("inr"))
    both = of(left, "l").unionByName(of(right, "r")).where("size(set) > 0").groupBy(*block, "set").agg(F.bool_or("inl").alias("inl"), F.bool_or("inr").alias("inr"))
    each = both.select("*", F.explode("set").alias("word"))
    common = each.groupBy(*block, "word").agg(F.count("*").alias("n"))
    ranked = each.join(common, [*block, "word"]).groupBy(*block, "set", "inl", "inr").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"))
    first = F.slice(F.transform("w", lambda x: x["word"]), 1, F.size("set") - F.ceil(F.size("set") * share - 1e-9).cast("int") + 1)
    known = ranked.select(*block, "set", "inl", "inr", first.alias("prefix")).select("*", F.explode("prefix").alias("word"))
    side = lambda n: known.where(f"in{n}").select(*block, F.col("set").alias(n), F.col("prefix").alias(f"p{n}"), "word")
    near = F.least(F.size("l"), F.size("r")) >= F.greatest(F.size("l"), F.size("r")) * share - 1e-9
    once = F.array_min(F.array_intersect("pl", "pr")) == F.col("word")  # of several common words one makes the pair
    met = side("l").join(side("r"), [*block, "word"]).where(near & once)
    return met.select(*block, "l", "r")


def similar_sets(left: DataFrame, right: DataFrame, block: list[str], words: str, least: float) -> DataFrame:
    """The pairs of ``candidate_sets`` whose Dice similarity, ``score``, is ``least`` or more."""
    met = candidate_sets(left, right, block, words, least)
    return met.withColumn("score", dice(F.col("l"), F.col("r"))).where(F.col("score") >= least)


def fuzzy_match(left: DataFrame, right: DataFrame, block: list[str], words: list[str], least: float, order: list[str], oldest: int | None = 100) -> DataFrame:
    """For each row of ``left`` the first row of ``right`` (columns prefixed r_) in its block whose greatest Dice similarity over the
    word columns ``words`` is ``least`` or more, among the block's first ``oldest`` rows by ``order`` (None: all of its rows).

    Word sets are matched, not rows: of the right rows with one set only the first can be found, and repeated left rows ask once. Sets
    of so few words that one word more or less makes them unlike are looked up as they are.
    """
    rank = F.row_number().over(Window.partitionBy(*block).orderBy(*order))
    kept = right if oldest is None else right.withColumn("_rank", rank).where(F.col("_rank") <= oldest).drop("_rank")
    of = lambda c: F.array_sort(F.array_distinct(c))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("_n"), of(c).alias("_set")) for n, c in enumerate(words)])).alias("_s")
    sets = lambda df, *more: df.select(*block, *more, each).select(*block, *more, "_s.*").where("size(_set) > 0")
    place, keys, out = (lambda r: F.struct(*[F.col(f"{r}.{c}") for c in order])), ["_n", *block], left
    heads = cut(sets(kept.withColumn("_row", F.struct(*right.columns)), "_row").groupBy(*keys, "_set").agg(F.min_by("_row", place("_row")).alias("_row")))
    # n and n + 1 words have a similarity of 2n / (2n + 1) at most, n and n others less
    long = F.size("_set") >= (math.ceil(least / (2 - 2 * least) - 1e-6) if least < 1 else sys.maxsize)
    found = similar_sets(sets(left).where(long), heads.where(long), keys, "_set", least).join(heads.withColumnRenamed("_set", "r"), [*keys, "r"])
    best = heads.where(~long).unionByName(found.groupBy(*keys, F.col("l").alias("_set")).agg(F.min_by("_row", place("_row")).alias("_row")))
    for n, c in enumerate(words):
        own = best.where(F.col("_n") == n).select(*block, "_set", F.col("_row").alias(f"_r{n}"))
        out = out.withColumn("_set", of(c)).join(own, [*block, "_set"], "left").drop("_set")
    firsts = [F.when(F.col(f"_r{n}").isNotNull(), F.struct(place(f"_r{n}").alias("at"), F.col(f"_r{n}").alias("row"))) for n in range(len(words))]
    out = out.withColumn("_m", (F.least(*firsts) if len(firsts) > 1 else firsts[0])["row"]).where("_m is not null")
    score = F.array_max(F.array(*[F.coalesce(dice(F.col(c), F.col(f"_m.{c}")), F.lit(0.0)) for c in words]))
    return out.select(*left.columns, *[F.col(f"_m.{c}").alias(f"r_{c}") for c in right.columns], score.alias("score"))


def one_to_one(left: DataFrame, right: DataFrame, block: list[str], l_id: str, r_id: str, evidence: Column | None = None, most: int = 6) -> DataFrame:
    """l_id, r_id, evidence, status for rows of ``left`` with a candidate: ``paired`` if each is the other's only candidate, else
    ``ambiguous``. Candidates share the block and have ``evidence``, a text expression over columns of both sides (null: none).

    Blocks with over ``most`` rows on a side are generic names and are left out, so no block is multiplied.
    """
    few = lambda df: df.groupBy(*block).agg(F.count("*").alias("_n")).where(F.col("_n") <= most).drop("_n")
    met = left.join(few(left), block).join(right.join(few(right), block), block)
    met = met.withColumn("evidence", F.lit("block") if evidence is None else evidence).where("evidence is not null")
    mine = met.groupBy(l_id).agg(F.count("*").alias("_k"), F.min(F.struct(r_id, "evidence")).alias("_m"))
    theirs = met.groupBy(r_id).agg(F.count("*").alias("_c"))
    out = mine.withColumn(r_id, F.col(f"_m.{r_id}")).join(theirs, r_id)
    alone = (F.col("_k") == 1) & (F.col("_c") == 1)
    return out.select(l_id, F.when(alone, F.col(r_id)).alias(r_id), F.when(alone, F.col("_m.evidence")).alias("evidence"), F.when(alone, "paired").otherwise("ambiguous").alias("status"))


def duplicates(rows: DataFrame, block: list[str], id_: str, marked: Column, near: Column, least: int = 2, most: int = 6) -> DataFrame:
    """with_id, without_id: in blocks of ``least`` to ``most`` rows, each unmarked row with exactly one marked row that is ``near``
    (an expression over a. and b.)."""
    sized = rows.join(rows.groupBy(*block).agg(F.count("*").alias("_n")).where(F.col("_n").between(least, most)).drop("_n"), block).withColumn("_marked", marked)
    a, b = sized.where("not _marked").alias("a"), sized.where("_marked").alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in block]
    test = near
    for s in same:
        test = test & s
    found = a.join(b, test).groupBy(F.col(f"a.{id_}").alias("without_id")).agg(F.count("*").alias("_k"), F.min(f"b.{id_}").alias("with_id"))
    return found.where("_k = 1").select("with_id", "without_id")


def cast_match(rows: DataFrame, candidates: DataFrame, key: str, names: str, billed: str, first: int = 30, least: int = 2) -> DataFrame:
    """key, candidate, shared, status of rows by how many of their ``names`` are among the first ``billed`` of each candidate:
    ``verified`` for ``least`` or more and no other with as many, else ``tie`` or ``weak``."""
    met = rows.join(candidates, key).withColumn("shared", F.size(F.array_intersect(F.array_distinct(names), F.slice(billed, 1, first))))
    best = met.groupBy(key).agg(F.max("shared").alias("shared"), F.max_by("candidate", F.struct("shared", -F.col("candidate"))).alias("candidate"))
    tied = met.join(best.select(key, F.col("shared").alias("_b")), key).where("shared = _b").groupBy(key).agg(F.count("*").alias("_n"))
    status = F.when(F.col("shared") < least, "weak").when(F.col("_n") > 1, "tie").otherwise("verified")
    return best.join(tied, key).select(key, "candidate", "shared", status.alias("status"))


def rank_hits(hits: DataFrame, key: str, most: int = 8, other: int = 2) -> DataFrame:
    """The hits worth a look: exact names 100, near years 30, 8 for each query that found them, less 2 a rank, and the log of votes;
    at most ``other`` of the other type. hits: key, id, exact, year_near, queries, rank, votes, same_type."""
    score = F.when(F.col("exact"), 100).otherwise(0) + F.when(F.col("year_near"), 30).otherwise(0) + F.col("queries") * 8 - F.col("rank") * 2 + F.log10(1 + F.col("votes"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    scored = hits.withColumn("score", score)
    second = F.count_if(~F.col("same_type")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = scored.withColumn("_o", second).where(F.col("same_type") | (F.col("_o") <= other))
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("_o")


def gate(candidates: DataFrame, key: str) -> DataFrame:
    """key, candidate, tier: tier 1 passes on cast, year and size; tier 2 on an exact name, year and size where no rival passes either
    tier. candidates: key, candidate, cast_ok, name_ok, year_ok, size_ok (null: unknown, which a false is and a pass is not)."""
    fits = F.coalesce("year_ok", F.lit(False)) & F.coalesce("size_ok", F.lit(True))
    tested = candidates.withColumn("_1", F.coalesce("cast_ok", F.lit(False)) & fits).withColumn("_2", F.coalesce("name_ok", F.lit(False)) & fits)
    per = tested.groupBy(key).agg(
        F.count_if("_1").alias("n1"), F.count_if(F.col("_1") | F.col("_2")).alias("n2"),
        F.min(F.when(F.col("_1"), F.col("candidate"))).alias("c1"), F.min(F.when(F.col("_1") | F.col("_2"), F.col("candidate"))).alias("c2"),
    )
    first = F.col("n1") == 1
    return per.where(first | ((F.col("n1") == 0) & (F.col("n2") == 1))).select(key, F.when(first, F.col("c1")).otherwise(F.col("c2")).alias("candidate"), F.when(first, 1).otherwise(2).alias("tier"))


def alias_lookup(wanted: DataFrame, rows: DataFrame, sources: DataFrame, aliases: DataFrame) -> DataFrame:
    """slug, id: by canonical or provider slug, best by season match, then canonical match, newest, slug; a merge alias only where
    nothing else matched. wanted: slug, season; rows: id, slug, season, sorted_at; sources and aliases: slug, id."""
    named = rows.select("id", F.col("slug").alias("own"), F.col("season").alias("_s"), "sorted_at")
    direct = rows.select("slug", "id").withColumn("canonical", F.lit(1)).unionByName(sources.select("slug", "id").withColumn("canonical", F.lit(0)))
    met = wanted.join(direct, "slug").join(named, "id")
    order = F.struct((F.coalesce("season", F.lit(-1)) == F.coalesce("_s", F.lit(-1))).cast("int").alias("a"), F.col("canonical").alias("b"), F.col("sorted_at").alias("c"))
    best = met.groupBy("slug").agg(F.max_by("id", order).alias("id"))
    spare = wanted.join(best, "slug", "left_anti").join(aliases, "slug").groupBy("slug").agg(F.min("id").alias("id"))
    return best.unionByName(spare)


def family(rows: DataFrame) -> DataFrame:
    """id, relative: rows of one base title or one series id (media_type, base, tmdb_id), from keyed groups of at most ten rows; larger
    groups are generic names."""
    keys = F.array_compact(F.array(F.concat_ws("|", F.lit("t"), "media_type", "base"), F.when((F.col("media_type") == "tv") & F.col("tmdb_id").isNotNull(), F.concat_ws("|", F.lit("i"), F.col("tmdb_id").cast("string")))))
    each = rows.select("id", F.explode(F.array_distinct(keys)).alias("k"))
    few = each.join(each.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n").between(2, 10)).select("k"), "k")
    return few.join(few.select("k", F.col("id").alias("relative")), "k").where("id != relative").select("id", "relative").distinct()


def alerts(stats: Column, pending: int, stall: int = 3) -> Column:
    """What in a pass's counts (remaining, skipped, ambiguous, stalled) needs a look."""
    tests = {"skipped": stats["skipped"] > 0, "ambiguous": stats["ambiguous"] > 0, "remaining": stats["remaining"] > pending, "stalled": stats["stalled"] >= stall}
    return F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))


def waterfall(rows: DataFrame, key: str, rules: list[tuple[DataFrame, dict[str, Column]]], order: list[str], veto: Column | None = None) -> DataFrame:
    """For each key of ``rows`` the first candidate of the earliest rule that has one, by ``order``; adds ``rule``.

    A rule: its candidates, and for columns of theirs the expressions over rows that they equal. veto: candidates that no rule may take.
    Of candidates that a rule cannot tell apart only the first is joined, so a value that many share is no product of both sides.
    """
    found = None
    for i, (candidates, on) in enumerate(rules):
        allowed = candidates if veto is None else candidates.where(~F.coalesce(veto, F.lit(False)))
        first = allowed.groupBy(*[F.col(c).alias(f"_on_{c}") for c in on]).agg(F.min_by(F.struct(*candidates.columns), F.struct(*order)).alias("_c"))
        asked = rows.select(key, *[e.alias(f"_on_{c}") for c, e in on.items()])
        met = asked.join(first, [f"_on_{c}" for c in on]).select(key, "_c.*", F.lit(i + 1).alias("rule"))
        found = met if found is None else found.unionByName(met)
    rest = [c for c in found.columns if c != key]
    return found.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("rule", *order)).alias("m")).select(key, "m.*")


def consensus(claims: DataFrame, key: str, value: str, supporter: str) -> DataFrame:
    """key, status (none, one, many), value (if one), support (its distinct supporters), of nullable claims."""
    per = claims.groupBy(key, value).agg(F.count_distinct(supporter).alias("s"))
    known = F.col(value).isNotNull()
    out = per.groupBy(key).agg(
        F.count(F.when(known, 1)).alias("k"), F.min(F.when(known, F.col(value))).alias("v"), F.coalesce(F.max(F.when(known, F.col("s"))), F.lit(0)).alias("s")
    )
    status = F.when(F.col("k") == 0, "none").when(F.col("k") == 1, "one").otherwise("many")
    only = F.col("k") == 1
    return out.select(key, status.alias("status"), F.when(only, F.col("v")).alias(value), F.when(only, F.col("s")).otherwise(0).alias("support"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, label: the smallest node reachable over undirected ``edges``. All nodes of one label take the smallest label next to
    any of them, labels then jump along themselves, and this goes on until nothing changes; each round is checkpointed in
    spark.checkpoint.dir."""
    both = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = cut(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")).select(F.col("x").alias("node"), "label"))
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("x")).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        hook = step.groupBy("old").agg(F.min("label").alias("hook"))
        step = cut(step.join(hook, "old").select("node", F.least("label", "hook").alias("label"), "old"))
        jump = step.select(F.col("node").alias("j"), F.col("label").alias("to"))
        fresh = cut(step.join(jump, F.col("label") == F.col("j"), "left").select("node", F.least("label", F.coalesce("to", "label")).alias("label"), "old"))
        labels = fresh.select("node", "label")
        if fresh.where("label != old").limit(1).count() == 0:
            return labels
