"""Scores that order cards: the spotlight, hits of a search, and how policies would have decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.functions.scalars import rolling_hash, wilson
from catalume.functions.text import normalize_title

#: Bonus of the list that a card comes from (fixed values).
SOURCE_BONUS = {"tv": 7, "animation": 6, "single-au-my": 10, "single-han-quoc": 10}


def _bands(value: Column, *steps: tuple[float, int], least: int = 0) -> Column:
    """The points of the first step that the value reaches."""
    out = F.when(value >= steps[0][0], steps[0][1])
    for at, points in steps[1:]:
        out = out.when(value >= at, points)
    return out.otherwise(least)


def spotlight_score(c: Column, sources: Column, order: Column, trending: Column, year_now: int) -> Column:
    """Points of a card (slug, rating, year, quality, episode, lang, type, category, country, thumb, poster) and the lists it is in."""
    text = lambda name: F.coalesce(normalize_title(c[name]), F.lit(""))
    bonus = F.aggregate(sources, F.lit(0), lambda n, s: n + F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SOURCE_BONUS.items() for x in p]), s), F.lit(0)))
    rating = F.when(F.coalesce(c["rating"], F.lit(0.0)) > 0, _bands(c["rating"], (8.5, 34), (8, 30), (7.5, 25), (7, 20), (6.5, 14), (6, 9), least=4)).otherwise(0)
    age = F.greatest(F.lit(0), F.lit(year_now) - c["year"])
    recent = F.when(F.coalesce(c["year"], F.lit(0)) > 0, F.when(age == 0, 18).when(age == 1, 14).when(age == 2, 10).when(age <= 5, 6).otherwise(0)).otherwise(0)
    quality = F.when(text("quality").rlike("4k|2160|uhd"), 10).when(text("quality").rlike("hd|1080|720"), 7).otherwise(0)
    quality = quality + F.when(text("episode").rlike("full|hoan tat|tron bo"), 8).otherwise(0) + F.when(text("lang").rlike("vietsub|thuyet minh|long tieng"), 4).otherwise(0)
    content = F.when(F.array_contains(sources, "cinema") | text("category").contains("chieu rap"), 26).otherwise(0)
    content = content + F.when(text("country").rlike("han quoc|au my|my|anh|phap|duc|canada|uc"), 4).otherwise(0)
    content = content + F.when(text("type").rlike("single|phim le|movie"), 3).otherwise(0) + F.when(text("type").rlike("series|phim bo|tv shows?"), 2).otherwise(0)
    has = lambda name: F.coalesce(c[name], F.lit("")) != ""
    image = F.when(has("thumb") & has("poster"), 7).when(has("thumb") | has("poster"), 4).otherwise(-45)
    place = F.greatest(F.lit(0), 10 - F.floor(order / 3))
    return bonus + rating + recent + quality + content + image + place + rolling_hash(c["slug"]) / 1000.0 * 4 + F.when(trending, 22).otherwise(0)


def spotlight(cards: DataFrame, trending: DataFrame, year_now: int, limit: int = 24, pinned: str = "single-au-my") -> DataFrame:
    """slug, score, place: cards (slug, source, ord, tmdb_id and the columns of a card) merged by slug, scored, the best of the pinned
    list first. Of merged cards the better rated one leads and the others fill its blanks; a slug's cards are few.
    """
    fields = ["rating", "year", "quality", "episode", "lang", "type", "category", "country", "thumb", "poster", "tmdb_id"]
    rank = lambda f: F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.struct(F.coalesce("rating", F.lit(0.0)), -F.col("ord")))
    joined = cards.groupBy("slug").agg(*[F.max_by(f, rank(f)).alias(f) for f in fields], F.sort_array(F.collect_set("source")).alias("sources"), F.min("ord").alias("ord"))
    hot = joined.join(trending.select("tmdb_id").distinct().withColumn("_hot", F.lit(True)), "tmdb_id", "left")
    card = F.struct("slug", *fields)
    scored = hot.withColumn("score", spotlight_score(card, F.col("sources"), F.col("ord"), F.coalesce("_hot", F.lit(False)), year_now))
    shown = (F.coalesce("thumb", F.lit("")) != "") | (F.coalesce("poster", F.lit("")) != "")
    first = scored.where(F.array_contains("sources", pinned) & shown).orderBy(F.desc_nulls_last("rating"), "ord", "slug").limit(1)
    order = [F.desc("score"), F.asc("ord"), F.asc("slug")]
    top = scored.orderBy(*order).limit(limit)
    both = first.select("slug", "score", "ord", F.lit(0).alias("_rest")).unionByName(top.select("slug", "score", "ord", F.lit(1).alias("_rest")))
    once = both.groupBy("slug").agg(F.min("_rest").alias("_rest"), F.first("score").alias("score"), F.first("ord").alias("ord"))
    placed = once.withColumn("place", F.row_number().over(Window.orderBy("_rest", *order)))  # limit + 1 rows
    return placed.where(F.col("place") <= limit).select("slug", "score", "place")


def replay(cases: DataFrame, policies: list[tuple[str, float, int]], truth: str = "truth") -> DataFrame:
    """policy, n, accepted, correct, precision, recall, lo, hi: what each policy (name, least score, least lead over the second) would have
    made of cases (id, best, score, lead, truth). Cases are read once; a policy is one entry of an array.
    """
    rules = F.array(*[F.struct(F.lit(n).alias("policy"), F.lit(float(s)).alias("least"), F.lit(m).alias("lead")) for n, s, m in policies])
    each = cases.withColumn("_p", F.explode(rules))
    taken = (F.col("score") >= F.col("_p.least")) & (F.col("lead") >= F.col("_p.lead"))
    per = each.groupBy(F.col("_p.policy").alias("policy")).agg(F.count("*").alias("n"), F.count_if(taken).alias("accepted"), F.count_if(taken & (F.col("best") == F.col(truth))).alias("correct"))
    lo, hi = (F.round(wilson(F.col("correct"), F.col("accepted").cast("double"), up), 6) for up in (False, True))
    share = lambda n: F.when(F.col(n) > 0, F.round(F.col("correct") / F.col(n), 6))
    return per.select("policy", "n", "accepted", "correct", share("accepted").alias("precision"), share("n").alias("recall"), lo.alias("lo"), hi.alias("hi"))
