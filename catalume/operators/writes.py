"""Writes as snapshot transforms: (stored rows, changes, clock) -> the next rows, with what changed. File tables have no MERGE, so
a caller writes the returned snapshot. Every join is on keys; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.functions.scalars import present
from catalume.functions.text import slugify


def unique_slugs(new: DataFrame, taken: DataFrame, key: str, title: str, year: str, most: int = 99) -> DataFrame:
    """key, slug for new rows: the title's slug, then with the year, then with 2, 3 ... ``most``, the first that is free.

    taken: one column ``slug``. New rows are served in key order, all slugs without suffix before those with a year and these before
    the numbers. Beyond ``most`` the key itself makes the slug unique.
    """
    used = taken.select("slug").distinct()
    rows = new.select(F.col(key), slugify(F.col(title)).alias("base"), F.col(year).cast("string").alias("_year"))
    plain = rows.select("base").distinct().join(used, F.col("base") == F.col("slug"), "left_anti")  # go to the first row of each
    gone = used.unionByName(plain.withColumnRenamed("base", "slug"))
    flag = lambda df, name: df.select(F.col("slug").alias(name), F.lit(True).alias(f"{name}_used"))
    dated = F.when(F.col("_year").isNotNull(), F.concat_ws("-", "base", "_year"))
    tried = rows.withColumn("_dated", dated).join(flag(used, "base"), "base", "left").join(flag(gone, "_dated"), "_dated", "left")

    def turn(*by: str) -> Column:
        return F.row_number().over(Window.partitionBy(*by).orderBy(key))

    tried = tried.withColumn("_first", F.col("base_used").isNull() & (turn("base") == 1))
    second = ~F.col("_first") & F.col("_dated").isNotNull() & F.col("_dated_used").isNull() & (turn("base", "_year", "_first") == 1)
    tried = tried.withColumn("_second", second).withColumn("_rest", ~F.col("_first") & ~F.col("_second"))
    tried = tried.withColumn("_turn", F.when(F.col("_rest"), turn("base", "_rest")))
    # a number is taken where a slug is the base and that number; of the free ones the turn tells which
    last = F.substring_index("slug", "-", -1)
    number = F.when(F.col("slug").contains("-") & last.rlike("^[1-9][0-9]*$"), last.try_cast("int"))
    held = gone.select(F.left("slug", F.length("slug") - F.length(last) - 1).alias("base"), number.alias("_k")).where(F.col("_k").between(2, most))
    held = held.groupBy("base").agg(F.collect_set("_k").alias("_held"))
    free = F.array_except(F.sequence(F.lit(2), F.lit(most)), F.coalesce("_held", F.array().cast("array<int>")))
    name = F.when(F.col("_first"), F.col("base")).when(F.col("_second"), F.col("_dated"))
    numbered = F.try_element_at(free, F.col("_turn")).cast("string")
    name = name.otherwise(F.concat_ws("-", "base", F.coalesce(numbered, F.col(key).cast("string"))))
    return tried.join(held, "base", "left").select(key, name.alias("slug"))


def dimension_keys(stored: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """The next dimension (id, value): stored rows and a hash key for each new distinct non-null value."""
    fresh = values.select(F.col(value)).where(F.col(value).isNotNull()).distinct().join(stored, value, "left_anti")
    return stored.select("id", value).unionByName(fresh.select(F.substring(F.md5(value), 1, 16).alias("id"), value))


def replace_snapshot(new: DataFrame, key: str, size: int) -> DataFrame:
    """``new`` if it holds exactly ``size`` rows of different keys, else nothing: a wrong batch never replaces a good one."""
    test = new.agg(((F.count("*") == size) & (F.count_distinct(key) == size)).alias("_good"))
    return new.join(F.broadcast(test.where("_good")), how="cross").drop("_good")  # one row or none


def keep_last_good(stored: DataFrame, new: DataFrame, key: str, payload: list[str], failed: Column) -> DataFrame:
    """The next status rows: a failed attempt updates all but ``payload``, which stays as last stored."""
    old = stored.select(key, F.struct(*payload).alias("_old"))
    out = new.join(old, key, "left")
    kept = {c: F.when(failed, F.col(f"_old.{c}")).otherwise(F.col(c)) for c in payload}
    fresh = out.select(*[kept.get(c, F.col(c)).alias(c) for c in new.columns])
    return fresh.unionByName(stored.select(*new.columns).join(new.select(key), key, "left_anti"))


def add_counters(stored: DataFrame, events: DataFrame, key: str, order: list[str], failed: Column, counters: dict[str, Column]) -> DataFrame:
    """key, streak and counters after ``events``: consecutive failures since the last success (continuing the stored streak if there
    was none), and cumulative counts. Only sums and maxima meet, so a key's events are never gathered.
    """
    at = F.struct(*order)
    last = events.groupBy(key).agg(F.max(F.when(~failed, at)).alias("_ok"), *[F.count_if(test).alias(f"_{n}") for n, test in counters.items()])
    runs = events.join(last.select(key, "_ok"), key).where(failed & (F.col("_ok").isNull() | (at > F.col("_ok")))).groupBy(key).agg(F.count("*").alias("_run"))
    both = stored.join(last.join(runs, key, "left"), key, "full")
    seen = F.col("_ok").isNotNull()
    streak = F.when(seen, 0).otherwise(F.coalesce("streak", F.lit(0))) + F.coalesce("_run", F.lit(0))
    return both.select(key, streak.cast("long").alias("streak"), *[(F.coalesce(n, F.lit(0)) + F.coalesce(f"_{n}", F.lit(0))).cast("long").alias(n) for n in counters])


def update_attempted(rows: DataFrame, results: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Columns take a result only where it was attempted (results: key, attempted, fields); others keep their value, null included."""
    new = results.select(key, F.col("attempted").alias("_did"), F.struct(*fields).alias("_new"))
    out = rows.join(new, key, "left")
    did = F.coalesce(F.col("_did"), F.lit(False))
    return out.select(*[F.when(did, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])


def merge_map(old: Column, new: Column) -> Column:
    """``new`` laid over ``old``; keys that new holds replace those of old."""
    return F.map_concat(F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(new, k)), new)


def refresh_claims(rows: DataFrame, claims: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key, metadata of the rows whose metadata map changes when the keys ``names`` are replaced by those of ``claims``.

    A claim without a season keeps the stored season of the same id (names: id, type, season first).
    """
    id_, _, season = names[:3]
    new = claims.select(key, F.map_filter(F.col("claim"), lambda k, v: v.isNotNull()).alias("_new"))
    both = rows.join(new, key)
    kept_season = F.col("metadata")[id_].eqNullSafe(F.col("_new")[id_]) & F.col("_new")[season].isNull() & F.col("metadata")[season].isNotNull()
    bare = F.map_filter("metadata", lambda k, v: ~k.isin(*names) | ((k == season) & kept_season))
    merged = both.withColumn("_next", merge_map(bare, F.col("_new")))
    sorted_ = lambda m: F.array_sort(F.map_entries(m))
    return merged.where(~sorted_("_next").eqNullSafe(sorted_("metadata"))).select(key, F.col("_next").alias("metadata"))


def write_identity(rows: DataFrame, identities: DataFrame, key: str, dependents: list[str]) -> DataFrame:
    """Writes (tmdb_id, media, season); where the tuple changes the status becomes pending and ``dependents`` null, and a score that was
    fetched for the other id or type leaves the ratings.
    """
    new = identities.select(key, F.struct("tmdb_id", "media", "season").alias("_id"))
    out = rows.join(new, key, "left")
    written, old = F.col("_id").isNotNull(), F.struct("tmdb_id", "media", "season")
    changed = written & ~old.eqNullSafe(F.col("_id"))
    moved = written & ~F.struct("tmdb_id", "media").eqNullSafe(F.struct("_id.tmdb_id", "_id.media"))
    put = {c: F.when(written, F.col(f"_id.{c}")).otherwise(F.col(c)) for c in ("tmdb_id", "media", "season")}
    put["status"] = F.when(changed, "pending").otherwise(F.col("status"))
    put |= {c: F.when(~changed, F.col(c)) for c in dependents}
    own_score = moved & F.map_contains_key("ratings", F.lit("tmdb_src"))
    put["ratings"] = F.when(own_score, F.map_filter("ratings", lambda k, v: ~k.isin("tmdb", "tmdb_count", "tmdb_src"))).otherwise(F.col("ratings"))
    return out.select(*[put.get(c, F.col(c)).alias(c) for c in rows.columns])


def fill_identity(rows: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """key, tmdb_id, media, season of what ``incoming`` may fill: an empty row, or the empty season of the same series; never a pinned
    row, a contradicting type, or a tuple that another row holds or another incoming row takes (the least key is served).
    """
    row = rows.select(key, F.struct("tmdb_id", "media", "season", "display", "pinned").alias("_r"))
    both = incoming.where("tmdb_id is not null and media is not null").join(row, key)
    r = F.col("_r")
    shown = F.lower(r["display"])
    odd = F.coalesce(((F.col("media") == "tv") & (shown == "single")) | ((F.col("media") == "movie") & shown.isin("series", "tvshows")), F.lit(False))
    empty = r["tmdb_id"].isNull() & ~odd
    season = (F.col("media") == "tv") & (r["media"] == "tv") & (r["tmdb_id"] == F.col("tmdb_id")) & r["season"].isNull() & F.col("season").isNotNull()
    open_ = both.where(~F.coalesce(r["pinned"], F.lit(False)) & (empty | F.coalesce(season, F.lit(False))))
    tuple_ = F.concat_ws(":", "media", F.col("tmdb_id").cast("string"), F.when(F.col("media") == "tv", F.coalesce(F.col("season").cast("string"), F.lit(""))).otherwise(""))
    held = rows.where("tmdb_id is not null").select(tuple_.alias("_t"))
    free = open_.withColumn("_t", tuple_).join(held.distinct(), "_t", "left_anti")
    return free.groupBy("_t").agg(F.min_by(F.struct(key, "tmdb_id", "media", "season"), key).alias("x")).select("x.*")


def advance_checkpoint(stored: DataFrame, pages: DataFrame, key: str, now: Column, restart_days: int) -> DataFrame:
    """The next checkpoints (key, page, ended_at): the furthest page read; back to page 1 when the end was reached ``restart_days`` ago."""
    read = pages.groupBy(key).agg(F.max("page").alias("_page"), F.bool_or("is_last").alias("_last"))
    both = stored.join(read, key, "full")
    due = F.col("ended_at").isNotNull() & (F.datediff(now, "ended_at") >= restart_days)
    ended = F.when(F.coalesce("_last", F.lit(False)), now).when(~F.coalesce(due, F.lit(False)), F.col("ended_at"))
    page = F.when(F.coalesce(due, F.lit(False)), F.coalesce("_page", F.lit(1))).otherwise(F.greatest(F.coalesce("page", F.lit(1)), F.coalesce("_page", F.lit(1))))
    return both.select(key, page.cast("long").alias("page"), ended.alias("ended_at"))


def add_favorites(stored: DataFrame, wanted: DataFrame, ready: DataFrame, now: Column) -> DataFrame:
    """The next favourites (user_id, item, at): wanted (user_id, item) that are ready and not stored yet are added, once."""
    fresh = wanted.select("user_id", "item").distinct().join(ready.select("item").distinct(), "item", "left_semi")
    return stored.unionByName(fresh.join(stored, ["user_id", "item"], "left_anti").select("user_id", "item", now.alias("at")))


def newest(rows: DataFrame, key: str, at: str, most: int, *ties: str) -> DataFrame:
    """Each key's newest rows, numbered; the rank is filtered before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), *ties))
    return rows.withColumn("place", rank).where(F.col("place") <= most)


def touch_history(stored: DataFrame, touches: DataFrame, tie: str = "episode") -> DataFrame:
    """The next history (user_id, item, at, episode): the newest time; an episode of null keeps the one before it. Of touches at one
    time the one with the greatest ``tie`` counts."""
    both = stored.unionByName(touches)
    return both.groupBy("user_id", "item").agg(F.max("at").alias("at"), F.max_by("episode", F.when(F.col("episode").isNotNull(), F.struct("at", tie))).alias("episode"))


def merge_import(stored: DataFrame, imported: DataFrame) -> DataFrame:
    """The next history after an import: the later time, and its episode only if the import is strictly newer."""
    new = imported.select("user_id", "item", F.col("at").alias("_at"), F.col("episode").alias("_episode"))
    both = stored.join(new, ["user_id", "item"], "full")
    newer = F.col("at").isNull() | (F.col("_at") > F.col("at"))
    episode = F.when(newer & F.col("_episode").isNotNull(), F.col("_episode")).otherwise(F.col("episode"))
    return both.select("user_id", "item", F.greatest("at", "_at").alias("at"), episode.alias("episode"))


def import_list(entries: Column, now_ms: Column, most: int) -> Column:
    """A guest's list (slug, saved_ms, episode) as distinct slugs: within the first ``most`` entries, valid slugs only, times clamped
    to now and after the year 2000. Of repeated slugs the least time stays; a later entry's episode is taken if its time is not
    before the least so far, which only an ordered fold can tell.
    """
    clamp = lambda t: F.when(t > 946_684_800_000, F.least(t, now_ms)).otherwise(now_ms)
    good = F.filter(F.slice(entries, 1, most), lambda e: e["slug"].rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"))
    timed = F.transform(good, lambda e: F.struct(e["slug"].alias("slug"), clamp(e["saved_ms"]).alias("ms"), e["episode"].alias("episode")))
    slugs = F.array_distinct(F.transform(timed, lambda e: e["slug"]))

    def fold(slug: Column) -> Column:
        own = F.filter(timed, lambda e: e["slug"] == slug)
        step = lambda a, e: F.struct(slug.alias("slug"), F.least(a["ms"], e["ms"]).alias("ms"), F.when((e["ms"] >= a["ms"]) & e["episode"].isNotNull(), e["episode"]).otherwise(a["episode"]).alias("episode"))
        return F.aggregate(F.slice(own, 2, most), own[0], step)

    return F.transform(slugs, fold)


def merge_children(children: dict[str, DataFrame], mapping: DataFrame, rules: dict[str, tuple[list[str], Column]]) -> dict[str, DataFrame]:
    """Child tables after rows were folded into others (mapping: dropped, kept). A rule names the keys that must stay unique next to
    row_id and the order whose greatest row stays; tables without a rule are only re-pointed.
    """
    out = {}
    for name, rows in children.items():
        moved = rows.join(mapping, F.col("row_id") == F.col("dropped"), "left")
        moved = moved.withColumn("row_id", F.coalesce("kept", "row_id")).drop("dropped", "kept")
        if name in rules:
            keys, order = rules[name]
            rest = [c for c in rows.columns if c not in ("row_id", *keys)]
            moved = moved.groupBy("row_id", *keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select("row_id", *keys, "_r.*")
        out[name] = moved.select(*rows.columns)
    return out


def undo(rows: DataFrame, log: DataFrame, fields: list[str]) -> DataFrame:
    """Rows with logged changes (id, before, after: structs of ``fields``) taken back, where the row still is as the change left it.
    Of several changes of a row the last counts (``change_id``)."""
    last = log.groupBy("id").agg(F.max_by(F.struct("before", "after"), "change_id").alias("_l"))
    both = rows.join(last, "id", "left")
    back = F.struct(*fields).eqNullSafe(F.col("_l.after")) & F.col("_l").isNotNull()
    return both.select(*[F.when(back, F.col(f"_l.before.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])
