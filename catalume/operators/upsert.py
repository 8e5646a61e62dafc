"""The canonical upsert: batches of provider records against the catalogue, with the outcome of taking them one after the other.

A record may belong to a row that an earlier record of its batch makes, or that an earlier one fills with the id it is looked up by.
Records and rows form a graph by shared keys (id tuple, IMDb id, original title, title, words of a title), cut where ids
contradict. In each round every open record looks for its row by seven rules; those that no earlier open record can still
affect are settled, and a settled record without a row makes one. What a round decides depends on the least record of each key only, so
a common key costs one row of an aggregate and not a comparison of pairs; there are as many rounds as rows that depend on one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalume.functions.scalars import present
from catalume.functions.text import normalize_title
from catalume.operators.identity import find_rows, incoming_season, row_season
from catalume.operators.tables import cut
from catalume.operators.writes import fill_identity, unique_slugs

#: Numbers of the rules by which a key finds rows, as in find_rows.
TUPLE, IMDB, ORIGINAL, TITLE, WORDS = 2, 3, 4, 6, 7
SERIES = 99  # the id without its season finds nothing, but rows are filled in the order of their records
LONG = 25  # from so many words on two lists may be similar without being equal


def _words(text: Column) -> Column:
    found = F.sort_array(F.array_distinct(F.split(text, " ")))
    return F.when(F.size(found) >= LONG, F.lit("*")).otherwise(F.array_join(found, " "))


def _tuple() -> Column:
    return F.when(F.col("tmdb_id").isNotNull(), F.concat_ws("|", "tmdb_media", F.col("tmdb_id").cast("string"), F.coalesce(F.col("tmdb_season").cast("string"), F.lit(""))))


def record_keys(records: DataFrame) -> DataFrame:
    """rec, sig, cls, key: what a record can be found by; ``sig`` is its id tuple, as records of different tuples are never one row."""
    dated = lambda c, name: F.when(F.col("year").isNotNull() & (name != ""), F.concat_ws("|", "media_type", F.col("year").cast("string"), c))
    keys = {
        TUPLE: [_tuple()], SERIES: [F.when(F.col("tmdb_id").isNotNull(), F.concat_ws("|", "tmdb_media", F.col("tmdb_id").cast("string")))], IMDB: [F.when(F.col("imdb").isNotNull(), F.concat_ws("|", "imdb", "media_type"))], ORIGINAL: [dated(F.col("original"), F.col("original"))],
        TITLE: [dated(F.col("title"), F.col("title"))], WORDS: [dated(_words(F.col(c)), F.col(c)) for c in ("original", "title")],
    }
    each = F.array(*[F.when(k.isNotNull(), F.struct(F.lit(cls).alias("cls"), k.alias("key"))) for cls, own in keys.items() for k in own])
    more = [c for c in ("tmdb_season", "id", "rule", "_no_tmdb", "_no_imdb") if c in records.columns]
    return records.select("rec", *more, _tuple().alias("sig"), F.explode(each).alias("k")).where("k is not null").select("rec", *more, "sig", "k.*")


def settled(open_: DataFrame, found: DataFrame, known: DataFrame) -> DataFrame:
    """``open_`` with id (null where a row has to be made) and ``settled``: no earlier open record can affect this one.

    A record without a row waits for earlier ones without a row that share a key with it; any record waits for earlier ones that are about
    to fill the tuple or IMDb id by which a stronger rule than its own would find their row, for one that is about to give its own
    row another tuple, and for those that may take an IMDb id that only one row without a season has. ``at`` is the place of ``rec``.
    """
    open_season = (F.col("tmdb_media") == "tv") & F.col("tmdb_season").isNull()
    blank = known.select("id", (F.col("tmdb_id").isNull() | open_season).alias("_no_tmdb"), F.col("imdb").isNull().alias("_no_imdb"))
    state = cut(open_.join(found.join(blank, "id"), "rec", "left"))
    keys = record_keys(state.withColumn("rec", F.col("at")))  # least numbers are found without sorting
    fills = (F.col("cls").isin(TUPLE, SERIES) & F.col("_no_tmdb")) | ((F.col("cls") == IMDB) & F.col("_no_imdb"))
    senders = keys.where(F.col("id").isNull() | fills)
    least = senders.groupBy("cls", "key").agg(F.min("rec").alias("_all"), F.min(F.when(F.col("sig").isNull(), F.col("rec"))).alias("_bare"), F.min(F.when(F.col("tmdb_season").isNull(), F.col("rec"))).alias("_lone"))
    same = senders.where("sig is not null").groupBy("cls", "key", "sig").agg(F.min("rec").alias("_same"))
    claims = (F.col("cls") == IMDB) & F.col("tmdb_season").isNull() & F.coalesce("_no_imdb", F.lit(True))
    affected = (F.col("cls") != SERIES) & (F.col("id").isNull() | (F.col("cls") < F.col("rule")))
    gives = F.col("cls").isin(TUPLE, SERIES) & F.coalesce("_no_tmdb", F.lit(False))
    asks = keys.withColumn("_claims", claims).withColumn("_affected", affected).withColumn("_gives", gives).where("_claims or _affected or _gives")
    met = asks.join(least, ["cls", "key"]).join(same, ["cls", "key", "sig"], "left")
    first = F.when(F.col("sig").isNull(), F.col("_all")).otherwise(F.least("_bare", "_same"))
    waits = met.where((F.col("_affected") & (first < F.col("rec"))) | (F.col("_claims") & (F.col("_lone") < F.col("rec"))) | (F.col("_gives") & (F.col("_all") < F.col("rec")))).select("rec")
    named = state.where(F.col("_no_tmdb")).withColumn("rec", F.col("at")).withColumn("sig", _tuple()).where("sig is not null")
    takes = named.groupBy("id").agg(F.min(F.struct("rec", "sig")).alias("_first"))
    rivals = named.where("rule >= 3").join(takes, "id").where((F.col("_first.rec") < F.col("rec")) & (F.col("_first.sig") != F.col("sig"))).select("rec")
    waits = waits.unionByName(rivals).distinct().select(F.col("rec").alias("at"), F.lit(True).alias("_waits"))
    return state.join(waits, "at", "left").withColumn("settled", F.col("_waits").isNull()).drop("rule", "_no_tmdb", "_no_imdb", "_waits")


def _filled(known: DataFrame, attached: DataFrame) -> DataFrame:
    """``known`` with empty ids taken from the first record of each row, unless another row has them."""
    firsts = attached.groupBy("id").agg(
        F.min_by(F.struct("tmdb_id", F.col("tmdb_media").alias("media"), F.col("tmdb_season").alias("season")), F.when(F.col("tmdb_id").isNotNull(), F.col("rec"))).alias("_t"),
        F.min_by("imdb", F.when(F.col("imdb").isNotNull(), F.col("rec"))).alias("_imdb"),
    )
    view = known.select("id", "tmdb_id", F.col("tmdb_media").alias("media"), F.col("tmdb_season").alias("season"), F.col("media_type").alias("display"), "pinned")
    ids = fill_identity(view, firsts.where("_t is not null").select("id", "_t.*"), "id").select("id", F.struct("tmdb_id", "media", "season").alias("_new"))
    lone = known.where("imdb is not null and tmdb_season is null").select(F.col("imdb").alias("_imdb"), "media_type").distinct()
    wants = firsts.where("_imdb is not null").select("id", "_imdb").join(known.where("imdb is null").select("id", "media_type"), "id")
    imdb = wants.join(lone, ["_imdb", "media_type"], "left_anti").groupBy("_imdb", "media_type").agg(F.min("id").alias("id")).select("id", "_imdb")
    out = known.join(ids, "id", "left").join(imdb, "id", "left")
    put = {"tmdb_id": F.coalesce("_new.tmdb_id", "tmdb_id"), "tmdb_media": F.coalesce("_new.media", "tmdb_media"), "tmdb_season": F.coalesce("_new.season", "tmdb_season"), "imdb": F.coalesce("imdb", "_imdb")}
    put["season"] = F.coalesce("_new.season", "season")
    return out.select(*[put.get(c, F.col(c)).alias(c) for c in known.columns])


def resolve_records(records: DataFrame, known: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rec, id, made) for each of ``records``, and ``known`` with the rows made and the ids filled. Columns as in find_rows;
    ``known`` has ``pinned`` as well. Records are taken in the order of ``rec``; a row answers to the names it had or was made with.
    """
    open_, known, done = cut(records), cut(known), None
    open_ = cut(open_.orderBy("rec").withColumn("at", F.monotonically_increasing_id()))
    remaining, new_id = open_.count(), F.concat(F.lit("~"), "rec")  # among made rows the older comes first
    while remaining:
        judged = cut(settled(open_, find_rows(open_, known.drop("pinned"), sources), known))
        ready = judged.where("settled").drop("settled")
        remaining -= ready.count()
        taken = known.where("imdb is not null and tmdb_season is null").select("imdb", "media_type").distinct().withColumn("_taken", F.lit(True))
        fresh = ready.where("id is null").drop("id").join(taken, ["imdb", "media_type"], "left")
        fresh = fresh.withColumn("id", new_id).withColumn("imdb", F.when(F.col("_taken").isNull() | F.col("tmdb_season").isNotNull(), F.col("imdb")))
        fresh = fresh.withColumn("created", F.lit("9999-01-01").cast("timestamp")).withColumn("state", F.lit("ready")).withColumn("pinned", F.lit(False))
        known = cut(_filled(known.unionByName(fresh.select(*known.columns)), ready.where("id is not null")))
        placed = ready.select("rec", F.coalesce("id", new_id).alias("id"), F.col("id").isNull().alias("made"))
        done = placed if done is None else done.unionByName(placed)
        open_ = judged.where("not settled").drop("settled", "id")
    if done is None:
        done = records.select("rec", F.lit(None).cast("string").alias("id"), F.lit(False).alias("made"))
    named = F.when(F.col("id").startswith("~"), F.substring(F.md5(F.substr("id", F.lit(2))), 1, 16)).otherwise(F.col("id"))
    return done.withColumn("id", named), known.withColumn("id", named)


def upsert_canonical(rows: DataFrame, sources: DataFrame, incoming: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next rows (id, slug, title, original, year, media_type, tmdb_id, tmdb_media, tmdb_season, imdb, episodes, state, pinned,
    created, updated_at), the next sources (provider, provider_id, provider_slug, row_id, payload, seen_at) and a log (provider,
    provider_id, row_id, change: insert, update, same).

    incoming: provider, provider_id, provider_slug, title, original, year, media_type, tmdb_id, tmdb_media, tmdb_season, imdb, episodes,
    payload; one row for each provider id, taken in the order of (provider, provider_id). Ids are filled, never overwritten; of a
    row's records the last by that order gives title, original title and year where it has them.
    """
    rec = F.concat_ws("|", "provider", "provider_id")
    blank = lambda c: F.coalesce(normalize_title(F.col(c)), F.lit(""))
    records = incoming.select(
        rec.alias("rec"), "provider", "provider_id", F.col("provider_slug").alias("slug"), F.col("title").alias("raw_title"), "media_type", "tmdb_id", "tmdb_media", "tmdb_season",
        incoming_season(F.col("tmdb_media"), F.col("tmdb_season"), F.col("title"), F.col("original"), F.col("provider_slug")).alias("season"), "imdb", "year", blank("original").alias("original"), blank("title").alias("title"), "episodes",
    )
    known = rows.select(
        "id", "created", "state", "slug", "media_type", "tmdb_id", "tmdb_media", "tmdb_season", row_season(F.col("tmdb_season"), F.col("title"), F.col("original"), F.col("slug")).alias("season"),
        "imdb", "year", blank("original").alias("original"), blank("title").alias("title"), "episodes", "pinned",
    )
    placed, after = resolve_records(records, known, sources.select("provider", "provider_id", "provider_slug", F.col("row_id").alias("id")))

    whole = cut(incoming.withColumn("rec", rec).join(placed, "rec"))
    best = whole.groupBy("id").agg(F.max_by(F.struct("title", "original", "year"), "rec").alias("_new"))
    ids = after.select("id", F.struct("tmdb_id", "tmdb_media", "tmdb_season", "imdb").alias("_ids"))
    both = rows.join(ids, "id").join(best, "id", "left")
    put = {c: F.when(present(F.col(f"_new.{c}")), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in ("title", "original", "year")}
    put |= {c: F.col(f"_ids.{c}") for c in ("tmdb_id", "tmdb_media", "tmdb_season", "imdb")}
    differs = ~F.struct(*put.values()).eqNullSafe(F.struct(*put))
    put["updated_at"] = F.when(differs, now).otherwise(F.col("updated_at"))
    kept = both.select(*[put.get(c, F.col(c)).alias(c) for c in rows.columns])
    makers = whole.where("made").select("id", "media_type", "episodes", F.col("title").alias("_named"), F.col("year").alias("_dated"))
    slugs = unique_slugs(makers.select("id", "_named", "_dated"), rows.select("slug"), "id", "_named", "_dated")
    fresh = makers.join(slugs, "id").join(ids, "id").join(best, "id").select("id", "slug", "_new.*", "media_type", "_ids.*", "episodes", F.lit("ready").alias("state"), F.lit(False).alias("pinned"), now.alias("created"), now.alias("updated_at"))

    new_sources = whole.select("provider", "provider_id", "provider_slug", F.col("id").alias("row_id"), "payload", now.alias("seen_at"))
    rest = sources.join(new_sources, ["provider", "provider_id"], "left_anti").join(new_sources, ["provider", "provider_slug"], "left_anti")
    before = sources.select("provider", "provider_id", F.struct("provider_slug", "row_id", "payload").alias("_was"))
    log = new_sources.join(before, ["provider", "provider_id"], "left")
    change = F.when(F.col("_was").isNull(), "insert").when(F.struct("provider_slug", "row_id", "payload").eqNullSafe(F.col("_was")), "same").otherwise("update")
    return kept.unionByName(fresh.select(*rows.columns)), rest.unionByName(new_sources), log.select("provider", "provider_id", "row_id", change.alias("change"))
