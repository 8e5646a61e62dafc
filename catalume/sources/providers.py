"""Raw provider payloads (one JSON text a row) to the canonical record. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalume.functions.scalars import positive
from catalume.functions.text import blank_to_null, first_integer, normalize_title, split_list
from catalume.operators.identity import media_family

DETAIL_A = """movie STRUCT<id STRING, name STRING, slug STRING, original_name STRING, thumb_url STRING, poster_url STRING,
  modified STRING, total_episodes STRING, current_episode STRING, year STRING, director STRING, casts STRING,
  tmdb STRUCT<id STRING, type STRING, season INT>, imdb STRUCT<id STRING>,
  category MAP<STRING, STRUCT<`group` STRUCT<name STRING>, list ARRAY<STRUCT<name STRING>>>>,
  episodes ARRAY<STRUCT<server_name STRING, items ARRAY<STRUCT<name STRING, slug STRING, embed STRING, m3u8 STRING>>>>>"""
DETAIL_B = """movie STRUCT<tmdb STRUCT<id STRING, type STRING, season INT>, imdb STRUCT<id STRING>, name STRING, slug STRING,
  origin_name STRING, type STRING, thumb_url STRING, poster_url STRING, episode_current STRING, episode_total STRING,
  year INT, actor ARRAY<STRING>, director ARRAY<STRING>, category ARRAY<STRUCT<name STRING, slug STRING>>>,
  episodes ARRAY<STRUCT<server_name STRING, server_data ARRAY<STRUCT<name STRING, slug STRING, link_embed STRING, link_m3u8 STRING>>>>"""


#: Where list payloads keep their page count, in the order they are tried (fixed values).
PAGE_PATHS = ("$.paginate.total_page", "$.pagination.totalPages", "$.data.pagination.totalPages", "$.data.paginate.total_page")


def total_pages(payload: Column, paths=PAGE_PATHS) -> Column:
    """The first positive integer among JSON paths."""
    found = [F.get_json_object(payload, p).try_cast("int") for p in paths]
    return F.coalesce(*[F.when(x > 0, x) for x in found])


def _servers(servers: Column, items: str, embed: str, stream: str) -> Column:
    """Servers with renamed episode fields; unnamed episodes are numbered, empty servers dropped."""

    def server(s: Column) -> Column:
        episodes = F.transform(
            s[items],
            lambda e, i: F.struct(
                F.coalesce(blank_to_null(e["name"]), (i + 1).cast("string")).alias("name"),
                F.coalesce(blank_to_null(e["slug"]), F.concat(F.lit("tap-"), (i + 1).cast("string"))).alias("slug"), e[embed].alias("embed"), e[stream].alias("stream"),
            ),
        )
        return F.struct(s["server_name"].alias("server"), episodes.alias("episodes"))

    return F.filter(F.transform(F.coalesce(servers, F.array()), server), lambda s: F.size(s["episodes"]) > 0)


def _canonical(df: DataFrame, provider: str) -> DataFrame:
    tmdb = F.when(F.col("tmdb_id").rlike("^[1-9][0-9]*$"), F.col("tmdb_id").try_cast("long"))
    imdb = F.when(F.col("imdb_id").rlike("^tt[0-9]{7,}$"), F.col("imdb_id"))
    return df.select(
        F.lit(provider).alias("provider"), blank_to_null(F.col("slug")).alias("slug"),
        blank_to_null(F.col("title")).alias("title"), blank_to_null(F.col("original_title")).alias("original_title"),
        normalize_title(F.col("title")).alias("normalized_title"), normalize_title(F.col("original_title")).alias("normalized_original_title"),
        positive(F.col("year")).cast("int").alias("year"), first_integer(F.col("total")).alias("episode_total"),
        tmdb.alias("tmdb_id"), F.nullif(F.col("season"), F.lit(0)).alias("tmdb_season"), imdb.alias("imdb_id"),
        "poster", "thumb", "actors", "directors", "labels", "kind", media_family(F.col("kind")).alias("media_type"), "streams",
    ).where("slug is not null and title is not null")


def provider_a(raw: DataFrame, payload: str = "value") -> DataFrame:
    """Labels come as a map of groups; people as comma lists."""
    m = raw.select(F.from_json(payload, DETAIL_A).alias("d")).select("d.movie.*")
    groups = F.map_values(F.coalesce("category", F.from_json(F.lit("{}"), "map<string, struct<`group`: struct<name: string>, list: array<struct<name: string>>>>")))
    labels = F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(g["list"], lambda x: x["name"]))))

    def group(name: str) -> Column:
        own = F.filter(groups, lambda g: normalize_title(g["group"]["name"]) == name)
        return F.coalesce(F.transform(F.try_element_at(own, F.lit(1))["list"], lambda x: x["name"]), F.array().cast("array<string>"))

    formats = F.transform(group("dinh dang"), normalize_title)
    said = lambda word: F.exists(formats, lambda f: f.contains(word))
    kind = F.when(said("phim le"), "single").when(said("hoat hinh"), "hoathinh").when(said("tv show"), "tvshows").otherwise("series")
    year = F.coalesce(blank_to_null(F.col("year")), F.try_element_at(group("nam"), F.lit(1)))
    return _canonical(
        m.select(
            "slug", F.col("name").alias("title"), F.col("original_name").alias("original_title"), year.alias("year"), F.col("total_episodes").alias("total"),
            F.col("tmdb.id").alias("tmdb_id"), F.col("tmdb.season").alias("season"), F.col("imdb.id").alias("imdb_id"),
            F.col("poster_url").alias("poster"), F.col("thumb_url").alias("thumb"),
            split_list(F.col("casts")).alias("actors"), split_list(F.col("director")).alias("directors"),
            labels.alias("labels"), kind.alias("kind"), _servers(F.col("episodes"), "items", "embed", "m3u8").alias("streams"),
        ), "a",
    )


def provider_b(raw: DataFrame, payload: str = "value") -> DataFrame:
    """This provider has poster and thumb the other way round."""
    d = raw.select(F.from_json(payload, DETAIL_B).alias("d")).select("d.*")
    m = d.select("movie.*", "episodes")
    return _canonical(
        m.select(
            "slug", F.col("name").alias("title"), F.col("origin_name").alias("original_title"), F.col("year").cast("string").alias("year"),
            F.col("episode_total").alias("total"), F.col("tmdb.id").alias("tmdb_id"), F.col("tmdb.season").alias("season"),
            F.col("imdb.id").alias("imdb_id"), F.col("thumb_url").alias("poster"), F.col("poster_url").alias("thumb"),
            F.col("actor").alias("actors"), F.col("director").alias("directors"),
            F.transform("category", lambda c: c["name"]).alias("labels"), F.coalesce(blank_to_null(F.col("type")), F.lit("series")).alias("kind"), _servers(F.col("episodes"), "server_data", "link_embed", "link_m3u8").alias("streams"),
        ), "b",
    )


def read_cache(lines: DataFrame, line: str, number: str) -> DataFrame:
    """key, value of an append-only cache of JSON pairs: the last line of a key wins, torn lines are skipped."""
    pair = lines.select(F.from_json(line, "array<string>").alias("p"), number).where("size(p) = 2 and p[0] is not null")
    return pair.groupBy(F.col("p")[0].alias("key")).agg(F.max_by(F.col("p")[1], number).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """All cells quoted, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def trending_ids(pages: DataFrame) -> DataFrame:
    """id, place: the distinct valid ids of ranked pages (page, ids) in first-seen order."""
    each = pages.select("page", F.posexplode("ids").alias("pos", "id")).where(F.col("id") > 0)
    return each.groupBy("id").agg(F.min(F.struct("page", "pos")).alias("place"))


def ratings_reply(replies: DataFrame, asked: DataFrame) -> DataFrame:
    """id and ratings of a batch reply (JSON arrays of id and ratings), for asked ids only; of repeated ids the first counts."""
    rows = replies.select("batch", F.posexplode(F.from_json("value", "array<struct<id:string,ratings:map<string,double>>>")).alias("pos", "r"))
    known = rows.where("r.id is not null").join(asked.select(F.col("id").alias("_id")).distinct(), F.col("r.id") == F.col("_id"), "left_semi")
    return known.groupBy(F.col("r.id").alias("id")).agg(F.min_by("r.ratings", F.struct("batch", "pos")).alias("ratings"))


def pages_due(checkpoint: DataFrame, head: int, backfill: int) -> DataFrame:
    """lane, page: what a crawl reads next: the first ``head`` pages every time, and ``backfill`` pages from the checkpoint on (lane,
    page, last_page), until the end."""
    first = F.sequence(F.lit(1), F.least(F.lit(head), F.coalesce("last_page", F.lit(head))))
    start = F.greatest(F.lit(head + 1), "page")
    stop = F.least(start + backfill - 1, F.coalesce("last_page", start + backfill - 1))
    more = F.when(start <= stop, F.sequence(start, stop)).otherwise(F.array().cast("array<int>"))
    return checkpoint.select("lane", F.explode(F.array_distinct(F.concat(first.cast("array<bigint>"), more.cast("array<bigint>")))).alias("page"))


def list_identities(items: DataFrame) -> DataFrame:
    """provider, slug and the identity keys of a list item's JSON (value): the lane that refreshes only these keys."""
    read = lambda path: F.get_json_object("value", path)
    claim = F.map_filter(F.create_map(F.lit("tmdb_id"), read("$.tmdb.id"), F.lit("tmdb_type"), read("$.tmdb.type"), F.lit("tmdb_season"), read("$.tmdb.season"), F.lit("imdb_id"), read("$.imdb.id")), lambda k, v: v.isNotNull() & (v != ""))
    return items.select("provider", read("$.slug").alias("slug"), claim.alias("claim")).where("slug is not null")


def sample_by_host(urls: DataFrame, seed: int, each: int) -> DataFrame:
    """``each`` URLs of every host in a seeded random order."""
    from catalume.functions.scalars import host
    from catalume.operators.pick import seeded_sample

    return seeded_sample(urls.withColumn("host", host(F.col("url"))), ["host"], "url", seed, each)


def guest_list(stored: Column, most: int) -> Column:
    """Slugs of a browser's stored rows (JSON: slug, savedAt), newest first, each once."""
    rows = F.filter(F.from_json(stored, "array<struct<slug:string,savedAt:bigint>>"), lambda r: F.coalesce(F.trim(r["slug"]), F.lit("")) != "")
    newest = F.array_sort(rows, lambda a, b: F.when(a["savedAt"] > b["savedAt"], -1).when(a["savedAt"] < b["savedAt"], 1).otherwise(0))
    return F.slice(F.array_distinct(F.transform(newest, lambda r: F.trim(r["slug"]))), 1, most)


def reader_card(payload: Column) -> Column:
    """One card shape from the payload variants that catalogue readers meet (JSON)."""
    first = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object(payload, p), F.lit("")) for p in paths])
    return F.struct(
        first("$.slug", "$.data.slug").alias("slug"), first("$.name", "$.title", "$.data.name").alias("name"), first("$.origin_name", "$.original_name", "$.originName").alias("origin_name"),
        first("$.thumb_url", "$.thumb", "$.poster_url").alias("thumb"), first("$.poster_url", "$.poster", "$.thumb_url").alias("poster"), first("$.year").try_cast("int").alias("year"),
        first("$.tmdb.vote_average", "$.vote_average").try_cast("double").alias("rating"),
    )
