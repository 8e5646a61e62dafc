"""What readers are shown: cards, details, credits, reviews, envelopes, entries for a model. Columns to structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.functions.scalars import percentage, rating
from catalume.functions.text import clip, first_by_key, normalize_title

#: The only columns that a matching model may see (fixed values).
MODEL_COLUMNS = ("id", "title", "original_title", "year", "media_type", "countries", "actors", "directors", "episode_total", "duration", "overview")


def model_view(rows: DataFrame) -> DataFrame:
    """Nothing but the whitelisted columns; a missing one is an error."""
    return rows.select(*MODEL_COLUMNS)


def season_title(title: Column, media: Column, season: Column) -> Column:
    """A series' title with its own season in place of what it says."""
    base = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?:\s+\(Phần\s+[0-9]+\))+$", "")
    return F.when((media == "tv") & season.isNotNull(), F.concat(base, F.lit(" (Phần "), season.cast("string"), F.lit(")"))).otherwise(F.coalesce(title, F.lit("")))


def merge_ratings(current: Column, incoming: Column, media: Column, tmdb_id: Column) -> Column:
    """Maps of scores and their provenance ``tmdb_src``. Null and 0 never erase; a score fetched for another identity goes first; one
    fetched for this identity is replaced only by another such; a provider's score drops a stale mark.
    """
    own = F.concat_ws(":", media, tmdb_id.cast("string"))
    stale = current["tmdb_src"].isNotNull() & ~(current["tmdb_src"].eqNullSafe(F.when(media.isNotNull() & tmdb_id.isNotNull(), own)))
    scores = F.array(F.lit("tmdb"), F.lit("tmdb_count"), F.lit("tmdb_src"))
    base = F.when(stale, F.map_filter(current, lambda k, v: ~F.array_contains(scores, k))).otherwise(current)
    fetched = lambda m: F.coalesce((m["tmdb_src"] == own) & (m["tmdb"].try_cast("double") > 0), F.lit(False))
    keep = fetched(base) & ~fetched(incoming)
    said = F.map_filter(incoming, lambda k, v: v.isNotNull() & (F.coalesce(v.try_cast("double"), F.lit(1.0)) != 0) & ~(keep & F.array_contains(scores, k)))
    drop_mark = F.map_contains_key(said, F.lit("tmdb")) & ~F.map_contains_key(incoming, F.lit("tmdb_src"))
    rest = F.map_filter(base, lambda k, v: ~F.map_contains_key(said, k) & ~((k == "tmdb_src") & drop_mark))
    return F.map_concat(rest, said)


def stale_score(ratings: Column, media: Column, tmdb_id: Column) -> Column:
    return F.coalesce(ratings["tmdb_src"] != F.concat_ws(":", media, tmdb_id.cast("string")), F.lit(False))


def card(r) -> Column:
    """A card of a row (``r``: name -> Column): titles, the image chain, scores of this identity only."""
    stale = stale_score(r("ratings"), r("tmdb_media"), r("tmdb_id"))
    score = lambda k: F.when(~stale, F.nullif(r("ratings")[k].try_cast("double"), F.lit(0.0))) if k.startswith("tmdb") else F.nullif(r("ratings")[k].try_cast("double"), F.lit(0.0))
    return F.struct(
        r("id").alias("id"), season_title(r("title"), r("tmdb_media"), r("tmdb_season")).alias("name"), r("original_title").alias("origin_name"), r("slug").alias("slug"),
        F.coalesce(r("display"), r("media_type")).alias("type"), r("year").alias("year"),
        F.coalesce(r("tmdb_thumb"), r("thumb"), r("poster")).alias("thumb"), F.coalesce(r("tmdb_poster"), r("poster"), r("thumb")).alias("poster"),
        F.struct(r("tmdb_id").alias("id"), F.coalesce(r("tmdb_media"), r("media_type")).alias("type"), r("tmdb_season").alias("season"), score("tmdb").alias("vote_average"), score("tmdb_count").alias("vote_count")).alias("tmdb"),
        F.struct(r("imdb_id").alias("id"), score("imdb").alias("vote_average"), score("imdb_count").alias("vote_count")).alias("imdb"),
        F.coalesce(r("sorted_at"), r("provider_updated_at"), r("updated_at")).alias("modified"),
    )


def details(rows: DataFrame, sources: DataFrame, credits_: DataFrame, reviews: DataFrame, shown: int = 2) -> DataFrame:
    """id, cast, directors, reviews (the first ``shown`` of review_count), episodes (all streams of live sources in priority order),
    sources. Children are aggregated before they meet their row.
    """
    ordered = lambda order, *fields: F.sort_array(F.collect_list(F.struct(order, *fields)))
    src = sources.groupBy("id").agg(ordered("priority", "provider", "available", "slug", "streams").alias("sources"))
    cast = credits_.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("role") == "cast", F.struct("ord", "name", "character")))).alias("cast"), F.sort_array(F.collect_list(F.when(F.col("role") == "director", F.struct("ord", "name")))).alias("directors"))
    rev = reviews.groupBy("id").agg(ordered("place", "author", "rating", "content").alias("r"), F.count("*").alias("review_count"))
    out = rows.select("id").join(src, "id", "left").join(cast, "id", "left").join(rev, "id", "left")
    streams = F.flatten(F.transform(F.filter("sources", lambda s: s["available"]), lambda s: F.coalesce(s["streams"], F.array().cast("array<string>"))))
    return out.select("id", "cast", "directors", F.slice("r", 1, shown).alias("reviews"), F.coalesce("review_count", F.lit(0)).alias("review_count"), F.coalesce(streams, F.array().cast("array<string>")).alias("episodes"), F.transform("sources", lambda s: F.struct(s["provider"].alias("provider"), s["priority"].alias("priority"), s["available"].alias("available"), s["slug"].alias("slug"))).alias("sources"))


def credits_of(body: Column, cap: int) -> Column:
    """cast and directors of a credits body (cast: id, name, character, order; crew: id, name, job): first billing of a person, ``cap`` cast."""
    valid = lambda p: (p["id"] > 0) & (F.trim(p["name"]) != "")
    billed = F.transform(F.filter(body["cast"], valid), lambda p, i: F.struct(p["id"].alias("id"), F.trim(p["name"]).alias("name"), F.nullif(F.trim(p["character"]), F.lit("")).alias("character"), F.coalesce(p["order"], i).alias("ord")))
    directed = F.transform(F.filter(body["crew"], lambda p: valid(p) & (p["job"] == "Director")), lambda p: F.struct(p["id"].alias("id"), F.trim(p["name"]).alias("name")))
    return F.struct(F.slice(first_by_key(billed, "id"), 1, cap).alias("cast"), first_by_key(directed, "id").alias("directors"))


def review_card(r) -> Column:
    fields = [r(c).alias(c) for c in ("id", "author")]
    return F.struct(*fields, r("rating").try_cast("double").alias("rating"), r("content").alias("content"), r("created_at").alias("created_at"), r("url").alias("url"), F.coalesce(r("spoiler"), F.lit(False)).alias("has_spoiler"))


def envelope(cards: DataFrame, title: str, size: int) -> DataFrame:
    """One row: the page's items in order, its title and the pagination. cards: place, card, total, page."""
    out = cards.agg(F.sort_array(F.collect_list(F.struct("place", "card"))).alias("x"), F.max("total").alias("total_items"), F.max("page").alias("current_page"))  # one page of rows
    pages = F.greatest(F.lit(1), F.ceil(F.coalesce("total_items", F.lit(0)) / size)).cast("long")
    return out.select(F.lit(title).alias("title"), F.transform("x", lambda x: x["card"]).alias("items"), F.coalesce("total_items", F.lit(0)).alias("total_items"), F.lit(size).alias("per_page"), F.coalesce("current_page", F.lit(1)).alias("current_page"), pages.alias("total_pages"))


def home(sections: dict[str, DataFrame], hero: DataFrame, fallback: DataFrame, limit: int) -> DataFrame:
    """section, place, id of all lists of the home page; the hero's rows, or if it has none the first of ``fallback``."""
    out = None
    for name, rows in sections.items():
        part = rows.select(F.lit(name).alias("section"), "place", "id")
        out = part if out is None else out.unionByName(part)
    none = hero.agg((F.count("*") == 0).alias("_none"))
    spare = fallback.crossJoin(F.broadcast(none)).where(F.col("_none") & (F.col("place") <= limit))  # one row
    chosen = hero.select("place", "id").unionByName(spare.select("place", "id"))
    return out.unionByName(chosen.select(F.lit("hero").alias("section"), "place", "id"))


def candidate(d, series: Column) -> Column:
    """A compact candidate of a title body (``d``: name -> Column): key, names (distinct), year, size, clipped overview, first cast."""
    names = F.array_distinct(F.filter(F.transform(F.concat(F.array(d("title"), d("name"), d("original_title"), d("original_name")), d("alternatives"), d("translations")), lambda n: F.trim(n)), lambda n: n != ""))
    year = F.substring(F.when(series, d("first_air_date")).otherwise(d("release_date")), 1, 4).try_cast("int")
    return F.struct(
        F.concat_ws(":", F.when(series, "tv").otherwise("movie"), d("id").cast("string")).alias("key"), F.coalesce(F.when(series, d("name")).otherwise(d("title")), F.lit("")).alias("title"),
        F.when(year > 1800, year).alias("year"), F.when(series, d("seasons")).alias("seasons"), F.when(series, d("episodes")).alias("episodes"), names.alias("names"),
        F.substring(F.coalesce(d("overview"), F.lit("")), 1, 400).alias("overview"), F.slice(d("cast"), 1, 30).alias("cast"),
    )


def prompt_entry(r, candidates: Column, level: int) -> Column:
    """One entry for a model, smaller at higher levels: fewer candidates and people, shorter overviews, and no ids of the row itself."""
    people, words, most = (10, 400, 8), (5, 200, 6), (3, 0, 4)
    n_people, overview, n_candidates = (people, words, most)[min(level, 2)]
    shown = F.transform(F.slice(candidates, 1, n_candidates), lambda c: F.struct(c["key"].alias("key"), c["title"].alias("title"), c["year"].alias("year"), clip(c["overview"], max(overview, 1)).alias("overview"), F.slice(c["cast"], 1, n_people).alias("cast")))
    return F.struct(r("title").alias("title"), r("original_title").alias("original_title"), r("year").alias("year"), F.slice(r("actors"), 1, n_people).alias("actors"), shown.alias("candidates"))


def display_ratings(r) -> Column:
    """The scores to show, TMDB first: of several places the first that holds a rating."""
    first = lambda *names: F.coalesce(*[F.nullif(rating(r(n)), F.lit(0.0)) for n in names])
    shown = lambda label, value: F.when(value.isNotNull(), F.concat(F.lit(f"{label} "), F.regexp_replace(F.format_string("%.1f", value), r"\.0$", "")))
    return F.array_compact(F.array(shown("TMDB", first("tmdb_rating", "vote_average")), shown("IMDb", first("imdb_rating", "imdb_score"))))


def score_badges(tomatometer: Column, audience: Column, fresh: int = 60) -> Column:
    """Both percentage badges; the first is fresh from ``fresh`` on."""
    tomato, people = percentage(tomatometer), percentage(audience)
    return F.struct(tomato.alias("tomato"), (tomatometer.try_cast("double") >= fresh).alias("fresh"), people.alias("popcorn"))


def nav_category(labels: Column, episodes: Column) -> Column:
    """The list a title belongs to by its labels (type, category, slugs, names), else by its episode count; empty if unknown."""
    text = F.concat(F.lit(" "), F.lower(F.translate(normalize_title(labels), "-_", "  ")), F.lit(" "))
    word = lambda pattern: text.rlike(f" (?:{pattern}) ")
    ladder = F.when(word("hoat ?hinh|anime|animation|cartoon"), "hoat-hinh").when(word("tv ?shows?|shows?|tv ?series"), "tv-shows")
    ladder = ladder.when(word("phim ?bo|series|serial"), "phim-bo").when(word("phim ?le|single|movie"), "phim-le")
    return ladder.when(F.lower(F.trim(episodes)).isin("full", "1"), "phim-le").otherwise("")


def page_number(value: Column) -> Column:
    """A page of at least 1 from any text."""
    return F.greatest(F.lit(1).cast("long"), F.coalesce(F.floor(F.trim(value).try_cast("double")), F.lit(1).cast("long")))


def review_order(reviews: DataFrame, day: Column, key: str, band: int = 10) -> DataFrame:
    """Adds ``place``: warned reviews first, then by band of the score, then in an order that changes from day to day."""
    rank = F.sha1(F.concat_ws("|", day, F.col(key), F.col("id")))
    w = Window.partitionBy(key).orderBy(F.coalesce("spoiler", F.lit(False)).desc(), F.floor(F.col("score") / band).desc(), rank)
    return reviews.withColumn("place", F.row_number().over(w))
