"""Which outside title a catalogue row is: claims of providers, seasons, conflicts, plans. Columns to columns, but for the plan's joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalume.functions.text import declared_seasons, first_integer, marked_season, season_in_slug, season_of, slugs_agree
from catalume.operators.match import fuzzy_match

CLAIM = "struct<provider:string,tmdb_id:bigint,media:string,season:int,imdb:string>"


def media_family(kind: Column) -> Column:
    """movie or tv."""
    return F.when(F.lower(kind).isin("single", "movie", "phim-le"), "movie").otherwise("tv")


def claim(provider: Column, meta: Column) -> Column:
    """A provider record's claim from its metadata map: an id only with its type, a season only of a series, a well-formed IMDb id."""
    number = F.nullif(F.greatest(meta["tmdb_id"].try_cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    kind = F.lower(meta["tmdb_type"])
    media = F.when(number.isNotNull() & kind.isin("movie", "tv"), kind)
    season = meta["tmdb_season"].try_cast("int")
    imdb = F.lower(F.trim(meta["imdb_id"]))
    fields = (
        provider.alias("provider"), F.when(media.isNotNull(), number).alias("tmdb_id"), media.alias("media"),
        F.when((media == "tv") & (season > 0), season).alias("season"), F.when(imdb.rlike("^tt[0-9]{5,}$"), imdb).alias("imdb"),
    )
    return F.struct(*fields).cast(CLAIM)


def claims_key(claims: Column) -> Column:
    """The sorted fingerprint of an array of claims; those that claim nothing do not count."""
    said = F.filter(claims, lambda c: c["tmdb_id"].isNotNull() | c["imdb"].isNotNull())
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    lines = F.transform(said, lambda c: F.concat_ws(":", c["provider"], blank(c["tmdb_id"]), blank(c["media"]), blank(c["season"]), blank(c["imdb"])))
    return F.array_join(F.array_sort(lines), "|")


def type_conflict(display: Column, media: Column) -> Column:
    """A series id on a single film or a film id on a series; unknown and animated rows never conflict."""
    shown = F.lower(display)
    return F.coalesce(((media == "tv") & (shown == "single")) | ((media == "movie") & shown.isin("series", "tvshows")), F.lit(False))


def incoming_season(media: Column, season: Column, title: Column, original: Column, slug: Column) -> Column:
    """The first of the stated season of a series and the markers of title, original title and slug."""
    return F.coalesce(F.when(media == "tv", season), season_of(title), season_of(original), season_in_slug(slug))


def row_season(season: Column, title: Column, original: Column, slug: Column) -> Column:
    return F.coalesce(season, season_of(title), season_of(original), season_in_slug(slug))


def identity_conflict(row: Column, incoming: Column) -> Column:
    """Null, or why a row cannot be an incoming record. Both are structs of media_type, tmdb_id, tmdb_media, season (the row's or
    the record's own), tmdb_season.
    """
    series = (media_family(row["media_type"]) == "tv") | (media_family(incoming["media_type"]) == "tv")
    other_id = row["tmdb_id"].isNotNull() & incoming["tmdb_id"].isNotNull() & ((row["tmdb_id"] != incoming["tmdb_id"]) | (row["tmdb_media"] != incoming["tmdb_media"]))
    other_season = (incoming["tmdb_media"] == "tv") & row["tmdb_id"].isNotNull() & row["tmdb_season"].isNotNull() & ~row["tmdb_season"].eqNullSafe(incoming["tmdb_season"])
    return F.when(series & (row["season"] != incoming["season"]), "season-differs").when(other_id, "tmdb-differs").when(other_season, "season-differs")


def reconcile_source(stored_id: Column, incoming_id: Column, slug: Column) -> Column:
    """provider_id and rekey_from: a summary (its id is its slug) keeps the stored id; another real id takes the stored row over."""
    kept = stored_id.isNull() | (stored_id == incoming_id)
    summary = ~kept & (incoming_id == slug)
    return F.struct(F.when(summary, stored_id).otherwise(incoming_id).alias("provider_id"), F.when(~kept & ~summary, stored_id).alias("rekey_from"))


def provider_decision(row: Column, claims: Column) -> Column:
    """action, tier, reason, tmdb_id, media, season and imdb_action for a row and its array of claims.

    row: tmdb_id, tmdb_media, tmdb_season, imdb, display, pinned, title, slug. Two providers with one id beat what the row holds; ids
    that differ are queued; one provider fills an empty row. A season is rewritten only on two agreeing signals, the title's marker
    being one. Pinned rows and contradicting types are never written.
    """
    named = F.filter(claims, lambda c: c["tmdb_id"].isNotNull())
    ids = F.array_distinct(F.transform(named, lambda c: F.struct(c["tmdb_id"].alias("tmdb_id"), c["media"].alias("media"))))
    one = F.try_element_at(ids, F.lit(1))
    number, media = one["tmdb_id"], one["media"]
    agreed = F.size(F.array_distinct(F.transform(named, lambda c: c["provider"]))) >= 2
    held = row["tmdb_id"].isNotNull()
    same = held & (row["tmdb_id"] == number) & (row["tmdb_media"].isNull() | (row["tmdb_media"] == media))
    pinned = F.coalesce(row["pinned"], F.lit(False))

    marker = marked_season(row["title"], row["slug"])
    said = F.filter(named, lambda c: c["season"].isNotNull())
    seasons = F.array_distinct(F.transform(said, lambda c: c["season"]))
    backers = lambda s: F.size(F.array_distinct(F.transform(F.filter(said, lambda c: c["season"] == s), lambda c: c["provider"])))
    only = F.try_element_at(seasons, F.lit(1))
    tv, several, single = media == "tv", F.size(seasons) > 1, F.size(seasons) == 1
    settled = several & F.coalesce(F.array_contains(seasons, marker), F.lit(False))
    disagree = tv & several & ~settled
    against = tv & single & marker.isNotNull() & (marker != only)
    season = F.when(tv, F.when(several, marker).when(single, only).otherwise(marker))
    support = F.when(several | (marker == season), backers(season) + 1).otherwise(backers(season))

    def verdict(action, tier=None, reason=None, with_season=None):
        text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
        given = F.lit(None).cast("int") if with_season is None else with_season
        return F.struct(text(action).alias("action"), text(tier).alias("tier"), text(reason).alias("reason"), given.alias("season"))

    def queue(reason: str):
        return verdict(F.when(pinned, "blocked").otherwise("queue"), None, F.when(pinned, "pinned").otherwise(reason))

    def write(tier: str, reason, with_season, unknown=None):
        blocked = verdict("blocked", None, "pinned")
        plain = F.when(pinned, blocked)
        return (plain if unknown is None else plain.when(unknown, verdict("resolve-season", tier, "season-unknown" if tier == "fill" else "providers-agree"))).otherwise(verdict("assign", tier, reason, with_season))

    imdb_ids = F.array_distinct(F.filter(F.transform(claims, lambda c: c["imdb"]), lambda x: x.isNotNull()))
    imdb = F.when(F.size(imdb_ids) == 0, F.lit(None).cast("string"))
    imdb = imdb.when(row["imdb"].isNotNull(), F.when(~F.array_contains(imdb_ids, row["imdb"]), "conflict")).when(F.size(imdb_ids) == 1, "fill").otherwise("conflict")
    findable = ~held & (row["imdb"].isNotNull() | (imdb == "fill"))
    kept = season.isNull() | (season == row["tmdb_season"])
    complete = row["tmdb_media"].isNotNull() & row["tmdb_season"].isNotNull()

    ladder = F.when(F.size(named) == 0, F.when(findable, verdict("find")).otherwise(verdict("none")))
    ladder = ladder.when(F.size(ids) > 1, queue("providers-disagree"))
    ladder = ladder.when(type_conflict(row["display"], media), F.when(same, verdict("noop")).otherwise(queue("type-mismatch")))
    ladder = ladder.when(disagree, queue("season-disagree"))
    ladder = ladder.when(against, F.when(same & (row["tmdb_season"] == marker), verdict("noop")).otherwise(queue("season-vs-title")))
    ladder = ladder.when(~held, write("fill", F.when(agreed, "providers-agree").otherwise("single-provider"), season, tv & season.isNull()))
    ladder = ladder.when(same & ~tv, F.when(row["tmdb_media"].isNotNull(), verdict("noop")).otherwise(write("fill", "type-fill", F.lit(None).cast("int"))))
    ladder = ladder.when(same & kept & complete, verdict("noop"))
    ladder = ladder.when(same & (kept | row["tmdb_season"].isNull()), write("fill", "season-fill", F.coalesce(season, row["tmdb_season"]), season.isNull() & row["tmdb_season"].isNull()))
    ladder = ladder.when(same, F.when(support < 2, queue("season-single-dissent")).otherwise(write("season", "season-agree", season)))
    ladder = ladder.when(pinned, verdict("blocked", None, "pinned")).when(~agreed, verdict("queue", None, "single-vs-existing"))
    ladder = ladder.otherwise(write("overwrite", "providers-agree", season, tv & season.isNull()))

    def named_fields(found: Column) -> Column:
        writes = found["action"].isin("assign", "resolve-season")
        return F.struct(
            found["action"].alias("action"), found["tier"].alias("tier"), found["reason"].alias("reason"),
            F.when(writes, number).alias("tmdb_id"), F.when(writes, media).alias("media"), found["season"].alias("season"), imdb.alias("imdb_action"),
        )

    return _bound(ladder, named_fields)


def review_key(claims: Column, row: Column, settings: Column) -> Column:
    """What a decision depends on: the claims, then the row's own identity and the settings."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    own = [blank(row[c]) for c in ("tmdb_id", "tmdb_media", "tmdb_season", "imdb")]
    return F.concat(claims_key(claims), F.lit("#"), F.concat_ws(":", *own, F.when(row["pinned"], "p").otherwise(""), settings))


def review_unchanged(stored_key: Column, status: Column, outcome: Column, key: Column) -> Column:
    """The same fingerprint, or a decision of the model on the same claims."""
    claims_part = F.concat(F.substring_index(key, "#", 1), F.lit("#"))
    settled = (status == "done") & F.coalesce(outcome.startswith("ai-"), F.lit(False)) & stored_key.startswith(claims_part)
    return stored_key.isNotNull() & ((stored_key == key) | F.coalesce(settled, F.lit(False)))


def resolve_season(media: Column, stored: Column, title: Column, slug: Column, known: Column, explicit: Column) -> Column:
    """season and blocked: the stored season, the marker, the given one, or 1 of a show of one season."""
    total = F.when(known > 0, known)
    marked = F.coalesce(F.when(stored >= 0, stored), marked_season(title, slug))
    bad = marked.isNull() & (explicit < 1)
    season = F.coalesce(marked, explicit, F.when(total == 1, 1))
    range_ = (season < 1) | F.coalesce(season > total, F.lit(False))
    blocked = F.when(media == "movie", F.lit(None).cast("string")).when(bad, "season-invalid").when(season.isNull(), "season-unknown").when(range_, "season-out-of-range")
    return F.struct(F.when((media != "movie") & ~F.coalesce(bad, F.lit(False)), season).alias("season"), blocked.alias("blocked"))


def _bound(value: Column, then) -> Column:
    """``then(value)``, with value computed once for each row however often it is used."""
    return F.transform(F.array(value), then)[0]


def infer_season(year: Column, total: Column, title: Column, original: Column, slug: Column, shows: Column) -> Column:
    """season and reason: which of ``shows`` (number, episodes, year: an array ordered by number) a row of this year and episode
    count is. An answer needs a year within one and an episode count within a quarter that one season alone has; ties go to the
    exact year, then to the exact count; several seasons that add up to the count are a span and no answer.
    """
    near = lambda s: s["year"].isNotNull() & (F.abs(s["year"] - year) <= 1)

    def far(s: Column, n: Column) -> Column:
        return (F.abs(s["episodes"] - n) > 5) & (F.abs(s["episodes"] - n) / F.greatest(F.lit(1), F.least(s["episodes"], n)) > 0.25)

    def fitting(known: Column) -> Column:
        """Adds to n and seasons the seasons in the year and those of them that fit."""
        n, seasons = known["n"], known["seasons"]
        ratio = lambda s: F.greatest(s["episodes"], n) / F.least(s["episodes"], n).cast("double")
        in_year = F.filter(seasons, near)
        return F.struct(n.alias("n"), seasons.alias("seasons"), in_year.alias("in_year"), F.filter(in_year, lambda s: (s["episodes"] > 0) & (ratio(s) <= 1.25)).alias("fits"))

    def choosing(known: Column) -> Column:
        n, seasons, in_year, fits = (known[c] for c in ("n", "seasons", "in_year", "fits"))

        def tied(exact: Column) -> Column:
            counted = F.filter(F.when(F.size(exact) > 0, exact).otherwise(fits), lambda s: s["episodes"] == n)
            return F.when(F.size(exact) == 1, exact[0]).when(F.size(counted) == 1, counted[0])

        chosen = F.when(F.size(seasons) == 1, seasons[0]).when(F.size(fits) == 1, fits[0]).when(F.size(fits) > 1, _bound(F.filter(fits, lambda s: s["year"] == year), tied))
        return F.struct(n.alias("n"), seasons.alias("seasons"), in_year.alias("in_year"), fits.alias("fits"), chosen.alias("chosen"))

    def judging(known: Column) -> Column:
        n, seasons, in_year, fits, chosen = (known[c] for c in ("n", "seasons", "in_year", "fits", "chosen"))

        def span(totals: Column) -> Column:
            """A span starts at a season near the year; sums of following seasons are differences of running totals."""
            starts = F.transform(seasons, lambda s, i: F.struct(near(s).alias("near"), i.alias("i")))
            return F.exists(starts, lambda s: s["near"] & F.exists(F.slice(totals, s["i"] + 3, F.greatest(F.lit(0), F.size(totals) - s["i"] - 2)), lambda t: t - F.element_at(totals, s["i"] + 1) == n))

        totals = F.aggregate(seasons, F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s["episodes"])))
        clash = F.exists(declared_seasons(title, original, slug), lambda m: m != chosen["number"])
        several = F.size(seasons) > 1
        reason = (
            F.when(year.isNull() | (year <= 0), "no-year").when(n < 3, "too-few-episodes").when(marked_season(title, slug).isNotNull(), "has-season-marker")
            .when(F.coalesce(F.size(seasons), F.lit(0)) <= 0, "no-seasons")
            .when(several & (F.size(fits) > 1) & chosen.isNull(), "ambiguous")
            .when(several & (F.size(in_year) == 0), "year-gap")
            .when(several & (F.size(fits) == 0), F.when(_bound(totals, span), "multi-season-span").when(F.forall(in_year, lambda s: (s["episodes"] > 0) & far(s, n)), "episode-gap").otherwise("no-season-fits"))
            .when(chosen["year"].isNotNull() & (F.abs(chosen["year"] - year) > 1), "year-gap").when((chosen["episodes"] > 0) & far(chosen, n), "episode-gap")
            .when(clash, "marker-conflict")
        )
        return _bound(F.struct(chosen["number"].alias("number"), reason.alias("reason")), lambda r: F.struct(F.when(r["reason"].isNull(), r["number"]).alias("season"), r["reason"].alias("reason")))

    known = F.struct(F.coalesce(first_integer(total.cast("string")), F.lit(0)).alias("n"), F.filter(shows, lambda s: s["number"] > 0).alias("seasons"))
    return _bound(known, lambda a: _bound(fitting(a), lambda b: _bound(choosing(b), judging)))


def merge_guard(a: Column, b: Column) -> Column:
    """Null, or why two rows (imdb, year, title, slug) plainly differ."""
    seasons = marked_season(a["title"], a["slug"]) != marked_season(b["title"], b["slug"])
    return F.when(a["imdb"] != b["imdb"], "imdb-differs").when(F.abs(a["year"] - b["year"]) > 1, "year-differs").when(seasons, "season-differs")


def identity_plan(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, action (noop, assign, merge, blocked), reason, survivor, dropped for ``wanted`` (id, tmdb_id, media, season and, where a row may
    lose another identity, ``replace``).

    rows: id, state, tmdb_id, media, season, imdb, year, title, slug, pinned, providers (array), filled (count of set fields), created.
    Holders of a tuple meet by its key, so a tuple that many rows hold is counted, not multiplied.
    """
    replace = F.coalesce("replace", F.lit(False)) if "replace" in wanted.columns else F.lit(False)
    key = F.concat_ws(":", "media", F.col("tmdb_id").cast("string"), F.when(F.col("media") == "tv", F.coalesce(F.col("season").cast("string"), F.lit(""))).otherwise(""))
    row = F.struct(*[F.col(c) for c in rows.columns])
    held = rows.where("tmdb_id is not null").groupBy(key.alias("_key")).agg(F.count("*").alias("_n"), F.min_by(row, F.col("id")).alias("_a"), F.max_by(row, F.col("id")).alias("_b"))
    target = rows.select(F.col("id").alias("_id"), row.alias("_t"))
    found = wanted.withColumn("_key", key).join(target, F.col("id") == F.col("_id"), "left").join(held, "_key", "left")
    t = F.col("_t")
    own = t["tmdb_id"].isNotNull() & (t["tmdb_id"] == F.col("tmdb_id")) & (t["media"] == F.col("media")) & t["season"].eqNullSafe(F.col("season"))
    holder = F.when(F.col("_a.id") == F.col("id"), F.col("_b")).otherwise(F.col("_a"))
    kk = lambda x: F.array_contains(x["providers"], "kkphim").cast("int")
    rank = lambda x: F.struct(F.size(x["providers"]).alias("p"), kk(x).alias("k"), x["filled"].alias("f"), (-F.unix_micros(x["created"])).alias("c"))
    keeps = (rank(t) > rank(holder)) | ((rank(t) == rank(holder)) & (t["id"] < holder["id"]))
    why = F.when(F.size(t["providers"]) != F.size(holder["providers"]), "more-providers").when(kk(t) != kk(holder), "has-kkphim").when(t["filled"] != holder["filled"], "fuller-metadata").otherwise("oldest-row")
    blocked = (
        F.when(t.isNull(), "row-missing").when(t["state"] != "ready", "not-ready").when(own, F.lit(None).cast("string")).when(t["pinned"], "pinned")
        .when(t["tmdb_id"].isNotNull() & ~replace, "row-has-other-identity").when(F.col("_n") > 1, "multiple-holders").when(F.col("_n").isNull(), F.lit(None).cast("string"))
        .when(holder["state"] != "ready", "holder-not-ready").when(merge_guard(t, holder).isNotNull(), merge_guard(t, holder)).when(holder["pinned"], "holder-pinned")
    )
    action = F.when(blocked.isNotNull(), "blocked").when(own, "noop").when(F.col("_n").isNull(), "assign").otherwise("merge")
    merges = action == "merge"
    return found.select(
        "id", action.alias("action"),
        F.when(blocked.isNotNull(), blocked).when(action == "noop", "already-assigned").when(merges, F.concat(F.lit("survivor:"), why)).alias("reason"),
        F.when(merges & ~keeps, holder["id"]).otherwise(F.col("id")).alias("survivor"), F.when(merges, F.when(keeps, holder["id"]).otherwise(F.col("id"))).alias("dropped"),
    )


def _row_keys(media_type: Column, tmdb_id: Column, media: Column, season: Column, imdb: Column, year: Column, original: Column, title: Column) -> list[Column]:
    """The keys of rules 2 to 6, as structs of rule and key; null where a side has none."""
    text = lambda *parts: F.concat_ws("|", *[p.cast("string") for p in parts])
    dated = lambda name: F.when(year.isNotNull() & name.isNotNull() & (name != ""), text(name, year, media_type))
    made = {2: F.when(tmdb_id.isNotNull(), text(media, tmdb_id, F.coalesce(season, F.lit(-1)))), 3: F.when(imdb.isNotNull(), text(imdb, media_type)), 4: dated(original), 5: dated(original), 6: dated(title)}
    return [F.when(key.isNotNull(), F.struct(F.lit(rule).alias("rule"), key.alias("key"))) for rule, key in made.items()]


def find_rows(incoming: DataFrame, rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rec, id, rule: the row each incoming record belongs to, by the first of seven rules that finds one: its source (1), its id
    tuple (2), IMDb id and type (3), for provider a the original title with the season it names (4), original title (5), title (6),
    similar title (7), among all rows of its year and type. A row whose season or ids contradict the record is passed over by rule 3
    and refused after rules 4 to 7.

    incoming: rec, provider, provider_id, slug, raw_title, media_type, tmdb_id, tmdb_media, tmdb_season, season, imdb, year, original,
    title (both normalised), episodes; sources: provider, provider_id, id and perhaps provider_slug, which counts after the id; rows:
    id, created, state, slug, media_type, tmdb_id, tmdb_media, tmdb_season, season, imdb, year, original, title, episodes.

    Rules 1 to 6 are one join: each side lists its keys with the rule they are for.
    """
    sides = ("media_type", "tmdb_id", "tmdb_media", "season", "tmdb_season")
    rest = (*sides, "slug", "episodes")
    own = [F.col(c) for c in ("media_type", "tmdb_id", "tmdb_media", "tmdb_season", "imdb", "year", "original", "title")]
    source = lambda c, n: F.struct(F.lit(1).alias("rule"), F.concat_ws("|", F.lit(n), "provider", c).alias("key"))
    named = F.when((F.col("provider") == "a") & (F.col("original") != ""), F.coalesce(marked_season(F.col("raw_title"), F.col("slug")), F.lit(1))).alias("named")  # for rule 4
    asked = incoming.select("rec", "provider", F.struct(*rest, named).alias("i"), F.explode(F.array(source("provider_id", "id"), source("slug", "slug"), *_row_keys(*own))).alias("k"))
    asked = asked.where("k is not null and (k.rule != 4 or provider = 'a')").select("rec", "i", "k.*")
    held = rows.select("id", "created", "state", F.struct(*rest).alias("r"), F.explode(F.array(*_row_keys(*own))).alias("k")).where("k is not null").select("id", "created", "state", "r", "k.*")
    for c, n in (("provider_id", "id"), ("provider_slug", "slug")):
        if c in sources.columns:
            blank = [F.lit(None).cast(held.schema[x].dataType).alias(x) for x in ("created", "state", "r")]
            held = held.unionByName(sources.where(F.col(c).isNotNull()).select("id", *blank, source(c, n).alias("k")).select("id", "created", "state", "r", "k.*"))
    clash = F.coalesce(identity_conflict(F.col("r"), F.col("i")).isNotNull(), F.lit(False))
    met = asked.join(held, ["rule", "key"]).withColumn("clash", clash)
    rule, season = F.col("rule"), F.col("r.tmdb_season")
    fits = F.when(rule == 3, ~F.col("clash")).when(rule == 4, F.coalesce((F.col("state") == "ready") & (season == F.col("i.named")), F.lit(False))).when(rule >= 5, season.isNull()).otherwise(True)
    order = F.struct(F.when(rule == 1, F.when(F.col("key").startswith("id|"), 0).otherwise(1)).when(rule == 3, F.coalesce(season, F.lit(-1))).otherwise(0).alias("a"), "created", "id")
    most, least = (f(F.col("i.episodes"), F.col("r.episodes")) for f in (F.greatest, F.least))
    near = F.when(rule == 4, slugs_agree(F.col("i.slug"), F.col("r.slug")) & F.coalesce((least <= 0) | (most / least <= 1.5), F.lit(True)))
    best = met.where(fits).select("rec", "rule", order.alias("o"), F.struct("id", "clash", near.alias("near")).alias("b"))
    best = best.groupBy("rec", "rule").agg(F.min_by("b", "o").alias("b"), F.count("*").alias("n"))
    exact = best.where((rule != 4) | ((F.col("n") == 1) & F.col("b.near"))).select("rec", "rule", "b.id", "b.clash")

    listed = lambda c: F.array_remove(F.split(c, " "), "")  # noqa: E731  an empty name is like no other
    words = lambda df: df.withColumn("_o", listed("original")).withColumn("_w", listed("title"))
    left, right = words(incoming.select("rec", "year", "original", "title", *sides)), words(rows.where("tmdb_season is null").select("id", "created", "year", "original", "title", *sides))
    alike = fuzzy_match(left, right, ["year", "media_type"], ["_o", "_w"], 0.96, ["created", "id"], oldest=None)
    sides_of = lambda prefix: F.struct(*[F.col(prefix + c).alias(c) for c in sides])
    alike = alike.select("rec", F.lit(7).alias("rule"), F.col("r_id").alias("id"), F.coalesce(identity_conflict(sides_of("r_"), sides_of("")).isNotNull(), F.lit(False)).alias("clash"))
    first = exact.unionByName(alike).groupBy("rec").agg(F.min_by(F.struct("id", "rule", "clash"), "rule").alias("f")).select("rec", "f.*")
    return first.where((F.col("rule") <= 3) | ~F.col("clash")).select("rec", "id", "rule")
