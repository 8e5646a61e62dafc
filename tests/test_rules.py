"""Rules that need no table: expected values are worked out by hand from what the rules say."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from catalume.functions import predicates as p
from catalume.functions import scalars as s
from catalume.functions import text as x
from catalume.operators import audit, identity, pick, ranking, state, writes


def values(spark, **columns):
    """Evaluates all columns in one row."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict(recursive=True)


def text(value):
    return F.lit(value).cast("string")


def test_text_rules(spark):
    got = values(
        spark,
        ligature=x.normalize_title(text("ﬁlm ＡＢ Ⅳ — Đường")), season=x.season_of(text("Tên (Phần 0)")), no_season=x.season_of(text("Mùa 3")),
        slug=x.season_in_slug(text("a-phan-12-2001")), base=x.base_title(text("Show Season 2 Extra")), marker=x.marked_season(text("x"), text("x-phan-3")),
        declared=x.declared_seasons(text("Tên 2, khác"), text("2nd Season"), text("a-season-3-2020")), comparable=x.comparable_title(text("Đé-X")),
        person=x.person_slug(text("Đặng Á"), text("12")), nobody=x.person_slug(text("漢字"), text("7")), without=x.person_slug(text("A"), text("x")),
        renamed=x.rename_slug(text("Show"), F.lit(3)), kept=x.rename_slug(text("Show Season 3"), F.lit(3)), clip=x.clip(text("  a \n b  c"), 4),
        names=F.transform(x.catalog_names(text("Alpha, Beta (Gamma) / 寄生虫"), text("Tên (Phần 2)")), lambda n: n["key"]),
        queries=x.search_queries(x.catalog_names(text("Alpha, Beta (Gamma) / 寄生虫"), text("Tên"))),
        episode=x.episode_name(text("Tập phim"), text("full"), text(""), F.lit(0)), numbered=x.episode_name(text(""), text("a"), text(None), F.lit(4)),
        watch=x.watch_key(text("Full"), text(""), F.lit(2)), index=x.watch_key(text("1"), text("tap phim"), F.lit(2)),
    )
    assert got == {
        "ligature": "film ab iv duong", "season": 0, "no_season": None, "slug": 12, "base": "show extra", "marker": 3, "declared": [2, 2, 3], "comparable": "e x",
        "person": "dang-a-12", "nobody": "nguoi-7", "without": "", "renamed": "show-phan-3", "kept": "show-season-3", "clip": "a b ",
        "names": ["alpha beta 寄生虫", "alpha", "beta", "寄生虫", "gamma", "ten"], "queries": ["Alpha", "Beta", "Gamma", "Alpha, Beta / 寄生虫"],
        "episode": "Full", "numbered": "Tap 5", "watch": "full", "index": "2",
    }


def test_plain_text_is_inert(spark):
    got = values(
        spark,
        script=x.html_to_text(text("a &lt;script&gt;alert(1)&lt;/script&gt; b")), open=x.html_to_text(text("a <style>x")), entity=x.html_to_text(text("&#8230;&#x41;&eacute;&#0;!")),
        marks=x.html_to_text(text("# Head\n> quote\n- **bold** and _it_ ~~no~~ `code`\n\n\n\n[l](u) ![i](v)")), lines=x.html_to_text(text("a<br>b<p>c</p>d")),
        cut=x.truncate_at_word(text("aaaa bbbb cccc dddd eeee"), 21), hard=x.truncate_at_word(text("a" * 30), 10), short=x.truncate_at_word(text("abc"), 10),
    )
    assert got == {
        "script": "a b", "open": "a", "entity": "…A&eacute; !", "marks": "Head\nquote\nbold and it no code\n\nl i", "lines": "a\nb c\nd",
        "cut": "aaaa bbbb cccc dddd…", "hard": "a" * 9 + "…", "short": "abc",
    }


def test_warnings(spark):
    cases = {
        "This contains major spoilers, beware": True, "No spoilers here at all": False, "spoiler-free review": False, "x" * 200 + " a spoiler in the middle " + "y" * 200: False,
        "Spoilers: he dies. " + "x" * 300: True, "SPOILER ALERT " + "x" * 400: True, "I won't spoil it": False, "": False,
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want boolean").select(x.warns(F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)


def test_json_in_free_text(spark):
    found = values(spark, fence=x.extract_json(text('so: ```json\n{"a": 1}\n``` done')), span=x.extract_json(text('the answer {"a": [1]} ok')), none=x.extract_json(text("nothing {")))
    assert found == {"fence": '{"a": 1}', "span": '{"a": [1]}', "none": None}
    schema = {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "k": {"enum": ["a", "b"]}, "l": {"type": "array", "items": {"anyOf": [{"type": "string"}, {"type": "null"}]}}}}
    texts = ['{"id": 1, "k": "a", "l": ["x", null]}', "{}", '{"id": "1"}', '{"id": 1, "k": "c"}', '{"id": 1, "l": [2]}', "no"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(audit.schema_problem(schema)("t").alias("p")).collect()
    assert [r.p for r in rows] == [None, "$.id: required", "$.id: expected integer, got string", "$.k: not in enum", "$.l[0]: fits no branch", "$: no JSON"]


def test_servers_and_predicates(spark):
    servers = F.from_json(
        F.lit(json.dumps([{"server_name": "A", "episodes": [{"name": "1", "slug": "tap-1", "filename": ""}]}, {"server_name": "B", "episodes": [{"name": "2", "slug": "tap-2", "filename": "f"}]}])),
        "array<struct<server_name:string,episodes:array<struct<name:string,slug:string,filename:string>>>>",
    )
    now = F.lit("2024-01-31 12:00:00").cast("timestamp")
    at = lambda t: F.lit(t).cast("timestamp")
    got = values(
        spark,
        named=x.server_index(servers, text("B"), text("tap-1")), keyed=x.server_index(servers, text("C"), text("f")), first=x.server_index(servers, text(None), text("zz")),
        image=p.has_image(text(None), text("a")), imdb=p.valid_imdb(text("tt0123456")), short=p.valid_imdb(text("tt12")), number=p.valid_number(text("012")),
        array=p.json_at_least(text("[1, 2]"), 2), scalar=p.json_at_least(text("3"), 1), first_ok=p.first_not_in(F.array().cast("array<string>"), ["a"]),
        broken=p.broken_url(text("https://x.dead.org/a"), ["dead.org"]), whole=p.broken_url(text("https://x.live.org/a"), ["dead.org"]), blank=p.broken_url(text(" "), []),
        good=p.good_source(F.array(F.lit(1)), text("https://a.org/x"), text("https://a.org/y"), []), gate=p.past_gate(text(None)), failed=p.past_gate(text("failed")),
        today=p.since_midnight(at("2024-01-31 00:00:00"), now), before=p.since_midnight(at("2024-01-30 23:59:59"), now), mail=p.valid_email(text("a@b.co")), no_mail=p.valid_email(text("a b@c")),
        uuid=p.valid_uuid(text("123e4567-e89b-12d3-a456-426614174000")), renew=p.session_state(at("2024-02-01"), at("2024-01-31 10:00:00"), now), gone=p.session_state(at("2024-01-01"), at("2024-01-01"), now),
        beat=p.heartbeat_state(F.lit(True), text("busy"), at("2024-01-31 11:59:30"), now, 60, ["ok"]), stale=p.heartbeat_state(F.lit(True), text("ok"), at("2024-01-31 11:00:00"), now, 60, ["ok"]),
        daily=p.rate_limit_kind(text("limit per-day reached"), F.lit(1)), wait=p.rate_limit_kind(text("slow down"), F.lit(100)), transient=p.transient_error(text("ECONNRESET"), text(""), ["ECONNRESET"], "timeout"),
        https=s.image_url(text("https://i.a.org/x.jpg#f"), ["a.org"]), http=s.image_url(text("http://i.a.org/x.jpg"), ["a.org"]), root=s.image_url(text("https://i.a.org/"), ["a.org"]),
    )
    want = {
        "named": 1, "keyed": 1, "first": 0, "image": True, "imdb": True, "short": False, "number": False, "array": True, "scalar": False, "first_ok": True, "broken": True, "whole": False, "blank": True,
        "good": True, "gate": True, "failed": False, "today": True, "before": False, "mail": True, "no_mail": False, "uuid": True, "renew": "renew", "gone": "expired", "beat": "busy", "stale": "stale",
        "daily": "daily", "wait": "short", "transient": True, "https": "https://i.a.org/x.jpg", "http": None, "root": None,
    }
    assert got == want


def claims_of(*rows):
    made = [identity.claim(text(prov), F.from_json(F.lit(json.dumps(meta)), "map<string,string>")) for prov, meta in rows]
    return F.array(*made) if made else F.array().cast(f"array<{identity.CLAIM}>")


def row_of(tmdb_id=None, media=None, season=None, imdb=None, display="series", pinned=False, title="Show", slug="show"):
    fields = [F.lit(tmdb_id).cast("long").alias("tmdb_id"), text(media).alias("tmdb_media"), F.lit(season).cast("int").alias("tmdb_season"), text(imdb).alias("imdb"), text(display).alias("display"), F.lit(pinned).alias("pinned"), text(title).alias("title"), text(slug).alias("slug")]
    return F.struct(*fields)


TV = {"tmdb_id": "5", "tmdb_type": "tv"}
DECISIONS = [
    (lambda: row_of(), [], ("none", None, None, None)),
    (lambda: row_of(imdb="tt12345"), [], ("find", None, None, None)),
    (lambda: row_of(), [("nguonc", {"imdb_id": "tt12345"})], ("find", None, None, None)),
    (lambda: row_of(display="single"), [("kkphim", {"tmdb_id": "9", "tmdb_type": "movie"})], ("assign", "fill", "single-provider", None)),
    (lambda: row_of(), [("kkphim", TV)], ("resolve-season", "fill", "season-unknown", None)),
    (lambda: row_of(), [("kkphim", TV | {"tmdb_season": "2"}), ("nguonc", TV)], ("assign", "fill", "providers-agree", 2)),
    (lambda: row_of(title="Show (Phần 3)"), [("kkphim", TV | {"tmdb_season": "2"})], ("queue", None, "season-vs-title", None)),
    (lambda: row_of(), [("kkphim", TV | {"tmdb_season": "2"}), ("nguonc", TV | {"tmdb_season": "3"})], ("queue", None, "season-disagree", None)),
    (lambda: row_of(title="Show (Phần 3)"), [("kkphim", TV | {"tmdb_season": "2"}), ("nguonc", TV | {"tmdb_season": "3"})], ("assign", "fill", "providers-agree", 3)),
    (lambda: row_of(), [("kkphim", TV), ("nguonc", TV | {"tmdb_id": "6"})], ("queue", None, "providers-disagree", None)),
    (lambda: row_of(pinned=True), [("kkphim", TV), ("nguonc", TV | {"tmdb_id": "6"})], ("blocked", None, "pinned", None)),
    (lambda: row_of(display="single"), [("kkphim", TV)], ("queue", None, "type-mismatch", None)),
    (lambda: row_of(5, "tv", 2), [("kkphim", TV)], ("noop", None, None, None)),
    (lambda: row_of(5, "tv"), [("kkphim", TV | {"tmdb_season": "2"})], ("assign", "fill", "season-fill", 2)),
    (lambda: row_of(5, "tv", 1), [("kkphim", TV | {"tmdb_season": "2"})], ("queue", None, "season-single-dissent", None)),
    (lambda: row_of(5, "tv", 1), [("kkphim", TV | {"tmdb_season": "2"}), ("nguonc", TV | {"tmdb_season": "2"})], ("assign", "season", "season-agree", 2)),
    (lambda: row_of(7, "tv", 1), [("kkphim", TV | {"tmdb_season": "2"})], ("queue", None, "single-vs-existing", None)),
    (lambda: row_of(7, "tv", 1), [("kkphim", TV | {"tmdb_season": "2"}), ("nguonc", TV)], ("assign", "overwrite", "providers-agree", 2)),
    (lambda: row_of(7, "tv", 1, pinned=True), [("kkphim", TV), ("nguonc", TV)], ("blocked", None, "pinned", None)),
]


def test_provider_decisions(spark):
    made = {f"d{i}": identity.provider_decision(row(), claims_of(*claims)) for i, (row, claims, _) in enumerate(DECISIONS)}
    got = values(spark, **made)
    for i, (_, _, want) in enumerate(DECISIONS):
        d = got[f"d{i}"]
        assert (d["action"], d["tier"], d["reason"], d["season"]) == want, i
    some = claims_of(("kkphim", TV), ("nguonc", {"imdb_id": "TT12345 "}), ("nguonc", {"tmdb_id": "x"}))
    keys = values(spark, key=identity.claims_key(some), review=identity.review_key(some, row_of(7, "tv"), text("apply:fill")))
    assert keys == {"key": "kkphim:5:tv::|nguonc::::tt12345", "review": "kkphim:5:tv::|nguonc::::tt12345#7:tv::::apply:fill"}
    same = identity.review_unchanged(text(keys["review"]), text("pending"), text(None), text(keys["review"]))
    settled = identity.review_unchanged(text(keys["key"] + "#old"), text("done"), text("ai-match"), text(keys["review"]))
    fresh = identity.review_unchanged(text(keys["key"] + "#old"), text("done"), text("noop"), text(keys["review"]))
    assert values(spark, a=same, b=settled, c=fresh, d=identity.review_unchanged(text(None), text(None), text(None), text("k#"))) == {"a": True, "b": True, "c": False, "d": False}


def test_seasons_and_conflicts(spark):
    shows = lambda *rows: F.array(*[F.struct(F.lit(n).alias("number"), F.lit(e).alias("episodes"), F.lit(y).cast("int").alias("year")) for n, e, y in rows])
    infer = lambda year, total, seasons, title="Show": identity.infer_season(F.lit(year).cast("int"), F.lit(total), text(title), text(None), text("show"), seasons)
    two = shows((1, 12, 2010), (2, 24, 2012))
    got = values(
        spark,
        fit=infer(2012, 24, two), marked=infer(2012, 24, two, "Show (Phần 2)"), few=infer(2012, 2, two), no_year=infer(None, 24, two), gap=infer(2020, 24, two), announced=infer(2012, 24, two, "Show Season 1"),
        tie=infer(2012, 24, shows((1, 24, 2011), (2, 24, 2012))), tied=infer(2012, 24, shows((1, 24, 2012), (2, 24, 2012))), span=infer(2010, 36, shows((1, 12, 2010), (2, 24, 2011), (3, 50, 2015))),
        one=infer(2010, 12, shows((1, 12, 2010))), far=infer(2010, 40, shows((1, 12, 2010))), none=infer(2010, 12, shows((0, 5, 2010))),
    )
    assert {k: (v["season"], v["reason"]) for k, v in got.items()} == {
        "fit": (2, None), "marked": (None, "has-season-marker"), "few": (None, "too-few-episodes"), "no_year": (None, "no-year"), "gap": (None, "year-gap"), "announced": (None, "marker-conflict"),
        "tie": (2, None), "tied": (None, "ambiguous"), "span": (None, "multi-season-span"), "one": (1, None), "far": (None, "episode-gap"), "none": (None, "no-seasons"),
    }
    side = lambda kind, season, tid=None, media=None, ts=None: F.struct(text(kind).alias("media_type"), F.lit(tid).cast("long").alias("tmdb_id"), text(media).alias("tmdb_media"), F.lit(season).cast("int").alias("season"), F.lit(ts).cast("int").alias("tmdb_season"))
    guard = lambda imdb, year, title: F.struct(text(imdb).alias("imdb"), F.lit(year).cast("int").alias("year"), text(title).alias("title"), text("s").alias("slug"))
    resolve = lambda media, stored, title, known, given: identity.resolve_season(text(media), F.lit(stored).cast("int"), text(title), text("s"), F.lit(known).cast("int"), F.lit(given).cast("int"))
    got = values(
        spark,
        season=identity.identity_conflict(side("series", 1), side("series", 2)), film=identity.identity_conflict(side("single", 1), side("single", 2)), other=identity.identity_conflict(side("series", None, 1, "tv"), side("series", None, 2, "tv")),
        fine=identity.identity_conflict(side("series", None, 1, "tv", 1), side("series", None, 1, "tv", 1)), split=identity.identity_conflict(side("series", None, 1, "tv", 1), side("series", None, 1, "tv", 2)),
        imdb=identity.merge_guard(guard("a", 2000, "x"), guard("b", 2000, "x")), year=identity.merge_guard(guard(None, 2000, "x"), guard("b", 2002, "x")), ok=identity.merge_guard(guard("a", 2000, "x"), guard(None, 2001, "x")),
        marks=identity.merge_guard(guard("a", 2000, "x (Phần 1)"), guard("a", 2000, "x (Phần 2)")),
        rekey=identity.reconcile_source(text("old"), text("new"), text("slug")), summary=identity.reconcile_source(text("old"), text("slug"), text("slug")), same=identity.reconcile_source(text("a"), text("a"), text("s")),
        lone=resolve("tv", None, "x", 1, None), unknown=resolve("tv", None, "x", 3, None), given=resolve("tv", None, "x", 3, 2), invalid=resolve("tv", None, "x", 3, 0), beyond=resolve("tv", 4, "x", 3, None), movie=resolve("movie", 4, "x", 3, None),
        check=s.season_year_check(F.lit(2010), text("tv"), F.lit(2), F.from_json(F.lit('{"first_air_date": "2000-01-01", "seasons": [{"season_number": 2, "air_date": "2014-05-05"}]}'), "struct<release_date:string,first_air_date:string,seasons:array<struct<season_number:int,air_date:string>>>")),
    )
    assert got == {
        "season": "season-differs", "film": None, "other": "tmdb-differs", "fine": None, "split": "season-differs", "imdb": "imdb-differs", "year": "year-differs", "ok": None, "marks": "season-differs",
        "rekey": {"provider_id": "new", "rekey_from": "old"}, "summary": {"provider_id": "old", "rekey_from": None}, "same": {"provider_id": "a", "rekey_from": None},
        "lone": {"season": 1, "blocked": None}, "unknown": {"season": None, "blocked": "season-unknown"}, "given": {"season": 2, "blocked": None}, "invalid": {"season": None, "blocked": "season-invalid"},
        "beyond": {"season": 4, "blocked": "season-out-of-range"}, "movie": {"season": None, "blocked": None}, "check": "year-2014",
    }


def test_identity_plan(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    fields = "id long, state string, tmdb_id long, media string, season int, imdb string, year int, title string, slug string, pinned boolean, providers array<string>, filled int, created timestamp"
    rows = spark.createDataFrame(
        [
            (1, "ready", None, None, None, None, 2000, "a", "a", False, ["nguonc"], 3, day(1)), (2, "ready", 5, "tv", 1, None, 2000, "a", "a2", False, ["kkphim", "nguonc"], 3, day(2)),
            (3, "ready", 6, "movie", None, None, 2000, "b", "b", False, ["kkphim"], 3, day(1)), (4, "hidden", None, None, None, None, 2000, "c", "c", False, [], 0, day(1)),
            (5, "ready", None, None, None, None, 2010, "a", "a5", False, ["kkphim"], 3, day(1)),
        ],
        fields,
    )
    wanted = spark.createDataFrame([(1, 5, "tv", 1), (2, 5, "tv", 1), (3, 9, "movie", None), (4, 9, "movie", None), (5, 5, "tv", 1), (9, 1, "tv", 1)], "id long, tmdb_id long, media string, season int")
    got = {r.id: (r.action, r.reason, r.survivor, r.dropped) for r in identity.identity_plan(rows, wanted).collect()}
    assert got == {
        1: ("merge", "survivor:more-providers", 2, 1), 2: ("noop", "already-assigned", 2, None), 3: ("blocked", "row-has-other-identity", 3, None),
        4: ("blocked", "not-ready", 4, None), 5: ("blocked", "year-differs", 5, None), 9: ("blocked", "row-missing", 9, None),
    }
    fresh = identity.identity_plan(rows, spark.createDataFrame([(1, 8, "tv", 1)], wanted.schema)).first()
    assert (fresh.action, fresh.survivor) == ("assign", 1)


def test_write_transforms(spark):
    now = F.lit("2024-01-31").cast("timestamp")
    made = spark.createDataFrame([(1, "A b", 2000), (2, "A b", 2000), (3, "A b", 2000), (4, "A b", 2001), (5, "a-b 2", None), (6, "!!", None)], "k long, title string, year int")
    taken = spark.createDataFrame([("a-b-3",), ("a-b-2001",)], "slug string")
    assert {r.k: r.slug for r in writes.unique_slugs(made, taken, "k", "title", "year").collect()} == {1: "a-b", 2: "a-b-2000", 3: "a-b-4", 4: "a-b-5", 5: "a-b-2", 6: "movie"}

    stored = spark.createDataFrame([(1, "ok", "p1"), (2, "ok", "p2"), (3, "ok", "p3")], "id long, status string, payload string")
    tried = spark.createDataFrame([(1, "error", None), (2, "ok", "new")], "id long, status string, payload string")
    kept = writes.keep_last_good(stored, tried, "id", ["payload"], F.col("status") == "error")
    assert {r.id: (r.status, r.payload) for r in kept.collect()} == {1: ("error", "p1"), 2: ("ok", "new"), 3: ("ok", "p3")}

    health = spark.createDataFrame([("a", 2, 5), ("b", 1, 0)], "host string, streak long, drift long")
    events = spark.createDataFrame([("a", 1, "fail"), ("a", 2, "drift"), ("b", 1, "ok"), ("b", 2, "fail"), ("c", 1, "fail")], "host string, at long, kind string")
    counted = writes.add_counters(health, events, "host", ["at"], F.col("kind") != "ok", {"drift": F.col("kind") == "drift"})
    assert {r.host: (r.streak, r.drift) for r in counted.collect()} == {"a": (4, 6), "b": (1, 0), "c": (1, 0)}

    rows = spark.createDataFrame([(1, 5, "tv", 1, "verified", "img", {"tmdb": "7", "tmdb_src": "tv:5", "imdb": "8"}), (2, 5, "tv", 2, "verified", "img", {})], "id long, tmdb_id long, media string, season int, status string, asset string, ratings map<string,string>")
    new = spark.createDataFrame([(1, 6, "tv", 1), (2, 5, "tv", 2)], "id long, tmdb_id long, media string, season int")
    assert {r.id: (r.tmdb_id, r.status, r.asset, r.ratings) for r in writes.write_identity(rows, new, "id", ["asset"]).collect()} == {1: (6, "pending", None, {"imdb": "8"}), 2: (5, "verified", "img", {})}

    holders = spark.createDataFrame([(1, None, None, None, "series", False), (2, 5, "tv", None, "series", False), (3, 9, "movie", None, "single", False), (4, None, None, None, "single", False), (5, None, None, None, "series", True)], "id long, tmdb_id long, media string, season int, display string, pinned boolean")
    incoming = spark.createDataFrame([(1, 7, "tv", 1), (2, 5, "tv", 3), (4, 7, "tv", 1), (5, 8, "tv", 1), (1, 9, "movie", None)], "id long, tmdb_id long, media string, season int")
    assert sorted((r.id, r.tmdb_id, r.season) for r in writes.fill_identity(holders, incoming, "id").collect()) == [(1, 7, 1), (2, 5, 3)]

    meta = spark.createDataFrame([(1, {"id": "5", "type": "tv", "season": "2", "x": "y"}), (2, {"id": "5", "type": "tv"})], "id long, metadata map<string,string>")
    claim = spark.createDataFrame([(1, {"id": "6", "type": "tv"}), (2, {"id": "5", "type": "tv"})], "id long, claim map<string,string>")
    assert {r.id: r.metadata for r in writes.refresh_claims(meta, claim, "id", ["id", "type", "season"]).collect()} == {1: {"id": "6", "type": "tv", "x": "y"}}
    stay = writes.refresh_claims(meta, spark.createDataFrame([(1, {"id": "5", "type": "movie"})], claim.schema), "id", ["id", "type", "season"])
    assert stay.first().metadata == {"id": "5", "type": "movie", "season": "2", "x": "y"}

    points = spark.createDataFrame([("a", 4, None), ("b", 9, dt.datetime(2024, 1, 1)), ("c", 2, dt.datetime(2024, 1, 30))], "lane string, page long, ended_at timestamp")
    pages = spark.createDataFrame([("a", 5, False), ("a", 6, True), ("d", 1, False)], "lane string, page long, is_last boolean")
    got = {r.lane: (r.page, r.ended_at and r.ended_at.day) for r in writes.advance_checkpoint(points, pages, "lane", now, 7).collect()}
    assert got == {"a": (6, 31), "b": (1, None), "c": (2, 30), "d": (1, None)}

    log = spark.createDataFrame([(1, 1, ("old",), ("new",)), (2, 1, ("old2",), ("changed",))], "id long, change_id long, before struct<slug:string>, after struct<slug:string>")
    now_ = spark.createDataFrame([(1, "new"), (2, "other"), (3, "x")], "id long, slug string")
    assert {r.id: r.slug for r in writes.undo(now_, log, ["slug"]).collect()} == {1: "old", 2: "other", 3: "x"}


def test_accounts(spark):
    at = lambda n: dt.datetime(2024, 1, n)
    fields = "user_id long, item string, at timestamp, episode string"
    stored = spark.createDataFrame([(1, "a", at(1), "e1"), (1, "b", at(5), "e5")], fields)
    touched = writes.touch_history(stored, spark.createDataFrame([(1, "a", at(2), None), (1, "c", at(3), "e3")], fields))
    assert {r.item: (r["at"].day, r.episode) for r in touched.collect()} == {"a": (2, "e1"), "b": (5, "e5"), "c": (3, "e3")}
    merged = writes.merge_import(stored, spark.createDataFrame([(1, "a", at(2), "new"), (1, "b", at(4), "older")], fields))
    assert {r.item: (r["at"].day, r.episode) for r in merged.collect()} == {"a": (2, "new"), "b": (5, "e5")}
    day = 86_400_000
    base = 1_700_000_000_000
    entries = [("a", base, "1"), ("a", base - day, "2"), ("a", base - day // 2, "3"), ("Bad!", base, "x"), ("b", 5, None), ("c", base + 90 * day, "z"), ("late", base, "no")]
    rows = spark.createDataFrame([(entries,)], "l array<struct<slug:string,saved_ms:long,episode:string>>")
    got = rows.select(F.explode(writes.import_list(F.col("l"), F.lit(base + day), 6)).alias("e")).select("e.*").collect()
    assert [(r.slug, r.ms, r.episode) for r in got] == [("a", base - day, "3"), ("b", base + day, None), ("c", base + day, "z")]


def test_limiters(spark):
    hits = spark.createDataFrame([("u", t) for t in (0, 10, 20, 95, 101, 105, 300)], "who string, ms long")
    got = {r.ms: (r.allowed, r.retry_ms) for r in state.sliding_limiter(hits, ["who"], "ms", 100, 3).collect()}
    assert got == {0: (True, 0), 10: (True, 0), 20: (True, 0), 95: (False, 5), 101: (True, 0), 105: (False, 5), 300: (True, 0)}
    windows = {r.ms: (r.window_start, r.hits) for r in state.fixed_windows(hits, ["who"], "ms", 100).collect()}
    assert windows == {0: (0, 1), 10: (0, 2), 20: (0, 3), 95: (0, 4), 101: (101, 1), 105: (101, 2), 300: (300, 1)}
    fails = spark.createDataFrame([("u", t, True) for t in range(7)] + [("u", 7, False), ("u", 8, True), ("u", 2_000_000, True)], "who string, ms long, bad boolean")
    delays = {r.ms: (r.streak, r.delay_ms) for r in state.failure_backoff(fails, ["who"], "ms", F.col("bad")).collect()}
    assert delays[3] == (4, 0) and delays[4] == (5, 250) and delays[6] == (7, 1000) and delays[7] == (0, 0) and delays[8] == (1, 0) and delays[2_000_000] == (1, 0)
    memo = state.failure_memo(spark.createDataFrame([("a", 0, 500), ("a", 10, 404), ("b", 0, 429), ("c", 0, 500)], "url string, ms long, status int"), "url", "ms", "status", F.lit(40_000))
    assert {r.url: (r.response_status, r.until) for r in memo.collect()} == {"a": (404, 3_600_010), "b": (503, 60_000)}
    cursors = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, False), ("c", 1, True)], "k string, id long, ok boolean")
    assert {r.k: r.cursor for r in state.cursor(cursors, ["k"], "id", F.col("ok")).collect()} == {"a": 1, "b": None, "c": 1}


def test_packs_and_shuffles(spark):
    rows = spark.createDataFrame([([5, 5, 5, 20, 1, 1, 1, 1],)], "t array<int>")
    assert rows.select(pick.budget_packs(F.col("t"), 3, 12).alias("p")).first().p == [0, 0, 1, 2, 3, 3, 3, 4]
    items = list("abcdefgh")
    want, state_ = list(items), 42
    for i in range(len(want) - 1, 0, -1):
        state_ = (state_ * 1664525 + 1013904223) % 2**32
        j = int(state_ / 2**32 * (i + 1))
        want[i], want[j] = want[j], want[i]
    got = spark.createDataFrame([(items,)], "a array<string>").select(pick.congruential_order(F.col("a"), 42).alias("a")).first().a
    assert got == want
    cells = spark.range(100).select("id", (F.col("id") % 3).alias("cell"))
    once, again = (sorted(map(tuple, pick.seeded_sample(cells, ["cell"], "id", 7, 4).collect())) for _ in range(2))
    assert once == again and len(once) == 12


def test_audit(spark):
    source = "array<struct<provider:string,available:boolean,season:int,tmdb_id:long,tmdb_media:string,episodes:int,year:int>>"
    fields = f"id long, media_type string, display string, tmdb_id long, tmdb_media string, tmdb_season int, title string, original string, slug string, aliases array<string>, sources {source}"
    rows = spark.createDataFrame(
        [
            (1, "tv", "series", 5, "tv", 1, "Show (Phần 2)", None, "show-phan-2", ["show-phan-3"], [("kk", True, 1, 6, "tv", 10, 2000), ("nc", True, 2, None, None, 30, 2004)]),
            (2, "movie", "single", None, None, None, "Film", None, "film", [], [("kk", False, None, None, None, 0, 2000)]), (3, "movie", "single", 9, "movie", None, "Fine", None, "fine", [], [("kk", True, None, 9, "movie", 0, 2000)]),
        ],
        fields,
    )
    assert {r.id: r.codes for r in audit.detect(rows).collect()} == {1: "alias-wrong,episode-mismatch,multi-season,season-marker,slug-season,tmdb-mismatch,year-spread", 2: "orphan"}
    found = values(spark, s=audit.source_season(text("tv"), F.lit(2), text("X Season 2"), text(None), text("x-phan-3")), n=audit.source_season(text(None), F.lit(None).cast("int"), text("x"), text(None), text("x")))
    assert found["s"] == {"season": 2, "strength": 2, "conflict": True} and found["n"]["season"] is None
    flagged = spark.createDataFrame([(1, ["alias-wrong"], "tv", "Show", 1, "show", ["show-phan-2"]), (2, ["orphan"], "tv", "Gone", 1, "gone", []), (3, ["slug-season"], "tv", "Slug", 2, "slug-phan-3", [])], "id long, codes array<string>, media_type string, title string, season int, slug string, aliases array<string>")
    siblings = spark.createDataFrame([(7, "tv", "Show Season 2", 2), (1, "tv", "Show", 1)], "id long, media_type string, title string, season int")
    assert sorted((r.id, r.type, r.target) for r in audit.proposals(flagged, siblings).collect()) == [(1, "fix_alias", "7"), (2, "hide_row", None), (3, "rename_slug", "slug-phan-2")]
    live = lambda i, season=None, strength=0, tmdb=None: (i, True, season, strength, False, tmdb)
    fields = "grp long, id long, media_type string, base string, slug string, season int, title_season int, slug_season int, tmdb_id long, imdb string, year int, inferred boolean, aliases array<struct<slug:string,season:int>>, sources array<struct<id:long,available:boolean,season:int,strength:int,conflict:boolean,tmdb_id:long>>"
    group = spark.createDataFrame(
        [
            (1, 10, "tv", "show", "show-phan-3", 1, 2, 3, 5, None, 2000, True, [("show-phan-2-old", 2)], [live(100, 2, 2), live(101, 4, 2), live(102)]), (1, 11, "tv", "show", "gone", None, None, None, None, None, None, False, [], []),
            (1, 12, "tv", "show", "show-phan-4", 4, None, 4, None, None, 2001, False, [], [live(103)]), (1, 13, "tv", "show", "show-x", 4, None, None, 6, None, 2001, False, [], [live(104)]),
            (2, 20, "movie", "film", "film", None, None, None, 9, None, 2000, True, [], [live(200, None, 0, 8)]),
        ],
        fields,
    )
    plan = [
        (1, 0, "hide_row", 11, None, None, None, None), (1, 1, "merge_rows", 12, 13, None, None, None), (1, 2, "move_source", None, None, None, 101, None), (1, 3, "set_season", 10, None, 2, None, None),
        (1, 4, "report", 10, None, None, None, None), (1, 5, "rename_slug", 10, None, None, None, None), (1, 6, "fix_alias", None, 13, None, None, "show-phan-2-old"), (1, 7, "hide_row", 13, None, None, None, None),
        (2, 0, "clear_tmdb", 20, None, None, None, None), (2, 1, "clear_tmdb", 20, None, None, None, None), (2, 2, "hide_row", 20, None, None, None, None),
    ]
    actions = spark.createDataFrame(plan, "grp long, pos long, type string, id long, target long, season int, source long, slug string")
    got = {(r.grp, r.pos): (r.ok, r.gate) for r in audit.gate_proposals(group, actions).collect()}
    assert got == {
        (1, 0): (True, None), (1, 1): (True, None), (1, 2): (True, None), (1, 3): (True, None), (1, 4): (False, "report-only"), (1, 5): (True, None), (1, 6): (False, "alias-agrees"), (1, 7): (False, "earlier-action-failed"),
        (2, 0): (True, None), (2, 1): (False, "no-tmdb-id"), (2, 2): (False, "earlier-action-failed"),
    }
    table = spark.createDataFrame([(1, "a", "ready", 1), (2, "b", "ready", 2)], "id long, slug string, state string, season int")
    after, log = audit.apply_actions(table, spark.createDataFrame([(1, "rename_slug", "z"), (1, "set_season", "3"), (2, "report", None)], "id long, type string, value string"))
    assert sorted(map(tuple, after.collect())) == [(1, "z", "ready", 3), (2, "b", "ready", 2)] and [r.id for r in log.collect()] == [1]
    back = writes.undo(after, log.withColumn("change_id", F.lit(1)), ["slug", "state", "season"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))
    row = "array<struct<id:string,flags:array<string>,aliases:array<string>,sources:array<string>,favorites:int,history:int>>"
    pair = spark.createDataFrame([([("a", ["x", "y"], [], ["s"], 3, 0), ("b", [], [], [], 0, 0)], ["d", "e"]), ([("b", [], [], [], 0, 0), ("a", ["y", "x"], [], ["s"], 9, 0)], ["e", "d"]), ([("a", ["x"], [], ["s"], 9, 0)], ["d"])], f"rows {row}, detectors array<string>")
    hashes = [r.h for r in pair.select(audit.group_hash(F.col("rows"), F.col("detectors")).alias("h")).collect()]
    assert hashes[0] == hashes[1] != hashes[2]
    report = audit.audit_report(spark.createDataFrame([(1, "merge", '{"keepId": 1, "dropId": 2}'), (2, "none", "{}")], "action_id long, type string, params string"), table)
    assert {r.action_id: r.slugs for r in report.collect()} == {1: "a,b", 2: ""}
    counts, sample = audit.promotion_report(spark.createDataFrame([(i, "merge" if i % 2 else "assign", "r") for i in range(20)], "id long, action string, reason string"), 3, 2)
    assert counts.count() == 2 and sample.count() == 4
    metrics = audit.repair_metrics(table, spark.createDataFrame([(1, 1, True), (1, 2, False)], "row_id long, season int, available boolean")).first()
    assert (metrics["rows"], metrics.sources, metrics.without_source, metrics.without_live_source, metrics.of_several_seasons, metrics.without_season) == (2, 2, 1, 1, 1, 0)


def test_find_rows(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    fields = "id long, created timestamp, state string, slug string, media_type string, tmdb_id long, tmdb_media string, tmdb_season int, season int, imdb string, year int, original string, title string, episodes int"
    rows = spark.createDataFrame(
        [
            (1, day(1), "ready", "one", "tv", 5, "tv", 1, 1, "tt1", 2000, "one", "mot", 10), (2, day(2), "ready", "one-phan-2", "tv", 5, "tv", 2, 2, "tt1", 2002, "one", "mot", 12),
            (3, day(3), "ready", "film", "movie", None, None, None, None, None, 2010, "the film of all", "phim", None), (4, day(4), "ready", "film-b", "movie", None, None, None, None, None, 2010, "other", "phim hay nhat", None),
            (5, day(5), "ready", "show-phan-3", "tv", None, None, None, 3, None, 2015, "show", "show x", None),
        ],
        fields,
    )
    names = "rec string, provider string, provider_id string, slug string, raw_title string, media_type string, tmdb_id long, tmdb_media string, tmdb_season int, season int, imdb string, year int, original string, title string, episodes int"
    incoming = spark.createDataFrame(
        [
            ("source", "b", "7", "x", "x", "tv", None, None, None, None, None, 1990, "", "x", None), ("tuple", "b", "8", "x", "x", "tv", 5, "tv", 2, 2, None, 1990, "", "x", None),
            ("imdb", "b", "9", "x", "x", "tv", None, None, None, 2, "tt1", 1990, "", "x", None), ("season", "a", "1", "one-phan-2", "One", "tv", None, None, None, None, None, 2002, "one", "y", 13),
            ("apart", "a", "2", "else-phan-2", "Else", "tv", None, None, None, None, None, 2002, "one", "y", 13), ("original", "b", "3", "x", "x", "movie", None, None, None, None, None, 2010, "other", "q", None),
            ("title", "b", "4", "x", "x", "movie", None, None, None, None, None, 2010, "", "phim", None), ("alike", "b", "5", "x", "x", "movie", None, None, None, None, None, 2010, "film the of all", "q", None),
            ("refused", "b", "6", "x", "x", "tv", None, None, None, 4, None, 2015, "show", "q", None),
        ],
        names,
    )
    got = {r.rec: (r.id, r.rule) for r in identity.find_rows(incoming, rows, spark.createDataFrame([("b", "7", 4)], "provider string, provider_id string, id long")).collect()}
    assert got == {"source": (4, 1), "tuple": (2, 2), "imdb": (2, 3), "season": (2, 4), "original": (4, 5), "title": (3, 6), "alike": (3, 7)}


def test_find_rows_compares_titles_with_all_rows_of_a_year(spark):
    """Rule 7 looked at the first 100 rows of a year and type only, so of 130 rows the last 30 were like no record."""
    fields = "id long, created timestamp, state string, slug string, media_type string, tmdb_id long, tmdb_media string, tmdb_season int, season int, imdb string, year int, original string, title string, episodes int"
    long = " ".join(f"w{i:02d}" for i in range(12))
    title = lambda i: {120: "the last of all", 125: long}.get(i, f"plain {i}")
    rows = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, 0, 0, i % 60) + dt.timedelta(minutes=i), "ready", f"s{i}", "movie", None, None, None, None, None, 2010, "", title(i), None) for i in range(130)], fields)
    names = "rec string, provider string, provider_id string, slug string, raw_title string, media_type string, tmdb_id long, tmdb_media string, tmdb_season int, season int, imdb string, year int, original string, title string, episodes int"
    asked = {"early": "3 plain", "late": "all of the last", "longer": f"{long} more", "none": "all of the first"}
    incoming = spark.createDataFrame([(rec, "b", rec, rec, rec, "movie", None, None, None, None, None, 2010, "", t, None) for rec, t in asked.items()], names)
    got = {r.rec: (r.id, r.rule) for r in identity.find_rows(incoming, rows, spark.createDataFrame([], "provider string, provider_id string, id long")).collect()}
    assert got == {"early": (3, 7), "late": (120, 7), "longer": (125, 7)}


def test_all_letters_fold_and_the_class_of_the_spread_ones_is_short(spark):
    """A class of 167 ranges was tried at each character, and each character of a text with one such letter was sought in a list."""
    import unicodedata

    from catalume.functions import text as x

    letters = [chr(c) for c in [*range(0x20, 0xAC00), *range(0xF900, 0xFFFE)] if not 0xD800 <= c < 0xE000]
    plain = lambda s: "".join(k for c in s for k in unicodedata.normalize("NFKD", c) if not "̀" <= k <= "ͯ").replace("đ", "d").replace("Đ", "D")
    texts = letters + ["", "plain … ﬁlm ½ … Đường ﬁ", "".join(letters)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", x.fold_accents(F.col("t")).alias("t")).collect()
    assert all(r.t == plain(texts[r.i]) for r in got)
    assert spark.createDataFrame([(None,)], "t string").select(x.fold_accents(F.col("t"))).first()[0] is None
    assert x.SPREAD_CLASS.count("-") < 60
