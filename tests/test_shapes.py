"""Provider payloads, projections, matching on awkward groups, and the streaming forms."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from catalume.functions import projections as show
from catalume.operators import match, state
from catalume.sources import providers
from catalume.streaming import ledger


def test_provider_payloads(spark):
    a = {"movie": {"id": "1", "name": " Tên ", "slug": "ten", "original_name": "Name", "year": "", "total_episodes": "12 tập", "casts": "A, B ,", "director": "C", "thumb_url": "t", "poster_url": "p",
         "tmdb": {"id": "77", "type": "tv", "season": 2}, "imdb": {"id": "tt1234567"}, "category": {"1": {"group": {"name": "Định dạng"}, "list": [{"name": "Phim lẻ"}]}, "3": {"group": {"name": "Năm"}, "list": [{"name": "2019"}]}},
         "episodes": [{"server_name": "S", "items": [{"name": "", "slug": "", "embed": "e", "m3u8": "m"}]}, {"server_name": "empty", "items": []}]}}
    b = {"movie": {"name": "B", "slug": "b", "origin_name": "Bo", "type": "hoathinh", "thumb_url": "T", "poster_url": "P", "year": 2020, "actor": ["X"], "director": [], "category": [{"name": "G", "slug": "g"}], "tmdb": {"id": "x"}, "imdb": {"id": "no"}},
         "episodes": [{"server_name": "S", "server_data": [{"name": "1", "slug": "s1", "link_embed": "e", "link_m3u8": "m"}]}]}
    raw = lambda d: spark.createDataFrame([(json.dumps(d),)], "value string")
    r = providers.provider_a(raw(a)).first()
    assert (r.title, r.normalized_title, r.year, r.episode_total, r.tmdb_id, r.tmdb_season, r.imdb_id, r.kind, r.media_type, r.actors) == ("Tên", "ten", 2019, 12, 77, 2, "tt1234567", "single", "movie", ["A", "B"])
    assert len(r.streams) == 1 and r.streams[0].episodes[0].asDict() == {"name": "1", "slug": "tap-1", "embed": "e", "stream": "m"}
    r = providers.provider_b(raw(b)).first()
    assert (r.poster, r.thumb, r.year, r.tmdb_id, r.imdb_id, r.kind, r.media_type, r.labels) == ("T", "P", 2020, None, None, "hoathinh", "tv", ["G"])
    pages = spark.createDataFrame([('{"paginate": {"total_page": 0}, "data": {"pagination": {"totalPages": 7}}}',), ("{}",)], "v string")
    assert [r.n for r in pages.select(providers.total_pages(F.col("v")).alias("n")).collect()] == [7, None]


def test_sources(spark, tmp_path):
    ids = providers.trending_ids(spark.createDataFrame([(1, [5, 0, 3]), (2, [3, 9])], "page int, ids array<long>")).orderBy("place").collect()
    assert [r.id for r in ids] == [5, 3, 9]
    reply = spark.createDataFrame([(1, '[{"id": "a", "ratings": {"x": 1}}, {"id": "zz", "ratings": {}}, {"id": "a", "ratings": {"x": 2}}]')], "batch int, value string")
    assert [(r.id, r.ratings) for r in providers.ratings_reply(reply, spark.createDataFrame([("a",), ("b",)], "id string")).collect()] == [("a", {"x": 1.0})]
    due = providers.pages_due(spark.createDataFrame([("a", 10, 11), ("b", 1, None)], "lane string, page int, last_page int"), 2, 3).collect()
    assert sorted((r.lane, r.page) for r in due) == [("a", 1), ("a", 2), ("a", 10), ("a", 11), ("b", 1), ("b", 2), ("b", 3), ("b", 4), ("b", 5)]
    items = spark.createDataFrame([("kk", '{"slug": "s", "tmdb": {"id": 5, "type": "tv"}}'), ("kk", "{}")], "provider string, value string")
    assert [(r.slug, r.claim) for r in providers.list_identities(items).collect()] == [("s", {"tmdb_id": "5", "tmdb_type": "tv"})]
    urls = spark.createDataFrame([(f"https://h{i % 2}.org/{i}",) for i in range(10)], "url string")
    assert sorted(r.host for r in providers.sample_by_host(urls, 3, 2).collect()) == ["h0.org"] * 2 + ["h1.org"] * 2
    lines = spark.createDataFrame([(1, '["k", "1"]'), (2, '["k", "2"]'), (3, '["k2", "x'), (4, '["j", "3"]')], "n int, line string")
    assert {r.key: r.value for r in providers.read_cache(lines, "line", "n").collect()} == {"k": "2", "j": "3"}
    stored = F.lit(json.dumps([{"slug": "a", "savedAt": 1}, {"slug": "b", "savedAt": 3}, {"slug": " ", "savedAt": 9}, {"slug": "a", "savedAt": 2}]))
    card = providers.reader_card(F.lit('{"data": {"slug": "s"}, "title": "T", "poster_url": "p", "year": "2001", "tmdb": {"vote_average": 7.5}}'))
    got = spark.range(1).select(providers.guest_list(stored, 5).alias("g"), card.alias("c")).first()
    assert got.g == ["b", "a"] and tuple(got.c) == ("s", "T", None, "p", "p", 2001, 7.5)
    path = str(tmp_path / "out")
    providers.write_csv(spark.createDataFrame([(1, 'say "hi"')], "a int, b string").coalesce(1), path)
    text = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert text == '"a","b"\n"1","say ""hi"""\n'


def test_projections(spark):
    ratings = lambda **kw: F.create_map(*[F.lit(x) for p in kw.items() for x in p])
    merged = lambda cur, inc, m="tv", i=5: F.array_sort(F.transform(F.map_entries(show.merge_ratings(cur, inc, F.lit(m), F.lit(i))), lambda e: F.concat_ws(":", e["key"], e["value"])))
    body = F.from_json(F.lit(json.dumps({"cast": [{"id": 1, "name": "A", "character": "x"}, {"id": 1, "name": "A", "character": "y"}, {"id": 0, "name": "Z"}, {"id": 2, "name": "B", "order": 9}], "crew": [{"id": 3, "name": "D", "job": "Director"}, {"id": 4, "name": "W", "job": "Writer"}]})), "struct<cast:array<struct<id:long,name:string,character:string,order:int>>,crew:array<struct<id:long,name:string,job:string>>>")
    text = lambda v: F.lit(v).cast("string")
    got = spark.range(1).select(
        merged(ratings(tmdb="7", imdb="8"), ratings(tmdb="0", imdb="9")).alias("zero"), merged(ratings(tmdb="7", tmdb_src="tv:5"), ratings(tmdb="6")).alias("own"),
        merged(ratings(tmdb="7", tmdb_src="tv:4"), ratings(tmdb="6")).alias("stale"), merged(ratings(tmdb="7", tmdb_src="tv:5"), ratings(tmdb="6", tmdb_src="tv:5")).alias("newer"),
        show.season_title(text("Show (Phần 1)"), text("tv"), F.lit(2)).alias("title"), show.season_title(text("Film"), text("movie"), F.lit(2)).alias("film"),
        show.credits_of(body, 5).alias("c"), show.page_number(text("x")).alias("p0"), show.page_number(text(" 3.7 ")).alias("p3"), show.page_number(text("-2")).alias("p1"),
        show.nav_category(text("Hoạt Hình, anime"), text("")).alias("anime"), show.nav_category(text("phim-bo"), text("")).alias("series"), show.nav_category(text("x"), text("Full")).alias("one"),
    ).first()
    assert got.zero == ["imdb:9", "tmdb:7"] and got.own == ["tmdb:7", "tmdb_src:tv:5"] and got.stale == ["tmdb:6"] and got.newer == ["tmdb:6", "tmdb_src:tv:5"]
    assert (got.title, got.film, got.p0, got.p3, got.p1, got.anime, got.series, got.one) == ("Show (Phần 2)", "Film", 1, 3, 1, "hoat-hinh", "phim-bo", "phim-le")
    assert [(c.id, c.character, c.ord) for c in got.c["cast"]] == [(1, "x", 0), (2, None, 9)] and [d.name for d in got.c.directors] == ["D"]

    fields = "id long, title string, original_title string, slug string, display string, media_type string, year int, thumb string, poster string, tmdb_thumb string, tmdb_poster string, tmdb_id long, tmdb_media string, tmdb_season int, imdb_id string, ratings map<string,string>, sorted_at timestamp, provider_updated_at timestamp, updated_at timestamp"
    day = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, "Show", "O", "show", None, "tv", 2000, None, "p", None, None, 5, "tv", 2, "tt1", {"tmdb": "7", "tmdb_src": "tv:4", "imdb": "8"}, None, None, day)], fields)
    card = rows.select(show.card(F.col).alias("c")).first().c
    assert (card.name, card.type, card.thumb, card.tmdb.vote_average, card.imdb.vote_average, card.modified) == ("Show (Phần 2)", "tv", "p", None, 8.0, day)
    sources = spark.createDataFrame([(1, 20, "kk", True, "s", ["b"]), (1, 10, "nc", True, "t", ["a"]), (1, 5, "x", False, "u", ["z"])], "id long, priority int, provider string, available boolean, slug string, streams array<string>")
    people = spark.createDataFrame([(1, "cast", 2, "B", "b"), (1, "cast", 1, "A", "a"), (1, "director", 0, "D", None)], "id long, role string, ord int, name string, character string")
    reviews = spark.createDataFrame([(1, i, f"r{i}", 5.0, "t") for i in (3, 1, 2)], "id long, place int, author string, rating double, content string")
    d = show.details(rows, sources, people, reviews).first()
    assert d.episodes == ["a", "b"] and [c.name for c in d["cast"]] == ["A", "B"] and [r.author for r in d.reviews] == ["r1", "r2"] and d.review_count == 3 and len(d.sources) == 3
    page = show.envelope(spark.createDataFrame([(2, "y", 30, 2), (1, "x", 30, 2)], "place int, card string, total long, page long"), "T", 24).first()
    assert (page["items"], page.total_items, page.current_page, page.total_pages) == (["x", "y"], 30, 2, 2)
    empty = show.envelope(spark.createDataFrame([], "place int, card string, total long, page long"), "T", 24).first()
    assert (empty["items"], empty.total_items, empty.total_pages) == ([], 0, 1)
    lists = spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "place int, id int")
    made = show.home({"new": lists}, lists.where("false"), lists, 2).collect()
    assert sorted((r.section, r.id) for r in made) == [("hero", 10), ("hero", 11), ("new", 10), ("new", 11), ("new", 12)]
    ordered = show.review_order(spark.createDataFrame([("m", "a", 95.0, False), ("m", "b", 15.0, True), ("m", "c", 40.0, False)], "k string, id string, score double, spoiler boolean"), F.lit("2024-01-01"), "k").orderBy("place").collect()
    assert [r.id for r in ordered] == ["b", "a", "c"]
    view = show.model_view(spark.createDataFrame([tuple(range(12))], [*show.MODEL_COLUMNS, "secret"]))
    assert "secret" not in view.columns


def test_matching(spark):
    left = spark.createDataFrame([(1, ["a", "b"], ["x"]), (1, ["a", "b"], ["x"]), (2, ["q"], ["a", "b"])], "g int, w array<string>, v array<string>")
    right = spark.createDataFrame([(1, 7, ["b", "a"], ["z"]), (1, 8, ["a", "b"], ["x"]), (2, 9, ["n"], ["b", "a"])], "g int, k int, w array<string>, v array<string>")
    got = match.fuzzy_match(left, right, ["g"], ["w", "v"], 0.96, ["k"])
    assert sorted((r.g, r.r_k) for r in got.collect()) == [(1, 7), (1, 7), (2, 9)]
    assert match.fuzzy_match(left, right, ["g"], ["w", "v"], 0.96, ["k"], oldest=1).count() == 3
    rows = spark.createDataFrame([("m", ["a", "b", "c"]), ("n", ["a", "b"]), ("o", ["a"])], "id string, names array<string>")
    cands = spark.createDataFrame([("m", 1, ["a", "b", "c"]), ("m", 2, ["a", "b"]), ("n", 1, ["a", "b"]), ("n", 2, ["b", "a"]), ("o", 1, ["a"])], "id string, candidate int, billed array<string>")
    assert {r.id: (r.candidate, r.shared, r.status) for r in match.cast_match(rows, cands, "id", "names", "billed").collect()} == {"m": (1, 3, "verified"), "n": (1, 2, "tie"), "o": (1, 1, "weak")}
    fields = "k string, candidate int, cast_ok boolean, name_ok boolean, year_ok boolean, size_ok boolean"
    gates = spark.createDataFrame([("a", 1, True, False, True, None), ("a", 2, False, True, True, True), ("b", 1, False, True, True, None), ("b", 2, None, True, None, True), ("c", 1, False, True, True, True), ("c", 2, False, True, True, True), ("d", 1, True, True, True, False)], fields)
    assert {r.k: (r.candidate, r.tier) for r in match.gate(gates, "k").collect()} == {"a": (1, 1), "b": (1, 2)}
    day = lambda n: dt.datetime(2024, 1, n)
    titles = spark.createDataFrame([(1, "s", 1, day(1)), (2, "t", 2, day(2))], "id int, slug string, season int, sorted_at timestamp")
    found = match.alias_lookup(spark.createDataFrame([("s", 2), ("old", None), ("s2", None), ("none", None)], "slug string, season int"), titles, spark.createDataFrame([("s", 2)], "slug string, id int"), spark.createDataFrame([("old", 1), ("s", 1)], "slug string, id int"))
    assert {r.slug: r.id for r in found.collect()} == {"s": 2, "old": 1}
    kin = match.family(spark.createDataFrame([(1, "tv", "x", 5), (2, "tv", "x", None), (3, "tv", "y", 5), (4, "movie", "x", 5)], "id int, media_type string, base string, tmdb_id long"))
    assert sorted((r.id, r.relative) for r in kin.collect()) == [(1, 2), (1, 3), (2, 1), (3, 1)]


def test_state_rules(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    checks = spark.createDataFrame([("h", i, v) for i, v in enumerate(["dead", "unknown", "dead", "dead", "unknown", "alive", "dead"])], "host string, at int, verdict string")
    got = {r.at: (r.failures, r.state) for r in state.host_states(checks, "host", "at", "verdict", 3).collect()}
    assert got == {0: (1, "alive"), 1: (1, "alive"), 2: (2, "alive"), 3: (3, "dead"), 4: (3, "dead"), 5: (0, "alive"), 6: (1, "alive")}
    alone = state.host_verdicts(spark.createDataFrame([("a", "gone"), ("b", "gone")], "host string, o string"), "host", "o").collect()
    assert {r.verdict for r in alone} == {"unknown"}
    fields = "id int, row_id int, available boolean, first_missing timestamp, next_check timestamp"
    sources = spark.createDataFrame([(1, 1, True, None, None), (2, 2, True, day(1), None), (3, 3, True, day(28), None), (4, 4, True, day(1), None), (5, 5, True, None, None)], fields)
    outcomes = spark.createDataFrame([(1, "404"), (2, "404"), (3, "404"), (4, "ok")], "id int, outcome string")
    after = state.stale_pass(sources, outcomes, F.lit("2024-01-31").cast("timestamp"))
    assert {r.id: (r.action, r.available) for r in after.collect()} == {1: ("waiting", True), 2: ("retired", False), 3: ("waiting", True), 4: ("refreshed", True), 5: ("unseen", True)}
    rows = spark.createDataFrame([(2,), (3,)], "id int")
    assert [r.id for r in state.rows_without_source(rows, after, after.select("row_id")).collect()] == [2]
    log = spark.createDataFrame([(1, "blocked", day(30)), (2, "blocked", day(1)), (3, "undone", day(1))], "id int, kind string, created_at timestamp")
    assert sorted(r.id for r in state.cooled_down(spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int"), log, F.lit("2024-01-31").cast("timestamp")).collect()) == [2, 4]
    tries = spark.createDataFrame([(1, "k")] * 3 + [(2, "old")] * 5, "id int, key string")
    assert [r.id for r in state.under_cap(spark.createDataFrame([(1, "k"), (2, "k")], "id int, key string"), tries).collect()] == [2]


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("a", dt.datetime(2024, 1, 1, 10), True, 5), ("a", dt.datetime(2024, 1, 1, 11), True, 7), ("b", dt.datetime(2024, 1, 2, 1), False, 1)]
    spark.createDataFrame(rows, "k string, t timestamp, bad boolean, n long").coalesce(1).write.parquet(folder)
    source = spark.readStream.schema("k string, t timestamp, bad boolean, n long").parquet(folder)

    def run(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    used = run(ledger.daily_ledger(source, "t", ["k"], "n"), "ledger_used", "update")
    assert {(r.k, r.day.start.day): (r.requests, r.used) for r in used} == {("a", 1): (2, 12), ("b", 2): (1, 1)}
    streaks = run(ledger.failure_streaks(source, "k", "t", "bad"), "ledger_streaks", "update")
    assert {r.k: r.streak for r in streaks} == {"a": 2, "b": 0}
