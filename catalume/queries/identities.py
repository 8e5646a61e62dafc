"""Decisions of identity over whole tables: provider decisions, plans, and a resolve batch whose budgets run out.

The catalogue rows are those of ``part``, claimed by two providers; the landed answers of the outside title database are made of ``orders``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalume.operators import identity, resolve
from catalume.queries.registry import query

ROWS = """
r AS (SELECT p_partkey AS id, p_partkey AS k, p_size AS z, p_partkey + (p_size % 7 = 1)::INT AS t, CASE WHEN p_partkey % 37 = 0 THEN 'hidden' ELSE 'ready' END AS state,
 CASE WHEN p_size % 5 >= 2 THEN (p_partkey * 7) % 7001 + 1 END AS tmdb_id,
 CASE WHEN p_size % 5 >= 2 AND p_size % 11 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'movie' ELSE 'tv' END END AS tmdb_media,
 CASE WHEN p_size % 5 >= 2 AND p_partkey % 3 <> 0 AND p_size % 4 <> 0 THEN p_size % 3 + 1 END AS tmdb_season,
 CASE WHEN p_partkey % 6 = 0 THEN 'tt' || lpad((p_partkey % 400)::VARCHAR, 5, '0') END AS imdb,
 CASE WHEN p_partkey % 31 = 0 OR p_partkey % 3 = 0 THEN 'single' WHEN p_partkey % 29 = 0 THEN 'hoathinh' ELSE 'series' END AS display,
 p_size % 13 = 0 AS pinned, CASE WHEN p_size % 8 = 0 THEN 2 WHEN p_size % 9 = 0 THEN 3 END AS marker,
 CASE WHEN p_size <> 17 THEN 2000 + p_size % 3 END AS year, p_size AS total,
 CASE p_partkey % 3 WHEN 0 THEN 2 ELSE 1 END AS n_providers, (p_partkey % 3 <> 1)::INT AS kk, p_partkey % 4 AS filled, p_partkey % 10 AS born FROM part),
said AS (
 SELECT id, 'kkphim' AS provider, CASE z % 7 WHEN 5 THEN NULL WHEN 6 THEN 10000000 + k ELSE (t * 7) % 7001 + 1 END AS n, CASE WHEN t % 3 = 0 THEN 'movie' ELSE 'tv' END AS m,
  CASE WHEN z % 4 <> 0 THEN z % 3 + 1 END AS s, CASE WHEN k % 6 < 3 THEN 'tt' || lpad((k % 400)::VARCHAR, 5, '0') END AS imdb FROM r WHERE k % 2 = 0 OR k % 5 = 0
 UNION ALL
 SELECT id, 'nguonc', CASE z % 7 WHEN 5 THEN NULL WHEN 6 THEN 10000000 + k WHEN 2 THEN (t * 7) % 7001 + 2 ELSE (t * 7) % 7001 + 1 END, CASE WHEN t % 3 = 0 THEN 'movie' ELSE 'tv' END,
  CASE WHEN z % 10 = 0 THEN z % 3 + 2 WHEN z % 4 <> 0 OR z % 8 = 0 THEN z % 3 + 1 END,
  CASE WHEN k % 6 < 2 THEN 'tt' || lpad((k % 400)::VARCHAR, 5, '0') WHEN k % 6 = 2 AND z % 2 = 0 THEN 'tt' || lpad(((k + 1) % 400)::VARCHAR, 5, '0') END FROM r WHERE k % 4 <> 1),
c AS (SELECT id, provider, n, CASE WHEN n IS NOT NULL THEN m END AS m, CASE WHEN n IS NOT NULL AND m = 'tv' THEN s END AS s, imdb FROM said)"""

DECIDED = """
per AS (
 SELECT id, count(n) AS named, count(DISTINCT (n, m)) FILTER (n IS NOT NULL) AS ids, min(n) AS num, min(m) AS med, count(DISTINCT provider) FILTER (n IS NOT NULL) >= 2 AS agreed,
  count(DISTINCT s) AS seasons, min(s) AS sole, list(DISTINCT s) FILTER (s IS NOT NULL) AS all_s, count(DISTINCT imdb) AS imdbs, min(imdb) AS one_imdb, list(DISTINCT imdb) FILTER (imdb IS NOT NULL) AS all_imdb,
  coalesce(string_agg(concat_ws(':', provider, coalesce(n::VARCHAR, ''), coalesce(m, ''), coalesce(s::VARCHAR, ''), coalesce(imdb, '')), '|'
   ORDER BY concat_ws(':', provider, coalesce(n::VARCHAR, ''), coalesce(m, ''), coalesce(s::VARCHAR, ''), coalesce(imdb, ''))) FILTER (n IS NOT NULL OR imdb IS NOT NULL), '') AS claims FROM c GROUP BY id),
a AS (
 SELECT r.*, coalesce(named, 0) AS named, coalesce(ids, 0) AS ids, num, med, coalesce(agreed, FALSE) AS agreed, coalesce(seasons, 0) AS seasons, sole, coalesce(imdbs, 0) AS imdbs, one_imdb, coalesce(claims, '') AS claims,
  coalesce(list_contains(all_s, marker), FALSE) AS settled, coalesce(list_contains(all_imdb, r.imdb), FALSE) AS has_imdb,
  CASE WHEN med = 'tv' THEN CASE WHEN seasons > 1 THEN marker WHEN seasons = 1 THEN sole ELSE marker END END AS season FROM r LEFT JOIN per USING (id)),
b AS (
 SELECT a.*, (SELECT count(DISTINCT provider) FROM c WHERE c.id = a.id AND c.n IS NOT NULL AND c.s = a.season) + (coalesce(seasons > 1 OR marker = season, FALSE))::INT AS support,
  tmdb_id IS NOT NULL AS held, tmdb_id IS NOT NULL AND tmdb_id = num AND (tmdb_media IS NULL OR tmdb_media = med) AS same,
  (med = 'tv' AND display = 'single') OR (med = 'movie' AND display IN ('series', 'tvshows')) AS odd,
  med = 'tv' AND seasons > 1 AND NOT settled AS disagree, med = 'tv' AND seasons = 1 AND marker IS NOT NULL AND marker <> sole AS against, (season IS NULL OR coalesce(season = tmdb_season, FALSE)) AS kept,
  CASE WHEN imdbs = 0 THEN NULL WHEN imdb IS NOT NULL THEN CASE WHEN NOT has_imdb THEN 'conflict' END WHEN imdbs = 1 THEN 'fill' ELSE 'conflict' END AS imdb_action FROM a),
v AS (
 SELECT *, CASE
  WHEN named = 0 THEN CASE WHEN NOT held AND (imdb IS NOT NULL OR coalesce(imdb_action = 'fill', FALSE)) THEN 'find' ELSE 'none' END
  WHEN ids > 1 THEN 'ask providers-disagree'
  WHEN coalesce(odd, FALSE) THEN CASE WHEN same THEN 'noop' ELSE 'ask type-mismatch' END
  WHEN coalesce(disagree, FALSE) THEN 'ask season-disagree'
  WHEN coalesce(against, FALSE) THEN CASE WHEN same AND coalesce(tmdb_season = marker, FALSE) THEN 'noop' ELSE 'ask season-vs-title' END
  WHEN NOT held THEN CASE WHEN med = 'tv' AND season IS NULL THEN 'open fill season-unknown' WHEN agreed THEN 'write fill providers-agree' ELSE 'write fill single-provider' END
  WHEN same AND med <> 'tv' THEN CASE WHEN tmdb_media IS NOT NULL THEN 'noop' ELSE 'write fill type-fill' END
  WHEN same AND kept AND tmdb_media IS NOT NULL AND tmdb_season IS NOT NULL THEN 'noop'
  WHEN same AND (kept OR tmdb_season IS NULL) THEN CASE WHEN season IS NULL AND tmdb_season IS NULL THEN 'open fill season-unknown' ELSE 'write fill season-fill' END
  WHEN same THEN CASE WHEN support < 2 THEN 'ask season-single-dissent' ELSE 'write season season-agree' END
  WHEN pinned THEN 'blocked' WHEN NOT agreed THEN 'queue single-vs-existing'
  WHEN med = 'tv' AND season IS NULL THEN 'open overwrite providers-agree' ELSE 'write overwrite providers-agree' END AS step FROM b),
d AS (
 SELECT *, split_part(step, ' ', 1) AS kind, CASE WHEN pinned AND split_part(step, ' ', 1) IN ('ask', 'write', 'open') THEN TRUE ELSE FALSE END AS stopped FROM v),
decided AS (
 SELECT *, CASE WHEN stopped THEN 'blocked' WHEN kind IN ('ask', 'queue') THEN 'queue' WHEN kind = 'write' THEN 'assign' WHEN kind = 'open' THEN 'resolve-season' ELSE kind END AS action,
  CASE WHEN NOT stopped AND kind IN ('write', 'open') THEN split_part(step, ' ', 2) END AS tier,
  CASE WHEN stopped OR kind = 'blocked' THEN 'pinned' WHEN kind IN ('ask', 'queue') THEN split_part(step, ' ', 2) WHEN kind IN ('write', 'open') THEN split_part(step, ' ', 3) END AS reason,
  CASE WHEN NOT stopped AND kind IN ('write', 'open') THEN num END AS to_id, CASE WHEN NOT stopped AND kind IN ('write', 'open') THEN med END AS to_media,
  CASE WHEN NOT stopped AND kind = 'write' THEN CASE split_part(step, ' ', 3) WHEN 'type-fill' THEN NULL WHEN 'season-fill' THEN coalesce(season, tmdb_season) ELSE season END END AS to_season FROM d)"""

#: Plans of asks(id, to_id, to_media, to_season, tier, replaces).
PLANNED = """
hold AS (SELECT *, concat_ws(':', tmdb_media, tmdb_id::VARCHAR, CASE WHEN tmdb_media = 'tv' THEN coalesce(tmdb_season::VARCHAR, '') ELSE '' END) AS key FROM r WHERE tmdb_id IS NOT NULL),
holds AS (SELECT key, count(*) AS n, min(id) AS first, max(id) AS last FROM hold GROUP BY key),
met AS (
 SELECT q.id, q.to_id, q.to_media, q.to_season, q.tier, q.replaces, g.n, CASE WHEN g.first = q.id THEN g.last ELSE g.first END AS holder
 FROM asks q LEFT JOIN holds g ON g.key = concat_ws(':', to_media, to_id::VARCHAR, CASE WHEN to_media = 'tv' THEN coalesce(to_season::VARCHAR, '') ELSE '' END)),
guarded AS (
 SELECT m.*, t.id IS NULL AS missing, t.state, t.tmdb_id IS NOT NULL AS has_id, t.pinned,
  coalesce(t.tmdb_id = to_id AND t.tmdb_media = to_media AND t.tmdb_season IS NOT DISTINCT FROM to_season, FALSE) AS own, h.state AS h_state, h.pinned AS h_pinned,
  CASE WHEN t.imdb <> h.imdb THEN 'imdb-differs' WHEN abs(t.year - h.year) > 1 THEN 'year-differs' WHEN t.marker <> h.marker THEN 'season-differs' END AS guard,
  (t.n_providers, t.kk, t.filled, -t.born) > (h.n_providers, h.kk, h.filled, -h.born) OR ((t.n_providers, t.kk, t.filled, -t.born) = (h.n_providers, h.kk, h.filled, -h.born) AND t.id < h.id) AS keeps,
  CASE WHEN t.n_providers <> h.n_providers THEN 'more-providers' WHEN t.kk <> h.kk THEN 'has-kkphim' WHEN t.filled <> h.filled THEN 'fuller-metadata' ELSE 'oldest-row' END AS why
 FROM met m LEFT JOIN r t ON t.id = m.id LEFT JOIN r h ON h.id = m.holder),
barred AS (
 SELECT *, CASE WHEN missing THEN 'row-missing' WHEN state <> 'ready' THEN 'not-ready' WHEN own THEN NULL WHEN pinned THEN 'pinned' WHEN has_id AND NOT replaces THEN 'row-has-other-identity'
  WHEN n > 1 THEN 'multiple-holders' WHEN n IS NULL THEN NULL WHEN h_state <> 'ready' THEN 'holder-not-ready' WHEN guard IS NOT NULL THEN guard WHEN h_pinned THEN 'holder-pinned' END AS bar FROM guarded),
plans AS (
 SELECT *, CASE WHEN bar IS NOT NULL THEN 'blocked' WHEN own THEN 'noop' WHEN n IS NULL THEN 'assign' ELSE 'merge' END AS plan,
  CASE WHEN bar IS NOT NULL THEN bar WHEN own THEN 'already-assigned' WHEN n IS NOT NULL THEN 'survivor:' || why END AS plan_reason,
  CASE WHEN bar IS NULL AND NOT own AND n IS NOT NULL AND NOT keeps THEN holder ELSE id END AS survivor,
  CASE WHEN bar IS NULL AND NOT own AND n IS NOT NULL THEN CASE WHEN keeps THEN holder ELSE id END END AS dropped FROM barred)"""

SETTINGS = resolve.Settings(lookups=150, writes=30, written=4)

BODIES = """
bodies AS (
 SELECT '/tv/' || o_orderkey AS path, CASE WHEN o_orderkey % 19 <> 0 THEN o_orderkey % 3 + 1 END AS seasons, (2000 + o_orderkey % 4) AS year, NULL AS hit, NULL AS hit_media, o_orderkey % 19 = 0 AS gone FROM orders
 UNION ALL SELECT '/movie/' || o_orderkey, NULL, 2000 + o_orderkey % 4, NULL, NULL, o_orderkey % 19 = 0 FROM orders
 UNION ALL SELECT '/find/tt' || lpad(o_orderkey::VARCHAR, 5, '0') || '?external_source=imdb_id', NULL, NULL, CASE WHEN o_orderkey % 5 IN (1, 3, 4) THEN o_orderkey + 1 END,
  CASE o_orderkey % 5 WHEN 1 THEN 'movie' WHEN 3 THEN 'tv' WHEN 4 THEN 'tv' END, FALSE FROM orders)"""

BATCH = f"""
keyed AS (
 SELECT *, claims || '#' || concat_ws(':', coalesce(tmdb_id::VARCHAR, ''), coalesce(tmdb_media, ''), coalesce(tmdb_season::VARCHAR, ''), coalesce(imdb, ''), CASE WHEN pinned THEN 'p' ELSE '' END, '{SETTINGS.key()}') AS key FROM decided),
open AS (SELECT *, k % 8 = 0 OR k % 16 = 4 AS skipped FROM keyed),
l1 AS (
 SELECT o.*, coalesce(o.imdb, CASE WHEN imdbs = 1 THEN one_imdb END) AS the_imdb, NOT skipped AND action = 'find' AS asks1 FROM open o),
l2 AS (SELECT l1.*, b.path IS NOT NULL AS there1, b.hit, b.hit_media FROM l1 LEFT JOIN bodies b ON asks1 AND b.path = '/find/' || the_imdb || '?external_source=imdb_id'),
l3 AS (
 SELECT * REPLACE (
  CASE WHEN f THEN CASE WHEN hit IS NULL THEN 'none' WHEN clash THEN 'blocked' WHEN hit_media = 'tv' THEN 'resolve-season' ELSE 'assign' END ELSE action END AS action,
  CASE WHEN f THEN CASE WHEN hit IS NOT NULL AND NOT clash THEN 'fill' END ELSE tier END AS tier,
  CASE WHEN f THEN CASE WHEN hit IS NULL THEN 'find-no-unique-result' WHEN clash THEN 'find-type-mismatch' ELSE 'imdb-find' END ELSE reason END AS reason,
  CASE WHEN f THEN CASE WHEN NOT clash THEN hit END ELSE to_id END AS to_id, CASE WHEN f THEN CASE WHEN NOT clash THEN hit_media END ELSE to_media END AS to_media)
 FROM (SELECT *, asks1 AND there1 AS f, coalesce((hit_media = 'tv' AND display = 'single') OR (hit_media = 'movie' AND display IN ('series', 'tvshows')), FALSE) AS clash FROM l2)),
l4 AS (SELECT *, NOT skipped AND action = 'resolve-season' AS resolves, NOT skipped AND action = 'assign' AND reason IN ('single-provider', 'season-unknown') AS checks FROM l3),
l5 AS (
 SELECT l4.*, asks1::INT + (resolves OR checks)::INT AS wants, b.path IS NOT NULL AS there2, b.gone, b.seasons AS show_seasons, b.year AS body_year
 FROM l4 LEFT JOIN bodies b ON (resolves AND b.path = '/tv/' || to_id) OR (checks AND b.path = '/' || to_media || '/' || to_id)),
l6 AS (SELECT *, greatest(0, least(wants, {SETTINGS.lookups} - (sum(wants) OVER (ORDER BY id) - wants)))::INT AS lookups FROM l5),
l7 AS (
 SELECT *, wants > 0 AND lookups = wants AND NOT CASE WHEN resolves OR checks THEN there2 ELSE there1 END AS failed FROM l6),
l8 AS (
 SELECT *, failed OR lookups < wants AS missed, CASE WHEN resolves THEN coalesce(marker, CASE WHEN NOT gone AND show_seasons = 1 THEN 1 END) ELSE to_season END AS found FROM l7),
l9 AS (
 SELECT *, resolves AND found IS NULL AS lost,
  CASE WHEN (resolves AND found IS NOT NULL AND reason = 'season-unknown') OR checks THEN CASE WHEN gone THEN 'missing' WHEN year >= 1900 AND abs(body_year - year) > 1 AND (to_media = 'movie' OR coalesce(found, 1) <= 1) THEN 'year-' || body_year END END AS why FROM l8),
judged AS (
 SELECT * REPLACE (
  CASE WHEN missed OR NOT (resolves OR checks) THEN action WHEN lost OR why IS NOT NULL THEN 'queue' ELSE 'assign' END AS action,
  CASE WHEN missed OR NOT (resolves OR checks) THEN reason WHEN lost THEN 'season-unresolved' WHEN why IS NOT NULL THEN 'provider-unverified' ELSE reason END AS reason,
  CASE WHEN missed OR NOT (resolves OR checks) THEN to_season ELSE found END AS to_season),
  CASE WHEN NOT missed AND lost THEN CASE WHEN gone THEN 'tmdb-show-missing' WHEN year IS NULL THEN 'no-year' WHEN total < 3 THEN 'too-few-episodes' ELSE 'no-seasons' END WHEN NOT missed THEN why END AS detail FROM l9),
asks AS (SELECT id, to_id, to_media, to_season, tier, tmdb_id IS NOT NULL AS replaces FROM judged WHERE NOT skipped AND NOT missed AND action = 'assign'),{PLANNED},
first AS (SELECT to_media, to_id, coalesce(to_season, -1) AS s, min(id) AS served FROM plans WHERE plan IN ('assign', 'merge') GROUP BY ALL),
turns AS (
 SELECT p.*, plan IN ('assign', 'merge') AND p.id <> served AS waits, tier IN ('season', 'overwrite') OR plan = 'merge' AS dear
 FROM plans p LEFT JOIN first f ON p.to_media = f.to_media AND p.to_id = f.to_id AND coalesce(p.to_season, -1) = f.s),
spent AS (SELECT *, (plan IN ('assign', 'merge') AND NOT waits AND dear)::INT AS uses FROM turns),
capped AS (SELECT *, dear AND sum(uses) OVER (ORDER BY id) - uses >= {SETTINGS.writes - SETTINGS.written} AS late FROM spent),
w AS (
 SELECT id, plan, survivor, dropped, CASE WHEN late OR waits THEN 'deferred' WHEN plan IN ('noop', 'blocked') THEN plan WHEN plan = 'merge' THEN 'merged' ELSE 'assigned' END AS result,
  CASE WHEN late THEN 'daily-cap' WHEN waits THEN 'tuple-in-batch' ELSE plan_reason END AS w_why FROM capped),
became AS (
 SELECT j.*, w.plan, w.survivor, w.dropped, w.w_why, w.id IS NOT NULL AS planned,
  CASE WHEN skipped THEN 'skipped' WHEN missed THEN 'deferred' WHEN w.id IS NOT NULL THEN w.result WHEN action = 'queue' THEN 'queued' WHEN action = 'blocked' THEN 'blocked' ELSE 'noop' END AS became,
  CASE WHEN w.result IN ('assigned', 'merged') THEN j.to_season ELSE j.tmdb_season END AS after, NOT skipped AND coalesce(imdb_action = 'fill', FALSE) AND imdb IS NULL AS fills FROM judged j LEFT JOIN w ON w.id = j.id),
free AS (
 SELECT b.*, fills AND (tmdb_season IS NOT NULL OR NOT EXISTS (SELECT 1 FROM became o WHERE o.imdb = b.the_imdb AND o.display = b.display AND o.id <> b.id AND CASE WHEN o.id < b.id THEN o.after ELSE o.tmdb_season END IS NULL)) AS free FROM became b),
settled AS (
 SELECT f.*, CASE WHEN fills THEN CASE WHEN free AND (tmdb_season IS NOT NULL OR NOT EXISTS (SELECT 1 FROM free o WHERE o.free AND o.after IS NULL AND o.the_imdb = f.the_imdb AND o.display = f.display AND o.id < f.id)) THEN 'imdb-filled' ELSE 'imdb-taken' END
  WHEN NOT skipped AND imdb_action = 'conflict' THEN 'imdb-conflict' END AS imdb_outcome FROM free f),
saved AS (SELECT *, became NOT IN ('skipped', 'deferred') AND NOT (became = 'merged' AND dropped = id) AS keeps, became IN ('assigned', 'merged') AS wrote FROM settled)
SELECT id, became AS state, CASE WHEN NOT skipped THEN action END AS action,
 CASE WHEN missed AND NOT skipped THEN 'lookup-deferred' WHEN became = 'deferred' THEN w_why WHEN NOT skipped THEN reason END AS reason, CASE WHEN NOT skipped THEN tier END AS tier,
 CASE WHEN NOT skipped THEN to_id END AS tmdb_id, CASE WHEN NOT skipped THEN to_media END AS media, CASE WHEN NOT skipped THEN to_season END AS season, survivor, dropped, imdb_outcome, lookups, failed,
 CASE WHEN keeps THEN claims || '#' || concat_ws(':', coalesce((CASE WHEN wrote THEN to_id ELSE tmdb_id END)::VARCHAR, ''), coalesce(CASE WHEN wrote THEN to_media ELSE tmdb_media END, ''),
  coalesce((CASE WHEN wrote THEN to_season ELSE tmdb_season END)::VARCHAR, ''), coalesce(CASE WHEN imdb_outcome = 'imdb-filled' THEN the_imdb ELSE imdb END, ''), CASE WHEN pinned THEN 'p' ELSE '' END, '{SETTINGS.key()}') END AS key,
 CASE WHEN keeps THEN CASE WHEN wrote THEN 'done' WHEN became = 'queued' THEN 'pending' WHEN became = 'blocked' THEN 'blocked' ELSE 'done' END END AS status,
 CASE WHEN keeps THEN nullif(concat_ws(';', CASE WHEN wrote THEN became WHEN planned AND became = 'blocked' THEN w_why WHEN planned AND became = 'noop' THEN 'noop' WHEN became = 'queued' THEN detail END, imdb_outcome), '') END AS outcome
FROM saved"""


def catalogue_rows(t):
    """Rows of ``part`` as catalogue rows with the claims of two providers."""
    k, z = F.col("p_partkey"), F.col("p_size")
    code = lambda n: F.concat(F.lit("tt"), F.lpad((n % 400).cast("string"), 5, "0"))
    target = k + F.when(z % 7 == 1, 1).otherwise(0)
    held, text = z % 5 >= 2, lambda c: c.cast("string")
    number = lambda more: F.when(z % 7 == 5, None).when(z % 7 == 6, 10_000_000 + k).otherwise((target * 7) % 7001 + 1 + more)

    def claim(provider, there, number, season, imdb):
        meta = F.create_map(*[x for n, v in (("tmdb_id", text(number)), ("tmdb_type", F.when(target % 3 == 0, "movie").otherwise("tv")), ("tmdb_season", text(season)), ("imdb_id", imdb)) for x in (F.lit(n), v)])
        return F.when(there, identity.claim(F.lit(provider), meta))

    one = claim("kkphim", (k % 2 == 0) | (k % 5 == 0), number(0), F.when(z % 4 != 0, z % 3 + 1), F.when(k % 6 < 3, code(k)))
    season = F.when(z % 10 == 0, z % 3 + 2).when((z % 4 != 0) | (z % 8 == 0), z % 3 + 1)
    two = claim("nguonc", k % 4 != 1, number(F.when(z % 7 == 2, 1).otherwise(0)), season, F.when(k % 6 < 2, code(k)).when((k % 6 == 2) & (z % 2 == 0), code(k + 1)))
    return t.part.select(
        k.alias("id"), k, F.when(k % 37 == 0, "hidden").otherwise("ready").alias("state"), F.when(held, (k * 7) % 7001 + 1).alias("tmdb_id"),
        F.when(held & (z % 11 != 0), F.when(k % 3 == 0, "movie").otherwise("tv")).alias("tmdb_media"), F.when(held & (k % 3 != 0) & (z % 4 != 0), z % 3 + 1).alias("tmdb_season"),
        F.when(k % 6 == 0, code(k)).alias("imdb"), F.when((k % 31 == 0) | (k % 3 == 0), "single").when(k % 29 == 0, "hoathinh").otherwise("series").alias("display"), (z % 13 == 0).alias("pinned"),
        F.concat("p_name", F.when(z % 8 == 0, " (Phần 2)").otherwise("")).alias("title"), F.concat(F.lit("row-"), text(k), F.when((z % 9 == 0) & (z % 8 != 0), "-phan-3").otherwise("")).alias("slug"),
        F.lit(None).cast("string").alias("original"), F.when(z != 17, 2000 + z % 3).alias("year"), z.alias("total"), F.array_compact(F.array(one, two)).alias("claims"),
        F.when(k % 3 == 0, F.array(F.lit("kkphim"), F.lit("nguonc"))).when(k % 3 == 2, F.array(F.lit("kkphim"))).otherwise(F.array(F.lit("nguonc"))).alias("providers"),
        (k % 4).alias("filled"), F.timestamp_seconds(1_577_836_800 + (k % 10) * 86_400).alias("created"),
    )


def landed_bodies(t):
    """Answers of the outside title database for each order number."""
    n = F.col("o_orderkey")
    path = lambda start, key=n, end="": F.concat(F.lit(start), key.cast("string"), F.lit(end))
    known, date = n % 19 != 0, F.concat((2000 + n % 4).cast("string"), F.lit("-06-01"))
    one = F.array(F.struct((n + 1).alias("id")))
    none = F.array().cast("array<struct<id:bigint>>")
    found = F.struct(F.when(n % 5 == 1, one).when(n % 5 == 2, F.array(F.struct(n.alias("id")), F.struct((n + 1).alias("id")))).otherwise(none).alias("movie_results"), F.when(n % 5 >= 3, one).otherwise(none).alias("tv_results"))
    shows = t.orders.select(path("/tv/").alias("path"), F.when(known, F.to_json(F.struct((n % 3 + 1).alias("number_of_seasons"), date.alias("first_air_date")))).alias("body"))
    films = t.orders.select(path("/movie/").alias("path"), F.when(known, F.to_json(F.struct(date.alias("release_date")))).alias("body"))
    return shows.unionByName(films).unionByName(t.orders.select(path("/find/tt", F.lpad(n.cast("string"), 5, "0"), "?external_source=imdb_id").alias("path"), F.to_json(found).alias("body")))


@query(f"WITH {ROWS},{DECIDED} SELECT id, action, tier, reason, to_id AS tmdb_id, to_media AS media, to_season AS season, imdb_action, claims FROM decided")
def provider_decision(t):
    rows = catalogue_rows(t).withColumn("d", identity.provider_decision(F.struct(*[F.col(c) for c in resolve.ROW]), F.col("claims")))
    return rows.select("id", "d.action", "d.tier", "d.reason", "d.tmdb_id", "d.media", "d.season", "d.imdb_action", identity.claims_key(F.col("claims")).alias("claims"))


@query(f"""WITH {ROWS}, asks AS (SELECT id, tmdb_id AS to_id, tmdb_media AS to_media, tmdb_season AS to_season, NULL AS tier, FALSE AS replaces FROM r WHERE k % 5 = 0 AND tmdb_media IS NOT NULL
UNION ALL SELECT id + 1, tmdb_id, tmdb_media, tmdb_season, NULL, k % 3 = 0 FROM r WHERE k % 5 = 1 AND tmdb_media IS NOT NULL UNION ALL SELECT id + 2, tmdb_id + 3, tmdb_media, tmdb_season, NULL, FALSE FROM r WHERE k % 5 = 2 AND tmdb_media IS NOT NULL),
{PLANNED} SELECT id, plan AS action, plan_reason AS reason, survivor, dropped FROM plans""")
def identity_plan(t):
    rows = catalogue_rows(t).withColumnsRenamed({"tmdb_media": "media", "tmdb_season": "season"})
    ask = lambda n, key, number, replaces: rows.where((F.col("p_partkey") % 5 == n) & F.col("media").isNotNull()).select(key.alias("id"), number.alias("tmdb_id"), "media", "season", replaces.alias("replace"))
    own, number, no = F.col("id"), F.col("tmdb_id"), F.lit(False)
    wanted = ask(0, own, number, no).unionByName(ask(1, own + 1, number, own % 3 == 0)).unionByName(ask(2, own + 2, number + 3, no))
    return identity.identity_plan(rows.drop("p_partkey", "claims", "original", "total", "display"), wanted)


@query(f"WITH {ROWS},{DECIDED},{BODIES},{BATCH}")
def resolve_batch(t):
    rows = catalogue_rows(t)
    row, k = F.struct(*[F.col(c) for c in resolve.ROW]), F.col("p_partkey")
    settled = F.concat(identity.claims_key(F.col("claims")), F.lit("#old"))
    key = F.when(k % 8 == 0, identity.review_key(F.col("claims"), row, F.lit(SETTINGS.key()))).when(k % 16 == 4, settled).otherwise("other#key")
    reviews = rows.where("p_partkey % 4 = 0").select("id", key.alias("key"), F.lit("done").alias("status"), F.when(k % 8 == 4, "ai-match").otherwise("noop").alias("outcome"))
    return resolve.resolve_batch(rows.drop("p_partkey"), landed_bodies(t), reviews, SETTINGS)
