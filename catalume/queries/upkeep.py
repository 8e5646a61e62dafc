"""Keeping the catalogue: status rows, counters, identity fills, stale sources, lookups by alias, gates and limits over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalume.functions.scalars import under_host, url_part
from catalume.operators import identity, match, snapshot, state, writes
from catalume.queries.registry import query

EARLY = "o_orderdate < TIMESTAMP '1998-01-01'"


def _orders(t, early: bool):
    at = F.col("o_orderdate").cast("timestamp")
    return t.orders.where(at < F.lit("1998-01-01").cast("timestamp") if early else at >= F.lit("1998-01-01").cast("timestamp"))


@query(f"""WITH o AS (SELECT o_custkey AS id, arg_max(o_totalprice, o_orderkey) AS payload, arg_max(o_orderpriority, o_orderkey) AS note FROM orders WHERE {EARLY} GROUP BY 1),
n AS (SELECT o_custkey AS id, arg_max(o_totalprice, o_orderkey) AS payload, arg_max(o_orderpriority, o_orderkey) AS note, arg_max(o_orderstatus, o_orderkey) AS status FROM orders WHERE NOT {EARLY} GROUP BY 1)
SELECT n.id, CASE WHEN n.status = 'F' THEN o.payload ELSE n.payload END AS payload, n.note FROM n LEFT JOIN o USING (id)
UNION ALL SELECT id, payload, note FROM o WHERE id NOT IN (SELECT id FROM n)""")
def keep_last_good(t):
    newest = lambda rows: rows.groupBy(F.col("o_custkey").alias("id")).agg(*[F.max_by(c, "o_orderkey").alias(n) for c, n in (("o_totalprice", "payload"), ("o_orderpriority", "note"), ("o_orderstatus", "status"))])
    new = newest(_orders(t, False))
    out = writes.keep_last_good(newest(_orders(t, True)), new, "id", ["payload"], F.col("status") == "F")
    return out.select("id", "payload", "note")


@query(f"""WITH s AS (SELECT o_custkey AS id, count(*) % 3 AS streak, count(*) AS late, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders WHERE {EARLY} GROUP BY 1),
e AS (SELECT *, max(CASE WHEN o_orderstatus <> 'F' THEN (o_orderdate, o_orderkey) END) OVER (PARTITION BY o_custkey) AS good FROM orders WHERE NOT {EARLY}),
n AS (SELECT o_custkey AS id, bool_or(good IS NOT NULL) AS any_good, count(*) FILTER (o_orderstatus = 'F' AND (good IS NULL OR (o_orderdate, o_orderkey) > good)) AS run,
 count(*) FILTER (o_orderpriority < '3') AS late, count(*) FILTER (o_orderstatus = 'O') AS open FROM e GROUP BY 1)
SELECT coalesce(s.id, n.id) AS id, (CASE WHEN coalesce(any_good, FALSE) THEN 0 ELSE coalesce(s.streak, 0) END + coalesce(run, 0))::BIGINT AS streak, (coalesce(s.late, 0) + coalesce(n.late, 0))::BIGINT AS late,
 (coalesce(s.open, 0) + coalesce(n.open, 0))::BIGINT AS open FROM s FULL JOIN n ON s.id = n.id""")
def add_counters(t):
    stored = _orders(t, True).groupBy(F.col("o_custkey").alias("id")).agg((F.count("*") % 3).alias("streak"), F.count("*").alias("late"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    events = _orders(t, False).withColumn("id", F.col("o_custkey"))
    return writes.add_counters(stored, events, "id", ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F", {"late": F.col("o_orderpriority") < "3", "open": F.col("o_orderstatus") == "O"})


@query(f"""WITH o AS (SELECT o_custkey, o_orderpriority, max(o_totalprice) AS price FROM orders WHERE {EARLY} GROUP BY ALL), n AS (SELECT o_custkey, o_orderpriority, max(o_totalprice) AS price FROM orders WHERE NOT {EARLY} GROUP BY ALL)
SELECT TRUE AS pruned, * FROM n UNION ALL SELECT FALSE, coalesce(n.o_custkey, o.o_custkey), coalesce(n.o_orderpriority, o.o_orderpriority), coalesce(n.price, o.price) FROM n FULL JOIN o ON n.o_custkey = o.o_custkey AND n.o_orderpriority = o.o_orderpriority""")
def upsert_children(t):
    keys = ["o_custkey", "o_orderpriority"]
    old, new = (_orders(t, early).groupBy(*keys).agg(F.max("o_totalprice").alias("price")) for early in (True, False))
    return snapshot.upsert(old, new, keys, ["price"]).withColumn("pruned", F.lit(True)).unionByName(snapshot.upsert(old, new, keys, ["price"], prune=False).withColumn("pruned", F.lit(False)))


@query("""WITH r AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 > 0 THEN p_partkey % 500 + 1 END AS n, CASE WHEN p_size % 3 > 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'movie' ELSE 'tv' END END AS media,
 CASE WHEN p_size % 3 > 0 AND p_partkey % 2 = 1 AND p_size % 4 > 0 THEN p_size % 4 END AS season, CASE p_size % 5 WHEN 0 THEN 'single' WHEN 1 THEN 'hoathinh' ELSE 'series' END AS display, p_size % 11 = 0 AS pinned FROM part),
i AS (SELECT id, CASE WHEN id % 7 = 0 THEN coalesce(n, id + 600) ELSE id % 700 + 501 END AS n, CASE WHEN id % 2 = 0 THEN 'movie' ELSE 'tv' END AS media, CASE WHEN id % 2 = 1 THEN id % 3 + 1 END AS season FROM r),
c AS (SELECT i.*, concat_ws(':', i.media, i.n::VARCHAR, CASE WHEN i.media = 'tv' THEN coalesce(i.season::VARCHAR, '') ELSE '' END) AS key FROM i JOIN r USING (id) WHERE NOT pinned AND (
 (r.n IS NULL AND NOT ((i.media = 'tv' AND display = 'single') OR (i.media = 'movie' AND display = 'series'))) OR (i.media = 'tv' AND r.media = 'tv' AND r.n = i.n AND r.season IS NULL AND i.season IS NOT NULL)))
SELECT id, n AS tmdb_id, media, season FROM c WHERE key NOT IN (SELECT concat_ws(':', media, n::VARCHAR, CASE WHEN media = 'tv' THEN coalesce(season::VARCHAR, '') ELSE '' END) FROM r WHERE n IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) = 1""")
def fill_identity(t):
    k, z = F.col("p_partkey"), F.col("p_size")
    media = F.when(k % 2 == 0, "movie").otherwise("tv")
    rows = t.part.select(
        k.alias("id"), F.when(z % 3 > 0, k % 500 + 1).alias("tmdb_id"), F.when(z % 3 > 0, media).alias("media"), F.when((z % 3 > 0) & (k % 2 == 1) & (z % 4 > 0), z % 4).alias("season"),
        F.when(z % 5 == 0, "single").when(z % 5 == 1, "hoathinh").otherwise("series").alias("display"), (z % 11 == 0).alias("pinned"),
    )
    given = F.when(k % 7 == 0, F.coalesce(F.when(z % 3 > 0, k % 500 + 1), k + 600)).otherwise(k % 700 + 501)
    incoming = t.part.select(k.alias("id"), given.alias("tmdb_id"), media.alias("media"), F.when(k % 2 == 1, k % 3 + 1).cast("int").alias("season"))
    return writes.fill_identity(rows, incoming, "id")


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey AS row_id, o_orderstatus <> 'P' AS available, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS first_missing FROM orders),
o AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'conflict' WHEN 4 THEN 'error' ELSE '404' END AS outcome FROM orders WHERE o_orderkey % 6 <> 5),
j AS (SELECT *, outcome = '404' AND first_missing IS NOT NULL AND date_diff('day', first_missing::DATE, DATE '1998-06-15') >= 7 AS confirmed FROM s LEFT JOIN o USING (id))
SELECT id, CASE WHEN confirmed THEN FALSE ELSE available END AS available, CASE WHEN outcome = 'ok' THEN NULL WHEN outcome = '404' THEN coalesce(first_missing, TIMESTAMP '1998-06-15 12:00:00') ELSE first_missing END AS first_missing,
 CASE WHEN outcome IS NULL THEN 'unseen' WHEN outcome = 'ok' THEN 'refreshed' WHEN confirmed THEN 'retired' WHEN outcome = '404' THEN 'waiting' ELSE 'deferred' END AS action,
 CASE WHEN outcome = 'ok' OR outcome IS NULL OR confirmed THEN NULL WHEN outcome = '404' THEN TIMESTAMP '1998-06-22 13:00:00' ELSE TIMESTAMP '1998-06-16 12:00:00' END AS next_check FROM j""")
def stale_pass(t):
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    sources = t.orders.select(k.alias("id"), F.col("o_custkey").alias("row_id"), (F.col("o_orderstatus") != "P").alias("available"), F.when(k % 3 == 0, at + F.expr("interval 1 day")).alias("first_missing"), F.lit(None).cast("timestamp").alias("next_check"))
    outcome = F.when(k % 5 == 0, "ok").when(k % 5 == 1, "conflict").when(k % 5 == 4, "error").otherwise("404")
    outcomes = t.orders.where(k % 6 != 5).select(k.alias("id"), outcome.alias("outcome"))
    return state.stale_pass(sources, outcomes, F.lit("1998-06-15 12:00:00").cast("timestamp")).drop("row_id")


@query("""WITH e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, (event_id % 4 <> 0)::INT AS bad FROM events),
m AS (SELECT *, (bad = 0 OR coalesce(ms - lag(ms) OVER w > 900000, FALSE))::INT AS cut FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
i AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS island FROM m),
s AS (SELECT *, sum(bad) OVER (PARTITION BY user_id, island ORDER BY ms, event_id) AS streak FROM i)
SELECT event_id, streak::BIGINT AS streak, CASE WHEN streak > 1 THEN least(5000, 250 * pow(2, streak - 2)) ELSE 0 END::BIGINT AS delay_ms FROM s""")
def failure_backoff(t):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = t.events.select("user_id", "event_id", F.struct(ms.alias("ms"), "event_id").alias("o"), ms.alias("ms"), (F.col("event_id") % 4 != 0).alias("bad"))
    out = state.failure_backoff(rows, ["user_id"], "ms", F.col("bad"), free=1, tie=["event_id"])
    return out.select("event_id", F.col("streak").cast("long").alias("streak"), "delay_ms")


@query("""WITH r AS (SELECT c_custkey AS id, 'n-' || c_nationkey || '-' || c_custkey % 7 AS slug, c_custkey % 4 AS season, c_acctbal AS sorted_at FROM customer),
s AS (SELECT 'n-' || c_nationkey || '-' || (c_custkey + 1) % 9 AS slug, c_custkey AS id FROM customer WHERE c_custkey % 2 = 0), a AS (SELECT 'old-' || c_nationkey || '-' || c_custkey % 3 AS slug, c_custkey AS id FROM customer),
w AS (SELECT DISTINCT 'n-' || c_nationkey || '-' || c_custkey % 11 AS slug, 2 AS season FROM customer UNION SELECT DISTINCT 'old-' || c_nationkey || '-' || c_custkey % 4, NULL FROM customer),
d AS (SELECT w.slug, x.id, x.canonical, (coalesce(w.season, -1) = coalesce(r.season, -1))::INT AS fits, r.sorted_at FROM w JOIN (SELECT slug, id, 1 AS canonical FROM r UNION ALL SELECT slug, id, 0 FROM s) x USING (slug) JOIN r ON r.id = x.id),
b AS (SELECT slug, id FROM d QUALIFY row_number() OVER (PARTITION BY slug ORDER BY fits DESC, canonical DESC, sorted_at DESC) = 1)
SELECT * FROM b UNION ALL SELECT slug, min(a.id) FROM w JOIN a USING (slug) WHERE slug NOT IN (SELECT slug FROM b) GROUP BY slug""")
def alias_lookup(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    named = lambda start, number: F.concat_ws("-", F.lit(start), n, number.cast("string"))
    rows = t.customer.select(k.alias("id"), named("n", k % 7).alias("slug"), (k % 4).alias("season"), F.col("c_acctbal").alias("sorted_at"))
    sources = t.customer.where(k % 2 == 0).select(named("n", (k + 1) % 9).alias("slug"), k.alias("id"))
    aliases = t.customer.select(named("old", k % 3).alias("slug"), k.alias("id"))
    wanted = t.customer.select(named("n", k % 11).alias("slug"), F.lit(2).cast("long").alias("season")).union(t.customer.select(named("old", k % 4), F.lit(None).cast("long"))).distinct()
    return match.alias_lookup(wanted, rows, sources, aliases)


@query("""WITH k AS (SELECT p_partkey AS id, 't|' || p_type || '|' || p_name || p_size AS k FROM part UNION ALL SELECT p_partkey, 'i|' || p_partkey // 4 FROM part WHERE p_size % 2 = 1),
f AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM k)
SELECT DISTINCT a.id, b.id AS relative FROM f a JOIN f b ON a.k = b.k AND a.id <> b.id WHERE a.n BETWEEN 2 AND 10""")
def family(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.concat("p_name", F.col("p_size").cast("string")).alias("base"), F.when(F.col("p_size") % 2 == 1, F.floor(F.col("p_partkey") / 4)).alias("tmdb_id"))
    # both media are shown: the id counts for series only
    return match.family(rows.select("id", F.lit("tv").alias("media_type"), F.concat_ws("|", "kind", "base").alias("base"), "tmdb_id"))


@query("""WITH c AS (SELECT l_orderkey AS key, l_linenumber AS candidate, l_quantity > 40 AS cast_ok, CASE WHEN l_tax = 0 THEN NULL ELSE l_returnflag = 'A' END AS name_ok, l_discount < 0.08 AS year_ok, CASE WHEN l_linestatus = 'F' THEN l_tax < 0.07 END AS size_ok FROM lineitem
 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1),
t AS (SELECT *, coalesce(cast_ok, FALSE) AND coalesce(year_ok, FALSE) AND coalesce(size_ok, TRUE) AS one, coalesce(name_ok, FALSE) AND coalesce(year_ok, FALSE) AND coalesce(size_ok, TRUE) AS two FROM c),
p AS (SELECT key, count(*) FILTER (one) AS n1, count(*) FILTER (one OR two) AS n2, min(candidate) FILTER (one) AS c1, min(candidate) FILTER (one OR two) AS c2 FROM t GROUP BY key)
SELECT key, CASE WHEN n1 = 1 THEN c1 ELSE c2 END AS candidate, CASE WHEN n1 = 1 THEN 1 ELSE 2 END AS tier FROM p WHERE n1 = 1 OR (n1 = 0 AND n2 = 1)""")
def gate_tiers(t):
    keys = ["l_orderkey", "l_linenumber"]
    rest = ["l_quantity", "l_tax", "l_returnflag", "l_discount", "l_linestatus"]
    one = t.lineitem.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("l_partkey", "l_suppkey", "l_extendedprice")).alias("r")).select(*keys, "r.*")
    rows = one.select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("candidate"), (F.col("l_quantity") > 40).alias("cast_ok"), F.when(F.col("l_tax") != 0, F.col("l_returnflag") == "A").alias("name_ok"),
        (F.col("l_discount") < 0.08).alias("year_ok"), F.when(F.col("l_linestatus") == "F", F.col("l_tax") < 0.07).alias("size_ok"),
    )
    return match.gate(rows, "key")


@query("""WITH s AS (SELECT o_custkey AS user_id, o_orderpriority AS item, o_orderdate AS seen, CASE WHEN o_orderkey % 3 > 0 THEN 'e' || o_orderkey END AS episode, o_orderkey AS k FROM orders)
SELECT user_id, item, max(seen) AS seen, arg_max(episode, (seen, k)) FILTER (episode IS NOT NULL) AS episode FROM s GROUP BY ALL""")
def touch_history(t):
    rows = t.orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("item"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("e"), F.col("o_orderkey").cast("string"))).alias("episode"), F.col("o_orderkey").alias("k"))
    stored, touches = rows.where("k % 2 = 0"), rows.where("k % 2 = 1")
    return writes.touch_history(stored, touches, tie="k").withColumnRenamed("at", "seen")


@query("""WITH l AS (SELECT o_custkey AS id, CASE o_orderstatus WHEN 'F' THEN 'blocked' WHEN 'P' THEN 'undone' ELSE 'assign' END AS kind, o_orderdate AS made FROM orders WHERE o_orderkey % 9 = 0)
SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM l WHERE kind = 'undone' OR (kind = 'blocked' AND made > TIMESTAMP '1998-06-15' - INTERVAL 300 DAY))""")
def cooled_down(t):
    kind = F.when(F.col("o_orderstatus") == "F", "blocked").when(F.col("o_orderstatus") == "P", "undone").otherwise("assign")
    log = t.orders.where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("id"), kind.alias("kind"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return state.cooled_down(t.customer.select(F.col("c_custkey").alias("id")), log, F.lit("1998-06-15").cast("timestamp"), 300)


@query("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'series' ELSE 'single' END AS kind, CASE WHEN o_orderkey % 5 < 3 THEN o_custkey % 50 END AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'tv' ELSE 'movie' END AS m,
 CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 4)::INT END AS s, o_custkey AS c FROM orders)
SELECT a.id, b.id AS other, CASE WHEN (a.kind = 'series' OR b.kind = 'series') AND a.s <> b.s THEN 'season-differs' WHEN a.n IS NOT NULL AND b.n IS NOT NULL AND (a.n <> b.n OR a.m <> b.m) THEN 'tmdb-differs'
 WHEN b.m = 'tv' AND a.n IS NOT NULL AND a.s IS NOT NULL AND a.s IS DISTINCT FROM b.s THEN 'season-differs' END AS conflict FROM r a JOIN r b ON b.id = a.id + 1""")
def identity_conflict(t):
    k = F.col("o_orderkey")
    season = F.when(k % 4 > 0, (k % 4).cast("int"))
    side = F.struct(F.when(k % 3 == 0, "series").otherwise("single").alias("media_type"), F.when(k % 5 < 3, F.col("o_custkey") % 50).alias("tmdb_id"), F.when(k % 3 == 0, "tv").otherwise("movie").alias("tmdb_media"), season.alias("season"), season.alias("tmdb_season"))
    a, b = t.orders.select(k.alias("id"), side.alias("row")), t.orders.select((k - 1).alias("id"), k.alias("other"), side.alias("incoming"))
    return a.join(b, "id").select("id", "other", identity.identity_conflict(F.col("row"), F.col("incoming")).alias("conflict"))


@query("""SELECT thumb AS asset FROM (SELECT url AS thumb FROM pages UNION SELECT regexp_replace(url, '^https?', 'ftp') FROM pages WHERE page_id % 2 = 0)""")
def union_columns(t):
    """All distinct values of two columns."""
    rows = t.pages.select(F.col("url").alias("thumb"), F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?", "ftp")).alias("poster"))
    return rows.select(F.explode(F.array_compact(F.array("thumb", "poster"))).alias("asset")).distinct()


@query("""WITH h AS (SELECT page_id, url, lower(split_part(split_part(url, '//', 2), '/', 1)) AS host FROM pages), d AS (SELECT *, regexp_matches(host, '(^|[.])(example[.]com|spam-farm[.]example[.]org)$') AS dead FROM h)
SELECT page_id, dead AND page_id % 3 <> 0 AS drop_thumb, dead AND page_id % 2 = 1 AND page_id % 5 <> 0 AS drop_poster FROM d WHERE dead AND (page_id % 3 <> 0 OR (page_id % 2 = 1 AND page_id % 5 <> 0))""")
def dead_host_purge(t):
    """Which images of a row go: those whose address is on a dead host and that are not cached."""
    host = F.lower(url_part(F.col("url"), "HOST"))
    dead = under_host(host, ["example.com", "spam-farm.example.org"])
    k = F.col("page_id")
    rows = t.pages.select(k, F.col("url").alias("thumb"), F.when(k % 2 == 1, F.col("url")).alias("poster"), (k % 3 == 0).alias("thumb_cached"), (k % 5 == 0).alias("poster_cached"), dead.alias("dead"))
    plan = rows.select("page_id", (F.col("dead") & ~F.col("thumb_cached")).alias("drop_thumb"), (F.col("dead") & F.col("poster").isNotNull() & ~F.col("poster_cached")).alias("drop_poster"))
    return plan.where("drop_thumb or drop_poster")
