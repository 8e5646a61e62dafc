"""Verdicts with reasons, snapshots, merges and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalume.operators import snapshot
from catalume.queries.registry import query

OLD = "SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 10 <> 3"
NEW = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS s, nullif(o_totalprice, 0) AS p FROM orders WHERE o_orderkey % 10 <> 4"


def _versions(t):
    rows = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    changed = rows.withColumn("s", F.when(F.col("k") % 6 == 0, "X").otherwise(F.col("s"))).withColumn("p", F.nullif(F.col("p"), F.lit(0.0)))
    return rows.where("k % 10 <> 3"), changed.where("k % 10 <> 4")


@query(f"""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'delete' WHEN a.s = b.s AND a.p IS NOT DISTINCT FROM b.p THEN 'same'
ELSE 'update' END AS change FROM ({OLD}) a FULL JOIN ({NEW}) b ON a.k = b.k""")
def row_diff(t):
    return snapshot.classify(*_versions(t), ["k"], ["s", "p"]).select("k", "change")


@query("""WITH r AS (SELECT o_custkey AS id, min(o_orderkey) AS t, min(o_orderstatus) AS media, NULL::INT AS season, 'verified' AS status, 'img' AS asset FROM orders GROUP BY 1),
n AS (SELECT o_custkey AS id, CASE WHEN o_custkey % 3 = 0 THEN max(o_orderkey) ELSE min(o_orderkey) END AS t, CASE WHEN o_custkey % 5 = 0 THEN 'tv' ELSE min(o_orderstatus) END AS media,
CASE WHEN o_custkey % 7 = 0 THEN 2 END AS season FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1)
SELECT r.id, CASE WHEN n.id IS NULL THEN r.t ELSE n.t END AS tmdb_id, CASE WHEN n.id IS NULL THEN r.media ELSE n.media END AS media, n.season,
CASE WHEN n.id IS NOT NULL AND (n.t, n.media, n.season) IS DISTINCT FROM (r.t, r.media, r.season) THEN 'pending' ELSE 'verified' END AS status,
CASE WHEN n.id IS NOT NULL AND (n.t, n.media, n.season) IS DISTINCT FROM (r.t, r.media, r.season) THEN NULL ELSE 'img' END AS asset,
CASE WHEN n.id IS NOT NULL AND (n.t, n.media) IS DISTINCT FROM (r.t, r.media) THEN 'imdb:8' ELSE 'imdb:8,tmdb:7,tmdb_src:x' END AS ratings FROM r LEFT JOIN n USING (id)""")
def snapshot_upsert(t):
    from catalume.operators import writes

    k = F.col("o_custkey")
    per = t.orders.groupBy(k.alias("id")).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), F.min("o_orderstatus").alias("media"))
    ratings = F.create_map(F.lit("imdb"), F.lit("8"), F.lit("tmdb"), F.lit("7"), F.lit("tmdb_src"), F.lit("x"))
    rows = per.select("id", F.col("lo").alias("tmdb_id"), "media", F.lit(None).cast("int").alias("season"), F.lit("verified").alias("status"), F.lit("img").alias("asset"), ratings.alias("ratings"))
    new = per.where("id % 2 = 0").select("id", F.when(F.col("id") % 3 == 0, F.col("hi")).otherwise(F.col("lo")).alias("tmdb_id"), F.when(F.col("id") % 5 == 0, "tv").otherwise(F.col("media")).alias("media"), F.when(F.col("id") % 7 == 0, 2).alias("season"))
    out = writes.write_identity(rows, new, "id", ["asset"])
    text = F.array_join(F.array_sort(F.transform(F.map_entries("ratings"), lambda e: F.concat_ws(":", e["key"], e["value"]))), ",")
    return out.withColumn("ratings", text)


@query(f"""SELECT b.k, b.s, CASE WHEN a.s = b.s THEN DATE '2001-01-01' ELSE DATE '2001-12-31' END AS decided_at FROM ({NEW}) b LEFT JOIN ({OLD}) a ON a.k = b.k""")
def decision_log(t):
    old, new = _versions(t)
    old = old.withColumn("decided_at", F.lit("2001-01-01").cast("date"))
    return snapshot.decision_log(old, new, "k", ["s"], F.lit("2001-12-31").cast("date"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND trim(b) <> '' THEN b WHEN trim(a) <> '' THEN a ELSE b END AS seg FROM (
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS a, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE lower(c_mktsegment) END AS b FROM customer)""")
def field_merge(t):
    old = F.struct(F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("seg")).alias("a")
    new = F.struct(F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.lower("c_mktsegment")).alias("seg")).alias("b")
    both = t.customer.select("c_custkey", old, new)
    return both.select("c_custkey", *snapshot.merge_fields("a", "b", ["seg"], F.col("c_custkey") % 3 == 0))


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice > 400000 THEN 'dear' END, CASE WHEN o_orderstatus = 'P' THEN 'open' END,
CASE WHEN n > 6 THEN 'long' END, CASE WHEN r THEN 'returned' END], lambda x: x IS NOT NULL), ',') AS codes FROM orders JOIN (
SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def detectors(t):
    per = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    joined = t.orders.join(per, F.col("o_orderkey") == F.col("l_orderkey"))
    tests = {"dear": F.col("o_totalprice") > 400_000, "open": F.col("o_orderstatus") == "P", "long": F.col("n") > 6, "returned": F.col("r")}
    return joined.select("o_orderkey", F.array_join(F.array_compact(F.array(*[F.when(v, k) for k, v in tests.items()])), ",").alias("codes"))


@query("""WITH o AS (SELECT user_id % 20 AS host, CASE WHEN s BETWEEN 200 AND 399 THEN 'ok' WHEN s IN (404, 410) OR (s IS NULL AND event_type = 'error') THEN 'gone' ELSE 'transient' END AS o
FROM (SELECT *, CASE event_type WHEN 'error' THEN CASE WHEN value > 30 THEN 404 END WHEN 'purchase' THEN CASE WHEN user_id % 20 < 6 THEN 404 ELSE 200 END ELSE CASE WHEN user_id % 20 < 4 THEN 410 ELSE 503 END END AS s FROM events)),
v AS (SELECT host, CASE WHEN bool_or(o = 'ok') THEN 'alive' WHEN bool_and(o = 'gone') THEN 'dead' ELSE 'unknown' END AS v FROM o GROUP BY 1)
SELECT host, CASE WHEN (SELECT count(*) > 1 AND bool_and(v = 'dead') FROM v) THEN 'unknown' ELSE v END AS verdict FROM v""")
def host_verdict(t):
    from catalume.operators import state

    kind, host = F.col("event_type"), F.col("user_id") % 20
    status = F.when(kind == "error", F.when(F.col("value") > 30, 404)).when(kind == "purchase", F.when(host < 6, 404).otherwise(200)).otherwise(F.when(host < 4, 410).otherwise(503))
    code = F.when(kind == "error", "ENOTFOUND")
    return state.host_verdicts(t.events.select(host.alias("host"), state.probe_outcome(status, code).alias("outcome")), "host", "outcome")


@query("""SELECT p_partkey, p_size, coalesce(CASE WHEN p_size > 40 THEN 'v' || p_size END, CASE WHEN p_brand < 'Brand#3' THEN 'm' || p_brand END, 'g' || p_partkey) AS identity FROM part""")
def identity_precedence(t):
    verified = F.when(F.col("p_size") > 40, F.concat(F.lit("v"), F.col("p_size").cast("string")))
    matched = F.when(F.col("p_brand") < "Brand#3", F.concat(F.lit("m"), F.col("p_brand")))
    return t.part.select("p_partkey", "p_size", F.coalesce(verified, matched, F.concat(F.lit("g"), F.col("p_partkey").cast("string"))).alias("identity"))


@query("""WITH e AS (SELECT *, event_id % 9 AS item FROM events),
a AS (SELECT user_id, item, max(ts) AS t, arg_max(props, (ts, event_id)) AS ep FROM e WHERE event_id % 2 = 0 GROUP BY ALL),
b AS (SELECT user_id, item, t, CASE WHEN item <> 4 THEN ep END AS ep FROM (SELECT user_id, item, max(ts) AS t, arg_max(props, (ts, event_id)) AS ep FROM e WHERE event_id % 2 = 1 GROUP BY ALL))
SELECT user_id, item, greatest(a.t, b.t) AS seen_at, CASE WHEN (a.t IS NULL OR b.t > a.t) AND b.ep IS NOT NULL THEN b.ep ELSE a.ep END AS episode FROM a FULL JOIN b USING (user_id, item)""")
def import_merge(t):
    from catalume.operators import writes

    rows = t.events.withColumn("item", F.col("event_id") % 9)
    per = lambda test: rows.where(test).groupBy("user_id", "item").agg(F.max("ts").alias("at"), F.max_by("props", F.struct("ts", "event_id")).alias("episode"))
    new = per("event_id % 2 = 1").withColumn("episode", F.when(F.col("item") != 4, F.col("episode")))
    return writes.merge_import(per("event_id % 2 = 0"), new).withColumnRenamed("at", "seen_at")


@query("""WITH r AS (SELECT event_type, count(*) FILTER (value > 90) AS remaining, count(*) FILTER (value < 10) AS skipped, count(*) FILTER (value > 99.9) AS ambiguous, max(event_id % 5) AS stalled FROM events GROUP BY 1)
SELECT event_type, remaining, array_to_string(list_filter([CASE WHEN skipped > 0 THEN 'skipped' END, CASE WHEN ambiguous > 0 THEN 'ambiguous' END, CASE WHEN remaining > 200 THEN 'remaining' END,
CASE WHEN stalled >= 3 THEN 'stalled' END], lambda x: x IS NOT NULL), ',') AS alerts FROM r""")
def reason_tally(t):
    from catalume.operators import match

    v = F.col("value")
    per = t.events.groupBy("event_type").agg(F.count_if(v > 90).alias("remaining"), F.count_if(v < 10).alias("skipped"), F.count_if(v > 99.9).alias("ambiguous"), F.max(F.col("event_id") % 5).alias("stalled"))
    return per.select("event_type", "remaining", F.array_join(match.alerts(F.struct("remaining", "skipped", "ambiguous", "stalled"), 200), ",").alias("alerts"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(l, ' (series|serial) ') THEN 'phim-bo' WHEN regexp_matches(l, ' (single|movie) ') THEN 'phim-le' WHEN e IN ('full', '1') THEN 'phim-le' ELSE '' END AS category,
CASE WHEN p_retailprice / 10 <= 100 THEN round(p_retailprice / 10)::INT END AS tomato, p_retailprice / 10 >= 95 AS fresh, CASE WHEN p_size * 3 <= 100 THEN p_size * 3 END::INT AS popcorn FROM (
SELECT *, ' ' || lower(CASE p_size % 4 WHEN 0 THEN 'Serial' WHEN 1 THEN 'Single' ELSE p_type END) || ' ' || p_name || ' ' AS l, CASE WHEN p_size % 3 = 0 THEN 'full' ELSE p_size::VARCHAR END AS e FROM part)""")
def nav_badges(t):
    from catalume.functions import projections as show

    k = F.col("p_size")
    labels = F.concat_ws(" ", F.when(k % 4 == 0, "Serial").when(k % 4 == 1, "Single").otherwise(F.col("p_type")), "p_name")
    badges_ = show.score_badges(F.col("p_retailprice") / 10, k * 3, fresh=95)
    category = show.nav_category(labels, F.when(k % 3 == 0, "full").otherwise(k.cast("string")))
    return t.part.select("p_partkey", category.alias("category"), badges_["tomato"].alias("tomato"), badges_["fresh"].alias("fresh"), badges_["popcorn"].alias("popcorn"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice > 1800 THEN 'gold' WHEN p_name LIKE '%ring%' THEN 'ring' WHEN regexp_matches(p_type, '(?i)steel|brass') THEN 'metal' ELSE 'plain' END AS badge
FROM part""")
def badges(t):
    ladder = F.when(F.col("p_retailprice") > 1800, "gold").when(F.col("p_name").contains("ring"), "ring").when(F.col("p_type").rlike("(?i)steel|brass"), "metal")
    return t.part.select("p_partkey", ladder.otherwise("plain").alias("badge"))


@query("""SELECT c_custkey, CASE WHEN s IS NULL THEN 'noop' WHEN s > 1 THEN 'blocked' WHEN c_acctbal < 0 THEN 'queue' ELSE 'assign' END AS action FROM customer LEFT JOIN (
SELECT o_custkey, count(DISTINCT o_orderstatus) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def promotion(t):
    per = t.orders.groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("s"))
    joined = t.customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    ladder = F.when(F.col("s").isNull(), "noop").when(F.col("s") > 1, "blocked").when(F.col("c_acctbal") < 0, "queue").otherwise("assign")
    return joined.select("c_custkey", ladder.alias("action"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'error' AND value > 60) AS errors FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error' AND value > 60) < 3""")
def attempt_cap(t):
    return t.events.groupBy("user_id").agg(F.count_if((F.col("event_type") == "error") & (F.col("value") > 60)).alias("errors")).where("errors < 3")


@query("""SELECT c_custkey, 'bal:' || c_acctbal::INT || CASE WHEN c_nationkey > 12 THEN ';seg:' || c_mktsegment ELSE '' END AS compact FROM (SELECT * FROM customer WHERE c_acctbal = floor(c_acctbal))
UNION ALL SELECT c_custkey, CASE WHEN c_nationkey > 12 THEN 'seg:' || c_mktsegment ELSE '' END FROM customer WHERE c_acctbal <> floor(c_acctbal)""")
def compact_map(t):
    balance = F.when(F.col("c_acctbal") == F.floor("c_acctbal"), F.col("c_acctbal").cast("int").cast("string"))
    segment = F.when(F.col("c_nationkey") > 12, F.col("c_mktsegment"))
    kept = F.map_filter(F.create_map(F.lit("bal"), balance, F.lit("seg"), segment), lambda k, v: v.isNotNull() & (v != ""))
    pairs = F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit(":"), e["value"])))
    return t.customer.select("c_custkey", F.array_join(pairs, ";").alias("compact"))
