"""Firsts, latest rows, streaks, windows over time, budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalume.operators import pick, state
from catalume.queries.registry import query

LOG = ["ts", "event_id"]
DAY = 86_400_000_000


def micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def distinct_on_latest(t):
    return pick.latest(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("""SELECT user_id, event_id, event_type FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
WHERE event_type = 'error'""")
def latest_struct(t):
    last = pick.latest(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])
    return last.where("event_type = 'error'").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def keep_newest(t):
    return pick.keep_first(t.events.select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id")


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW), 3) AS used
FROM events""")
def token_window(t):
    out = state.sliding_sum(t.events.withColumn("us", micros()), ["user_id"], "us", "value", 3_600_000_000, "used")
    return out.select("event_id", F.round("used", 3).alias("used"))


@query("""SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap, lag(epoch_us(ts)) OVER w + 60250000 AS next_allowed FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def spacing(t):
    before = F.lag(micros()).over(Window.partitionBy("user_id").orderBy(*LOG))
    return t.events.select("event_id", (micros() - before).alias("gap"), (before + 60_250_000).alias("next_allowed"))


@query("""WITH m AS (SELECT *, (event_type = 'error')::INT AS f FROM events),
i AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM m)
SELECT event_id, (sum(f) OVER (PARTITION BY user_id, island ORDER BY ts, event_id))::BIGINT AS streak FROM i""")
def failure_streak(t):
    return state.streaks(t.events, ["user_id"], LOG, F.col("event_type") == "error").select("event_id", "streak")


@query(f"""WITH m AS (SELECT *, (event_type != 'purchase')::INT AS f, epoch_us(ts) AS us FROM events),
i AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM m),
s AS (SELECT *, min(CASE WHEN f = 1 THEN us END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS first_strike FROM i)
SELECT event_id, first_strike FROM s WHERE f = 1 AND us - first_strike >= {7 * DAY}""")
def two_strikes(t):
    out = state.two_strikes(t.events.withColumn("us", micros()), ["user_id"], "us", LOG, F.col("event_type") != "purchase", 7 * DAY)
    return out.select("event_id", "first_strike")


@query("""SELECT doc_id, source FROM (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
sum(n_chars) OVER (PARTITION BY source) AS a FROM documents) WHERE a - b > a * 0.9""")
def evict_until(t):
    return state.evict(t.documents.select("doc_id", "source", "n_chars"), ["source"], F.floor(F.col("doc_id") / 4096), ["doc_id"], "n_chars", 0.9).select("doc_id", "source")


@query("""SELECT event_id, least(want, greatest(0, 40 - prior))::BIGINT AS granted FROM (SELECT *, coalesce(sum(want) OVER (PARTITION BY day, event_type ORDER BY ts, event_id
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM (SELECT *, ts::DATE AS day, (event_id % 5 + 1) AS want FROM events))""")
def budget_grant(t):
    asked = t.events.withColumn("day", F.to_date("ts")).withColumn("want", F.col("event_id") % 5 + 1)
    return state.grant(asked, ["day", "event_type"], F.hour("ts"), LOG, "want", 40).select("event_id", "granted")


@query("""SELECT o_custkey, max(o_orderkey) FILTER (o_orderkey < stop) AS cursor FROM orders JOIN (SELECT o_custkey, coalesce(min(o_orderkey) FILTER (o_orderstatus = 'P'),
9223372036854775807) AS stop FROM orders GROUP BY 1) USING (o_custkey) GROUP BY 1""")
def cursor_advance(t):
    return state.cursor(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey", F.col("o_orderstatus") != "P")


@query("""SELECT l_returnflag, min(CASE WHEN rn >= greatest(1, floor(n * 0.5)) THEN v END) AS p50, min(CASE WHEN rn >= greatest(1, floor(n * 0.95)) THEN v END) AS p95,
min(CASE WHEN rn >= greatest(1, floor(n * 0.99)) THEN v END) AS p99 FROM (SELECT l_returnflag, l_extendedprice AS v,
row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) GROUP BY 1""")
def nearest_rank_pct(t):
    return pick.nearest_rank(t.lineitem, ["l_returnflag"], "l_extendedprice", F.floor(F.col("l_extendedprice") / 1000), {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("""WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT o_custkey, max(n) AS best FROM c GROUP BY 1)
SELECT o_custkey, best, min(o_orderstatus) AS o_orderstatus, count(*) = 1 AS is_unique FROM c JOIN m USING (o_custkey) WHERE n = best GROUP BY ALL""")
def unique_maximum(t):
    counts = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return pick.unique_maximum(counts, ["o_custkey"], "n", "o_orderstatus")


@query("""SELECT c_nationkey, c_custkey, CASE WHEN n2 IS NULL THEN 'only' WHEN n > n2 THEN 'orders' WHEN c_acctbal > b2 THEN 'balance' ELSE 'id' END AS reason FROM (
SELECT *, row_number() OVER w AS rn, lead(n) OVER w AS n2, lead(c_acctbal) OVER w AS b2 FROM customer LEFT JOIN
(SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey, LATERAL (SELECT coalesce(k, 0) AS n)
WINDOW w AS (PARTITION BY c_nationkey ORDER BY n DESC, c_acctbal DESC, c_custkey)) WHERE rn = 1""")
def survivor_choice(t):
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("k"))
    rows = t.customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("n", F.coalesce("k", F.lit(0)))
    top = pick.keep_first(rows, ["c_nationkey"], [F.desc("n"), F.desc("c_acctbal"), F.asc("c_custkey")], 2)
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("n"), F.desc("c_acctbal"), F.asc("c_custkey"))
    out = top.withColumn("rn", F.row_number().over(w)).withColumn("n2", F.lead("n").over(w)).withColumn("b2", F.lead("c_acctbal").over(w))
    reason = F.when(F.col("n2").isNull(), "only").when(F.col("n") > F.col("n2"), "orders").when(F.col("c_acctbal") > F.col("b2"), "balance").otherwise("id")
    return out.where("rn = 1").select("c_nationkey", "c_custkey", reason.alias("reason"))


@query("""SELECT o_orderpriority, o_orderkey, chunk, source FROM (SELECT *, floor((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) / 10)::BIGINT AS chunk
FROM orders), (SELECT unnest(['a', 'b']) AS source)""")
def chunk_work(t):
    numbered = pick.chunks(t.orders.select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], F.floor(F.col("o_orderkey") / 4096), [F.asc("o_orderkey")], 10)
    return numbered.withColumn("source", F.explode(F.lit(["a", "b"])))


@query("""SELECT conv_id, turn, ceil(count(*) OVER (PARTITION BY conv_id) / 3.0)::BIGINT AS pages FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) BETWEEN 4 AND 6""")
def page_slice(t):
    w = Window.partitionBy("conv_id")
    numbered = t.conversations.select("conv_id", "turn", F.row_number().over(w.orderBy("turn")).alias("rn"), F.ceil(F.count("*").over(w) / 3).alias("pages"))
    return numbered.where("rn between 4 and 6").drop("rn")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events),
a AS (SELECT user_id, event_type, min(ms) AS ms FROM e GROUP BY ALL UNION ALL
SELECT a.user_id, a.event_type, min(e.ms) FROM a JOIN e ON e.user_id = a.user_id AND e.event_type = a.event_type AND e.ms >= a.ms + 86400000 GROUP BY ALL)
SELECT user_id, event_type, ms FROM a""")
def insert_once(t):
    rows = t.events.select("user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return state.fixed_windows(rows, ["user_id", "event_type"], "ms", 86_400_000).where("hits = 1").select("user_id", "event_type", "ms")


@query("""WITH r AS (SELECT p_size, p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn, p_size > 40 AS hit FROM part)
SELECT ceil(rn / 24.0)::BIGINT AS depth FROM (SELECT rn, sum(hit::INT) OVER (ORDER BY rn) AS c FROM r) WHERE c >= 12 ORDER BY rn LIMIT 1""")
def depth_needed(t):
    hits = t.part.where("p_size > 40").orderBy("p_partkey").limit(12).agg(F.max("p_partkey").alias("last"), F.count("*").alias("n")).where("n = 12")
    before = t.part.join(F.broadcast(hits), F.col("p_partkey") <= F.col("last"))
    return before.agg(F.ceil(F.count("*") / 24).alias("depth")).where("depth > 0")


@query("""SELECT user_id, max(ts) AS last_seen, CASE WHEN max(ts) >= TIMESTAMP '2024-01-30' THEN 'ok' WHEN max(ts) >= TIMESTAMP '2024-01-24' THEN 'stale' ELSE 'gone' END AS state
FROM events GROUP BY 1""")
def last_seen(t):
    out = t.events.groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    state_ = F.expr("case when last_seen >= timestamp_ntz'2024-01-30' then 'ok' when last_seen >= timestamp_ntz'2024-01-24' then 'stale' else 'gone' end")
    return out.withColumn("state", state_)


@query("""WITH m AS (SELECT *, (event_type = 'error')::INT AS f FROM events), i AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM m)
SELECT event_id, least(5000, 250 * pow(2, s - 1))::DOUBLE AS delay FROM (SELECT event_id, sum(f) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS s FROM i) WHERE s > 0""")
def backoff(t):
    from catalume.functions.scalars import retry_delay

    out = state.streaks(t.events, ["user_id"], LOG, F.col("event_type") == "error").where("streak > 0")
    return out.select("event_id", retry_delay(F.lit(250.0), F.col("streak") - 1, F.lit(5000.0)).alias("delay"))


@query("""SELECT d.doc_id, toxic, floor(n_chars / 1000)::BIGINT AS band, sha1('2024-01-31|' || lang || '|' || d.doc_id) AS rank FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def daily_shuffle(t):
    joined = t.documents.join(t.labels, "doc_id")
    rank = F.sha1(F.concat_ws("|", F.lit("2024-01-31"), "lang", F.col("doc_id").cast("string")).cast("binary"))
    return joined.select("doc_id", "toxic", F.floor(F.col("n_chars") / 1000).alias("band"), rank.alias("rank"))


@query("""SELECT user_id, round(list_reduce(list_prepend(4.0::DOUBLE, list(value::DOUBLE ORDER BY ts, event_id)), lambda a, x: greatest(1.2, least(8.0, 0.6 * a + 0.4 * x))), 6) AS ratio
FROM (SELECT user_id, ts, event_id, value / 10 AS value FROM events) GROUP BY 1""")
def moving_ratio(t):
    ordered = F.sort_array(F.collect_list(F.struct("ts", "event_id", (F.col("value") / 10).alias("v"))))
    fold = F.aggregate(ordered, F.lit(4.0), lambda a, x: F.greatest(F.lit(1.2), F.least(F.lit(8.0), a * 0.6 + x["v"] * 0.4)))
    return t.events.groupBy("user_id").agg(F.round(fold, 6).alias("ratio"))
