"""Catalogue reads: filters, joins, pages, facets, aggregates, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalume.functions.text import normalize_title
from catalume.operators import pick, search
from catalume.operators.snapshot import orphans
from catalume.operators.tables import shared_folder
from catalume.queries.registry import query


def _page(number: int) -> str:
    return f"""
WITH f AS (SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'F'),
t AS (SELECT count(*) AS total, greatest(1, ceil(count(*) / 24.0))::BIGINT AS pages FROM f),
p AS (SELECT *, greatest(1, least({number}, pages))::BIGINT AS page FROM t)
SELECT o_orderkey, o_orderdate, o_totalprice, total, pages, page FROM (
  SELECT f.*, row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey) AS rn FROM f), p
WHERE rn > (page - 1) * 24 AND rn <= page * 24"""


def _orders_page(t, number):
    done = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate", "o_totalprice")
    order = [F.desc_nulls_last("o_orderdate"), F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")]
    return pick.page(done, order, F.coalesce(-F.unix_date(F.to_date("o_orderdate")), F.lit(1)), number, 24)


@query(_page(3))
def catalog_page(t):
    return _orders_page(t, 3)


@query(_page(1000000))
def catalog_page_clamped(t):
    return _orders_page(t, 1_000_000)


@query("SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')")
def label_containment(t):
    labels = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("slug"), F.upper(w).alias("name")))
    return t.part.withColumn("labels", labels).where(F.exists("labels", lambda x: x["slug"] == "ring")).select("p_partkey", "p_name")


@query(
    """SELECT doc_id FROM documents WHERE contains(trim(regexp_replace(lower(replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'd')),
    '[^\\p{L}\\p{N}]+', ' ', 'g')), 'the than')"""
)
def keyword_search(t):
    return t.documents.where(normalize_title(F.col("text")).contains("the than")).select("doc_id")


SOUGHT = ("the than", "Ing  the", "ther than th", "e a", "x", "zq", "qqqzzz")


@query(
    f"""WITH n AS (SELECT doc_id, trim(regexp_replace(lower(replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'd')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS t FROM documents)
    SELECT s.words, n.doc_id FROM n JOIN (VALUES {", ".join(f"('{w}', '{' '.join(w.lower().split())}')" for w in SOUGHT)}) s(words, w) ON contains(n.t, s.w)"""
)
def trigram_search(t):
    """All searches read one index of all texts."""
    path = shared_folder(t.spark, "trigrams")
    search.build_index(t.documents, "doc_id", "text", path)
    found = [search.search(t.spark, path, w).select(F.lit(w).alias("words"), F.col("key").alias("doc_id")) for w in SOUGHT]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query("SELECT w AS slug, max(upper(w)) AS name, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w")
def facet_counts(t):
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("slug"))
    return words.groupBy("slug").agg(F.max(F.upper("slug")).alias("name"), F.count("*").alias("n"))


@query("""SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey
WHERE last IS NULL OR last < TIMESTAMP '2001-12-31' - INTERVAL 400 DAY""")
def due_simple(t):
    last = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    joined = t.customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.where("last is null or last < timestamp_ntz'2001-12-31' - interval 400 days").select("c_custkey")


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '2001-12-31' - CASE o_orderstatus WHEN 'F' THEN INTERVAL 900 DAY
WHEN 'O' THEN INTERVAL 300 DAY ELSE INTERVAL 30 DAY END""")
def due_status_ttl(t):
    ttl = "case o_orderstatus when 'F' then interval 900 days when 'O' then interval 300 days else interval 30 days end"
    return t.orders.where(f"o_orderdate < timestamp_ntz'2001-12-31' - {ttl}").select("o_orderkey")


@query("""SELECT o_orderkey, band FROM (SELECT *, date_diff('day', o_orderdate::DATE, DATE '2001-12-31') AS age FROM orders) , LATERAL (
SELECT CASE WHEN age < 90 THEN 1 WHEN age < 730 THEN 7 ELSE least(30, CASE WHEN o_orderpriority LIKE '1%' THEN 14 ELSE 60 END) END AS band)
WHERE coalesce(age % 97 >= band AND nullif(o_orderstatus, 'P') IS NOT NULL, false)""")
def due_age_banded(t):
    age = F.datediff(F.lit("2001-12-31").cast("date"), F.to_date("o_orderdate"))
    cadence = F.when(F.col("o_orderpriority").startswith("1"), 14).otherwise(60)
    band = F.when(age < 90, 1).when(age < 730, 7).otherwise(F.least(F.lit(30), cadence))
    due = F.coalesce((age % 97 >= F.col("band")) & F.nullif(F.col("o_orderstatus"), F.lit("P")).isNotNull(), F.lit(False))
    return t.orders.withColumn("band", band).where(due).select("o_orderkey", "band")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def playable_semi(t):
    good = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey")
    return t.orders.join(good, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("""SELECT n_nationkey, n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey + 5 = n_nationkey)
AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey + 5 = n_nationkey)""")
def orphan_anti(t):
    children = [(t.customer.withColumn("k", F.col("c_nationkey") + 5), "k"), (t.supplier.withColumn("k", F.col("s_nationkey") + 5), "k")]
    return orphans(t.nation.select("n_nationkey", "n_name"), "n_nationkey", children)


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'F') AND NOT bool_or(o_orderstatus = 'P')")
def a_not_b(t):
    status = F.col("o_orderstatus")
    return pick.having(t.orders, ["o_custkey"], a=F.bool_or(status == "F"), b=~F.bool_or(status == "P"))


@query("""SELECT o_orderkey, c_custkey, n_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus = 'O'""")
def inner_equi(t):
    orders = t.orders.where("o_orderstatus = 'O'")
    joined = orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("o_orderkey", "c_custkey", "n_name", "o_totalprice")


IDS = [7, 3, 3, 999_999_999, 12, 5, 7, 1]


@query(f"""WITH ids AS (SELECT id, min(pos) AS pos FROM (SELECT unnest({IDS}) AS id, generate_subscripts({IDS}, 1) - 1 AS pos) GROUP BY id)
SELECT p_partkey, p_name, pos::INT AS pos FROM ids JOIN part ON p_partkey = id""")
def ranked_join(t):
    listed = t.spark.range(1).select(F.posexplode(F.lit(IDS)).alias("pos", "id"))
    ids = pick.first_seen(listed, ["id"], "pos")
    return ids.join(t.part, F.col("id") == F.col("p_partkey")).select("p_partkey", "p_name", "pos")


@query("""SELECT o_orderkey, 'verified' AS route FROM orders WHERE o_orderpriority LIKE '1%'
UNION ALL SELECT o_orderkey, 'guessed' FROM orders WHERE NOT o_orderpriority LIKE '1%' AND o_totalprice > 400000""")
def or_as_union(t):
    first = F.col("o_orderpriority").startswith("1")
    a = t.orders.where(first).select("o_orderkey", F.lit("verified").alias("route"))
    return a.unionByName(t.orders.where(~first & (F.col("o_totalprice") > 400_000)).select("o_orderkey", F.lit("guessed").alias("route")))


@query("""WITH r AS (SELECT p_partkey, p_retailprice AS v FROM part WHERE p_size = 7 ORDER BY v DESC, p_partkey LIMIT 9),
f AS (SELECT p_partkey, p_retailprice AS v FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) ORDER BY v DESC, p_partkey LIMIT 40),
u AS (SELECT p_partkey, 0 AS s, row_number() OVER (ORDER BY v DESC, p_partkey) AS p FROM r
  UNION ALL SELECT p_partkey, 1, row_number() OVER (ORDER BY v DESC, p_partkey) FROM f),
d AS (SELECT p_partkey, min((s, p)) AS spot FROM u GROUP BY 1 ORDER BY spot, p_partkey LIMIT 16)
SELECT p_partkey, row_number() OVER (ORDER BY spot, p_partkey)::INT AS place FROM d WHERE (SELECT count(*) FROM d) >= 4""")
def ranked_then_fill(t):
    from pyspark.sql import Window

    order = [F.desc("p_retailprice"), F.asc("p_partkey")]
    number = F.row_number().over(Window.orderBy(*order)).alias("pos")
    ranked = t.part.where("p_size = 7").orderBy(*order).limit(9).select("p_partkey", number)
    brand = t.part.agg(F.min("p_brand").alias("b"))
    fill = t.part.join(F.broadcast(brand), F.col("p_brand") == F.col("b")).orderBy(*order).limit(40).select("p_partkey", number)
    return pick.ranked_then_fill(ranked, fill, "p_partkey", 16, 4)


@query("""SELECT c_custkey, coalesce(n, 0) AS orders, last, coalesce(s, 0) AS statuses FROM customer LEFT JOIN (
SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last, count(DISTINCT o_orderstatus) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def scalar_subqueries(t):
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"), F.count_distinct("o_orderstatus").alias("s"))
    joined = t.customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), "last", F.coalesce("s", F.lit(0)).alias("statuses"))


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases FROM events
WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1""")
def filtered_counts(t):
    near = t.events.where("ts >= timestamp_ntz'2024-01-10' and ts < timestamp_ntz'2024-01-20'")
    kind = F.col("event_type")
    return near.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(kind == "error").alias("errors"), F.count_if(kind == "purchase").alias("purchases"))


@query("""SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS recent,
(SELECT count(DISTINCT user_id) FROM events WHERE ts >= TIMESTAMP '2024-01-24') AS active""")
def kpi_row(t):
    a = t.customer.agg(F.count("*").alias("customers"))
    b = t.orders.where("o_orderdate >= timestamp_ntz'1998-01-01'").agg(F.count("*").alias("recent"))
    c = t.events.where("ts >= timestamp_ntz'2024-01-24'").agg(F.count_distinct("user_id").alias("active"))
    return a.crossJoin(b).crossJoin(c)  # one row each


@query("""SELECT l_returnflag, l_linestatus, o_orderstatus, o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY ALL""")
def report_four_keys(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 2")
def having_distinct(t):
    return pick.having(t.orders, ["o_custkey"], many=F.count_distinct("o_orderstatus") > 2)


@query("""SELECT conv_id, md5(string_agg(role || ':' || text, '|' ORDER BY turn, role, text)) AS digest, count(*) AS turns FROM conversations GROUP BY 1""")
def ordered_nested(t):
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    joined = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "|")
    return t.conversations.groupBy("conv_id").agg(F.md5(joined).alias("digest"), F.count("*").alias("turns"))


@query("SELECT doc_id, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS longest FROM documents")
def array_max_len(t):
    return t.documents.select("doc_id", F.array_max(F.transform(F.split("text", "\n"), F.length)).cast("long").alias("longest"))


@query("""SELECT o_custkey, max(o_totalprice) AS hi, min(o_totalprice) AS lo FROM orders WHERE o_totalprice > 0 GROUP BY 1
HAVING max(o_totalprice) >= 2 * min(o_totalprice) AND max(o_totalprice) - min(o_totalprice) >= 300000""")
def group_spread(t):
    spread = t.orders.where("o_totalprice > 0").groupBy("o_custkey").agg(F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"))
    return spread.where("hi >= 2 * lo and hi - lo >= 300000")


@query("""SELECT event_type AS route, count(*) AS n, count(*) FILTER (value > 90) AS errors, round(sum(value), 2) AS total, max(value) AS worst,
round(avg(value)) AS mean FROM events GROUP BY 1""")
def request_metrics(t):
    v = F.col("value")
    return t.events.groupBy(F.col("event_type").alias("route")).agg(
        F.count("*").alias("n"), F.count_if(v > 90).alias("errors"), F.round(F.sum(v), 2).alias("total"), F.max(v).alias("worst"), F.round(F.avg(v)).alias("mean")
    )


@query("SELECT l_returnflag, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS statuses FROM lineitem GROUP BY 1")
def distinct_agg(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.array_join(F.sort_array(F.collect_set("l_linestatus")), ",").alias("statuses"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def missing_keys(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey > 100 ORDER BY p_partkey LIMIT 50")
def keyset_page(t):
    return t.part.where("p_partkey > 100").orderBy("p_partkey").limit(50).select("p_partkey", "p_name")


@query("""SELECT x.id, x.name, c_name FROM (SELECT unnest([{'id': 3, 'name': 'a'}, {'id': 9, 'name': 'b'}, {'id': 3000000, 'name': 'c'}], recursive := true)) x
LEFT JOIN customer ON c_custkey = x.id""")
def array_param(t):
    text = '[{"id": 3, "name": "a"}, {"id": 9, "name": "b"}, {"id": 3000000, "name": "c"}]'
    rows = t.spark.range(1).select(F.inline(F.from_json(F.lit(text), "array<struct<id: int, name: string>>")))
    return rows.join(t.customer, F.col("id") == F.col("c_custkey"), "left").select("id", "name", "c_name")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)
AND contains(lower(c_name), '1') AND c_custkey > 10""")
def member_lists(t):
    c = t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(1, 2, 3))
    return c.where(F.contains(F.lower("c_name"), F.lit("1")) & (F.col("c_custkey") > 10)).select("c_custkey", "c_name")


@query("""SELECT c_custkey, CASE WHEN o_custkey IS NULL THEN 'unavailable' ELSE 'ready' END AS state FROM customer
LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey""")
def hide_empty_parent(t):
    keys = t.orders.select("o_custkey").distinct()
    state = F.when(F.col("o_custkey").isNull(), "unavailable").otherwise("ready").alias("state")
    return t.customer.join(keys, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", state)


@query("""SELECT a.l_orderkey FROM (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS s FROM lineitem GROUP BY 1) a
JOIN (SELECT l_orderkey, list_sort(list(DISTINCT CASE WHEN l_quantity > 45 THEN 'N' ELSE l_returnflag END)) AS s FROM lineitem GROUP BY 1) b USING (l_orderkey)
WHERE a.s <> b.s""")
def set_change(t):
    changed = F.when(F.col("l_quantity") > 45, "N").otherwise(F.col("l_returnflag"))
    both = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("a"), F.sort_array(F.collect_set(changed)).alias("b"))
    return both.where("a != b").select("l_orderkey")


@query("""SELECT DISTINCT p_brand, page FROM part, (SELECT unnest([1, 2, 3]) AS page) WHERE p_size <= 5""")
def fan_out(t):
    keys = t.part.where("p_size <= 5").select("p_brand").distinct()
    return keys.select("p_brand", F.explode(F.lit([1, 2, 3])).alias("page"))
