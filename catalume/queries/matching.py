"""Entity resolution: similarity, pairing, waterfalls, consensus, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalume.operators import match
from catalume.queries.registry import query

PART = "(SELECT p_partkey, p_name, p_brand, p_size, list_distinct(string_split(p_name, ' ')) AS w FROM part)"
DICE = "2.0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w))"


def _halves(t):
    rows = t.part.select("p_partkey", "p_size", "p_brand", F.split("p_name", " ").alias("words"))
    return rows.where("p_partkey % 2 = 0"), rows.where("p_partkey % 2 = 1")


@query(f"""SELECT a.p_partkey, b.p_partkey AS r_p_partkey, round({DICE}, 6) AS score FROM {PART} a JOIN (
SELECT * FROM {PART} WHERE p_partkey % 2 = 1 QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) <= 100) b ON a.p_size = b.p_size
WHERE a.p_partkey % 2 = 0 AND {DICE} >= 0.96
QUALIFY row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey) = 1""")
def fuzzy_match(t):
    left, right = _halves(t)
    out = match.fuzzy_match(left, right, ["p_size"], ["words"], 0.96, ["p_partkey"])
    return out.select("p_partkey", "r_p_partkey", F.round("score", 6).alias("score"))


@query(f"""SELECT a.p_partkey AS a, b.p_partkey AS b, round({DICE}, 6) AS score FROM {PART} a JOIN {PART} b
ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE {DICE} >= 0.5""")
def dice_pairs(t):
    rows = t.part.select("p_brand", "p_size", "p_partkey", F.array_sort(F.array_distinct(F.split("p_name", " "))).alias("w"))
    near = match.similar_sets(rows, rows, ["p_brand", "p_size"], "w", 0.5)
    a, b = (rows.select("p_brand", "p_size", F.col("p_partkey").alias(n), F.col("w").alias(s)) for n, s in (("a", "l"), ("b", "r")))
    met = near.join(a, ["p_brand", "p_size", "l"]).join(b, ["p_brand", "p_size", "r"]).where("a < b")
    return met.select("a", "b", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT *, count(*) OVER (PARTITION BY p_name, p_size, p_brand < 'Brand#3') AS n FROM part),
m AS (SELECT a.p_partkey AS l, b.p_partkey AS r, CASE WHEN a.p_type = b.p_type THEN 'type' WHEN abs(a.p_retailprice - b.p_retailprice) < 40 THEN 'price' END AS evidence
FROM s a JOIN s b USING (p_name, p_size) WHERE a.p_brand < 'Brand#3' AND b.p_brand >= 'Brand#3' AND a.n <= 6 AND b.n <= 6),
c AS (SELECT *, count(*) OVER (PARTITION BY l) AS k, count(*) OVER (PARTITION BY r) AS c FROM m WHERE evidence IS NOT NULL)
SELECT DISTINCT l, CASE WHEN k = 1 AND c = 1 THEN r END AS r, CASE WHEN k = 1 AND c = 1 THEN evidence END AS evidence,
CASE WHEN k = 1 AND c = 1 THEN 'paired' ELSE 'ambiguous' END AS status FROM c""")
def one_to_one(t):
    cut = lambda test, n: t.part.where(test).select("p_name", "p_size", F.col("p_partkey").alias(n), F.col("p_type").alias(f"t{n}"), F.col("p_retailprice").alias(f"p{n}"))
    evidence = F.when(F.col("tl") == F.col("tr"), "type").when(F.abs(F.col("pl") - F.col("pr")) < 40, "price")
    return match.one_to_one(cut("p_brand < 'Brand#3'", "l"), cut("p_brand >= 'Brand#3'", "r"), ["p_name", "p_size"], "l", "r", evidence)


@query("""WITH s AS (SELECT *, o_orderdate::DATE AS d, o_orderstatus = 'F' AS m, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM orders),
p AS (SELECT a.o_orderkey AS without_id, b.o_orderkey AS with_id, count(*) OVER (PARTITION BY a.o_orderkey) AS k FROM s a JOIN s b ON a.o_custkey = b.o_custkey
AND a.o_orderpriority = b.o_orderpriority AND NOT a.m AND b.m AND abs(date_diff('day', a.d, b.d)) <= 300 WHERE a.n BETWEEN 2 AND 6)
SELECT with_id, without_id FROM p WHERE k = 1""")
def duplicate_pairs(t):
    rows = t.orders.select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("d"))
    near = F.abs(F.datediff("a.d", "b.d")) <= 300
    return match.duplicates(rows, ["o_custkey", "o_orderpriority"], "o_orderkey", F.col("o_orderstatus") == "F", near)


@query("""WITH c AS (SELECT s_suppkey, p_partkey, 1 AS rule FROM supplier JOIN part ON p_partkey = s_suppkey * 7 AND p_size > 10
UNION ALL SELECT s_suppkey, p_partkey, 2 FROM supplier JOIN part ON p_size = s_nationkey AND p_brand = 'Brand#11'
UNION ALL SELECT s_suppkey, p_partkey, 3 FROM supplier JOIN part ON p_partkey = s_suppkey)
SELECT s_suppkey, p_partkey, rule::INT AS rule FROM c WHERE p_partkey % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY rule, p_partkey) = 1""")
def waterfall(t):
    s, p = t.supplier.select("s_suppkey", "s_nationkey"), t.part.select("p_partkey", "p_size", "p_brand")
    rules = [
        (p.where("p_size > 10"), {"p_partkey": F.col("s_suppkey") * 7}),
        (p.where("p_brand = 'Brand#11'"), {"p_size": F.col("s_nationkey")}),
        (p, {"p_partkey": F.col("s_suppkey")}),
    ]
    out = match.waterfall(s, "s_suppkey", rules, ["p_partkey"], F.col("p_partkey") % 10 == 0)
    return out.select("s_suppkey", "p_partkey", "rule")


@query("""WITH h AS (SELECT p_brand, nullif(p_size, 1) AS s, max(p_partkey) AS holder, count(*) AS n FROM part GROUP BY ALL)
SELECT p_partkey, holder, n FROM part JOIN h ON part.p_brand = h.p_brand AND nullif(p_size, 1) IS NOT DISTINCT FROM s""")
def null_safe_tuple(t):
    rows = t.part.select("p_partkey", "p_brand", F.nullif(F.col("p_size"), F.lit(1)).alias("s"))
    held = rows.groupBy(F.col("p_brand").alias("b"), F.col("s").alias("hs")).agg(F.max("p_partkey").alias("holder"), F.count("*").alias("n"))
    return rows.join(held, (F.col("p_brand") == F.col("b")) & F.col("s").eqNullSafe(F.col("hs"))).select("p_partkey", "holder", "n")


@query("""WITH p AS (SELECT l_orderkey, nullif(l_returnflag, 'N') AS flag, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CASE count(flag) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS status, CASE WHEN count(flag) = 1 THEN min(flag) END AS flag,
CASE WHEN count(flag) = 1 THEN max(CASE WHEN flag IS NOT NULL THEN s END) ELSE 0 END AS support FROM p GROUP BY 1""")
def consensus(t):
    claims = t.lineitem.select("l_orderkey", F.nullif(F.col("l_returnflag"), F.lit("N")).alias("flag"), "l_suppkey")
    return match.consensus(claims, "l_orderkey", "flag", "l_suppkey")


@query("""SELECT name, n, CASE WHEN n = 1 THEN 'matched' WHEN k = 1 THEN 'matched by size' WHEN n = 0 THEN 'unmatched' ELSE 'ambiguous' END AS status FROM (
SELECT name, count(p_partkey) AS n, count(p_partkey) FILTER (p_size = 5) AS k FROM (SELECT DISTINCT p_name AS name FROM part UNION SELECT 'no such name')
LEFT JOIN part ON p_name = name GROUP BY name)""")
def unique_title(t):
    names = t.part.select(F.col("p_name").alias("name")).distinct().union(t.spark.range(1).select(F.lit("no such name")))
    per = names.join(t.part, F.col("p_name") == F.col("name"), "left").groupBy("name").agg(F.count("p_partkey").alias("n"), F.count_if(F.col("p_size") == 5).alias("k"))
    status = F.when(F.col("n") == 1, "matched").when(F.col("k") == 1, "matched by size").when(F.col("n") == 0, "unmatched").otherwise("ambiguous")
    return per.select("name", "n", status.alias("status"))


@query()
def components(t):
    edges = t.orders.select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + 7 * (F.col("o_orderkey") % 3 + 1)).alias("b"))
    return match.components(edges, "a", "b")


@query("SELECT p_brand, p_size, max(p_partkey) AS holder FROM part GROUP BY ALL")
def tuple_holder(t):
    return t.part.groupBy("p_brand", "p_size").agg(F.max("p_partkey").alias("holder"))


@query("""SELECT l_orderkey, string_agg((l_returnflag = 'N')::INT || l_returnflag, ',' ORDER BY (l_returnflag = 'N')::INT, l_returnflag) AS parts FROM (
SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) GROUP BY 1 HAVING bool_or(l_returnflag <> 'N')""")
def split_plan(t):
    own = (F.col("l_returnflag") == "N").cast("int")
    parts = F.sort_array(F.collect_set(F.struct(own.alias("own"), "l_returnflag")))
    per = t.lineitem.groupBy("l_orderkey").agg(parts.alias("p"), F.bool_or(F.col("l_returnflag") != "N").alias("any")).where("any")
    return per.select("l_orderkey", F.array_join(F.transform("p", lambda x: F.concat(x["own"].cast("string"), x["l_returnflag"])), ",").alias("parts"))


@query("""WITH s AS (SELECT p_brand, p_partkey, p_type, round((CASE WHEN p_name LIKE '%ring%' THEN 100 ELSE 0 END) + (CASE WHEN p_size % 7 = 0 THEN 30 ELSE 0 END) + p_size % 3 * 8 - p_size % 10 * 2 + log10(1 + p_partkey), 6) AS score,
p_size % 2 = 1 AS other FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, other ORDER BY score DESC, p_partkey) AS k FROM s)
SELECT p_brand, p_partkey, score FROM r WHERE NOT other OR k <= 2 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) <= 8""")
def hit_rank(t):
    k = F.col("p_size")
    hits = t.part.select(
        "p_brand", F.col("p_partkey").alias("id"), F.col("p_name").contains("ring").alias("exact"), (k % 7 == 0).alias("year_near"), (k % 3).alias("queries"),
        (k % 10).alias("rank"), F.col("p_partkey").alias("votes"), (k % 2 != 1).alias("same_type"),
    )
    return match.rank_hits(hits, "p_brand").select("p_brand", F.col("id").alias("p_partkey"), F.round("score", 6).alias("score"))


@query("""SELECT p_brand, p_size, min(CASE WHEN p_retailprice > 980 AND p_name LIKE '%ring%' THEN p_partkey END) AS p_partkey FROM part GROUP BY ALL
HAVING count(*) FILTER (p_retailprice > 980 AND p_name LIKE '%ring%') = 1""")
def gate_rivals(t):
    passed = (F.col("p_retailprice") > 980) & F.col("p_name").contains("ring")
    per = t.part.groupBy("p_brand", "p_size").agg(F.min(F.when(passed, F.col("p_partkey"))).alias("p_partkey"), F.count_if(passed).alias("n"))
    return per.where("n = 1").drop("n")
