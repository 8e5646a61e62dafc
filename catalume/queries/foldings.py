"""Folds of rows into others over whole tables, and their undo: customers are the rows, their orders the children."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalume.operators import folds
from catalume.queries.registry import query

FIELDS = ["segment", "balance"]

#: Chains in order, chains whose second link comes first, and cycles; ``turn`` is the place of a row in its group.
GROUPS = """
c AS (SELECT c_custkey AS id, 'row-' || c_custkey AS slug, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 5 > 1 THEN c_acctbal END AS balance, c_custkey // 3 AS g, c_custkey % 3 AS n FROM customer),
size AS (SELECT g, count(*) AS members FROM c GROUP BY g),
m AS (SELECT c.*, CASE WHEN g % 4 = 3 OR members < 3 THEN id WHEN g % 4 = 2 THEN CASE WHEN n = 2 THEN id ELSE 3 * g + 1 END ELSE 3 * g + 2 END AS root FROM c JOIN size USING (g)),
p AS (SELECT *, CASE WHEN id = root THEN 0 WHEN g % 4 = 2 THEN 1 ELSE 2 - n END AS turn FROM m)"""
MERGED = """
x AS (SELECT root AS id, arg_min(segment, turn) FILTER (segment IS NOT NULL) AS segment, arg_min(balance, turn) FILTER (balance IS NOT NULL) AS balance FROM p GROUP BY root)"""
HISTORY = """
h AS (SELECT o_custkey AS row_id, o_orderpriority AS item, o_orderdate AS at, o_totalprice AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""


def _tables(t):
    k = F.col("c_custkey")
    rows = t.customer.select(k.alias("id"), F.concat(F.lit("row-"), k.cast("string")).alias("slug"), F.when(k % 2 == 1, F.col("c_mktsegment")).alias("segment"), F.when(k % 5 > 1, F.col("c_acctbal")).alias("balance"))
    orders = t.orders.select(F.col("o_custkey").alias("row_id"), F.col("o_orderpriority").alias("item"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("price"), "o_orderkey")
    history = orders.groupBy("row_id", "item").agg(F.max_by(F.struct("at", "price"), F.struct("at", "o_orderkey")).alias("h")).select("row_id", "item", "h.*")
    favorites = orders.groupBy("row_id", "item").agg(F.min("at").alias("at"))
    sources = orders.select("row_id", F.col("o_orderkey").alias("source_id"))
    aliases = rows.where("id % 7 = 0").select(F.concat(F.lit("old-"), "slug").alias("slug"), F.col("id").alias("row_id"))
    return {"rows": rows, "history": history, "favorites": favorites, "sources": sources, "aliases": aliases}


def _folds(t):
    """Fold numbers 2g + 1 and 2g + 2 of each whole group of three: a-b b-c, b-c a-b, a-b b-a, none."""
    g = F.floor(F.col("c_custkey") / 3).cast("long")
    whole = t.customer.groupBy(g.alias("g")).count().where("count = 3").select("g")
    kind, a, g = F.col("g") % 4, F.col("g") * 3, F.col("g")
    fold = lambda n, dropped, kept: F.struct((2 * g + n).alias("fold"), dropped.alias("dropped"), kept.alias("kept"))
    pairs = F.when(kind == 0, F.array(fold(1, a, a + 1), fold(2, a + 1, a + 2))).when(kind == 1, F.array(fold(1, a + 1, a + 2), fold(2, a, a + 1))).when(kind == 2, F.array(fold(1, a, a + 1), fold(2, a + 1, a)))
    return whole.select(F.explode(pairs).alias("f")).select("f.*")


def _children():
    return {"sources": folds.Child(), "favorites": folds.Child(("item",)), "history": folds.Child(("item",), F.col("at"))}


@query(f"""WITH {GROUPS},{MERGED}, s AS (SELECT root, count(*) AS sources FROM orders JOIN p ON id = o_custkey GROUP BY root),
a AS (SELECT root, string_agg(alias, ',' ORDER BY alias) AS aliases FROM (SELECT root, 'old-' || slug AS alias FROM p WHERE id % 7 = 0 UNION ALL SELECT root, slug FROM p WHERE id <> root) GROUP BY root)
SELECT x.id, 'row-' || x.id AS slug, x.segment, x.balance, coalesce(s.sources, 0) AS sources, a.aliases FROM x LEFT JOIN s ON s.root = x.id LEFT JOIN a ON a.root = x.id""")
def fold_rows(t):
    after, _, _ = folds.fold_rows(_tables(t), _folds(t), FIELDS, _children())
    sources = after["sources"].groupBy(F.col("row_id").alias("id")).agg(F.count("*").alias("sources"))
    aliases = after["aliases"].groupBy(F.col("row_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("slug")), ",").alias("aliases"))
    return after["rows"].join(sources, "id", "left").join(aliases, "id", "left").na.fill(0, ["sources"])


@query(f"""WITH {GROUPS},{HISTORY}, f AS (SELECT o_custkey AS row_id, o_orderpriority AS item, min(o_orderdate) AS at FROM orders GROUP BY ALL),
b AS (SELECT root, item, h.at, price FROM h JOIN p ON id = row_id QUALIFY row_number() OVER (PARTITION BY root, item ORDER BY h.at DESC, turn) = 1),
g AS (SELECT root, item, f.at FROM f JOIN p ON id = row_id QUALIFY row_number() OVER (PARTITION BY root, item ORDER BY turn) = 1)
SELECT b.root AS row_id, item, b.at AS seen, price, g.at AS added FROM b JOIN g USING (root, item)""")
def fold_children(t):
    after, _, _ = folds.fold_rows(_tables(t), _folds(t), FIELDS, _children())
    return after["history"].withColumnRenamed("at", "seen").join(after["favorites"].withColumnRenamed("at", "added"), ["row_id", "item"])


@query(f"""WITH {GROUPS},{HISTORY},
w AS (SELECT *, CASE WHEN id % 24 IN (2, 5) THEN 'changed' END AS edited FROM p),
e AS (SELECT g, max(edited) FILTER (root = id) AS edited FROM w GROUP BY g),
q AS (SELECT w.*, e.edited IS NOT NULL AND g % 4 <> 3 OR 2 * g + 2 < 301 AS stays FROM w JOIN e USING (g)),
r AS (SELECT *, CASE WHEN stays THEN root WHEN 2 * g + 1 < 301 AND root <> id THEN CASE WHEN g % 4 = 0 AND n = 0 THEN 3 * g + 1 WHEN g % 4 = 0 THEN id WHEN g % 4 = 1 AND n = 1 THEN root WHEN g % 4 = 1 THEN id ELSE root END ELSE id END AS back FROM q),
x AS (SELECT back AS id, arg_min(segment, turn) FILTER (segment IS NOT NULL) AS segment, arg_min(balance, turn) FILTER (balance IS NOT NULL) AS balance FROM (
 SELECT * REPLACE (CASE WHEN back = id THEN 0 ELSE turn END AS turn) FROM r) GROUP BY back),
s AS (SELECT back, count(*) AS items FROM (SELECT back, item FROM h JOIN r ON r.id = row_id GROUP BY ALL) GROUP BY back)
SELECT x.id, 'row-' || x.id AS slug, CASE WHEN q.edited IS NOT NULL THEN 'changed' ELSE x.segment END AS segment, x.balance, coalesce(items, 0) AS items FROM x LEFT JOIN q ON q.id = x.id LEFT JOIN s ON s.back = x.id""")
def undo_folds(t):
    """All folds from number 301 on are taken back, but where the kept row has been edited since."""
    after, log, before = folds.fold_rows(_tables(t), _folds(t), FIELDS, _children())
    after["rows"] = after["rows"].withColumn("segment", F.when((F.col("id") % 24).isin(2, 5), "changed").otherwise(F.col("segment")))
    tables, _ = folds.undo_folds(after, log, before, 301, FIELDS, _children())
    items = tables["history"].groupBy(F.col("row_id").alias("id")).agg(F.count("*").alias("items"))
    return tables["rows"].join(items, "id", "left").na.fill(0, ["items"])
