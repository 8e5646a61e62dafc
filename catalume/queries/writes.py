"""The write path and the rules that guard it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalume.functions import predicates as p
from catalume.functions import scalars as s
from catalume.functions import text as x
from catalume.operators import identity, pick, ranking, upsert, writes
from catalume.queries.registry import query

SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"""WITH b AS (SELECT p_partkey AS k, {SLUG.format('p_name')} AS base, (1990 + p_size % 3)::VARCHAR AS y FROM part),
t AS (SELECT {SLUG.format('s_name')} AS slug FROM supplier UNION SELECT {SLUG.format('c_name')} FROM customer UNION SELECT base || '-4' FROM b WHERE k % 5 = 0
UNION SELECT base FROM b WHERE base LIKE '%ring'),
p1 AS (SELECT k, base AS slug FROM b QUALIFY row_number() OVER (PARTITION BY base ORDER BY k) = 1 AND base NOT IN (SELECT slug FROM t)),
t2 AS (SELECT slug FROM t UNION SELECT slug FROM p1), r1 AS (SELECT * FROM b WHERE k NOT IN (SELECT k FROM p1)),
p2 AS (SELECT k, base || '-' || y AS slug FROM r1 QUALIFY row_number() OVER (PARTITION BY base, y ORDER BY k) = 1 AND base || '-' || y NOT IN (SELECT slug FROM t2)),
t3 AS (SELECT slug FROM t2 UNION SELECT slug FROM p2),
r2 AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY k) AS turn FROM r1 WHERE k NOT IN (SELECT k FROM p2)),
m AS (SELECT base, base || '-' || i AS slug, row_number() OVER (PARTITION BY base ORDER BY i) AS turn FROM (SELECT DISTINCT base FROM r2), range(2, 100) AS q(i)
WHERE base || '-' || i NOT IN (SELECT slug FROM t3))
SELECT k AS p_partkey, slug FROM p1 UNION ALL SELECT k, slug FROM p2 UNION ALL SELECT k, coalesce(slug, base || '-' || k) FROM r2 LEFT JOIN m USING (base, turn)""")
def name_taken(t):
    part = t.part.select("p_partkey", "p_name", (1990 + F.col("p_size") % 3).alias("year"))
    own = part.select("p_partkey", x.slugify(F.col("p_name")).alias("base"))
    taken = t.supplier.select(x.slugify(F.col("s_name")).alias("slug")).union(t.customer.select(x.slugify(F.col("c_name"))))
    taken = taken.union(own.where("p_partkey % 5 = 0").select(F.concat("base", F.lit("-4")))).union(own.where("base like '%ring'").select("base"))
    return writes.unique_slugs(part, taken, "p_partkey", "p_name", "year")


@query(r"""SELECT doc_id, regexp_matches(r, '(?i)\bwith\b') AND (regexp_matches(r, '(?i)\bthe\s+with\b') OR regexp_matches(left(r, 150), '(?i)\bwith\b') OR
regexp_matches(right(r, 150), '(?i)\bwith\b')) AS warns FROM (SELECT doc_id, regexp_replace(text, '(?i)\b(?:of\s+with|and[\s-]*with)\b', ' ', 'g') AS r FROM documents)""")
def warning_heuristic(t):
    found = x.warns(F.col("text"), safe=(r"of\s+with", r"and[\s-]*with"), strong=(r"\bthe\s+with\b",), word=r"\bwith\b")
    return t.documents.select("doc_id", found.alias("warns"))


@query("""SELECT doc_id, floor(least(100.0, greatest(0.0, ((CASE WHEN r IS NULL THEN 50.0 ELSE least(100.0, greatest(0.0, r * 10)) END) * 0.6 + least(1.0, length(text) / 1500.0) * 100 * 0.25
+ 100 * pow(0.95, greatest(0.0, (1706659200000 - ms) / 2629800000.0)) * 0.15) / 1.0)) * 100 + 0.5) / 100 AS score FROM (SELECT doc_id, text,
CASE WHEN doc_id % 9 > 0 THEN (quality * 7 + doc_id % 4)::DOUBLE END AS r, 1672531200000 + doc_id * 86400000 AS ms FROM documents JOIN labels USING (doc_id))""")
def review_score(t):
    rows = t.documents.join(t.labels, "doc_id")
    rating = F.when(F.col("doc_id") % 9 > 0, (F.col("quality") * 7 + F.col("doc_id") % 4).cast("double"))
    created, now = F.timestamp_millis(F.lit(1_672_531_200_000) + F.col("doc_id") * 86_400_000), F.timestamp_millis(F.lit(1_706_659_200_000))
    return rows.select("doc_id", s.review_score(rating, F.col("text"), created, now).alias("score"))


@query("""WITH st AS (SELECT user_id, event_id % 50 AS item, min(ts) AS saved_at FROM events WHERE event_id % 3 = 0 GROUP BY ALL),
nw AS (SELECT DISTINCT user_id, event_id % 50 AS item FROM events WHERE event_type = 'click' AND (event_id % 50) % 7 <> 0),
al AS (SELECT * FROM st UNION ALL SELECT user_id, item, TIMESTAMP '2024-01-31' FROM nw ANTI JOIN st USING (user_id, item))
SELECT user_id, item, saved_at, (row_number() OVER (PARTITION BY user_id ORDER BY saved_at DESC, item))::INT AS place FROM al QUALIFY place <= 5""")
def favorites(t):
    rows = t.events.withColumn("item", F.col("event_id") % 50)
    stored = rows.where("event_id % 3 = 0").groupBy("user_id", "item").agg(F.min("ts").alias("at"))
    ready = rows.select("item").distinct().where("item % 7 <> 0")
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    return writes.newest(writes.add_favorites(stored, rows.where("event_type = 'click'"), ready, now), "user_id", "at", 5, "item").withColumnRenamed("at", "saved_at")


HOST = "split_part(split_part({}, '//', 2), '/', 1)"
DEAD = "({0} = 'example.net' OR {0} LIKE '%.example.net')"


@query(f"""WITH q AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '' ELSE url END AS thumb, replace(url, '.com/', '.org/') AS poster,
CASE WHEN page_id % 3 = 0 THEN url ELSE 'https://img.example.org/' || page_id END AS c FROM pages),
h AS (SELECT *, thumb = '' OR {DEAD.format(HOST.format('thumb'))} AS bt, {DEAD.format(HOST.format('poster'))} AS bp, NOT {DEAD.format(HOST.format('c'))} AS ok FROM q)
SELECT page_id, CASE WHEN bt AND ok THEN c END AS thumb, CASE WHEN bp AND ok THEN c END AS poster FROM h WHERE ok AND (bt OR bp)""")
def heal_plan(t):
    dead = ["example.net"]
    thumb = F.when(F.col("page_id") % 4 == 0, "").otherwise(F.col("url"))
    new = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("https://img.example.org/"), F.col("page_id").cast("string")))
    rows = t.pages.select("page_id", thumb.alias("thumb"), F.replace("url", F.lit(".com/"), F.lit(".org/")).alias("poster"), new.alias("c"))
    healed = lambda name: F.when(p.broken_url(F.col(name), dead) & ~p.broken_url(F.col("c"), dead), F.col("c"))
    return rows.select("page_id", healed("thumb").alias("thumb"), healed("poster").alias("poster")).where("thumb is not null or poster is not null")


@query("""WITH c AS (SELECT p_name AS name, replace(p_name, ' ', '-') AS slug, p_partkey AS ord, CASE p_size % 4 WHEN 0 THEN 'tv' WHEN 1 THEN 'single-au-my' WHEN 2 THEN 'cinema' ELSE 'animation' END AS source,
p_retailprice / 120 AS rating, 2016 + p_size % 9 AS year, CASE WHEN p_size % 3 = 0 THEN '4K' ELSE 'HD' END AS quality, p_size % 6 = 0 AS thumb FROM part),
m AS (SELECT slug, arg_max(rating, (rating, -ord)) AS rating, arg_max(year, (rating, -ord)) AS year, arg_max(quality, (rating, -ord)) AS quality, bool_or(thumb) AS thumb,
list_sort(list_distinct(list(source))) AS sources, min(ord) AS ord FROM c GROUP BY slug),
z AS (SELECT *, (CASE WHEN list_contains(sources, 'tv') THEN 7 ELSE 0 END) + (CASE WHEN list_contains(sources, 'single-au-my') THEN 10 ELSE 0 END) + (CASE WHEN list_contains(sources, 'animation') THEN 6 ELSE 0 END)
+ CASE WHEN rating >= 8.5 THEN 34 WHEN rating >= 8 THEN 30 WHEN rating >= 7.5 THEN 25 WHEN rating >= 7 THEN 20 ELSE 14 END
+ CASE WHEN year >= 2024 THEN 18 WHEN year = 2023 THEN 14 WHEN year = 2022 THEN 10 WHEN year >= 2019 THEN 6 ELSE 0 END + CASE WHEN quality = '4K' THEN 10 ELSE 7 END
+ (CASE WHEN list_contains(sources, 'cinema') THEN 26 ELSE 0 END) + (CASE WHEN thumb THEN 4 ELSE -45 END) + greatest(0, 10 - floor(ord / 3))
+ (list_reduce(list_prepend(0::BIGINT, list_transform(string_split(slug, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) % 1000) / 1000.0 * 4 AS score FROM m),
f AS (SELECT slug FROM z WHERE list_contains(sources, 'single-au-my') AND thumb ORDER BY rating DESC, ord, slug LIMIT 1)
SELECT slug, round(score, 6) AS score, row_number() OVER (ORDER BY slug NOT IN (SELECT slug FROM f), score DESC, ord, slug)::INT AS place FROM z QUALIFY place <= 10""")
def spotlight(t):
    k, none = F.col("p_size"), F.lit(None).cast("string")
    source = F.when(k % 4 == 0, "tv").when(k % 4 == 1, "single-au-my").when(k % 4 == 2, "cinema").otherwise("animation")
    cards = t.part.select(
        F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"), F.col("p_partkey").alias("ord"), source.alias("source"), (F.col("p_retailprice") / 120).alias("rating"),
        (2016 + k % 9).alias("year"), F.when(k % 3 == 0, "4K").otherwise("HD").alias("quality"), F.when(k % 6 == 0, "x").alias("thumb"),
        *[none.alias(c) for c in ("episode", "lang", "type", "category", "country", "poster", "tmdb_id")],
    )
    out = ranking.spotlight(cards, cards.select("tmdb_id").where("tmdb_id is not null"), 2024, 10)
    return out.select("slug", F.round("score", 6).alias("score"), "place")


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS number, min(l_quantity)::INT AS episodes, min(year(l_shipdate))::INT AS year FROM lineitem GROUP BY ALL),
o AS (SELECT o_orderkey AS k, year(o_orderdate) AS y, CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 20 + o_orderkey % 30 END AS total, CASE WHEN o_orderkey % 17 = 0 THEN 2 END AS marker FROM orders),
w AS (SELECT *, list(struct_pack(n := number, e := episodes, y := year) ORDER BY number) AS s FROM o JOIN l USING (k) GROUP BY k, y, total, marker, number, episodes, year),
a AS (SELECT k, any_value(o.y) AS y, any_value(total) AS total, any_value(marker) AS marker, list(struct_pack(n := number, e := episodes, yr := l.year) ORDER BY number) AS s FROM o JOIN l USING (k) GROUP BY k),
b AS (SELECT *, list_filter(s, lambda q: abs(q.yr - y) <= 1) AS near FROM a),
c AS (SELECT *, list_filter(near, lambda q: q.e > 0 AND greatest(q.e, total) / least(q.e, total)::DOUBLE <= 1.25) AS fits FROM b),
d AS (SELECT *, list_filter(fits, lambda q: q.yr = y) AS exact FROM c),
e AS (SELECT *, list_filter(CASE WHEN len(exact) > 0 THEN exact ELSE fits END, lambda q: q.e = total) AS counted FROM d),
f AS (SELECT *, CASE WHEN len(s) = 1 THEN s[1] WHEN len(fits) = 1 THEN fits[1] WHEN len(fits) > 1 THEN CASE WHEN len(exact) = 1 THEN exact[1] WHEN len(counted) = 1 THEN counted[1] END END AS pick,
EXISTS (SELECT 1 FROM range(1, len(s) + 1) AS i(i), range(1, len(s) + 1) AS j(j) WHERE j > i AND abs(s[i].yr - y) <= 1 AND list_sum(list_transform(s[i:j], lambda q: q.e)) = total) AS span FROM e),
g AS (SELECT *, CASE WHEN total < 3 THEN 'too-few-episodes' WHEN marker IS NOT NULL THEN 'has-season-marker' WHEN len(s) > 1 AND len(fits) > 1 AND pick IS NULL THEN 'ambiguous'
WHEN len(s) > 1 AND len(near) = 0 THEN 'year-gap' WHEN len(s) > 1 AND len(fits) = 0 THEN CASE WHEN span THEN 'multi-season-span'
WHEN len(list_filter(near, lambda q: NOT (q.e > 0 AND abs(q.e - total) > 5 AND abs(q.e - total) / greatest(1, least(q.e, total))::DOUBLE > 0.25))) = 0 THEN 'episode-gap' ELSE 'no-season-fits' END
WHEN abs(pick.yr - y) > 1 THEN 'year-gap' WHEN pick.e > 0 AND abs(pick.e - total) > 5 AND abs(pick.e - total) / greatest(1, least(pick.e, total))::DOUBLE > 0.25 THEN 'episode-gap' END AS reason FROM f)
SELECT k AS o_orderkey, CASE WHEN reason IS NULL THEN pick.n END::INT AS season, reason FROM g""".replace(
    "w AS (SELECT *, list(struct_pack(n := number, e := episodes, y := year) ORDER BY number) AS s FROM o JOIN l USING (k) GROUP BY k, y, total, marker, number, episodes, year),\n", ""))
def season_infer(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("number")).agg(F.min("l_quantity").cast("int").alias("episodes"), F.min(F.year("l_shipdate")).alias("year"))
    shows = lines.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("number", "episodes", "year"))).alias("shows"))  # a parent's children are few
    k = F.col("o_orderkey")
    rows = t.orders.join(shows, k == F.col("k"))
    total = F.when(k % 11 == 0, 2).otherwise(20 + k % 30).cast("int")
    title = F.when(k % 17 == 0, "Name (Phần 2)").otherwise("Name")
    out = identity.infer_season(F.year("o_orderdate"), total, title, F.lit(None).cast("string"), F.lit("name"), F.col("shows"))
    return rows.select("o_orderkey", out["season"].alias("season"), out["reason"].alias("reason"))


@query(r"""SELECT doc_id, regexp_matches(i, '^tt[0-9]{7,}$') AS imdb, len(string_split(text, chr(10))) >= 2 AS several, string_split(text, ' ')[1] NOT IN ('De', 'The', 'La') AS other_first,
length(trim(lang)) BETWEEN 1 AND 2 AS field FROM (SELECT *, 'tt' || (doc_id * 7919 + 999900) AS i FROM documents)""")
def guards(t):
    imdb = F.concat(F.lit("tt"), (F.col("doc_id") * 7919 + 999_900).cast("string"))
    return t.documents.select(
        "doc_id", p.valid_imdb(imdb).alias("imdb"), p.at_least(F.split("text", "\n"), 2).alias("several"),
        p.first_not_in(F.split("text", " "), ["De", "The", "La"]).alias("other_first"), p.valid_field(F.col("lang"), 1, 2).alias("field"),
    )


@query("""WITH st AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN epoch_ms(o_orderdate) + 1 WHEN o_orderkey % 7 > 0 THEN epoch_ms(o_orderdate) END AS ms, o_orderstatus = 'F' AS good FROM orders WHERE o_orderkey % 13 > 0)
SELECT o_orderkey, NOT coalesce(good, false) AND CASE WHEN o_orderpriority = '1-URGENT' THEN st.k IS NOT NULL AND NOT good ELSE true END AS summary
FROM orders LEFT JOIN st ON st.k = o_orderkey WHERE ms IS NULL OR ms <> epoch_ms(o_orderdate)""")
def unchanged_skip(t):
    millis, k = F.unix_millis(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey")
    ms = F.when(k % 5 == 0, millis + 1).when(k % 7 > 0, millis)
    stored = t.orders.where("o_orderkey % 13 > 0").select(k.alias("k"), ms.alias("ms"), (F.col("o_orderstatus") == "F").alias("good"))
    listed = t.orders.withColumn("ms", millis)
    changed = listed.join(stored.select(F.col("k").alias("o_orderkey"), "ms"), ["o_orderkey", "ms"], "left_anti")
    both = changed.join(stored.drop("ms"), k == F.col("k"), "left")
    good, bare = F.coalesce("good", F.lit(False)), F.col("k").isNotNull() & ~F.coalesce("good", F.lit(False))
    provider = F.when(F.col("o_orderpriority") == "1-URGENT", "nguonc").otherwise("kkphim")
    return both.select("o_orderkey", p.summary_allowed(provider, good, bare).alias("summary"))


@query("""SELECT key, max(o_orderdate) AS newest, bool_or(o_totalprice > 450000) AS dear FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'c' || o_custkey ELSE 'p' || o_orderpriority END AS key FROM orders)
GROUP BY 1""")
def derived_key(t):
    key = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("p"), F.col("o_orderpriority")))
    return t.orders.groupBy(key.alias("key")).agg(F.max("o_orderdate").alias("newest"), F.bool_or(F.col("o_totalprice") > 450_000).alias("dear"))


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderkey % 3 > 0 AS did, CASE WHEN o_orderkey % 6 = 1 THEN NULL ELSE 'new' END AS v FROM orders WHERE o_orderkey % 2 = 1)
SELECT o_orderkey, CASE WHEN did THEN v ELSE o_orderstatus END AS status, CASE WHEN did THEN 'checked;' ELSE '' END || 'p:' || left(o_orderpriority, 1) AS meta, did IS TRUE AND v IS DISTINCT FROM o_orderstatus AS shown
FROM orders LEFT JOIN r ON k = o_orderkey""")
def update_from(t):
    k = F.col("o_orderkey")
    results = t.orders.where(k % 2 == 1).select("o_orderkey", (k % 3 > 0).alias("attempted"), F.when(k % 6 == 1, None).otherwise("new").alias("o_orderstatus"))
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_orderstatus").alias("before"))
    out = writes.update_attempted(rows, results, "o_orderkey", ["o_orderstatus"]).join(results.select("o_orderkey", "attempted"), "o_orderkey", "left")
    did = F.coalesce("attempted", F.lit(False))
    old = F.create_map(F.lit("p"), F.left("o_orderpriority", F.lit(1)))
    meta = writes.merge_map(old, F.map_filter(F.create_map(F.lit("checked"), F.when(did, "")), lambda a, b: b.isNotNull()))
    text = F.array_join(F.array_sort(F.transform(F.map_entries(meta), lambda e: F.concat_ws(":", e["key"], F.nullif(e["value"], F.lit(""))))), ";")
    return out.select("o_orderkey", F.col("o_orderstatus").alias("status"), text.alias("meta"), (did & ~F.col("o_orderstatus").eqNullSafe(F.col("before"))).alias("shown"))


@query("""SELECT c_custkey, row_number() OVER (ORDER BY last IS NOT NULL, last DESC, c_custkey)::INT AS place FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1)
ON o_custkey = c_custkey QUALIFY place <= 40""")
def never_first(t):
    last = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    rows = t.customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "last")
    order = [F.col("last").isNull().desc(), F.desc_nulls_last("last"), F.asc("c_custkey")]
    return rows.orderBy(*order).limit(40).select("c_custkey", F.row_number().over(Window.orderBy(*order)).alias("place"))  # 40 rows


@query(f"""WITH v AS (SELECT page_id, {HOST.format('url')} AS host FROM pages), st AS (SELECT DISTINCT 'h' || host AS id, host FROM v WHERE page_id % 2 = 0)
SELECT page_id, coalesce(st.id, substr(md5(v.host), 1, 16)) AS host_id FROM v LEFT JOIN st ON st.host = v.host""")
def dimension_keys(t):
    values = t.pages.select("page_id", s.host(F.col("url")).alias("host"))
    stored = values.where("page_id % 2 = 0").select(F.concat(F.lit("h"), "host").alias("id"), "host").distinct()
    return values.join(writes.dimension_keys(stored, values, "host"), "host").select("page_id", F.col("id").alias("host_id"))


@query("""SELECT p_partkey, 'ten' AS batch FROM part WHERE p_partkey < 10""")
def snapshot_swap(t):
    good, doubled, short = t.part.where("p_partkey < 10").select("p_partkey"), t.part.where("p_partkey < 5").select("p_partkey"), t.part.where("p_partkey < 9").select("p_partkey")
    tried = {"ten": good, "twice": doubled.union(doubled), "nine": short}
    out = None
    for name, rows in tried.items():
        kept = writes.replace_snapshot(rows, "p_partkey", 10).withColumn("batch", F.lit(name))
        out = kept if out is None else out.unionByName(kept)
    return out


@query("""SELECT conv_id, role, turn, place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS place FROM (
SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY ALL)) WHERE place <= 2""")
def nested_first(t):
    first = pick.first_seen(t.conversations.select("conv_id", "role", "turn"), ["conv_id", "role"], "turn")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return first.select("conv_id", "role", "turn", F.row_number().over(w).alias("place")).where("place <= 2")


@query(f"""SELECT page_id, CASE WHEN starts_with(u, 'https://') AND ({HOST.format('u')} LIKE '%.example.com' OR {HOST.format('u')} LIKE '%.example.org') AND NOT regexp_matches({HOST.format('u')}, '(^|[.])spam-farm[.]example[.](com|org)$')
AND NOT regexp_matches(u, '^https://[^/]*/?$') THEN regexp_replace(u, '#.*$', '') END AS image FROM (
SELECT page_id, CASE WHEN page_id % 10 = 0 THEN regexp_extract(url, '^[a-z]+://[^/]*/') ELSE url END AS u FROM pages)""")
def url_path(t):
    url = F.when(F.col("page_id") % 10 == 0, F.regexp_extract("url", "^[a-z]+://[^/]*/", 0)).otherwise(F.col("url"))
    return t.pages.select("page_id", s.image_url(url, ["example.com", "example.org"], ["spam-farm.example.com", "spam-farm.example.org"]).alias("image"))


@query("""WITH q AS (SELECT *, o_orderdate::DATE AS day, CASE WHEN o_orderstatus = 'P' THEN 'pinned' WHEN o_totalprice < 50000 THEN 'weak-evidence' WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'capped-tier' END AS v FROM orders),
r AS (SELECT *, CASE WHEN v = 'capped-tier' THEN row_number() OVER (PARTITION BY day, v ORDER BY o_orderkey) END AS n FROM q)
SELECT o_orderkey, CASE WHEN v IN ('pinned', 'weak-evidence') THEN 'blocked' WHEN n > 1 THEN 'deferred' ELSE 'assigned' END AS action,
CASE WHEN v IN ('pinned', 'weak-evidence') THEN v WHEN n > 1 THEN 'daily-cap' END AS reason FROM r""")
def capped_assign(t):
    guard = F.when(F.col("o_orderstatus") == "P", "pinned").when(F.col("o_totalprice") < 50_000, "weak-evidence")
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"), guard.alias("guard"), (F.col("o_orderkey") % 3 != 0).alias("capped"))
    counts = F.col("guard").isNull() & F.col("capped")  # refused and uncapped rows consume nothing
    ranked = pick.running_totals(rows.withColumn("_c", counts.cast("long")), ["day"], F.floor(F.col("o_orderkey") / 4096), ["o_orderkey"], F.col("_c"), "upto")
    late = counts & (F.col("upto") > 1)
    action = F.when(F.col("guard").isNotNull(), "blocked").when(late, "deferred").otherwise("assigned")
    return ranked.select("o_orderkey", action.alias("action"), F.coalesce("guard", F.when(late, "daily-cap")).alias("reason"))


@query("""WITH m AS (SELECT DISTINCT user_id AS d, user_id - 1 AS k FROM events WHERE user_id % 10 = 5), e AS (SELECT coalesce(k, user_id) AS row_id, event_id, event_type, value, ts FROM events LEFT JOIN m ON d = user_id)
SELECT row_id, event_type AS item, max(ts) AS seen_at, arg_max(value, (ts, event_id)) AS value FROM e GROUP BY ALL""")
def merge_children(t):
    rows = t.events.select(F.col("user_id").alias("row_id"), F.col("event_type").alias("item"), F.col("ts").alias("at"), "value", "event_id")
    mapping = t.events.where("user_id % 10 = 5").select(F.col("user_id").alias("dropped"), (F.col("user_id") - 1).alias("kept")).distinct()
    out = writes.merge_children({"history": rows}, mapping, {"history": (["item"], F.struct("at", "event_id"))})
    return out["history"].select("row_id", "item", F.col("at").alias("seen_at"), "value")


@query("""WITH c AS (SELECT p_partkey, p_size % 5 AS best, p_partkey % 5 AS truth, p_retailprice / 1000 AS score, p_size % 4 AS lead FROM part),
q AS (SELECT * FROM (VALUES ('strict', 0.98, 3), ('default', 0.95, 1), ('loose', 0.0, 0)) AS v(policy, s, m)),
r AS (SELECT policy, count(*) AS n, count(*) FILTER (score >= s AND lead >= m) AS accepted, count(*) FILTER (score >= s AND lead >= m AND best = truth) AS correct FROM c, q GROUP BY 1),
w AS (SELECT *, correct / accepted AS f, accepted::DOUBLE AS a FROM r)
SELECT policy, n, accepted, correct, round(f, 6) AS precision, round(correct / n, 6) AS recall,
round((f + 3.8416 / (2 * a) - 1.96 * sqrt(f * (1 - f) / a + 3.8416 / (4 * a * a))) / (1 + 3.8416 / a), 6) AS lo,
round((f + 3.8416 / (2 * a) + 1.96 * sqrt(f * (1 - f) / a + 3.8416 / (4 * a * a))) / (1 + 3.8416 / a), 6) AS hi FROM w""")
def policy_replay(t):
    cases = t.part.select("p_partkey", (F.col("p_size") % 5).alias("best"), (F.col("p_partkey") % 5).alias("truth"), (F.col("p_retailprice") / 1000).alias("score"), (F.col("p_size") % 4).alias("lead"))
    return ranking.replay(cases, [("strict", 0.98, 3), ("default", 0.95, 1), ("loose", 0.0, 0)])


SHOWS = """k AS (SELECT p_partkey AS k, p_partkey // 3 AS g, p_partkey % 3 AS pos, p_size AS z FROM part),
t AS (SELECT g, max(CASE WHEN pos = 0 THEN 'a|' || k END) AS r0, max(CASE WHEN pos = 1 THEN 'b|' || k END) AS r1, max(CASE WHEN pos = 2 THEN 'c|' || k END) AS r2, count(*) AS n FROM k GROUP BY g HAVING count(*) = 3)"""


@query(f"""WITH {SHOWS}, made AS (SELECT *, substr(md5(r0), 1, 16) AS m0, substr(md5(r1), 1, 16) AS m1, substr(md5(r2), 1, 16) AS m2 FROM t),
placed AS (SELECT *, CASE WHEN g % 4 = 0 THEN 'S' || g ELSE m0 END AS i0 FROM made),
more AS (SELECT *, CASE WHEN g % 5 <> 0 THEN i0 ELSE m1 END AS i1 FROM placed),
whole AS (SELECT *, CASE WHEN g % 9 = 0 AND g % 4 = 0 THEN 'S' || g WHEN g % 7 <> 0 THEN i1 ELSE m2 END AS i2 FROM more)
SELECT r0 AS rec, i0 AS row_id, 'insert' AS change, CASE WHEN g % 5 <> 0 THEN 1000 + g WHEN g % 9 = 0 AND g % 4 = 0 AND g % 7 = 0 THEN 1000 + g END AS tmdb_id,
 CASE WHEN g % 5 <> 0 THEN CASE WHEN g % 7 = 0 THEN 2 ELSE 1 END WHEN g % 9 = 0 AND g % 4 = 0 AND g % 7 = 0 THEN 1 END AS season FROM whole
UNION ALL SELECT r1, i1, 'insert', 1000 + g, CASE WHEN g % 7 = 0 THEN 2 ELSE 1 END FROM whole
UNION ALL SELECT r2, i2, CASE WHEN g % 9 = 0 AND g % 4 = 0 THEN 'update' ELSE 'insert' END, CASE WHEN i2 = i1 OR i2 = m2 OR g % 5 <> 0 OR g % 7 = 0 THEN 1000 + g END,
 CASE WHEN i2 = i1 THEN CASE WHEN g % 7 = 0 THEN 2 ELSE 1 END WHEN i2 = m2 THEN 1 WHEN g % 5 <> 0 THEN CASE WHEN g % 7 = 0 THEN 2 ELSE 1 END WHEN g % 7 = 0 THEN 1 END FROM whole""")
def upsert_canonical(t):
    """Triples of records that meet only by rows made or filled within the batch: by title, then IMDb id, then id tuple."""
    k = F.col("p_partkey")
    part = t.part.select(k, F.floor(k / 3).cast("long").alias("g"), (k % 3).alias("pos"))
    part = part.join(part.groupBy("g").count().where("count = 3").select("g"), "g")
    g, pos = F.col("g"), F.col("pos")
    null = lambda kind: F.lit(None).cast(kind)
    imdb, season = F.concat(F.lit("tt"), F.lpad(g.cast("string"), 7, "0")), F.when((pos == 1) & (g % 7 == 0), 2).otherwise(1)
    name = lambda n: F.concat(F.lit("Shöw "), g.cast("string"), F.lit(" "), n)
    incoming = part.select(
        F.when(pos == 0, "a").when(pos == 1, "b").otherwise("c").alias("provider"), k.cast("string").alias("provider_id"), F.concat(F.lit("p-"), k.cast("string")).alias("provider_slug"),
        name(F.when(pos == 0, "One").when(pos == 1, "Two").otherwise("Three")).alias("title"), null("string").alias("original"), (2000 + g % 20).cast("int").alias("year"), F.lit("series").alias("media_type"),
        F.when(pos > 0, 1000 + g).alias("tmdb_id"), F.when(pos > 0, "tv").alias("tmdb_media"), F.when(pos > 0, season).alias("tmdb_season"), F.when((pos == 1) | ((pos == 0) & (g % 5 != 0)), imdb).alias("imdb"),
        null("int").alias("episodes"), F.lit("p").alias("payload"),
    )
    held, day = part.where("pos = 0 and g % 4 = 0"), F.lit("2023-01-01").cast("timestamp")
    row_id = F.concat(F.lit("S"), g.cast("string"))
    rows = held.select(
        row_id.alias("id"), F.concat(F.lit("s-"), g.cast("string")).alias("slug"), F.upper(name(F.lit("one"))).alias("title"), null("string").alias("original"), (2000 + g % 20).cast("int").alias("year"), F.lit("series").alias("media_type"),
        null("long").alias("tmdb_id"), null("string").alias("tmdb_media"), null("int").alias("tmdb_season"), null("string").alias("imdb"), null("int").alias("episodes"), F.lit("ready").alias("state"), F.lit(False).alias("pinned"), day.alias("created"), day.alias("updated_at"),
    )
    sources = held.where("g % 9 = 0").select(F.lit("c").alias("provider"), (3 * g + 2).cast("string").alias("provider_id"), F.lit("old-").alias("provider_slug"), row_id.alias("row_id"), F.lit("p").alias("payload"), day.alias("seen_at"))
    sources = sources.withColumn("provider_slug", F.concat("provider_slug", "provider_id"))
    next_rows, _, log = upsert.upsert_canonical(rows, sources, incoming, F.lit("2024-01-31").cast("timestamp"))
    return log.join(next_rows.select(F.col("id").alias("row_id"), "tmdb_id", "tmdb_season"), "row_id").select(F.concat_ws("|", "provider", "provider_id").alias("rec"), "row_id", "change", "tmdb_id", F.col("tmdb_season").alias("season"))
