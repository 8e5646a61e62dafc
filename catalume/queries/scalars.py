"""Text and scalar functions on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalume.functions import scalars as s
from catalume.functions import text as x
from catalume.queries.registry import query

NORMAL = "trim(regexp_replace(lower(replace(replace(strip_accents({}), 'đ', 'd'), 'Đ', 'd')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(f"SELECT doc_id, {NORMAL.format('text')} AS title FROM documents")
def normalize_title(t):
    return t.documents.select("doc_id", x.normalize_title(F.col("text")).alias("title"))


@query("""SELECT p_partkey, CASE WHEN s = '' THEN 'movie' ELSE s END AS slug FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(
CASE WHEN p_size = 1 THEN '!!' ELSE p_name || ' ' || p_brand END), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS s FROM part)""")
def slugify(t):
    name = F.when(F.col("p_size") == 1, "!!").otherwise(F.concat_ws(" ", "p_name", "p_brand"))
    return t.part.select("p_partkey", x.slugify(name).alias("slug"))


TITLE = "p_name || CASE p_size % 5 WHEN 0 THEN ' (Season ' || p_size % 7 || ')' WHEN 1 THEN ' Phần ' || p_size WHEN 2 THEN ' mua 3' WHEN 3 THEN '' ELSE ' season 4 extended' END"
SLUG = "replace(p_name, ' ', '-') || CASE p_size % 4 WHEN 0 THEN '-phan-' || p_size % 12 WHEN 1 THEN '-phan-2-2001' WHEN 2 THEN '-phan-x' ELSE '' END"


@query(f"""SELECT p_partkey, TRY_CAST(nullif(regexp_extract(n, '(?:^| )(?:season|phan) ([0-9][0-9]?)(?: |$)', 1), '') AS INT) AS season,
TRY_CAST(nullif(regexp_extract(s, '(?:^|-)phan-([0-9][0-9]?)(?:-(?:19|20)[0-9][0-9])?$', 1), '') AS INT) AS slug_season,
trim(regexp_replace(regexp_replace(n, '(?:^| )(?:season|phan) [0-9][0-9]?(?: |$)', ' '), ' +', ' ', 'g')) AS base
FROM (SELECT p_partkey, {NORMAL.format(TITLE)} AS n, {SLUG} AS s FROM part)""")
def season_extract(t):
    k = F.col("p_size")
    parts = F.when(k % 5 == 0, F.concat(F.lit(" (Season "), (k % 7).cast("string"), F.lit(")"))).when(k % 5 == 1, F.concat(F.lit(" Phần "), k.cast("string")))
    title = F.concat("p_name", parts.when(k % 5 == 2, " mua 3").when(k % 5 == 3, "").otherwise(" season 4 extended"))
    tail = F.when(k % 4 == 0, F.concat(F.lit("-phan-"), (k % 12).cast("string"))).when(k % 4 == 1, "-phan-2-2001").when(k % 4 == 2, "-phan-x").otherwise("")
    slug = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), tail)
    return t.part.select("p_partkey", x.season_of(title).alias("season"), x.season_in_slug(slug).alias("slug_season"), x.base_title(title).alias("base"))


@query("""SELECT a.p_partkey, a.p_size, contains(' ' || a.p_name || ' ', ' ' || s || ' ') AS agrees FROM part a JOIN (SELECT p_size, p_brand,
split_part(min(p_name), ' ', 1) || ' ' || split_part(min(p_name), ' ', 2) AS s FROM part GROUP BY ALL) b ON a.p_size = b.p_size AND a.p_brand = b.p_brand""")
def slug_run(t):
    least = t.part.groupBy("p_size", "p_brand").agg(F.min("p_name").alias("m"))
    short = F.concat_ws(" ", F.split_part("m", F.lit(" "), F.lit(1)), F.split_part("m", F.lit(" "), F.lit(2)))
    return t.part.join(least, ["p_size", "p_brand"]).select("p_partkey", "p_size", x.has_run(F.col("p_name"), short).alias("agrees"))


def _html() -> str:
    """The plain text of a page in SQL: entities first and tags after, twice, then Markdown signs and white space."""
    out = "regexp_replace(html, '\\r\\n?', chr(10), 'g')"
    for _ in range(2):
        for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&mdash;", "—"), ("&amp;", "&")):
            out = f"replace({out}, '{name}', '{sign}')"
        for pattern, put in (
            ("(?is)<script\\b.*?(?:</script\\s*>|\\z)|<style\\b.*?(?:</style\\s*>|\\z)", "' '"), ("(?s)<!--.*?(?:-->|\\z)", "' '"),
            ("(?i)<\\s*br\\s*/?\\s*>|</\\s*(?:p|div|li|blockquote|h[1-6])\\s*>", "chr(10)"), ("(?i)</?[a-z!][^>]*>?", "' '"),
        ):
            out = f"regexp_replace({out}, '{pattern}', {put}, 'g')"
    for pattern, put in (
        ("!\\[([^\\]]*)\\]\\([^)]*\\)", "'\\1'"), ("\\[([^\\]]+)\\]\\([^)]*\\)", "'\\1'"), ("(?m)^\\s{0,3}#{1,6}\\s+", "''"), ("(?m)^\\s{0,3}>\\s?", "''"),
        ("(?m)^\\s*(?:[-*+]|[0-9]+\\.)\\s+", "''"), ("\\*\\*(.+?)\\*\\*", "'\\1'"), ("__(.+?)__", "'\\1'"), *[("(^|[^\\w*])[*_]([^*_\\n]+)[*_]([^\\w*]|$)", "'\\1\\2\\3'")] * 2, ("~~(.+?)~~", "'\\1'"), ("`+([^`]*)`+", "'\\1'"),
        ("[ \\t]+", "' '"), (" ?\\n ?", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)"), ("[<>]", "''"), ("^\\s+|\\s+$", "''"),
    ):
        out = f"regexp_replace({out}, '{pattern}', {put}, 'g')"
    return out


HTML = _html()


@query(f"SELECT page_id, md5({HTML}) AS digest, length({HTML}) AS n FROM pages")
def html_text(t):
    out = t.pages.select("page_id", x.html_to_text(F.col("html")).alias("t"))
    return out.select("page_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(CASE WHEN length(h) - strpos(reverse(h), ' ') > 96 AND contains(h, ' ')
THEN left(h, length(h) - strpos(reverse(h), ' ')) ELSE h END, '\\s+$', '') || '…' END AS head FROM (SELECT *, substr(text, 1, 119) AS h FROM documents)""")
def truncate_word(t):
    return t.documents.select("doc_id", x.truncate_at_word(F.col("text"), 120).alias("head"))


@query("""SELECT doc_id, len(p) AS parts, TRY_CAST(nullif(regexp_extract(text, '[0-9]+', 0), '') AS INT) AS first_int FROM (
SELECT *, list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents)""")
def split_people(t):
    return t.documents.select("doc_id", F.size(x.split_list(F.col("text"))).cast("long").alias("parts"), x.first_integer(F.col("text")).alias("first_int"))


@query("""SELECT event_id, CASE WHEN value > 50 THEN value END AS high, CASE WHEN value / 10 BETWEEN 0 AND 10 THEN round(value / 10, 1) END AS rating,
CASE WHEN value BETWEEN 0 AND 100 THEN round(value)::INT END AS pct FROM events""")
def numeric_guards(t):
    v = F.col("value")
    return t.events.select("event_id", (s.positive(v - 50) * 0 + v).alias("high"), s.rating(v / 10).alias("rating"), s.percentage(v).alias("pct"))


@query("""SELECT lang, round((p + z / (2 * n) - d) / (1 + z / n), 6) AS lo, round((p + z / (2 * n) + d) / (1 + z / n), 6) AS hi, n FROM (
SELECT lang, n, p, 3.8416 AS z, 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) AS d FROM (
SELECT lang, count(*)::DOUBLE AS n, avg(quality) AS p FROM documents JOIN labels USING (doc_id) GROUP BY 1))""")
def wilson_by_group(t):
    per = t.documents.join(t.labels, "doc_id").groupBy("lang").agg(F.sum("quality").alias("k"), F.count("*").cast("double").alias("n"))
    lo, hi = (F.round(s.wilson(F.col("k"), F.col("n"), up), 6) for up in (False, True))
    return per.select("lang", lo.alias("lo"), hi.alias("hi"), "n")


@query("""SELECT p_partkey, md5(p_name) AS m, sha1(p_brand) AS s, substr(sha256(p_name || chr(0) || coalesce(nullif(p_type, p_type), '') || chr(0) || p_size), 1, 12) AS k FROM part""")
def hash_keys(t):
    key = F.substring(s.hash_key(F.col("p_name"), F.nullif(F.col("p_type"), F.col("p_type")), F.col("p_size")), 1, 12)
    return t.part.select("p_partkey", F.md5("p_name").alias("m"), F.sha1("p_brand").alias("s"), key.alias("k"))


@query("""SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_brand, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) % 1000 AS jitter
FROM part""")
def rolling_hash(t):
    return t.part.select("p_partkey", s.rolling_hash(F.col("p_brand")).alias("jitter"))


@query("""SELECT split_part(split_part(url, '//', 2), '/', 1) AS host, count(*) AS n FROM pages WHERE NOT split_part(split_part(url, '//', 2), '/', 1) LIKE '%.net' GROUP BY 1""")
def host_filter(t):
    out = t.pages.withColumn("host", s.host(F.col("url"))).where(~F.col("host").endswith(".net"))
    return out.groupBy("host").agg(F.count("*").alias("n"))


@query("SELECT event_id, (props ->> '$.k')::INT AS k, props ->> '$.missing' IS NOT NULL AS has FROM events")
def json_path(t):
    props = F.from_json("props", "map<string, string>")
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.map_contains_key(props, "missing").alias("has"))


@query("""SELECT event_id, epoch_us(ts) // 1000 AS ms, ts::DATE AS day, floor(epoch(ts))::BIGINT - ((floor(epoch(ts))::BIGINT - (3 * 86400 + 9 * 3600 - 25200)) % 604800 + 604800) % 604800 AS slot FROM events""")
def time_parts(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", F.unix_millis(ts).alias("ms"), F.to_date("ts").alias("day"), s.weekly_slot(ts, 0, 9).alias("slot"))


@query("""SELECT p_partkey, len(list_intersect(list_distinct(w), ['ring', 'part'])) AS hits, coalesce(list_position(w, 'ring'), 0) AS pos, w[1] AS head, len(w) AS n FROM (
SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")
def array_ops(t):
    w = F.split("p_name", " ")
    hits = F.size(F.array_intersect(w, F.lit(["ring", "part"]))).cast("long")
    return t.part.select("p_partkey", hits.alias("hits"), F.array_position(w, "ring").alias("pos"), F.try_element_at(w, F.lit(1)).alias("head"), F.size(w).cast("long").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN s IS NULL THEN NULL ELSE abs(year(o_orderdate) - s) <= 1 END AS ok FROM orders LEFT JOIN (
SELECT l_orderkey, min(year(l_shipdate)) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""")
def year_compat(t):
    first = t.lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min(F.year("l_shipdate")).alias("s"))
    joined = t.orders.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", s.year_check(F.year("o_orderdate"), F.col("s")).alias("ok"))
