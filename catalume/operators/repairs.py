"""Audit repairs: seven actions written in one pass over the tables, with a log of every change, and their undo.

Tables: rows (id, slug, state, media, tmdb_id, season, id_source, pinned, title, year), aliases (slug, row_id), sources (id, row_id, slug,
available, season). An action (no, type, row_id, target, source_id, slug, season, created, expect) has passed its gate; it is checked again
against the tables as they are. Each compiles to changes of keys in the three tables, which one join a table puts in place.

Of the actions of a batch that touch one row the first by number is served; the others are ``deferred`` to the next batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalume.functions.text import rename_slug, season_in_slug, season_of
from catalume.operators.tables import cut

ROW = ("slug", "state", "media", "tmdb_id", "season", "id_source", "pinned", "title", "year")
IDENTITY = ("tmdb_id", "media", "season", "id_source")
Tables = tuple[DataFrame, DataFrame, DataFrame]


def _image(prefix: str, **put: Column) -> Column:
    return F.struct(*[put.get(c, F.col(f"{prefix}.{c}")).alias(c) for c in ROW])


def _known(tables: Tables, actions: DataFrame) -> DataFrame:
    """Actions with the rows they touch (``home``: the row acted on; h and t: images of it and of the target; s: the source)."""
    rows, aliases, sources = tables
    image = rows.select(F.col("id").alias("_id"), F.struct(*ROW).alias("_image"))
    owner = aliases.select(F.col("slug").alias("_slug"), F.col("row_id").alias("owner"))
    source = sources.select(F.col("id").alias("_sid"), F.struct("row_id", "available", "season").alias("s"))
    live = sources.where("available").groupBy(F.col("row_id").alias("_lid")).agg(F.count("*").alias("live"))
    found = actions.join(owner, (F.col("type") == "fix_alias") & (F.col("slug") == F.col("_slug")), "left").join(source, F.col("source_id") == F.col("_sid"), "left")
    home = F.when(F.col("type") == "fix_alias", F.col("owner")).when(F.col("type") == "move_source", F.col("s.row_id")).otherwise(F.col("row_id"))
    found = found.drop("_slug", "_sid").withColumn("home", home)
    found = found.join(image, F.col("home") == F.col("_id"), "left").withColumnRenamed("_image", "h").drop("_id")
    found = found.join(image, F.col("target") == F.col("_id"), "left").withColumnRenamed("_image", "t").drop("_id")
    found = found.join(live, F.col("home") == F.col("_lid"), "left").withColumn("live", F.coalesce("live", F.lit(0))).drop("_lid")
    each = found.select("no", F.explode(F.array_compact(F.array_distinct(F.array("home", "target")))).alias("_row"))
    firsts = each.groupBy("_row").agg(F.min("no").alias("_first"))
    turns = each.join(firsts, "_row").groupBy("no").agg(F.bool_and(F.col("no") == F.col("_first")).alias("served"))
    return found.join(turns, "no", "left").withColumn("served", F.coalesce("served", F.lit(True)))


def _gate() -> Column:
    """Why an action of ``_known`` with its ``new_slug`` cannot be written, or null."""
    kind, has = F.col("type"), lambda c: F.col(c).isNotNull()
    named = F.coalesce("h.season", season_of(F.col("h.title")), F.lit(1))
    ready = F.coalesce(F.col("h.state") == "ready", F.lit(False))
    wrong = has("s.season") & has("t.season") & (F.col("t.season") != F.col("s.season"))
    strayed = has("expect") & (F.col("target") != F.col("expect")) & ~F.coalesce("created", F.lit(False))
    cases = {
        "set_season": [(~has("h") | ~F.col("h.media").eqNullSafe("tv") | ~has("h.tmdb_id"), "row-changed")],
        "clear_tmdb": [(~has("h") | ~has("h.tmdb_id") | ~F.col("h.id_source").eqNullSafe("inferred"), "row-changed")],
        "merge_rows": [(~has("h") | ~has("t") | (F.col("home") == F.col("target")) | ~has("h.tmdb_id") | has("t.tmdb_id"), "row-changed")],
        "fix_alias": [(~has("owner"), "alias-gone"), (~F.col("t.state").eqNullSafe("ready"), "target-gone")],
        "rename_slug": [
            (~ready, "row-changed"), (season_in_slug(F.col("h.slug")).eqNullSafe(named), "slug-agrees"),
            (~has("new_slug") | season_in_slug(F.col("new_slug")).eqNullSafe(season_in_slug(F.col("h.slug"))), "no-free-slug"),
        ],
        "hide_row": [(~ready, "row-changed"), (F.col("live") > 0, "has-available-source")],
        "move_source": [
            (~has("s"), "source-gone"), (F.col("live") - F.col("s.available").cast("int") < 1, "last-source"), (~has("t"), "target-gone"),
            (F.col("home") == F.col("target"), "landed-on-same-row"), (wrong | strayed, "landed-wrong-row"),
        ],
    }
    out = F.when(~kind.isin(*cases), "not-applicable")
    for name, tests in cases.items():
        why = F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), code) for bad, code in tests])
        out = out.when(kind == name, why)
    return out


def _free_slugs(known: DataFrame, tables: Tables, most: int = 49) -> DataFrame:
    """no, new_slug: for each renaming the first free slug of its title and season, then with the year, then with 2 to ``most``.
    Aliases and source slugs of the row itself do not count as taken."""
    rows, aliases, sources = tables
    named = F.coalesce("h.season", season_of(F.col("h.title")), F.lit(1))
    asked = known.where("type = 'rename_slug' and served and h is not null").select("no", F.col("home").alias("own"), rename_slug(F.col("h.title"), named).alias("base"), F.col("h.year").alias("year"))
    numbers = F.transform(F.sequence(F.lit(2), F.lit(most)), lambda n: F.concat_ws("-", "base", n.cast("string")))
    tries = F.concat(F.array("base", F.when(F.col("year").isNotNull(), F.concat_ws("-", "base", F.col("year").cast("string")))), numbers)
    each = asked.select("no", "own", F.posexplode(tries).alias("pos", "try")).where("try is not null")
    taken = rows.select("slug", F.lit(None).cast("long").alias("row_id")).unionByName(aliases.select("slug", "row_id")).unionByName(sources.select("slug", "row_id")).distinct()
    free = each.join(taken, (F.col("try") == F.col("slug")) & ~F.col("row_id").eqNullSafe(F.col("own")), "left_anti")
    return free.groupBy("no").agg(F.min_by("try", "pos").alias("new_slug"))


def apply_repairs(rows: DataFrame, aliases: DataFrame, sources: DataFrame, actions: DataFrame) -> tuple[Tables, dict[str, DataFrame]]:
    """The next (rows, aliases, sources), and the log: ``actions`` (no, type, status, gate, home, target, created), and the changes of
    ``rows``, ``aliases`` and ``sources`` (no, key, before, after; null: not there).

    status: applied, deferred, blocked (gate says why) or failed (a source landed on a wrong row). Two renamings that want one slug: the
    second waits. A refused action writes nothing.
    """
    tables = (rows, aliases, sources)
    known = _known(tables, actions)
    known = cut(known)  # read by the slugs and by every table's changes
    known = known.join(_free_slugs(known, tables), "no", "left").withColumn("_gate", _gate())
    wants = known.where("served and _gate is null and new_slug is not null").groupBy("new_slug").agg(F.min("no").alias("_first"))
    known = known.join(wants, "new_slug", "left").withColumn("late", ~F.col("served") | ((F.col("type") == "rename_slug") & F.col("_gate").isNull() & (F.col("no") != F.col("_first"))))
    gate = F.when(~F.col("served"), "row-in-batch").when(F.col("late"), "slug-in-batch").otherwise(F.col("_gate"))
    known = known.withColumn("gate", gate)
    status = F.when(F.col("late"), "deferred").when(F.col("gate") == "landed-wrong-row", "failed").when(F.col("gate").isNotNull(), "blocked").otherwise("applied")
    known = cut(known.withColumn("status", status))
    done, none = known.where("status = 'applied'"), F.lit(None)
    kind = F.col("type")

    after = (
        F.when(kind == "set_season", _image("h", season=F.col("season"), pinned=F.lit(True)))
        .when(kind == "clear_tmdb", _image("h", pinned=F.lit(True), **{c: none for c in IDENTITY}))
        .when(kind == "rename_slug", _image("h", slug=F.col("new_slug")))
        .when(kind == "hide_row", _image("h", state=F.lit("unavailable")))
    )
    gone = done.where(kind == "merge_rows").select("no", F.col("target").alias("key"), F.col("t").alias("before"))
    row_changes = done.where(kind.isin("set_season", "clear_tmdb", "rename_slug", "hide_row")).select("no", F.col("home").alias("key"), F.col("h").alias("before"), after.alias("after"))
    row_changes = row_changes.unionByName(gone, allowMissingColumns=True)

    merged = done.where(kind == "merge_rows").select("no", F.col("home").alias("keep"), F.col("target").alias("drop"), F.col("t.slug").alias("old"))
    fixed = done.where(kind == "fix_alias").select("no", F.col("slug").alias("key"), F.when(F.col("t.slug") != F.col("slug"), F.col("target")).alias("after"))
    old = done.where(kind == "rename_slug").select("no", F.col("h.slug").alias("key"), F.when(F.col("t.state") == "ready", F.col("target")).otherwise(F.col("home")).alias("after"))
    own = done.where(kind == "rename_slug").select("no", F.col("new_slug").alias("key"), none.cast("long").alias("after"))
    left = aliases.join(merged, F.col("row_id") == F.col("drop")).select("no", F.col("slug").alias("key"), F.col("keep").alias("after"))
    became = merged.select("no", F.col("old").alias("key"), F.col("keep").alias("after"))
    put = fixed.unionByName(old).unionByName(own).unionByName(left).unionByName(became)
    put = put.groupBy("key").agg(F.max_by(F.struct("no", "after"), "no").alias("_p")).select("_p.*", "key")
    held = aliases.select(F.col("slug").alias("key"), F.col("row_id").alias("before"))
    alias_changes = put.join(held, "key", "left").where(~F.col("before").eqNullSafe(F.col("after"))).select("no", "key", "before", "after")

    moved = done.where(kind == "move_source").select("no", F.col("source_id").alias("key"), F.col("home").alias("before"), F.col("target").alias("after"))
    folded = sources.join(merged, F.col("row_id") == F.col("drop")).select("no", F.col("id").alias("key"), F.col("drop").alias("before"), F.col("keep").alias("after"))
    log = {
        "actions": known.select("no", "type", "status", "gate", "home", "target", F.coalesce("created", F.lit(False)).alias("created")),
        "rows": row_changes, "aliases": alias_changes, "sources": moved.unionByName(folded),
    }
    return _put(tables, log["rows"], log["aliases"], log["sources"]), log


def _put(tables: Tables, row_changes: DataFrame, alias_changes: DataFrame, source_changes: DataFrame) -> Tables:
    """Tables with ``after`` put in place, at most one change a key; columns beyond the named ones stay."""
    rows, aliases, sources = tables
    news = row_changes.select(F.col("key").alias("_key"), F.col("after").alias("_after"), F.lit(True).alias("_hit"))
    both = rows.join(news, F.col("id") == F.col("_key"), "full").where("_hit is null or _after is not null")
    hit = F.col("_hit").isNotNull()
    next_rows = both.select(*[F.coalesce("id", "_key").alias("id") if c == "id" else F.when(hit, F.col(f"_after.{c}")).otherwise(F.col(c)).alias(c) if c in ROW else F.col(c) for c in rows.columns])
    news = alias_changes.select(F.col("key").alias("_key"), F.col("after").alias("_after"), F.lit(True).alias("_hit"))
    both = aliases.join(news, F.col("slug") == F.col("_key"), "full").withColumn("row_id", F.when(hit, F.col("_after")).otherwise(F.col("row_id"))).where("row_id is not null")
    next_aliases = both.withColumn("slug", F.coalesce("slug", "_key")).select(*aliases.columns)
    news = source_changes.select(F.col("key").alias("_key"), F.col("after").alias("_after"))
    next_sources = sources.join(news, F.col("id") == F.col("_key"), "left").withColumn("row_id", F.coalesce("_after", "row_id")).select(*sources.columns)
    return next_rows, next_aliases, next_sources


def undo_repairs(rows: DataFrame, aliases: DataFrame, sources: DataFrame, log: dict[str, DataFrame], wanted: DataFrame) -> tuple[Tables, DataFrame]:
    """The tables with ``wanted`` (no) logged actions taken back, and their outcomes (no, action: undone or noop, reason).

    An action is taken back only where its effect still stands: a row's identity or slug that changed since, an old slug that another row
    has taken, or a merged row that is there again refuse it. Of several asked at once for one row the latest goes back, the others say
    ``later-first``. Only what the action wrote is restored; a row stays pinned.
    """
    tables = (rows, aliases, sources)
    now = rows.select(F.col("id").alias("key"), F.struct(*ROW).alias("now"))
    asked = wanted.select("no").distinct().join(log["actions"], "no", "left")
    asked = asked.join(log["rows"].select("no", "key", "before", "after"), "no", "left").withColumn("key", F.coalesce("key", "home"))
    holder = rows.groupBy(F.col("slug").alias("_slug")).agg(F.min("id").alias("_a"), F.max("id").alias("_b"))
    asked = asked.join(now, "key", "left").join(holder, F.col("before.slug") == F.col("_slug"), "left")
    turns = asked.where("status = 'applied'").select("no", F.explode(F.array_distinct(F.array_compact(F.array("home", "target")))).alias("_row"))
    last = turns.groupBy("_row").agg(F.max("no").alias("_last"))
    waits = turns.join(last, "_row").groupBy("no").agg(F.bool_or(F.col("no") != F.col("_last")).alias("waits"))
    kind, is_ = F.col("type"), lambda a, b: F.col(a).eqNullSafe(F.col(b))
    same = is_("now.tmdb_id", "after.tmdb_id") & is_("now.media", "after.media") & is_("now.season", "after.season")
    other = (F.col("_a") != F.col("key")) | (F.col("_b") != F.col("key"))
    why = (
        F.when(kind.isNull(), "action-missing").when(F.col("status") != "applied", F.concat(F.lit("status-"), "status")).when(F.col("waits"), "later-first")
        .when(kind.isin("set_season", "clear_tmdb") & F.col("now").isNull(), "row-missing").when(kind.isin("set_season", "clear_tmdb") & ~same, "identity-changed-since")
        .when((kind == "rename_slug") & ~is_("now.slug", "after.slug"), "slug-changed-since").when((kind == "rename_slug") & F.coalesce(other, F.lit(False)), "old-slug-taken")
        .when((kind == "merge_rows") & F.col("now").isNotNull(), "dropped-row-exists")
    )
    judged = cut(asked.join(waits, "no", "left").withColumn("reason", why))
    back = judged.where("reason is null")

    image = lambda put: _image("now", **{c: F.col(f"before.{c}") for c in put})
    restored = F.when(kind.isin("set_season", "clear_tmdb"), image(IDENTITY)).when(kind == "rename_slug", image(["slug"])).when(kind == "hide_row", image(["state"])).when(kind == "merge_rows", F.col("before"))
    stands = (kind != "hide_row") | (F.col("now.state") == "unavailable")
    row_back = back.where(kind.isin("set_season", "clear_tmdb", "rename_slug", "hide_row", "merge_rows") & stands).select("key", restored.alias("after"))
    numbers = back.select("no", "type")
    alias_back = log["aliases"].join(numbers, "no").select("key", F.col("before").alias("after"))
    source_back = log["sources"].join(numbers, "no").select("key", F.col("before").alias("after"))

    put = _put(tables, row_back, alias_back, source_back)
    landed = back.where((kind == "move_source") & F.col("created")).select(F.col("target").alias("_id")).distinct()
    empty = landed.join(put[2].select("row_id"), F.col("_id") == F.col("row_id"), "left_anti").withColumn("_empty", F.lit(True))
    next_rows = put[0].join(empty, F.col("id") == F.col("_id"), "left").withColumn("state", F.when(F.col("_empty"), "unavailable").otherwise(F.col("state"))).select(*rows.columns)
    outcomes = judged.select("no", F.when(F.col("reason").isNull(), "undone").otherwise("noop").alias("action"), "reason")
    return (next_rows, put[1], put[2]), outcomes
