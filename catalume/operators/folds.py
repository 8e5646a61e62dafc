"""Folding rows into others, and taking folds back.

Folds are numbered and take effect in that order: the dropped row's sources, lists and history go to the kept row, which takes the
fields it lacks, and the dropped slug becomes an alias. Instead of replaying them, the mapping from dropped to kept rows is closed by
pointer jumping, so chains of any length take a logarithmic number of joins and each child row is re-pointed once. Which value wins
follows from the place of its row in the tree of folds: a row comes before those folded into it, and these come in the order of their folds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalume.functions.scalars import present
from catalume.operators.tables import cut


def _last_of_cycles(edges: DataFrame) -> DataFrame:
    """fold, dropped: the last fold of each cycle of ``edges`` (fold, dropped, kept; one for each dropped row).

    Each row looks along its way by twice as many folds each round and keeps only the last of them. Ways that end are left out. The
    same fold can be the last of a stretch and of the next only on a cycle, and then both together hold all of it.
    """
    shape, found = edges.select("fold", "dropped"), None
    reach = edges.select(F.col("dropped").alias("node"), F.col("kept").alias("to"), F.struct("fold", "dropped").alias("top"))
    while not reach.isEmpty():
        on = reach.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("top").alias("_top"))
        met = cut(reach.join(on, "to").select("node", F.col("_to").alias("to"), F.greatest("top", "_top").alias("top"), (F.col("top") == F.col("_top")).alias("_found")))
        new = met.where("_found").select("top.*")
        found = new if found is None else found.unionByName(new)
        reach = met.where("not _found").drop("_found")
    return shape.limit(0) if found is None else found.distinct()


def closed(folds: DataFrame, rows: DataFrame) -> DataFrame:
    """fold, dropped, kept, root, path, refused for ``folds`` (fold, dropped, kept) over ``rows`` (id).

    refused: row-missing (a side does not exist, or an earlier fold dropped the row already), cycle (the last fold of a cycle), else
    null. path: the folds that lead from the root down to the row; a fold into a row that was dropped before goes to that row's root.
    """
    known = rows.select("id")
    sides = folds.join(known.withColumnRenamed("id", "dropped").withColumn("_d", F.lit(True)), "dropped", "left").join(known.withColumnRenamed("id", "kept").withColumn("_k", F.lit(True)), "kept", "left")
    first = folds.groupBy("dropped").agg(F.min("fold").alias("_first"))
    judged = sides.join(first, "dropped").withColumn("refused", F.when(F.col("_d").isNull() | F.col("_k").isNull() | (F.col("fold") != F.col("_first")), "row-missing").when(F.col("dropped") == F.col("kept"), "cycle"))
    judged = cut(judged.select("fold", "dropped", "kept", "refused"))

    edges = judged.where("refused is null").select("fold", "dropped", "kept")
    last = _last_of_cycles(edges)
    judged = cut(judged.join(last.withColumn("_cycle", F.lit(True)), ["fold", "dropped"], "left").select("fold", "dropped", "kept", F.coalesce("refused", F.when(F.col("_cycle"), "cycle")).alias("refused")))

    # node, to, up: the furthest row reached, and of the folds on the way those that come after all before them, from the node up
    reach = judged.where("refused is null").select(F.col("dropped").alias("node"), F.col("kept").alias("to"), F.array(F.col("fold").cast("bigint")).alias("up"))
    moving = True
    while moving:
        on = reach.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("up").alias("_up"))
        later = F.filter("_up", lambda f: f > F.element_at("up", -1))
        met = cut(reach.join(on, "to", "left").select("node", F.coalesce("_to", "to").alias("to"), F.when(F.col("_up").isNull(), F.col("up")).otherwise(F.concat("up", later)).alias("up"), F.col("_to").isNotNull().alias("_on")))
        reach, moving = met.drop("_on"), not met.where("_on").isEmpty()
    placed = reach.select(F.col("node").alias("dropped"), F.col("to").alias("root"), F.reverse("up").alias("path"))
    kept = F.col("refused").isNull()
    return judged.join(placed, "dropped", "left").select("fold", "dropped", "kept", F.when(kept, F.col("root")).alias("root"), F.when(kept, F.col("path")).alias("path"), "refused")


@dataclass(frozen=True)
class Child:
    """A table with row_id. ``keys``: at most one row for each of them and row_id stays, the greatest by ``order`` (null: none is greater),
    else the first by path; without keys all rows stay."""

    keys: tuple[str, ...] | None = None
    order: Column | None = None


def apply_folds(tables: dict[str, DataFrame], mapping: DataFrame, fields: list[str], children: dict[str, Child]) -> dict[str, DataFrame]:
    """``tables`` after the folds of ``mapping`` (dropped, root, path, as from ``closed``).

    rows: id, slug and ``fields``, which a kept row takes where it lacks them; aliases: slug, row_id; others by ``children``.
    """
    to = mapping.where("root is not null").select(F.col("dropped").alias("_from"), "root", "path")
    begin = F.array().cast("array<bigint>")
    rows = tables["rows"].join(to, F.col("id") == F.col("_from"), "left").withColumn("_root", F.coalesce("root", "id")).withColumn("_path", F.coalesce("path", begin))
    rest = [c for c in tables["rows"].columns if c not in ("id", *fields)]
    touched = rows.join(to.select(F.col("root").alias("_root")).distinct(), "_root", "left_semi")
    merged = touched.groupBy("_root").agg(
        F.min_by(F.struct(*rest), "_path").alias("_own"), *[F.min_by(c, F.when(present(F.col(c)), F.col("_path"))).alias(c) for c in fields]
    ).select(F.col("_root").alias("id"), "_own.*", *fields)
    untouched = rows.join(to.select(F.col("root").alias("_root")).distinct(), "_root", "left_anti")
    out = {"rows": untouched.select(*tables["rows"].columns).unionByName(merged.select(*tables["rows"].columns))}
    gone = rows.where("_from is not null").select("slug", F.col("_root").alias("row_id"))
    moved = {n: t.join(to, F.col("row_id") == F.col("_from"), "left").withColumn("row_id", F.coalesce("root", "row_id")).withColumn("_path", F.coalesce("path", begin)) for n, t in tables.items() if n != "rows"}
    out["aliases"] = moved["aliases"].select("slug", "row_id").join(gone, "slug", "left_anti").unionByName(gone)
    for name, rule in children.items():
        names, keys = tables[name].columns, rule.keys
        if keys is None:
            out[name] = moved[name].select(*names)
            continue
        kept = [c for c in names if c not in ("row_id", *keys)]
        best = F.struct((rule.order if rule.order is not None else F.lit(0)).alias("o"), F.transform(F.concat("_path", F.array(F.lit(0).cast("bigint"))), lambda x: -x).alias("p"))
        # of equal orders the first path wins: fold numbers are positive, so negated paths, ended by 0, compare the other way round
        out[name] = moved[name].groupBy("row_id", *keys).agg(F.max_by(F.struct(*kept), best).alias("_b")).select("row_id", *keys, "_b.*").select(*names)
    return out


def fold_rows(tables: dict[str, DataFrame], folds: DataFrame, fields: list[str], children: dict[str, Child]) -> tuple[dict[str, DataFrame], DataFrame, dict[str, DataFrame]]:
    """The next tables, the log (fold, dropped, kept, root, path, refused), and ``before``: what all rows in a fold were, with their children."""
    log = cut(closed(folds, tables["rows"]))
    after = apply_folds(tables, log, fields, children)
    done = log.where("refused is null")
    members = done.select(F.col("dropped").alias("row_id")).unionByName(done.select(F.col("root").alias("row_id"))).distinct()
    before = {"rows": tables["rows"].join(members.withColumnRenamed("row_id", "id"), "id", "left_semi")}
    before |= {n: t.join(members, "row_id", "left_semi") for n, t in tables.items() if n != "rows"}
    return after, log, before


def undo_folds(tables: dict[str, DataFrame], log: DataFrame, before: dict[str, DataFrame], least: int, fields: list[str], children: dict[str, Child]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after taking back all folds from number ``least`` on, latest first, and what became of them (fold, result: undone,
    changed-since, dropped-row-exists).

    A row that is no longer as its folds left it, or a dropped id or slug that is in use again, stops the undo of all folds into that
    row. Children that came since stay with the row they came to.
    """
    folded = cut(apply_folds(before, log, fields, children)["rows"])
    names = tables["rows"].columns
    now = tables["rows"].select("id", F.struct(*names).alias("_now"))
    roots = log.where((F.col("fold") >= least) & F.col("refused").isNull()).select("root").distinct()
    same = folded.select("id", F.struct(*names).alias("_left")).join(now, "id", "left").select(F.col("id").alias("root"), F.col("_now").eqNullSafe(F.col("_left")).alias("_same"))
    own = log.where("refused is null").join(before["rows"].select(F.col("id").alias("dropped"), F.col("slug").alias("_slug")), "dropped").select("root", "dropped", "_slug")
    used = own.join(tables["rows"].select(F.col("id").alias("dropped"), F.lit(True).alias("_i")), "dropped", "left").join(tables["rows"].select(F.col("slug").alias("_slug"), F.lit(True).alias("_s")), "_slug", "left")
    used = used.groupBy("root").agg(F.bool_or(F.coalesce("_i", "_s", F.lit(False))).alias("_used"))
    verdict = roots.join(same, "root").join(used, "root").withColumn("result", F.when(~F.col("_same"), "changed-since").when(F.col("_used"), "dropped-row-exists").otherwise("undone"))
    verdict = cut(verdict.select("root", "result"))
    back = verdict.where("result = 'undone'").select("root")

    # what the groups that go back were before, folded again up to the number
    groups = log.where("refused is null").join(back, "root", "left_semi")
    members = cut(groups.select(F.col("dropped").alias("id")).unionByName(back.select(F.col("root").alias("id"))).distinct())
    old = {n: t.join(members if n == "rows" else members.withColumnRenamed("id", "row_id"), "id" if n == "rows" else "row_id", "left_semi") for n, t in before.items()}
    earlier = cut(closed(groups.where(F.col("fold") < least).select("fold", "dropped", "kept"), old["rows"]))
    again, whole = apply_folds(old, earlier, fields, children), apply_folds(old, groups, fields, children)
    out = {"rows": tables["rows"].join(back.withColumnRenamed("root", "id"), "id", "left_anti").unionByName(again["rows"])}
    for name in (n for n in tables if n != "rows"):
        cols = tables[name].columns
        all_ = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols])
        left = tables[name].withColumn("_all", all_).join(whole[name].select(all_.alias("_all")).distinct(), "_all", "left_anti").drop("_all")
        out[name] = left.unionByName(again[name].select(*cols))
    return out, log.where((F.col("fold") >= least) & F.col("refused").isNull()).join(verdict, "root").select("fold", "result")
