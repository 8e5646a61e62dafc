"""Folds of rows against a loop that folds one pair after the other, and undo back to any point."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from catalume.operators import folds

FIELDS = ["a", "b"]


def tables_of(spark, rows, favorites, history, aliases):
    make = lambda data, schema: spark.createDataFrame(data, schema)
    return {
        "rows": make(rows, "id long, slug string, a string, b string"), "favorites": make(favorites, "row_id long, user string, at long"),
        "history": make(history, "row_id long, user string, at long, episode string"), "sources": make([(r[0], f"s{r[0]}") for r in rows], "row_id long, source string"),
        "aliases": make(aliases, "slug string, row_id long"),
    }


def children():
    return {"favorites": folds.Child(("user",)), "history": folds.Child(("user",), F.col("at")), "sources": folds.Child()}


def plain(rows, favorites, history, aliases, pairs):
    rows = {r[0]: list(r) for r in rows}
    fav, his = {(r, u): at for r, u, at in favorites}, {(r, u): (at, e) for r, u, at, e in history}
    src, ali, gone, refused = {f"s{r}": r for r in rows}, dict(aliases), {}, set()
    root = lambda x: root(gone[x]) if x in gone else x
    for fold, dropped, kept in sorted(pairs):
        if dropped in gone or dropped not in rows or kept not in rows and kept not in gone or root(kept) == dropped:
            refused.add(fold)
            continue
        to, old = root(kept), rows.pop(dropped)
        for i in (2, 3):
            rows[to][i] = rows[to][i] or old[i]
        for (r, u), at in list(fav.items()):
            if r == dropped:
                fav.setdefault((to, u), at)
                del fav[r, u]
        for (r, u), x in list(his.items()):
            if r == dropped:
                if (to, u) not in his or x[0] > his[to, u][0]:
                    his[to, u] = x
                del his[r, u]
        src = {k: to if v == dropped else v for k, v in src.items()}
        ali = {k: to if v == dropped else v for k, v in ali.items()} | {old[1]: to}
        gone[dropped] = to
    return sorted(map(tuple, rows.values())), sorted((r, u, at) for (r, u), at in fav.items()), sorted((r, u, *x) for (r, u), x in his.items()), sorted((v, k) for k, v in src.items()), sorted(ali.items()), refused


def shown(tables):
    return tuple(sorted(tuple(r) for r in tables[n].collect()) for n in ("rows", "favorites", "history", "sources", "aliases"))


@pytest.mark.parametrize("seed", [1, 2])
def test_folds_and_undo(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"row-{i}", rng.choice([None, f"a{i}"]), rng.choice([None, "", f"b{i}"])) for i in range(14)]
    favorites = [(i, u, rng.randrange(99)) for i in range(14) for u in "xyz" if rng.random() < 0.4]
    history = [(i, u, rng.randrange(5), f"e{i}") for i in range(14) for u in "xyz" if rng.random() < 0.5]
    aliases = [(f"old-{i}", i) for i in range(0, 14, 3)]
    ids = rng.sample(range(14), 9)
    # a tree with late folds into rows that are gone, one row dropped twice, one that does not exist, and a fold into itself
    pairs = [(n + 1, *sorted(rng.sample(ids, 2))) for n in range(8)] + [(20, 77, 3), (21, 3, 3)]
    data = tables_of(spark, rows, favorites, history, aliases)
    after, log, before = folds.fold_rows(data, spark.createDataFrame(pairs, "fold long, dropped long, kept long"), FIELDS, children())
    *want, refused = plain(rows, favorites, history, aliases, pairs)
    blank = lambda x: [tuple(v or None for v in r) if len(r) == 4 and isinstance(r[1], str) and r[1].startswith("row-") else r for r in x]
    assert {r.fold for r in log.where("refused is not null").collect()} == refused
    assert [blank(x) for x in shown(after)] == [blank(x) for x in want]
    for least in (1, 4):
        back, results = folds.undo_folds(after, log, before, least, FIELDS, children())
        *want, _ = plain(rows, favorites, history, aliases, [p for p in pairs if p[0] < least or p[0] >= 20])
        assert [blank(x) for x in shown(back)] == [blank(x) for x in want]
        assert {r.result for r in results.collect()} == {"undone"}


def test_cycles_lose_their_last_fold_and_edits_stop_the_undo(spark):
    rows = [(i, f"row-{i}", f"a{i}", None) for i in range(6)]
    data = tables_of(spark, rows, [(0, "x", 1)], [(0, "x", 1, "e")], [("old", 0)])
    pairs = [(1, 0, 1), (2, 1, 2), (3, 2, 0), (4, 4, 5), (5, 3, 0)]
    after, log, before = folds.fold_rows(data, spark.createDataFrame(pairs, "fold long, dropped long, kept long"), FIELDS, children())
    found = {r.fold: (r.root, r.refused) for r in log.collect()}
    assert found == {1: (2, None), 2: (2, None), 3: (None, "cycle"), 4: (5, None), 5: (2, None)}
    edited = after | {"rows": after["rows"].withColumn("a", F.when(F.col("id") == 5, "new").otherwise(F.col("a")))}
    edited["favorites"] = edited["favorites"].unionByName(spark.createDataFrame([(2, "late", 9)], "row_id long, user string, at long"))
    back, results = folds.undo_folds(edited, log, before, 2, FIELDS, children())
    assert {r.fold: r.result for r in results.collect()} == {2: "undone", 5: "undone", 4: "changed-since"}
    assert sorted(r.id for r in back["rows"].collect()) == [1, 2, 3, 5]
    assert sorted(tuple(r) for r in back["favorites"].collect()) == [(1, "x", 1), (2, "late", 9)]
    taken = edited | {"rows": after["rows"].unionByName(spark.createDataFrame([(9, "row-0", None, None)], data["rows"].schema))}
    assert {r.result for r in folds.undo_folds(taken, log, before, 1, FIELDS, children())[1].where("fold < 4").collect()} == {"dropped-row-exists"}


def test_many_cycles_take_few_rounds_and_short_paths(spark, monkeypatch):
    """Rows on a cycle kept all folds of as many turns as the table has folds: the arrays grew with the table."""
    sizes = []
    cut = folds.cut

    def watched(df):
        out = cut(df)
        sizes.append(max([out.agg(F.coalesce(F.max(F.size(c)), F.lit(0))).first()[0] for c, kind in out.dtypes if kind.startswith("array")], default=0))
        return out

    monkeypatch.setattr(folds, "cut", watched)
    pairs = spark.range(600).selectExpr("2 * id + 1 AS fold", "2 * id AS dropped", "2 * id + 1 AS kept").union(spark.range(600).selectExpr("2 * id + 2", "2 * id + 1", "2 * id"))
    out = folds.closed(pairs, spark.range(1200).select("id"))
    assert {(r.fold % 2, r.refused, tuple(r.path or ())) for r in out.where("fold < 99").collect()} == {(0, "cycle", ())} | {(1, None, (f,)) for f in range(1, 99, 2)}
    assert max(sizes) <= 2 and len(sizes) <= 8


@pytest.mark.parametrize("seed", range(4))
def test_closure_of_graphs_with_cycles_and_tails(spark, seed):
    rng = random.Random(seed)
    n = 40
    order = rng.sample(range(1, 200), n)
    to = [rng.randrange(n) for _ in range(n)] if seed else [(i + 1) % n for i in range(n)]
    pairs = [(order[i], i, to[i]) for i in range(n)]
    up = {order[i]: (i, to[i]) for i in range(n) if i != to[i]}
    state = dict(up.values())
    fold_of = {i: f for f, (i, _) in up.items()}
    refused = {order[i] for i in range(n) if i == to[i]}
    for start in list(state):  # the last fold of each cycle
        way, x = [], start
        while x in state and x not in way:
            way.append(x)
            x = state[x]
        if x in way:
            worst = max(way[way.index(x) :], key=fold_of.get)
            refused.add(fold_of[worst])
            del state[worst]
    want = {}
    for x in state:
        path, y = [], x
        while y in state:
            if not path or fold_of[y] > path[-1]:
                path.append(fold_of[y])
            y = state[y]
        want[fold_of[x]] = (y, path[::-1])
    got = folds.closed(spark.createDataFrame(pairs, "fold long, dropped long, kept long"), spark.range(n).select("id")).collect()
    assert {r.fold for r in got if r.refused} == refused
    assert {r.fold: (r.root, r.path) for r in got if not r.refused} == want
