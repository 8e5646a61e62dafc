"""Seven audit actions, their refusals, and their undo, on small tables."""

from __future__ import annotations

import pytest

from catalume.operators import repairs

ROWS = "id long, slug string, state string, media string, tmdb_id long, season int, id_source string, pinned boolean, title string, year int"
ACTIONS = "no long, type string, row_id long, target long, source_id long, slug string, season int, created boolean, expect long"
SOURCES = "id long, row_id long, slug string, available boolean, season int"


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        (1, "one", "ready", "tv", 10, 1, "inferred", False, "One", 2001), (2, "two", "ready", "movie", 20, None, "inferred", False, "Two", 2002),
        (3, "keep", "ready", "tv", 30, 1, "provider", False, "Keep", 2003), (4, "drop", "ready", "tv", None, None, None, False, "Keep", 2003),
        (5, "show-phan-3", "ready", "tv", 50, 2, "inferred", False, "Show", 2005), (6, "dead", "ready", "movie", None, None, None, False, "Dead", None),
        (7, "from", "ready", "tv", 70, 1, "inferred", False, "From", 2007), (8, "to", "ready", "tv", 80, 2, "inferred", True, "To", 2008),
        (9, "show-phan-2", "ready", "tv", 90, 2, "inferred", False, "Other", 2009), (11, "hid", "hidden", "tv", 91, 2, "provider", False, "Hid", 2009),
        (12, "a", "ready", "movie", None, None, None, False, "A", 1), (13, "b", "ready", "movie", None, None, None, False, "B", 1),
    ]
    aliases = [("old", 12), ("b", 12), ("drop-old", 4), ("show-phan-2-2005", 5)]
    sources = [(100, 7, "s100", True, 2), (101, 7, "s101", True, 1), (102, 4, "s102", True, 1), (103, 6, "s103", False, None), (104, 1, "s104", True, 1), (105, 3, "s105", False, 1)]
    return spark.createDataFrame(rows, ROWS), spark.createDataFrame(aliases, "slug string, row_id long"), spark.createDataFrame(sources, SOURCES)


def act(spark, *rows):
    names = [c.split()[0] for c in ACTIONS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ACTIONS)


def plain(tables):
    return [sorted(tuple(r) for r in t.collect()) for t in tables]


ALL = (
    dict(no=1, type="set_season", row_id=1, season=4), dict(no=2, type="clear_tmdb", row_id=2), dict(no=3, type="merge_rows", row_id=3, target=4),
    dict(no=4, type="rename_slug", row_id=5), dict(no=5, type="hide_row", row_id=6), dict(no=6, type="move_source", source_id=100, target=8, created=True),
    dict(no=7, type="fix_alias", slug="old", target=13),
)


def test_seven_actions_and_their_undo(spark, tables):
    after, log = repairs.apply_repairs(*tables, act(spark, *ALL))
    assert {r.no: (r.status, r.gate) for r in log["actions"].collect()} == {n: ("applied", None) for n in range(1, 8)}
    rows, aliases, sources = plain(after)
    row = {r[0]: r for r in rows}
    assert row[1][5] == 4 and row[1][7] and row[2][3:8] == (None, None, None, None, True) and 4 not in row
    assert row[5][1] == "show-phan-2-2005" and row[6][2] == "unavailable"  # the plain slug is another row's, the alias its own
    assert dict(aliases) == {"old": 13, "b": 12, "drop-old": 3, "drop": 3, "show-phan-3": 5}
    assert {s[0]: s[1] for s in sources} == {100: 8, 101: 7, 102: 3, 103: 6, 104: 1, 105: 3}

    back, outcomes = repairs.undo_repairs(*after, log, act(spark, *ALL).select("no"))
    assert {(r.action, r.reason) for r in outcomes.collect()} == {("undone", None)}
    want = plain(tables)
    want[0] = sorted(r[:7] + (r[0] in (1, 2, 8),) + r[8:] if r[0] != 8 else r[:2] + ("unavailable",) + r[3:] for r in want[0])
    assert plain(back) == want  # pinned rows stay so; the row made for the source is hidden


def test_refusals_write_nothing(spark, tables):
    asked = (
        (dict(type="set_season", row_id=2, season=1), "row-changed"), (dict(type="clear_tmdb", row_id=3), "row-changed"), (dict(type="merge_rows", row_id=12, target=13), "row-changed"),
        (dict(type="rename_slug", row_id=9), "slug-agrees"), (dict(type="rename_slug", row_id=11), "row-changed"), (dict(type="hide_row", row_id=1), "has-available-source"),
        (dict(type="move_source", source_id=999, target=8), "source-gone"), (dict(type="fix_alias", slug="none"), "alias-gone"), (dict(type="report", row_id=7), "not-applicable"),
    ), ((dict(type="move_source", source_id=105, target=77), "last-source"), (dict(type="fix_alias", slug="old", target=11), "target-gone"))
    for batch in asked:
        after, log = repairs.apply_repairs(*tables, act(spark, *[a | {"no": n} for n, (a, _) in enumerate(batch)]))
        assert {r.no: (r.status, r.gate) for r in log["actions"].collect()} == {n: ("blocked", why) for n, (_, why) in enumerate(batch)}
        assert plain(after) == plain(tables)
    after, log = repairs.apply_repairs(*tables, act(spark, dict(no=1, type="move_source", source_id=100, target=3)))
    assert log["actions"].first().status == "failed" and plain(after) == plain(tables)


def test_turns_shadowed_aliases_and_undo_refusals(spark, tables):
    asked = act(spark, dict(no=1, type="fix_alias", slug="b", target=13), dict(no=2, type="fix_alias", slug="old", target=13), dict(no=3, type="rename_slug", row_id=5), dict(no=4, type="set_season", row_id=1, season=2))
    after, log = repairs.apply_repairs(*tables, asked)
    assert {r.no: r.status for r in log["actions"].collect()} == {1: "applied", 2: "deferred", 3: "applied", 4: "applied"}
    assert "b" not in dict(plain(after)[1])  # the target answers that slug itself
    later = after[0].selectExpr("id", "case when id = 5 then 'manual' else slug end slug", "state", "media", "tmdb_id", "case when id = 1 then 9 else season end season", "id_source", "pinned", "title", "year")
    numbers = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 99)], "no long")
    back, outcomes = repairs.undo_repairs(later, after[1], after[2], log, numbers)
    assert {r.no: r.reason for r in outcomes.collect()} == {1: None, 2: "status-deferred", 3: "slug-changed-since", 4: "identity-changed-since", 99: "action-missing"}
    assert dict(plain(back)[1])["b"] == 12
    taken = after[0].unionByName(spark.createDataFrame([(77, "show-phan-3", "ready", "tv", None, None, None, False, "X", 1)], ROWS))
    _, outcomes = repairs.undo_repairs(taken, after[1], after[2], log, numbers.where("no = 3"))
    assert outcomes.first().reason == "old-slug-taken"
