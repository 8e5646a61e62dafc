"""The canonical upsert against a loop that takes records one after the other."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from catalume.operators import upsert

OLD = dt.datetime(2023, 1, 1)
ROWS = "id string, slug string, title string, original string, year int, media_type string, tmdb_id long, tmdb_media string, tmdb_season int, imdb string, episodes int, state string, pinned boolean, created timestamp, updated_at timestamp"
SOURCES = "provider string, provider_id string, provider_slug string, row_id string, payload string, seen_at timestamp"
INCOMING = "provider string, provider_id string, provider_slug string, title string, original string, year int, media_type string, tmdb_id long, tmdb_media string, tmdb_season int, imdb string, episodes int, payload string"


def row(id_, title, year, kind, tmdb=(None, None, None), imdb=None, original=None):
    return (id_, title.lower(), title, original, year, kind, *tmdb, imdb, None, "ready", False, OLD, OLD)


def record(provider, number, title, year, kind, tmdb=(None, None, None), imdb=None, original=None, payload="p"):
    return (provider, number, f"{provider}-{number}", title, original, year, kind, *tmdb, imdb, None, payload)


def run(spark, rows, sources, incoming):
    frames = [spark.createDataFrame(d, s) for d, s in ((rows, ROWS), (sources, SOURCES), (incoming, INCOMING))]
    next_rows, next_sources, log = upsert.upsert_canonical(*frames, F.lit("2024-01-31").cast("timestamp"))
    return {r.id: r for r in next_rows.collect()}, {(r.provider, r.provider_id): r.row_id for r in next_sources.collect()}, {(r.provider, r.provider_id): r.change for r in log.collect()}


def test_rows_and_sources(spark):
    rows = [row("r1", "Alpha", 2000, "tv", (5, "tv", 1)), row("r2", "Beta", 2001, "movie")]
    sources = [("kk", "1", "kk-1", "r1", "p", OLD), ("kk", "9", "gone", "r1", "q", OLD)]
    incoming = [
        record("kk", "1", "Alpha", 2000, "tv", (5, "tv", 1)), record("nc", "7", "Other name", 2000, "tv", (5, "tv", 1)), record("nc", "8", " BÊTA", 2001, "movie", (77, "movie", None)),
        record("kk", "2", "Gamma", 2010, "movie", (88, "movie", None)), record("nc", "3", "Gamma again", 2010, "movie", (88, "movie", None)), record("nc", "4", "Alpha", 2000, "tv", (6, "tv", 2)),
    ]
    found, where, log = run(spark, rows, sources, incoming)
    assert where["kk", "1"] == where["nc", "7"] == where["kk", "9"] == "r1" and where["nc", "8"] == "r2" and where["kk", "2"] == where["nc", "3"] not in ("r1", "r2")
    assert where["nc", "4"] not in ("r1", "r2", where["kk", "2"]) and len(found) == 4
    assert found["r2"].tmdb_id == 77 and found["r1"].tmdb_id == 5 and found[where["kk", "2"]].slug == "gamma" and found[where["nc", "4"]].slug == "alpha-2000"
    assert log == {("kk", "1"): "same", **{k: "insert" for k in (("nc", "7"), ("nc", "8"), ("kk", "2"), ("nc", "3"), ("nc", "4"))}}


def test_a_chain_that_meets_only_in_the_batch(spark):
    """The second record meets the row of the first by IMDb id and gives it the tuple by which the third one finds it."""
    incoming = [record("a", "1", "One", 2005, "tv", imdb="tt10001"), record("a", "2", "Two", 2006, "tv", (9, "tv", 1), imdb="tt10001"), record("b", "3", "Three", 2007, "tv", (9, "tv", 1))]
    found, where, _ = run(spark, [], [], incoming)
    assert len(found) == 1 and len(set(where.values())) == 1
    only = next(iter(found.values()))
    assert (only.tmdb_id, only.tmdb_season, only.imdb, only.slug) == (9, 1, "tt10001", "one")


def plain(rows, sources, incoming):
    """Rules 1, 2, 3, 5, 6 and 7 (for short titles) one record after the other."""
    known = [dict(id=r[0], title=(r[2] or "").lower(), original=(r[3] or "").lower(), year=r[4], kind=r[5], tmdb=r[6:9], imdb=r[9], n=i) for i, r in enumerate(rows)]
    by_source, out = {(s[0], s[1]): s[3] for s in sources}, {}
    words = lambda x: frozenset(x.split())

    def clash(r, kind, tmdb):
        if r["tmdb"][0] is not None and tmdb[0] is not None:
            if r["tmdb"][:2] != tmdb[:2] or tmdb[1] == "tv" and r["tmdb"][2] is not None and r["tmdb"][2] != tmdb[2]:
                return True
        series = kind == "tv" or r["kind"] == "tv"
        return series and r["tmdb"][2] is not None and tmdb[1] == "tv" and tmdb[2] is not None and r["tmdb"][2] != tmdb[2]

    for provider, number, _, title, original, year, kind, *rest in sorted(incoming, key=lambda r: f"{r[0]}|{r[1]}"):
        tmdb, imdb, rec = tuple(rest[:3]), rest[3], f"{provider}|{number}"
        title, original = title.lower(), (original or "").lower()
        row = next((r for r in known if r["id"] == by_source.get((provider, number))), None)
        if row is None and tmdb[0] is not None:
            row = next((r for r in known if r["tmdb"] == tmdb), None)
        if row is None and imdb:
            same = sorted((r for r in known if r["imdb"] == imdb and r["kind"] == kind and not clash(r, kind, tmdb)), key=lambda r: (r["tmdb"][2] is not None, r["tmdb"][2] or 0, r["n"]))
            row = same[0] if same else None
        if row is None and year:
            tests = [lambda r: original and r["original"] == original, lambda r: title and r["title"] == title, lambda r: original and words(r["original"]) == words(original) or title and words(r["title"]) == words(title)]
            for test in tests:
                same = [r for r in known if r["year"] == year and r["kind"] == kind and r["tmdb"][2] is None and test(r)]
                if same:
                    row = None if clash(same[0], kind, tmdb) else same[0]
                    break
        held = {(r["imdb"], r["kind"]) for r in known if r["tmdb"][2] is None}
        if row is None:
            row = dict(id=rec, title=title, original=original, year=year, kind=kind, tmdb=tmdb, imdb=imdb if tmdb[2] is not None or (imdb, kind) not in held else None, n=len(known))
            known.append(row)
        else:
            if tmdb[0] is not None and row["tmdb"][0] is None and all(r["tmdb"] != tmdb for r in known):
                row["tmdb"] = tmdb
            if imdb and row["imdb"] is None and (imdb, kind) not in held:
                row["imdb"] = imdb
        out[provider, number] = row["id"]
    return out


@pytest.mark.parametrize("seed", [1, 3])
def test_batches_end_as_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    films = lambda i: rng.choice([(None, None, None), (rng.randrange(4) + 1, "movie", None)])
    names = ["red sun", "sun red", "blue moon", "green hill", "old town"]
    rows = [row(f"r{i}", rng.choice(names) + str(i), 2000 + i % 2, "movie") for i in range(3)]
    incoming = [record(rng.choice("ab"), f"{i:02d}", rng.choice(names), 2000 + rng.randrange(2), "movie", films(i), rng.choice([None, None, "tt10001", "tt10002"]), rng.choice([None, *names])) for i in range(12)]
    found, where, _ = run(spark, rows, [], incoming)
    want = plain(rows, [], incoming)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(where) == groups(want)
    assert len(found) == 3 + len({v for v in want.values() if "|" in v}), sorted(found)
