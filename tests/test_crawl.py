"""The crawl over landed pages: each page once a pass, over stops, crashes and restarts after the cycle."""

from __future__ import annotations

import json
import tempfile
from collections import Counter
from pathlib import Path

import pytest

from catalume.streaming.crawl import LandedPages, PageReader, advance, stated_pages


def land(folder: Path, lane: str, pages, total=None) -> None:
    (folder / lane).mkdir(parents=True, exist_ok=True)
    for page in pages:
        body = {"items": [{"slug": f"{lane}-{page}-{i}"} for i in range(2)]}
        if total:
            body["pagination"] = {"totalPages": total}
        (folder / lane / f"{page}.json").write_text(json.dumps(body))


@pytest.fixture
def place():
    return Path(tempfile.mkdtemp(prefix="spark-crawl-", dir="/tmp"))


def run(spark, place: Path, day: str, crash: bool = False, **options) -> list[tuple]:
    """One run with a new query; its rows by batch number, so a repeated batch replaces itself."""
    spark.dataSource.register(LandedPages)
    opts = {"path": f"file://{place}/landed", "state": f"file://{place}/state", "head": 1, "backfill": 2, "cycle_days": 7, "day": day} | options

    def sink(batch, number):
        rows = [tuple(r) for r in batch.select("kind", "lane", "pass", "page").collect()]
        if crash:
            raise RuntimeError("lost")
        (place / "out").mkdir(exist_ok=True)
        (place / "out" / f"{number:03d}").write_text(json.dumps(rows))

    stream = spark.readStream.format("landed_pages").options(**opts).load()
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{place}/log").trigger(availableNow=True).start()
    try:
        query.awaitTermination(60)
    except Exception:
        if not crash:
            raise
    return taken(place)


def taken(place: Path) -> list[tuple]:
    out = place / "out"
    return [tuple(r) for f in sorted(out.glob("*")) for r in json.loads(f.read_text())] if out.exists() else []


def test_each_page_once_a_pass_over_restarts_and_a_crash(spark, place):
    land(place / "landed", "a", range(1, 8), total=7)
    land(place / "landed", "b", range(1, 4))
    (place / "landed" / "b" / "4.json").write_text('{"items": []}')
    for day, crash in (("2024-03-01", False), ("2024-03-02", True), ("2024-03-02", False), ("2024-03-03", False), ("2024-03-04", False)):
        rows = run(spark, place, day, crash, lanes="a,b", identity_lanes="a")
    found = Counter(r for r in rows if r[0] != "head")
    want = [("backfill", "a", 1, p) for p in range(2, 8)] + [("backfill", "b", 1, p) for p in (2, 3, 4)] + [("identity", "a", 1, p) for p in range(1, 8)]
    assert found == Counter(want)
    heads = Counter((lane, page) for kind, lane, _, page in rows if kind == "head")
    assert heads["a", 1] == heads["b", 1] == len(list((place / "out").glob("*")))

    again = run(spark, place, "2024-03-09", lanes="a,b", identity_lanes="a")[len(rows) :]  # seven days after a ended at 2024-03-03
    fresh = [r for r in again if r[0] == "backfill"]
    assert [r for r in fresh if r[1] == "b"] == [("backfill", "b", 2, 2), ("backfill", "b", 2, 3)]


def test_pages_that_have_not_landed_are_waited_for(spark, place):
    land(place / "landed", "a", (1, 2), total=4)
    rows = run(spark, place, "2024-03-01", lanes="a")
    assert [r for r in rows if r[0] == "backfill"] == [("backfill", "a", 1, 2)]
    land(place / "landed", "a", (3, 4), total=4)
    rows = run(spark, place, "2024-03-01", lanes="a")
    assert [r[3] for r in rows if r[0] == "backfill"] == [2, 3, 4]


def test_advance():
    pages = {1: {"items": [1], "paginate": {"total_page": "3"}}, 2: {"items": [1]}, 3: {"items": [1]}, 4: {"items": []}}
    step = lambda at, day=10, most=2, end=0, cycle=7: advance(at, day, 1, most, end, cycle, pages.__contains__, pages.__getitem__)
    fresh = {"pass": 1, "page": 1, "last": 0, "done": -1}
    assert step(fresh) == {"pass": 1, "page": 3, "last": 3, "done": -1}
    assert step(fresh, most=9) == {"pass": 1, "page": 4, "last": 3, "done": 10}  # as many pages as stated
    assert step(fresh | {"page": 3})["done"] == 10  # an empty page ends the pass
    assert step(fresh | {"page": 5}) == fresh | {"page": 5}  # not landed
    assert step(fresh | {"page": 2}, end=1)["done"] == 10
    over = fresh | {"page": 4, "done": 10}
    assert step(over, day=16) == over and step(over, day=17)["pass"] == 2 and step(over, day=99, cycle=0) == over


def test_stated_pages_and_torn_payloads(place):
    assert stated_pages({"data": {"paginate": {"total_page": 9}}}) == 9 and stated_pages({"paginate": {"total_page": -1}}) is None and stated_pages(None) is None
    land(place / "landed", "a", (1, 2))
    (place / "landed" / "a" / "3.json").write_text("{")
    reader = PageReader({"path": f"file://{place}/landed", "state": f"file://{place}/state", "lanes": "a", "head": "1", "backfill": "5", "day": "2024-01-01"})
    end = reader.latestOffset()
    assert end["walks"]["backfill/a"]["page"] == 4 and end["walks"]["backfill/a"]["done"] > 0  # no JSON counts as empty
    rows = [r for p in reader.partitions(reader.initialOffset(), end) for r in reader.read(p)]
    assert [r[3] for r in rows if r[1] == "backfill"] == [2, 3] and rows[-1][4] == "{"
