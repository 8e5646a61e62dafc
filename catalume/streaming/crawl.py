"""A resumable crawl of landed list pages as a streaming source.

Pages lie as ``{path}/{lane}/{page}.json``, one payload a file, in any store that pyarrow's file systems open. Each micro-batch is one
run of the crawl and has three kinds of parts for each lane:

* ``head``: pages 1 to ``head``, read every run, up to the first page that is empty or not landed;
* ``backfill``: the next ``backfill`` pages from where the lane stands, each read once a pass;
* ``identity``: the same walk with its own place and page number, for lanes named in ``identity_lanes``; it starts at page 1.

A pass ends with the last page that the payloads state, with an empty page, or after ``end_page``; a new one begins at the walk's first
page once ``cycle_days`` have gone by since (0: never). A page that has not landed ends the run of its walk and is asked for again.

Offsets hold the whole place of the crawl, so Spark's own log of offsets decides what a batch reads, and a batch that is repeated after
a crash reads the same pages. Spark does not tell a restarted source where it stood; the place is therefore also kept in the file
``place`` of the folder ``state``, written when a batch is planned. A batch that is logged but was not planned is planned again by
Spark before the next offset is asked for, so the file is never behind.

The driver looks at two pages a walk and run, for the stated page count and emptiness; all other pages are read by executors only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Where list payloads keep their page count and their items, in the order they are tried (fixed values).
TOTAL_PATHS = (("paginate", "total_page"), ("pagination", "totalPages"), ("data", "pagination", "totalPages"), ("data", "paginate", "total_page"))
ITEM_PATHS = (("items",), ("data", "items"))


def _at(payload, path):
    for name in path:
        payload = payload.get(name) if isinstance(payload, dict) else None
    return payload


def stated_pages(payload) -> int | None:
    """The first positive integer among the paths."""
    found = [str(_at(payload, p)) for p in TOTAL_PATHS]
    return next((int(x) for x in found if x.isascii() and x.isdigit() and int(x) > 0), None)


def is_empty(payload) -> bool:
    return not any(isinstance(_at(payload, p), list) and _at(payload, p) for p in ITEM_PATHS)


def advance(place: dict, day: int, first: int, most: int, end_page: int, cycle_days: int, landed, peek) -> dict:
    """A walk's next place (pass, page, last, done) from ``place``; ``landed(page)`` tells whether a page is there and ``peek(page)`` reads it.

    ``page`` is the next page to read, ``last`` the stated page count (0: unknown), ``done`` the day the pass ended (-1: it goes on).
    """
    if place["done"] >= 0:
        if cycle_days <= 0 or day - place["done"] < cycle_days:
            return place
        place = {"pass": place["pass"] + 1, "page": first, "last": 0, "done": -1}
    page, past = place["page"], None
    if end_page and page > end_page:
        return place | {"done": day}
    while page < place["page"] + most and landed(page) and not (end_page and page > end_page):
        if page == place["page"]:
            payload = peek(page)
            past, last = is_empty(payload), stated_pages(payload) or 0
        page += 1
        if past or last and page > last:
            return {"pass": place["pass"], "page": page, "last": last, "done": day}
    if page == place["page"]:
        return place
    past = is_empty(peek(page - 1)) if page - 1 > place["page"] else past
    return {"pass": place["pass"], "page": page, "last": last, "done": day if past else -1}


class Pages(InputPartition):
    """Pages ``start`` to before ``stop`` of one walk; a head part stops at the first page that is empty or not there."""

    def __init__(self, lane: str, kind: str, turn: int, start: int, stop: int):
        self.lane, self.kind, self.turn, self.start, self.stop = lane, kind, turn, start, stop


class LandedPages(DataSource):
    """``spark.readStream.format("landed_pages")``. Options: path, state, lanes and identity_lanes (by commas), head (2), backfill (5),
    first_page (head + 1), end_page (0: none), cycle_days (7), day (a date for today; tests set it), part (pages a task, 50)."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return "lane string, kind string, pass int, page int, value string"

    def streamReader(self, schema) -> "PageReader":
        return PageReader(dict(self.options))


class PageReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.state = options["path"].rstrip("/"), options["state"].rstrip("/")
        names = lambda key: [x.strip() for x in options.get(key, "").split(",") if x.strip()]
        number = lambda key, other: int(options.get(key, other))
        self.head, self.most, self.end = number("head", 2), number("backfill", 5), number("end_page", 0)
        self.first, self.cycle, self.part = number("first_page", 0) or self.head + 1, number("cycle_days", 7), number("part", 50)
        self.today = options.get("day")
        self.walks = {f"backfill/{x}": self.first for x in names("lanes")} | {f"identity/{x}": 1 for x in names("identity_lanes")}
        self.lanes, self.at = names("lanes"), None

    def _open(self, folder: str, name: str):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        return store, f"{root}/{name}"

    def _landed(self, lane: str, page: int) -> bool:
        from pyarrow import fs

        store, path = self._open(self.path, f"{lane}/{page}.json")
        return store.get_file_info(path).type == fs.FileType.File

    def _text(self, lane: str, page: int) -> str:
        store, path = self._open(self.path, f"{lane}/{page}.json")
        with store.open_input_stream(path) as f:
            return f.read().decode("utf-8", "replace")

    def _payload(self, lane: str, page: int):
        """A payload that is no JSON counts as one without items."""
        try:
            return json.loads(self._text(lane, page))
        except ValueError:
            return None

    def initialOffset(self) -> dict:
        return {"run": 0, "walks": {}}

    def _place(self) -> dict:
        from pyarrow import fs

        if self.at is None:
            store, path = self._open(self.state, "place")
            if store.get_file_info(path).type == fs.FileType.File:
                with store.open_input_stream(path) as f:
                    self.at = json.loads(f.read())
            else:
                self.at = self.initialOffset()
        return self.at

    def _whole(self, walks: dict) -> dict:
        """Walks that an offset does not know yet stand at their first page."""
        return {w: walks.get(w, {"pass": 1, "page": first, "last": 0, "done": -1}) for w, first in self.walks.items()}

    def latestOffset(self) -> dict:
        now = date.fromisoformat(self.today) if self.today else datetime.now(timezone.utc).date()
        at, walks = self._place(), {}
        for name, place in self._whole(at["walks"]).items():
            lane = name.partition("/")[2]
            walks[name] = advance(
                place, now.toordinal(), self.walks[name], self.most, self.end, self.cycle,
                lambda page, lane=lane: self._landed(lane, page), lambda page, lane=lane: self._payload(lane, page),
            )
        gone = {k: v for k, v in at["walks"].items() if k not in walks}  # lanes that are switched off keep their place
        return {"run": at["run"] + 1, "walks": gone | walks}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        parts = [Pages(lane, "head", end["run"], 1, self.head + 1) for lane in self.lanes] if end["run"] > start["run"] else []
        before, after = self._whole(start["walks"]), self._whole(end["walks"])
        for name, first in self.walks.items():
            kind, _, lane = name.partition("/")
            begin = before[name]["page"] if before[name]["pass"] == after[name]["pass"] else first
            stop = after[name]["page"]
            parts += [Pages(lane, kind, after[name]["pass"], p, min(p + self.part, stop)) for p in range(begin, stop, self.part)]
        self._save(end)
        return parts

    def _save(self, place: dict) -> None:
        """Written aside and moved over the old file."""
        self.at = place
        store, path = self._open(self.state, "place")
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(f"{path}-next") as f:
            f.write(json.dumps(place).encode())
        store.move(f"{path}-next", path)

    def read(self, partition: Pages) -> Iterator[tuple]:
        for page in range(partition.start, partition.stop):
            if partition.kind == "head" and not self._landed(partition.lane, page):
                return
            text = self._text(partition.lane, page)
            yield partition.lane, partition.kind, partition.turn, page, text
            if partition.kind == "head":
                try:
                    payload = json.loads(text)
                except ValueError:
                    payload = None
                if is_empty(payload):
                    return

    def commit(self, end: dict) -> None:
        """Spark's log has the offset; nothing is left to do."""
