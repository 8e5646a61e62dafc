"""Keyed rules as streams with value state, list state and event-time timers. operators.state has their batch forms.

A key's events of a micro-batch are put into order by time and ``tie``; across micro-batches they must not go back in time beyond the
watermark. State is kept for each key alone and goes when its timer fires, so what is remembered does not grow with the stream. A
micro-batch, which the source's limits bound, brings at most its own events of a key to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from catalume.functions.predicates import source_failure

DAY = 86_400_000


class _Ordered(StatefulProcessor):
    """Feeds a key's events one by one to ``step`` and yields what it returns; ``expire`` answers the timer."""

    names: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open(handle)

    def rewind(self, at: int | None) -> None:
        """One timer for a key: at ``at``, or none."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ms", "tie"], kind="stable")
        found = list(self.run(key, events.to_dict("records")))
        if found:
            yield pd.DataFrame(found, columns=list(self.names))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = list(self.expire(key, expiredTimerInfo.getExpiryTimeInMs()))
        if found:
            yield pd.DataFrame(found, columns=list(self.names))

    def expire(self, key, at: int):
        return ()

    def close(self) -> None:
        pass


def _keyed(events: DataFrame, keys: list[str], millis: str, tie: str, late: str, rest: list[str], processor: _Ordered, fields: str) -> DataFrame:
    shaped = events.select(*keys, *rest, F.col(millis).alias("ms"), F.col(tie).alias("tie"), F.timestamp_millis(millis).alias("at")).withWatermark("at", late)
    return shaped.groupBy(*keys).transformWithStateInPandas(processor, fields, "append", "EventTime")


class _Limiter(_Ordered):
    def __init__(self, span: int, limit: int):
        self.span, self.limit, self.names = span, limit, ("who", "ms", "tie", "allowed", "retry_ms")

    def open(self, handle):
        self.live = handle.getListState("live", "ms long")

    def run(self, key, events):
        live = [t for (t,) in self.live.get()]
        for e in events:
            t = int(e["ms"])
            live = [x for x in live if x > t - self.span]
            allowed = len(live) < self.limit
            yield key[0], t, e["tie"], allowed, 0 if allowed else live[0] + self.span - t
            if allowed:
                live.append(t)
        if live:
            self.live.put([(t,) for t in live])
        else:
            self.live.clear()
        self.rewind(live[-1] + self.span if live else None)

    def expire(self, key, at):
        self.live.clear()
        return ()


def sliding_limiter(events: DataFrame, key: str, millis: str, tie: str, span: int, limit: int, late: str = "0 seconds") -> DataFrame:
    """who, ms, tie, allowed, retry_ms: at most ``limit`` recorded hits within ``span``; denied hits are not recorded."""
    return _keyed(events, [key], millis, tie, late, [], _Limiter(span, limit), f"who {dict(events.dtypes)[key]}, ms long, tie long, allowed boolean, retry_ms long")


class _Windows(_Ordered):
    def __init__(self, span: int):
        self.span, self.names = span, ("who", "ms", "tie", "window_start", "hits")

    def open(self, handle):
        self.window = handle.getValueState("window", "start long, hits long")

    def run(self, key, events):
        start, hits = self.window.get() or (None, 0)
        for e in events:
            t = int(e["ms"])
            start, hits = (start, hits + 1) if start is not None and t < start + self.span else (t, 1)
            yield key[0], t, e["tie"], start, hits
        self.window.update((start, hits))
        self.rewind(start + self.span)

    def expire(self, key, at):
        self.window.clear()
        return ()


def fixed_windows(events: DataFrame, key: str, millis: str, tie: str, span: int, late: str = "0 seconds") -> DataFrame:
    """who, ms, tie, window_start, hits: a window opens at a key's first hit and takes all hits within ``span``."""
    return _keyed(events, [key], millis, tie, late, [], _Windows(span), f"who {dict(events.dtypes)[key]}, ms long, tie long, window_start long, hits long")


class _Backoff(_Ordered):
    def __init__(self, free: int, base: int, most: int, expires: int):
        self.free, self.base, self.most, self.expires, self.names = free, base, most, expires, ("who", "ms", "tie", "streak", "delay_ms")

    def open(self, handle):
        self.state = handle.getValueState("streak", "streak long, last long")

    def run(self, key, events):
        streak, last = self.state.get() or (0, None)
        for e in events:
            t = int(e["ms"])
            if not e["failed"]:
                streak = 0
            else:
                streak = 1 if last is not None and t - last > self.expires else streak + 1
            last = t
            yield key[0], t, e["tie"], streak, int(min(self.most, self.base * 2 ** (streak - self.free - 1))) if streak > self.free else 0
        self.state.update((streak, last))
        self.rewind(last + self.expires + 1)

    def expire(self, key, at):
        self.state.clear()
        return ()


def failure_backoff(events: DataFrame, key: str, millis: str, tie: str, failed: str, free: int = 4, base: int = 250, most: int = 5000, expires: int = 900_000, late: str = "0 seconds") -> DataFrame:
    """who, ms, tie, streak, delay_ms: failures in a row, ended by a success or a pause of ``expires``, and the delay they cost."""
    return _keyed(events.withColumnRenamed(failed, "failed"), [key], millis, tie, late, ["failed"], _Backoff(free, base, most, expires), f"who {dict(events.dtypes)[key]}, ms long, tie long, streak long, delay_ms long")


class _Strikes(_Ordered):
    def __init__(self, gap: int):
        self.gap, self.names = gap, ("id", "ms", "action")

    def open(self, handle):
        self.first = handle.getValueState("first", "ms long")

    def run(self, key, events):
        held = self.first.get()
        first, due = held[0] if held else None, None
        for e in events:
            t, outcome = int(e["ms"]), e["outcome"]
            if outcome == "ok":
                first, action = None, "refreshed"
            elif outcome == "404" and first is not None and t // DAY - first // DAY >= self.gap:
                first, action = None, "retired"
            elif outcome == "404":
                first, action = t if first is None else first, "waiting"
            else:
                action = "deferred"
            due = t + DAY if action == "deferred" else t + self.gap * DAY + DAY // 24 if action == "waiting" else None
            yield key[0], t, action
        if first is None:
            self.first.clear()
        else:
            self.first.update((first,))
        self.rewind(due)

    def expire(self, key, at):
        yield key[0], at, "due"


def source_strikes(checks: DataFrame, id_: str, millis: str, tie: str, outcome: str, gap_days: int = 7, late: str = "0 seconds") -> DataFrame:
    """id, ms, action: refreshed, waiting (a first 404), retired (a second one ``gap_days`` later) or deferred for each check, and ``due``
    from a timer when a source is to be checked again and was not."""
    return _keyed(checks.withColumnRenamed(outcome, "outcome"), [id_], millis, tie, late, ["outcome"], _Strikes(gap_days), f"id {dict(checks.dtypes)[id_]}, ms long, action string")


class _Memo(_Ordered):
    names = ("key", "status", "until", "event")

    def open(self, handle):
        self.held = handle.getValueState("memo", "status int, until long")

    def run(self, key, events):
        last = events[-1]
        until = int(last["ms"]) + int(last["ttl_ms"])
        self.held.update((int(last["status"]), until))
        self.rewind(until)
        yield key[0], int(last["status"]), until, "remembered"

    def expire(self, key, at):
        status, until = self.held.get()
        self.held.clear()
        yield key[0], status, until, "forgotten"


def failure_memo(failures: DataFrame, key: str, millis: str, tie: str, status: str, late: str = "0 seconds") -> DataFrame:
    """key, status, until, event: the last failure of each key in a micro-batch, remembered until its time to live is over."""
    timed = failures.withColumn("ttl_ms", source_failure(F.col(status))["ttl_ms"]).where("ttl_ms > 0").withColumnRenamed(status, "status")
    return _keyed(timed, [key], millis, tie, late, ["status", "ttl_ms"], _Memo(), f"key {dict(failures.dtypes)[key]}, status int, until long, event string")


class _Ledger(_Ordered):
    names = ("key", "model", "day_ms", "requests", "tokens", "refused", "closed")

    def __init__(self, budget: int):
        self.budget = budget

    def open(self, handle):
        self.sums = handle.getValueState("sums", "requests long, tokens long, refused long")

    def run(self, key, events):
        requests, tokens, refused = self.sums.get() or (0, 0, 0)
        for e in events:
            if tokens + int(e["tokens"]) > self.budget:
                refused += 1
            else:
                requests, tokens = requests + 1, tokens + int(e["tokens"])
        self.sums.update((requests, tokens, refused))
        self.rewind(int(key[2]) + DAY)
        return ()

    def expire(self, key, at):
        requests, tokens, refused = self.sums.get()
        self.sums.clear()
        yield key[0], key[1], int(key[2]), requests, tokens, refused, True


def token_ledger(calls: DataFrame, key: str, model: str, millis: str, tie: str, tokens: str, budget: int, late: str = "0 seconds") -> DataFrame:
    """key, model, day_ms, requests, tokens, refused, closed: one row for each key, model and UTC day when the day is over. A call whose
    tokens would pass the day's ``budget`` is refused and counted as such."""
    dated = calls.select(F.col(key).alias("key"), F.col(model).alias("model"), (F.col(millis) - F.pmod(millis, F.lit(DAY))).alias("day_ms"), F.col(tokens).alias("tokens"), millis, tie)
    kind = dict(calls.dtypes)
    return _keyed(dated, ["key", "model", "day_ms"], millis, tie, late, ["tokens"], _Ledger(budget), f"key {kind[key]}, model {kind[model]}, day_ms long, requests long, tokens long, refused long, closed boolean")
