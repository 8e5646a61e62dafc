"""Stateful rules as batch replays of event logs: windows over time, streaks, strikes, budgets, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.functions.predicates import source_failure
from catalume.operators.pick import running_totals


def sliding_sum(df: DataFrame, keys: list[str], millis: str, value: str, span: int, name: str) -> DataFrame:
    """The sum of ``value`` over (t - span, t] of each key; ``millis`` is the event time in integer units."""
    frame = Window.partitionBy(*keys).orderBy(millis).rangeBetween(-(span - 1), 0)
    return df.withColumn(name, F.sum(value).over(frame))


def streaks(df: DataFrame, keys: list[str], order: list[str], failed: Column, name: str = "streak") -> DataFrame:
    """The running count of failures since the last success; successes have 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_f", failed.cast("int"))
    marked = marked.withColumn("_island", F.sum(1 - F.col("_f")).over(w))
    return marked.withColumn(name, F.sum("_f").over(Window.partitionBy(*keys, "_island").orderBy(*order))).drop("_f", "_island")


def two_strikes(df: DataFrame, keys: list[str], time: str, order: list[str], failed: Column, apart: int) -> DataFrame:
    """Failures that are ``apart`` or more time units after the first failure since the last success."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_f", failed.cast("int")).withColumn("_island", F.sum(1 - F.col("_f")).over(w))
    first = F.min(F.when(F.col("_f") == 1, F.col(time))).over(Window.partitionBy(*keys, "_island").orderBy(*order))
    out = marked.withColumn("first_strike", first)
    return out.where((F.col("_f") == 1) & (F.col(time) - F.col("first_strike") >= apart)).drop("_f", "_island")


def grant(df: DataFrame, keys: list[str], bucket: Column, order: list[str], want: str, cap: int, name: str = "granted") -> DataFrame:
    """A budget of ``cap`` for each key, given in order: least(want, what earlier requests left)."""
    out = running_totals(df, keys, bucket, order, F.col(want), "_upto")
    return out.withColumn(name, F.least(F.col(want), F.greatest(F.lit(0), F.lit(cap) - F.col("_upto") + F.col(want)))).drop("_upto")


def evict(df: DataFrame, group: list[str], bucket: Column, order: list[str], size: str, keep: float) -> DataFrame:
    """The oldest rows of each group to remove until at most ``keep`` of the group's size is left."""
    out = running_totals(df, group, bucket, order, F.col(size), "_upto").join(df.groupBy(*group).agg(F.sum(size).alias("_all")), group)
    return out.where(F.col("_all") - F.col("_upto") + F.col(size) > F.col("_all") * keep).drop("_upto", "_all")


def cursor(df: DataFrame, keys: list[str], id_: str, done: Column) -> DataFrame:
    """The last id before the first row that is not done, by key; null if the first row is not."""
    stop = df.groupBy(*keys).agg(F.min(F.when(~done, F.col(id_))).alias("_stop"))
    reached = df.join(stop, keys).where(F.col("_stop").isNull() | (F.col(id_) < F.col("_stop"))).groupBy(*keys).agg(F.max(id_).alias("cursor"))
    return stop.select(*keys).join(reached, keys, "left")


def fixed_windows(df: DataFrame, keys: list[str], millis: str, span: int) -> DataFrame:
    """Adds window_start and hits: a window opens at a key's first hit and takes all hits within ``span``; the next hit opens another.

    Where a window ends depends on the one before, so a key's times are folded in order (a limiter's key is one user or address).
    """
    times = df.groupBy(*keys).agg(F.array_sort(F.collect_list(millis)).alias("_t"))
    start = F.expr("named_struct('at', cast(null as bigint), 'n', 0, 'out', cast(array() as array<struct<t:bigint,start:bigint,hits:int>>))")

    def step(s: Column, t: Column) -> Column:
        opens = s["at"].isNull() | (t >= s["at"] + span)
        at, n = F.when(opens, t).otherwise(s["at"]), F.when(opens, 1).otherwise(s["n"] + 1)
        return F.struct(at.alias("at"), n.alias("n"), F.concat(s["out"], F.array(F.struct(t.alias("t"), at.alias("start"), n.alias("hits")))).alias("out"))

    folded = times.select(*keys, F.explode(F.aggregate("_t", start, step)["out"]).alias("_h"))
    return folded.select(*keys, F.col("_h.t").alias(millis), F.col("_h.start").alias("window_start"), F.col("_h.hits").alias("hits"))


def sliding_limiter(df: DataFrame, keys: list[str], millis: str, span: int, limit: int) -> DataFrame:
    """keys, time, allowed, retry_ms: at most ``limit`` recorded hits within ``span``. Denied hits are not recorded, so the answer to
    one depends on those before it, and a key's times are folded; the state holds ``limit`` times at most.
    """
    times = df.groupBy(*keys).agg(F.array_sort(F.collect_list(millis)).alias("_t"))
    start = F.expr("named_struct('live', cast(array() as array<bigint>), 'out', cast(array() as array<struct<t:bigint,allowed:boolean,retry:bigint>>))")

    def step(s: Column, t: Column) -> Column:
        live = F.filter(s["live"], lambda x: x > t - span)
        ok = F.size(live) < limit
        retry = F.when(ok, F.lit(0).cast("long")).otherwise(F.get(live, F.lit(0)) + span - t)
        return F.struct(F.when(ok, F.concat(live, F.array(t))).otherwise(live).alias("live"), F.concat(s["out"], F.array(F.struct(t.alias("t"), ok.alias("allowed"), retry.alias("retry")))).alias("out"))

    folded = times.select(*keys, F.explode(F.aggregate("_t", start, step)["out"]).alias("_h"))
    return folded.select(*keys, F.col("_h.t").alias(millis), F.col("_h.allowed").alias("allowed"), F.col("_h.retry").alias("retry_ms"))


def failure_backoff(df: DataFrame, keys: list[str], millis: str, failed: Column, free: int = 4, base: int = 250, most: int = 5000, expires: int = 900_000, tie: list[str] = ()) -> DataFrame:
    """Adds streak and delay_ms: nothing for the first ``free`` failures in a row, then base doubling up to ``most``; a success or a
    pause of ``expires`` ends the streak.
    """
    w = Window.partitionBy(*keys).orderBy(millis, *tie)
    gap = F.coalesce(F.col(millis) - F.lag(millis).over(w) > expires, F.lit(False))
    marked = df.withColumn("_f", failed.cast("int")).withColumn("_cut", ((F.col("_f") == 0) | gap).cast("int")).withColumn("_island", F.sum("_cut").over(w))
    out = marked.withColumn("streak", F.sum("_f").over(Window.partitionBy(*keys, "_island").orderBy(millis, *tie)))
    delay = F.when(F.col("streak") > free, F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.col("streak") - free - 1))).otherwise(0.0)
    return out.withColumn("delay_ms", delay.cast("long")).drop("_f", "_cut", "_island")


def failure_memo(df: DataFrame, key: str, millis: str, status: str, now: Column, most: int = 5000) -> DataFrame:
    """The failures still remembered at ``now``: the last of each key, until its time to live is over; the newest ``most`` keys."""
    last = df.groupBy(key).agg(F.max_by(F.struct(status, millis), F.col(millis)).alias("_l")).select(key, "_l.*")
    live = last.withColumn("_f", source_failure(F.col(status))).withColumn("until", F.col(millis) + F.col("_f.ttl_ms")).where(F.col("until") > now)
    return live.orderBy(F.desc(millis), key).limit(most).select(key, status, F.col("_f.response_status").alias("response_status"), "until")


def probe_outcome(status: Column, code: Column) -> Column:
    """ok, gone or transient for a probe of an image URL."""
    return F.when(status.between(200, 399), "ok").when(status.isin(404, 410), "gone").when(status.isNull() & code.isin("ENOTFOUND", "ECONNREFUSED"), "gone").otherwise("transient")


def host_verdicts(probes: DataFrame, host: str, outcome: str) -> DataFrame:
    """host, verdict: alive with one ok, dead if all are gone, else unknown; if several hosts were probed and all seem dead, the prober
    is at fault and all are unknown."""
    per = probes.groupBy(host).agg(F.bool_or(F.col(outcome) == "ok").alias("_ok"), F.bool_and(F.col(outcome) == "gone").alias("_gone"))
    judged = per.withColumn("_v", F.when(F.col("_ok"), "alive").when(F.col("_gone"), "dead").otherwise("unknown"))
    every = judged.agg(((F.count("*") > 1) & F.bool_and(F.col("_v") == "dead")).alias("_all"))
    return judged.crossJoin(F.broadcast(every)).select(host, F.when(F.col("_all"), "unknown").otherwise(F.col("_v")).alias("verdict"))  # one row


def host_states(checks: DataFrame, host: str, at: str, verdict: str, dead_after: int) -> DataFrame:
    """Adds failures and state after each check: a dead verdict counts, unknown changes nothing, alive resets; dead from ``dead_after``
    failures on, and until alive."""
    w = Window.partitionBy(host).orderBy(at)
    marked = checks.withColumn("_island", F.count_if(F.col(verdict) == "alive").over(w))
    failures = F.count_if(F.col(verdict) == "dead").over(Window.partitionBy(host, "_island").orderBy(at))
    return marked.withColumn("failures", failures).withColumn("state", F.when(F.col("failures") >= dead_after, "dead").otherwise("alive")).drop("_island")


def stale_pass(sources: DataFrame, outcomes: DataFrame, now: Column, gap_days: int = 7) -> DataFrame:
    """The next sources (id, row_id, available, first_missing, next_check) after a pass over stale ones, with ``action``: refreshed; a
    second 404 ``gap_days`` after the first retires the source; a first one waits that long; conflicts and other errors wait a day.
    outcomes: id, outcome (ok, conflict, 404, error)."""
    both = sources.join(outcomes, "id", "left")
    missing, seen = F.col("outcome") == "404", F.col("outcome").isNotNull()
    confirmed = missing & F.col("first_missing").isNotNull() & (F.datediff(now, "first_missing") >= gap_days)
    action = F.when(~seen, "unseen").when(F.col("outcome") == "ok", "refreshed").when(confirmed, "retired").when(missing, "waiting").otherwise("deferred")
    put = {
        "available": F.when(confirmed, False).otherwise(F.col("available")),
        "first_missing": F.when(F.col("outcome") == "ok", None).when(missing, F.coalesce("first_missing", now)).otherwise(F.col("first_missing")),
        "next_check": F.when(F.col("outcome") == "ok", None).when(confirmed | ~seen, F.col("next_check")).when(missing, now + F.expr(f"interval {gap_days} days 1 hour")).otherwise(now + F.expr("interval 1 day")),
    }
    return both.select(*[put.get(c, F.col(c)).alias(c) for c in sources.columns], action.alias("action"))


def rows_without_source(rows: DataFrame, sources: DataFrame, touched: DataFrame) -> DataFrame:
    """The rows of ``touched`` (row_id) that no available source holds up: what a pass may delete."""
    live = sources.where("available").select("row_id")
    return rows.join(touched.select("row_id").distinct(), F.col("id") == F.col("row_id"), "left_semi").join(live, F.col("id") == F.col("row_id"), "left_anti")


def cooled_down(rows: DataFrame, log: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Rows without a blocked or conflicting log entry in the last ``days``, and never undone. log: id, kind, created_at."""
    recent = F.col("kind").isin("blocked", "conflict") & (F.col("created_at") > now - F.expr(f"interval {days} days"))
    return rows.join(log.where(recent | (F.col("kind") == "undone")).select("id").distinct(), "id", "left_anti")


def under_cap(rows: DataFrame, tries: DataFrame, cap: int = 3) -> DataFrame:
    """Rows (id, key) with fewer than ``cap`` tries on their present key; tries on an older key do not count."""
    used = tries.groupBy("id", "key").agg(F.count("*").alias("_n")).where(F.col("_n") >= cap)
    return rows.join(used, ["id", "key"], "left_anti")
