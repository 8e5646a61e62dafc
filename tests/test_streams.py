"""Streams replayed in micro-batches with a restart against the batch forms, and tables that take each batch once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from catalume.operators import state, writes
from catalume.streaming import keyed, sink

EVENTS = "who string, ms long, n long, bad boolean, outcome string, status int, tokens long"
FAR = 10**12


def events():
    rng, out, t = random.Random(5), [], 0
    for i in range(120):
        t += rng.choice([0, 1, 40, 200, 2_000_000, 90_000_000])
        out.append((rng.choice("abc"), t, i, rng.random() < 0.7, rng.choice(["ok", "404", "404", "404", "error"]), rng.choice([404, 503, 429]), rng.randrange(50)))
    return out


def replay(spark, tmp_path, make, rows):
    """Three micro-batches, the last two after a restart; then a late event of its own key that lets all timers fire."""
    source, name = f"{tmp_path}/in", f"{tmp_path}/out"
    cut = [rows[:40], rows[40:80], rows[80:], [("zzz", FAR, 999, False, "ok", 503, 0)], [("zzz", FAR + 1, 1000, False, "ok", 503, 0)]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
        query = make(stream).writeStream.format("parquet").option("path", name).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(120)

    try:
        for part in ([cut[0]], cut[1:3], [cut[3]], [cut[4]]):
            for rows_ in part:
                spark.createDataFrame(rows_, EVENTS).coalesce(1).write.mode("append").parquet(source)
            run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(name)


def batch(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def test_limiter_stream(spark, tmp_path):
    rows = events()
    got = replay(spark, tmp_path, lambda s: keyed.sliding_limiter(s, "who", "ms", "n", 500, 2), rows).where("who != 'zzz'")
    want = state.sliding_limiter(batch(spark, rows), ["who"], "ms", 500, 2)
    assert sorted((r.who, r.ms, r.allowed, r.retry_ms) for r in got.collect()) == sorted((r.who, r.ms, r.allowed, r.retry_ms) for r in want.collect())


def test_window_and_backoff_streams(spark, tmp_path):
    rows = events()
    got = replay(spark, tmp_path / "w", lambda s: keyed.fixed_windows(s, "who", "ms", "n", 300), rows).where("who != 'zzz'")
    want = state.fixed_windows(batch(spark, rows), ["who"], "ms", 300)
    assert sorted((r.who, r.ms, r.window_start, r.hits) for r in got.collect()) == sorted((r.who, r.ms, r.window_start, r.hits) for r in want.collect())
    apart = [(w, ms + n, n, *rest) for w, ms, n, *rest in rows]  # the batch form orders by time alone
    got = replay(spark, tmp_path / "b", lambda s: keyed.failure_backoff(s, "who", "ms", "n", "bad", 2), apart).where("who != 'zzz'")
    want = state.failure_backoff(batch(spark, apart), ["who"], "ms", F.col("bad"), 2)
    assert sorted((r.who, r.ms, r.streak, r.delay_ms) for r in got.collect()) == sorted((r.who, r.ms, r.streak, r.delay_ms) for r in want.collect())


def test_strikes_retire_and_timers_ask_again(spark, tmp_path):
    day = keyed.DAY
    say = lambda who, d, n, outcome: (who, d * day, n, False, outcome, 0, 0)
    rows = [say("a", 1, 1, "404"), say("b", 1, 2, "404"), say("c", 1, 3, "error"), *[say("p", 1, 100 + i, "ok") for i in range(37)], say("a", 3, 5, "404"), say("b", 2, 6, "ok"), say("c", 2, 7, "404"), *[say("p", 3, 200 + i, "ok") for i in range(37)], say("a", 8, 8, "404"), say("c", 8, 9, "404")]
    got = replay(spark, tmp_path, lambda s: keyed.source_strikes(s, "who", "ms", "n", "outcome"), rows).where("id not in ('zzz', 'p')")
    found = sorted((r.id, r.action) for r in got.collect())
    assert found == sorted([("a", "waiting"), ("a", "waiting"), ("a", "retired"), ("b", "waiting"), ("b", "refreshed"), ("c", "deferred"), ("c", "waiting"), ("c", "waiting"), ("c", "due")])


def test_memo_and_ledger_close_by_timer(spark, tmp_path):
    rows = events()
    got = replay(spark, tmp_path / "m", lambda s: keyed.failure_memo(s, "who", "ms", "n", "status"), rows).where("key != 'zzz'").collect()
    assert sum(r.event == "forgotten" for r in got) >= 3 and {r.key for r in got if r.event == "forgotten"} == {"a", "b", "c"}
    got = replay(spark, tmp_path / "l", lambda s: keyed.token_ledger(s, "who", "who", "ms", "n", "tokens", 60), rows).where("key != 'zzz'").collect()
    want = {}
    for who, ms, n, *_, tokens in rows:
        own = want.setdefault((who, ms - ms % keyed.DAY), [0, 0, 0])
        if own[1] + tokens > 60:
            own[2] += 1
        else:
            own[0], own[1] = own[0] + 1, own[1] + tokens
    assert {(r.key, r.day_ms): [r.requests, r.tokens, r.refused] for r in got} == want and all(r.closed for r in got)


def test_batches_take_effect_once(spark, tmp_path):
    schema = "key string, streak long, n long"
    table = sink.SnapshotTable(spark, f"file://{tmp_path}/table", schema)
    step = lambda old, new: writes.add_counters(old, new, "key", ["ms"], F.col("bad"), {"n": F.lit(True)}).select("key", "streak", "n")
    one = table.apply("calls", step)
    first, second = (spark.createDataFrame(d, "key string, ms long, bad boolean") for d in ([("a", 1, True), ("b", 1, False)], [("a", 2, True)]))
    one(first, 0)
    one(first, 0)  # delivered twice
    before = table.read()
    one(second, 1)
    one(first, 0)
    assert sorted(tuple(r) for r in table.read().collect()) == [("a", 2, 2), ("b", 0, 1)]
    assert sorted(tuple(r) for r in before.collect()) == [("a", 1, 1), ("b", 0, 1)]  # a reader that had begun


def test_a_crash_before_the_swap_changes_nothing(spark, tmp_path):
    table = sink.SnapshotTable(spark, f"file://{tmp_path}/table", "key string, n long", keep=1)
    rows = lambda n: spark.createDataFrame([("a", n)], "key string, n long")
    table.write(rows(1), "s", 0)
    swap, table._point = table._point, lambda state: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        table.write(rows(2), "s", 1)
    table._point = swap
    assert [r.n for r in table.read().collect()] == [1]
    assert table.write(rows(2), "s", 1) and not table.write(rows(9), "s", 1)
    assert [r.n for r in table.read().collect()] == [2]
    table.write(rows(3))
    assert [r.n for r in table.read().collect()] == [3] and len(table.state()["old"]) == 1


def test_a_stream_keeps_a_table(spark, tmp_path):
    table = sink.SnapshotTable(spark, f"file://{tmp_path}/table", "key string, streak long, n long")
    step = lambda old, new: writes.add_counters(old, new, "key", ["ms"], F.col("bad"), {"n": F.lit(True)}).select("key", "streak", "n")
    for part in ([("a", 1, True), ("b", 1, False)], [("a", 2, True), ("b", 2, True)]):
        spark.createDataFrame(part, "key string, ms long, bad boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key string, ms long, bad boolean").parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(table.apply("calls", step)).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(tuple(r) for r in table.read().collect()) == [("a", 2, 2), ("b", 1, 2)]
