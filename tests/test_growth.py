"""What grows with the tables: rows that a step makes of each row, and rows that meet in one task."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalume.operators import match, resolve, writes


def test_numbers_of_slugs_are_no_rows(spark):
    """A new slug made 98 rows, whether it needed a number or not."""
    made = spark.createDataFrame([(i, "A B", None) for i in range(1, 5)] + [(9, "C", 2000)], "k int, title string, year int")
    taken = spark.createDataFrame([(x,) for x in ("a-b-2", "a-b-04", "a-b-3-3", "a-b-99999999999", "c-2", None)], "slug string")
    slugs = writes.unique_slugs(made, taken, "k", "title", "year")
    assert {r.k: r.slug for r in slugs.collect()} == {1: "a-b", 2: "a-b-3", 3: "a-b-4", 4: "a-b-5", 9: "c"}
    assert "Generate" not in slugs._jdf.queryExecution().optimizedPlan().toString()
    few = writes.unique_slugs(made, taken, "k", "title", "year", most=3)
    assert {r.k: r.slug for r in few.where("k > 2").collect()} == {3: "a-b-3", 4: "a-b-4", 9: "c"}


def test_short_sets_meet_only_their_equals(spark, monkeypatch):
    """Twelve words are like the same twelve and one more; eleven are like no other set, and are not taken apart."""
    seen = []
    similar = match.similar_sets
    monkeypatch.setattr(match, "similar_sets", lambda left, right, *rest: (seen.extend((left, right)), similar(left, right, *rest))[1])
    words = lambda n, *more: [f"w{i:02d}" for i in range(n)] + list(more)
    shape = "k int, g int, w array<string>, v array<string>"
    left = spark.createDataFrame([(1, 1, words(12, "x"), []), (2, 1, words(11, "x"), None), (3, 1, ["b", "a", "a"], []), (4, 1, [], ["q"]), (5, 2, ["a", "b"], [])], shape)
    right = spark.createDataFrame([(10, 1, words(12), []), (11, 1, words(11), ["q"]), (12, 1, ["a", "b"], []), (13, 1, ["a", "b"], [])], shape)
    got = match.fuzzy_match(left, right, ["g"], ["w", "v"], 0.96, ["k"])
    assert sorted((r.k, r.r_k, round(r.score, 4)) for r in got.collect()) == [(1, 10, 0.96), (3, 12, 1.0), (4, 11, 1.0)]
    assert [sorted(len(r[0]) for r in side.select("_set").collect()) for side in seen] == [[12, 13], [12]]


def test_rows_that_ask_nothing_stay_where_they_are(spark):
    """All rows without a path met in the task of the null key."""
    rows = spark.range(4000).select("id", F.when(F.col("id") % 100 == 0, F.concat(F.lit("/"), "id")).alias("p"), F.lit(1).alias("d"))
    other = spark.range(0, 4000, 200).select(F.concat(F.lit("/"), "id").alias("p"), F.lit(1).alias("d"), F.lit(True).alias("there"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = resolve.met_by(rows, other, ["p", "d"])
        found = out.groupBy(F.spark_partition_id().alias("n")).agg(F.count("*").alias("c")).collect()
        told = {r.id: r.there for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(told) == 4000 and {k for k, v in told.items() if v} == set(range(0, 4000, 200))
    assert max(r.c for r in found) < 1000
