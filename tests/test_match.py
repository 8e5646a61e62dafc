"""Entity matching on small graphs whose shape is awkward."""

from __future__ import annotations

from catalume.operators import match


def test_components_of_a_chain_with_falling_labels(spark):
    chain = [1, *range(300, 199, -1), 2]
    edges = [*zip(chain, chain[1:]), (1000, 1001), (1002, 1002)]
    got = match.components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert {r.node: r.label for r in got.collect()} == dict.fromkeys(chain, 1) | {1000: 1000, 1001: 1000, 1002: 1002}


def test_components_of_the_query(spark):
    """The registered query against union-find over the same links."""
    from catalume.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for r in spark.read.parquet(f"{folder}/orders.parquet").select("o_custkey", "o_orderkey").collect():
        a, b = find(r.o_custkey), find(r.o_custkey + 7 * (r.o_orderkey % 3 + 1))
        root[max(a, b)] = min(a, b)
    assert {r.node: r.label for r in QUERIES["components"](spark, folder).collect()} == {i: find(i) for i in list(root)}


def test_similar_sets_meet_by_rare_words_only(spark):
    """In a block with one word in every row, candidates stay few, and none that is similar is missed."""
    import random

    deal = random.Random(5)
    names = ["the " + " ".join(deal.sample([f"w{i}" for i in range(400)], deal.randint(2, 7))) for _ in range(400)]
    names += [n + " more" for n in names[:40]] + names[:20] + ["the", ""]
    rows = spark.createDataFrame([(i, 1, n.split()) for i, n in enumerate(names)] + [(-1, 1, None), (-2, 2, ["the"]), (-3, None, ["the"])], "id int, g int, w array<string>")
    sets = sorted({tuple(sorted(set(n.split()))) for n in names if n})
    alike = lambda a, b: 2 * len(set(a) & set(b)) / (len(a) + len(b))
    for least in (0.5, 0.8, 0.96):
        want = {(a, b) for a in sets for b in sets if alike(a, b) >= least}
        found = match.similar_sets(rows, rows, ["g"], "w", least).where("g = 1").collect()
        assert {(tuple(r.l), tuple(r.r)) for r in found} == want and len(found) == len(want)
        assert all(abs(r.score - alike(r.l, r.r)) < 1e-9 for r in found)
        met = match.candidate_sets(rows, rows, ["g"], "w", least).where("g = 1").count()
        assert met < len(sets) ** 2 / (8 if least == 0.5 else 40)  # all pairs share a word


def test_waterfall_joins_only_the_first_of_candidates_that_share_a_value(spark):
    """Many rows and many candidates with one value were all multiplied before the first was taken."""
    import random

    from pyspark.sql import functions as F

    deal = random.Random(3)
    rows = [(i, deal.choice([None, 1, 2, 3]), deal.choice([None, *range(40)])) for i in range(60)]
    found = [(i, deal.choice([None, 1, 2]), deal.choice(["a", "b", None])) for i in range(40)]
    want = {}
    for i, one, two in rows:
        tests = [lambda c: c[2] == "a" and one == c[1], lambda c: two == c[0]]
        first = next(((n + 1, min(c[0] for c in fits)) for n, t in enumerate(tests) if (fits := [c for c in found if t(c) and None not in (c[1], c[0]) and c[0] % 5])), None)
        if first:
            want[i] = first
    c = spark.createDataFrame(found, "c int, g int, m string").where("g is not null")
    left = spark.createDataFrame(rows, "i int, one int, two int")
    out = match.waterfall(left, "i", [(c.where("m = 'a'"), {"g": F.col("one")}), (c, {"c": F.col("two")})], ["c"], F.col("c") % 5 == 0)
    assert {r.i: (r.rule, r.c) for r in out.collect()} == want
    many = spark.range(100_000).select("id", F.lit(1).alias("g"))  # as pairs these are ten thousand million
    out = match.waterfall(many, "id", [(many.withColumnRenamed("id", "c"), {"g": F.col("g")})], ["c"])
    assert out.agg(F.count("*"), F.max("c"), F.max("rule")).first() == (100_000, 0, 1)
