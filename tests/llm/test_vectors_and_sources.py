"""Vector codes, divergence of sources and repeated substrings against SQL and plain versions, on sample tables and awkward rows."""

from __future__ import annotations

import hashlib
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from catalume.llm import divergence, substrings, vector_codes
from catalume.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def in_duckdb(name: str, table: str, path: str, columns: list[str]) -> list[tuple]:
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall(), key=repr)


def test_vector_codes_match_sql(spark):
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = sorted((tuple(r) for r in QUERIES["op11_vector_codes"](spark, DATA).select(*names).collect()), key=repr)
    assert got == in_duckdb("op11_vector_codes", "embeddings", f"{DATA}/embeddings.parquet", names)


def test_vector_codes_on_awkward_rows(spark, tmp_path):
    """Nulls, values that are not finite, repeated rows, null labels, clashing columns; fewer rows than entries."""
    good = [[float(i % 7) - i / 9 for i in range(k, k + 16)] for k in range(5)]
    rows = [(1, good[0], 1), (2, None, 1), (3, [None, *good[1][1:]], 2), (4, [NAN, *good[1][1:]], 2), (5, [*good[1][1:], -INF], None),
            (6, good[2], None), (7, good[3], None), (8, good[3], 2), (8, good[3], 2), (9, [-0.001] * 16, 3), (10, [100_000.25] * 16, 3)]
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, _label long").coalesce(1).write.parquet(path)
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = sorted((tuple(r) for r in QUERIES["op11_vector_codes"](spark, str(tmp_path)).select(*names).collect()), key=repr)
    assert [r[0] for r in got] == [1, 10, 6, 7, 8, 8, 9]
    assert got == in_duckdb("op11_vector_codes", "embeddings", f"{path}/*.parquet", names)


def test_vectors_of_other_lengths_and_no_vectors(spark, tmp_path):
    schema = "vec_id long, vector array<double>, label int"
    rows = spark.createDataFrame([(1, [0.5] * 32, 1), (2, [0.25] * 16, 1), (None, [1.0] * 32, None), (3, [], 2)], schema)
    got = {r.vec_id: (r.code is None, r.error, r.label_error) for r in vector_codes.compress(rows).collect()}
    assert got == {1: (False, 0, 0), 2: (True, None, 0), 3: (True, None, None), None: (False, 0, 0)}
    assert vector_codes.compress(spark.createDataFrame([(1, [NAN], 1), (2, None, 2)], schema)).collect() == []
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 15, 1)], schema))


def test_label_sums_by_salted_join(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3, i) for i in range(50)], "vec_id long, label int, error long")
    few, many = (sorted(tuple(r) for r in vector_codes.with_label_error(rows, few=n).select("vec_id", "error", "label_error").collect()) for n in (10, 1))
    assert few == many and few[3] == (3, 3, sum(range(0, 50, 3)))


def test_decoded_vectors_are_near(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", vector_codes.F.col("embedding").cast("array<double>").alias("vector"), "label")
    books = vector_codes.train(rows)
    back = {r.vec_id: np.array(r.vector) for r in vector_codes.decode(vector_codes.encode(rows, books), books).collect()}
    far = [np.sum((np.array(r.vector) - back[r.vec_id]) ** 2) / np.sum(np.array(r.vector) ** 2) for r in rows.collect()]
    assert np.mean(far) < 0.6


def plain_audit(rows: list[tuple], least: int = 3, top: int = 200) -> set[tuple]:
    own, found, totals = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = "".join(c.lower() if c.isascii() and c.isalpha() else c if ord(c) >= 128 else " " for c in text or "").split(" ")
        words = [w for w in words if w]
        own[lang or "", source or ""].update(words)
        found[lang or ""].update(set(words))
        totals[lang or ""].update(words)
    out = set()
    for lang in found:
        kept = sorted(t for t, n in found[lang].items() if n >= least)

        def share(counts, kept=kept):
            whole = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // whole for t in kept}

        groups = {s: share(c) for (g, s), c in own.items() if g == lang}
        base = share(totals[lang])
        for s, p in groups.items():
            pairs = [(sum((p[t] - q[t]) ** 2 // q[t] for t in kept), item) for item, q in groups.items() if item != s]
            marks = [((p[t] - base[t]) ** 2 // base[t], t) for t in kept if own[lang, s][t] and p[t] > base[t]]
            for part, values, most in (("pair", pairs, None), ("term", marks, top)):
                order = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(order, 1)}
    return out


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]
TEXTS = [
    (None, "en", "a"), ("", "en", None), ("One two\x00two ÉTÉ été 漢字", "en", "b"), ("one TWO-two été", "en", "b"), ("one two Été漢字x", "en", "b"), ("one two ÉTÉ", None, None),
    ("word " * 40_000, "en", "c"), ("word one", "en", "d"), ("word two three", "en", "e"), ("two word", "en", "f"), ("two word", "en", "f"), ("x", "de", "a"), ("y", "de", "b"), ("1 2 3", "fr", "a"),
]


@pytest.mark.parametrize("options", [{}, {"lot_terms": 2, "block_groups": 1}, {"lot_terms": 3, "block_groups": 3, "top": 2}])
def test_divergence_of_awkward_rows(spark, options):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in TEXTS], "text string, lang string, source string, term string, n long, lot int")
    got = [tuple(r) for r in divergence.audit(docs, **options).select(*COLUMNS).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(TEXTS, top=options.get("top", 200))


def test_divergence_of_sample_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text", "lang", "source").collect()]
    got = [tuple(r) for r in QUERIES["op12_source_divergence"](spark, DATA).select(*COLUMNS).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows)
    assert sorted(got, key=repr) == in_duckdb("op12_source_divergence", "documents", f"{DATA}/documents.parquet", COLUMNS)


def test_divergence_of_no_documents(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_shares_are_exact_for_large_counts():
    counts = [0, 1, 12_345_678_901, 999_999_999_999_999]
    got = divergence.shares(np.array(counts), 10**15, 77).tolist()
    assert got == [1 + 10**9 * (c + 1) // (10**15 + 77) for c in counts]


@pytest.mark.parametrize("blocks", [1, 2, 5, 6])
def test_tournament_meets_each_pair_once(spark, blocks):
    rounds = blocks + blocks % 2 - 1
    table = spark.range(blocks).withColumnRenamed("id", "block")
    met = Counter()
    for turn in range(rounds):
        other = divergence.opponent(divergence.F.col("block"), divergence.F.lit(blocks), turn)
        rows = {r[0]: r[1] for r in table.select("block", other).collect()}
        assert all(rows.get(rows[b], b) == b for b in rows)
        met.update(tuple(sorted((b, o))) for b, o in rows.items() if o < blocks and b < o)
    assert met == Counter((i, j) for j in range(blocks) for i in range(j))


def plain_removal(rows: list[tuple]) -> list[tuple]:
    width, first = substrings.WIDTH, {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - width + 1 if doc_id is not None else 0):
            first[data[i : i + width]] = min(doc_id, first.get(data[i : i + width], doc_id))
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1 if doc_id is not None else 0):
            if first[data[i : i + width]] < doc_id:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(g and not before for g, before in zip(gone, b"\0" + gone, strict=False))
        out.append((doc_id, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removal(docs, **options) -> list[tuple]:
    rows = substrings.dedup_substrings(docs, **options).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.starts), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows), key=repr)


PASSAGE = "The committee shall meet in the first week of each quarter, unless its chair decides otherwise. "
SPREAD = np.random.default_rng(7)
NOISE = ["".join(SPREAD.choice(list("abcdefgh "), 120)) for _ in range(30)]
ODD = [
    (1, None), (2, ""), (3, PASSAGE[:49]), (4, PASSAGE[:49]), (5, PASSAGE), (6, PASSAGE), (6, PASSAGE), (None, PASSAGE), (7, "a" * 300), (8, "b" + "a" * 200 + "b"), (9, "ab" * 90), (0, "ba" * 60),
    (10, "é漢" * 400 + PASSAGE), (11, PASSAGE[1:60] + "é漢" * 30), (12, PASSAGE * 400), (-5, PASSAGE[10:70] + "\0" * 70), (13, "\0" * 60 + "x"), (13, "y" + "\0" * 55), (14, "short"),
    *((20 + i, NOISE[i] + PASSAGE[20:80] + NOISE[(i * 7) % 30][:90]) for i in range(30)),
]


@pytest.mark.parametrize("options", [{}, {"hot": 2, "bucket_bytes": 500}, {"chunk_bytes": 700, "hot": 9, "bucket_bytes": 500}, {"chunk_bytes": 64, "hot": 4}])
def test_substrings_of_awkward_rows(spark, options):
    docs = spark.createDataFrame([(*r, "x", 1, b"") for r in ODD], "doc_id long, text string, kept string, piece int, starts binary").repartition(3)
    assert removal(docs, **options) == plain_removal(ODD)


def test_substrings_of_sample_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    want = plain_removal([tuple(r) for r in docs.collect()])
    got = [tuple(r) for r in QUERIES["op13_substring_dedup"](spark, DATA).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=repr) == want
    assert sum(r[2] for r in want) > 0


def test_multikey_order(spark):
    rows = np.random.default_rng(3).integers(0, 3, (4000, 13)).astype(np.uint8)
    order, shared = substrings.sorted_runs(rows)
    want = sorted(bytes(r) for r in rows)
    assert [bytes(r) for r in rows[order]] == want
    for i in range(1, len(want)):
        same = next((k for k in range(13) if want[i][k] != want[i - 1][k]), 13)
        assert shared[i] == same


def test_anchors_are_found_in_bounded_memory():
    """Hashes of all positions of a chunk, and several copies of them, were held at once: over 30 bytes for each byte of text."""
    rng, spread = np.random.default_rng(5), [0, 3, 49, 50, 51, 700, 3000]
    lengths = np.array([spread[i] for i in rng.integers(0, len(spread), 900)])
    ends = np.cumsum(lengths)
    data = rng.integers(97, 100, int(ends[-1])).astype(np.uint8).tobytes() + bytes(64)
    whole = substrings.anchors(data, ends - lengths, ends, block=len(data))
    for block in (300, 4096):
        assert all(np.array_equal(a, b) for a, b in zip(whole, substrings.anchors(data, ends - lengths, ends, block=block), strict=True))
    data = rng.integers(97, 110, 4 << 20).astype(np.uint8).tobytes() + bytes(64)
    tracemalloc.start()
    try:
        substrings.anchors(data, np.array([0]), np.array([4 << 20]))
        assert tracemalloc.get_traced_memory()[1] < 80 << 20
    finally:
        tracemalloc.stop()


def test_buckets_of_a_table_whose_parts_differ(spark, monkeypatch):
    """Buckets were cut by a fixed number of chunks; texts unlike those all came into one bucket, which one task holds."""
    rng, sizes = np.random.default_rng(11), {}
    passages = {k: ["".join(rng.choice(list(letters), 80)) for _ in range(400)] for k, letters in (("low", "abcdefgh"), ("high", "stuvwxyz"))}
    rows = [(i, " ".join(passages["low" if i < 400 else "high"][j] for j in rng.integers(0, 400, 5))) for i in range(800)]
    sort_buckets = substrings.sort_buckets

    def seen(sent):
        for r in sent.select("part", "a").collect():
            sizes[r.part] = sizes.get(r.part, 0) + len(substrings.loose(bytes(r.a), f"V{substrings.BACK + substrings.WIDTH + 2}"))
        return sort_buckets(sent)

    monkeypatch.setattr(substrings, "sort_buckets", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert removal(docs, chunk_bytes=4000, bucket_bytes=40_000, sampled=1) == plain_removal(rows)
    assert max(sizes.values()) < 0.25 * sum(sizes.values())


def test_large_buckets_are_judged_in_portions():
    """A bucket was judged as a whole, however large: several hundred bytes for each suffix."""
    rng = np.random.default_rng(2)
    leads, width = rng.integers(97, 123, (60, substrings.GRAM)), substrings.BACK + substrings.WIDTH + 2
    contexts = rng.integers(97, 99, (3000, width)).astype(np.uint8)
    contexts[:, substrings.BACK : substrings.BACK + substrings.GRAM] = leads[np.minimum(rng.integers(0, 120, 3000), 59)]
    contexts[:, : substrings.BACK - 3] = contexts[:, substrings.BACK + substrings.GRAM + 3 : -2] = 97
    contexts[:, -2:] = [0, substrings.BACK]
    docs = rng.integers(0, 500, 3000)
    some = substrings.portions(contexts, 100)
    assert sorted(np.concatenate(some).tolist()) == list(range(3000)) and len(some) > 10
    counts = [Counter(bytes(c) for c in contexts[x, substrings.BACK : substrings.BACK + substrings.GRAM]) for x in some]
    assert sum(map(len, counts)) == 60 and all(len(x) - max(c.values()) < 100 for x, c in zip(some, counts, strict=True))
    bits = np.empty(3000, np.uint32)
    for x in some:
        bits[x] = substrings.judged(contexts[x], docs[x])
    assert np.array_equal(bits, substrings.judged(contexts, docs)) and bits.any()
    assert [len(x) for x in substrings.portions(contexts[:0])] == [0]
