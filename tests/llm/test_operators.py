"""The numbered operators against plain versions, on the sample documents and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from catalume.llm import binary_tokens, fingerprints, line_dedup, mixing, ngram_join, packing, quality, sharding, toxicity, tree_scoring
from catalume.llm.queries import QUERIES, SQL
from catalume.llm.tokens import encoder, vocabulary_path

DATA = "/root/testdata/sf0.001"
LONG = "word " * 30_000 + "end"
ODD = [
    (1, None, "en", None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "One two", "en", "a", 7), (5, "one TWO", "en", "b", 7),
    (6, LONG, "en", "a", len(LONG)), (7, LONG, "en", "a", len(LONG)), (8, "x y z w v u\nx y z w v u\nİé ß 漢字 don't <|endoftext|>", "de", "b", 50),
    (9, "x y z w v u\nsame line of text here\nother", "en", None, 40), (10, "same line of text here\nx y z w v u", "en", "b", 38), (10, "same line of text here\nx y z w v u", "en", "b", 38),
]
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, tokens string, size string, h1 string, part string, shard string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of awkward rows, with columns whose names clash, and of no rows."""
    top = tmp_path_factory.mktemp("odd")
    rows = [(*r, "t", "s", "h", "p", "q") for r in ODD]
    for name, data in (("odd", rows), ("none", [])):
        spark.createDataFrame(data, FIELDS).write.parquet(f"{top}/{name}/documents.parquet")
        labels = [(4, 1, 1), (5, 1, 0), (8, None, None)] if data else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/{name}/labels.parquet")
    return top


def texts(spark, where=DATA):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("op11_", "op12_"))])  # no doc_id: test_vectors_and_sources.py
def test_awkward_rows_and_empty_tables(spark, folder, name):
    rows = QUERIES[name](spark, f"{folder}/odd").collect()
    assert {r.doc_id for r in rows} == set(range(1, 11))
    assert len(rows) >= len(ODD)
    assert QUERIES[name](spark, f"{folder}/none").collect() == []


def test_line_dedup_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(con.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({SQL['op5_line_dedup']})").fetchall())
    got = sorted(tuple(r) for r in line_dedup.op5_line_dedup(spark, DATA).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    assert got == want


def test_runs_compact(spark):
    from catalume.llm.common import Scratch

    scratch, runs = Scratch(spark, "test"), line_dedup.LevelledRuns(spark, fanout=2, buckets=2)
    seen = []
    for i in range(5):
        keys = scratch.save(spark.createDataFrame([(i, 1, 1), (i, 2, i), (i, 3, i % 2)], "doc_id long, h1 long, h2 long"), "k")
        seen.append(sorted(tuple(r) for r in runs.add(keys, scratch).collect()))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert seen[0] == [] and seen[1] == [(1, 1, 1)] and seen[4] == [(4, 1, 1), (4, 3, 0)]
    runs.close()


def plain_components(docs):
    sets, inverted = {}, defaultdict(list)
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in inverted[s])
        for s in sets[i]:
            inverted[s].append(i)
        for j, k in common.items():
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies():
    """A base text, copies with more and more words changed, and two texts that only middling copies link."""
    rng, base = np.random.default_rng(5), [f"w{i}" for i in range(400)]
    out = [(1000, " ".join(base)), (1001, " ".join(base).upper())]
    for i in range(60):
        own = list(base)
        for at in rng.choice(400, i // 4, replace=False):
            own[at] = f"z{i}_{at}"
        out.append((i, " ".join(own)))
    for i in range(20):  # a chain: each is linked with the next only
        out.append((2000 + i, " ".join(f"c{j}" for j in range(i * 9, i * 9 + 100))))
    return out


def test_join_finds_all_components(spark):
    docs = near_copies() + [(10_000 + i, t) for i, t in texts(spark)[:100]]
    want = plain_components(docs)
    got = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), block=16)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def test_join_finds_all_links(spark):
    docs = near_copies() + [(10_000 + i, t) for i, t in texts(spark)[:100]] + [(20_000, None), (20_001, " ")]
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset() for i, w in ((i, (t or "").encode().lower().split()) for i, t in docs)}
    links, n_links = set(), Counter()
    for i, x in sets.items():
        for j, y in sets.items():
            if i != j and x and y and 5 * len(x & y) >= 4 * len(x | y):
                n_links[i] += 1
                links |= {frozenset((x, y))} if x != y else set()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = ngram_join.near_duplicates(table, block=16).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: n_links[i] for i in sets}
    found, rows = ngram_join.near_duplicate_links(table, block=16)
    class_of = {r.class_id: sets[r.doc_id] for r in rows.collect()}
    pairs = [frozenset((class_of[r.a], class_of[r.b])) for r in found.collect()]
    assert len(pairs) == len(links) > 300 and set(pairs) == links
    assert "n_links" in ngram_join.op1_ngram_jaccard_join(spark, DATA).columns


def test_join_keeps_apart_texts_of_one_doc_id(spark):
    words = [[f"w{k}_{i}" for i in range(120)] for k in range(2)]
    close = [" ".join([*w[:-1], "other"]) for w in words]
    rows = [(10, " ".join(words[0])), (10, " ".join(words[1])), (20, close[0]), (30, close[1]), (40, "w w w w w w"), (None, close[1].upper())]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.n_links) for r in got) == [(0, 10, 2), (10, 10, 1), (10, 10, 2), (20, 10, 1), (30, 10, 2), (40, 40, 0)]
    table = spark.createDataFrame(rows[:1] + [(10, "one two three four five six")] + rows[2:3], "doc_id long, text string")
    kept = ngram_join.keep_first(table.withColumn("_id", F.lit(1)).withColumn("_copy", F.lit(2)))
    assert sorted(r.text[:5] for r in kept.collect()) == ["one t", "w0_0 "] and kept.columns == ["doc_id", "text", "_id", "_copy"]


def test_join_around_the_threshold(spark):
    """One large group whose pairs lie just under and just over the threshold, in many blocks."""
    rng, base = np.random.default_rng(8), [f"w{i}" for i in range(150)]
    docs = []
    for i in range(400):
        own = list(base)
        for at in rng.choice(150, int(rng.integers(1, 5)), replace=False):
            own[at] = f"z{i}_{at}"
        docs.append((i, " ".join(own[: int(rng.integers(110, 150))])))
    want = plain_components(docs)
    assert 5 < len({c for _, c in want.values()}) < 390
    got = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), block=32, most=5000).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_overlaps_are_exact():
    rng = np.random.default_rng(2)
    core = np.unique(rng.integers(0, 1 << 40, 300)).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(core, int(rng.integers(1, len(core)))), rng.integers(0, 1 << 40, int(rng.integers(0, 200))).astype(np.uint64)])) for _ in range(40)]
    for same, xs, ys in ((False, sets[:17], sets[17:]), (True, sets, sets)):
        got = ngram_join.overlaps(xs, ys, same, slab=64)
        want = np.array([[len(np.intersect1d(x, y)) for y in ys] for x in xs])
        assert ((got == want) | (np.eye(*want.shape, dtype=bool) if same else False)).all()
    keys = np.unique(rng.integers(0, 1 << 48, 1000)).astype(np.uint64)
    for own in (keys, keys[:1], keys[:0], np.arange(50, dtype=np.uint64)):
        assert (ngram_join.unpacked(ngram_join.packed(own)) == own).all()


def test_fingerprints_estimate_likeness(spark):
    docs = sorted(texts(spark))
    got = {r.doc_id: r for r in fingerprints.op2_weighted_fingerprints(spark, DATA).collect()}
    off = []
    for (i, t), (_, n) in zip(docs, [*docs[1:], docs[0]], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = Counter(t.lower().split()), Counter(edited.lower().split())
        off.append(got[i].near_edited - sum((a & b).values()) / max(1, sum((a | b).values())))
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.12
    by_text = defaultdict(set)
    for i, t in docs:
        by_text[t].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def plain_fingerprint(text, count=128, seed=3):
    """The signature by a loop over samples and words."""

    def mixed(*parts):
        state = 42
        for value, width in parts:
            state = xxhash.xxh64_intdigest(value.to_bytes(width, "little"), state)
        return state

    quantiles = fingerprints.gamma_quantiles()
    words = Counter(w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w) or Counter([""])
    hashes = {xxhash.xxh64_intdigest(w.encode(), 42): n for w, n in words.items()}
    out = []
    for k in range(count):
        least = []
        for h, n in hashes.items():
            u = mixed((seed + k, 4), (h, 8))
            r, c, b = quantiles[u & 1023], math.log(quantiles[(u >> 10) & 1023]), ((u >> 20) & 0xFFFFF) / 2**20
            t = math.floor(math.log(n) / r + b)
            least.append((math.floor((c - r * (t - b + 1) + 60) * 2**24), ((u >> 40) + t * 40503) & 0xFFFF))
        out.append(f"{min(least)[1]:04x}")
    return out


def test_fingerprints_match_the_plain_signature(spark):
    docs = sorted(texts(spark))
    got = {r.doc_id: r for r in fingerprints.op2_weighted_fingerprints(spark, DATA).collect()}
    own = {i: [r.fingerprint[k : k + 4] for k in range(0, 512, 4)] for i, r in got.items()}
    for (i, t), (j, n) in zip(docs, [*docs[1:], docs[0]], strict=True):
        assert got[i].near_next == sum(a == b for a, b in zip(own[i], own[j], strict=True)) / 128
        if len(t) < 1500 and i % 10 == 0:
            assert own[i] == plain_fingerprint(t)
            half = len(t) // 2
            new = plain_fingerprint(t[: len(t) - half] + n[:half])
            assert got[i].edited_fingerprint == "".join(new) and got[i].near_edited == sum(a == b for a, b in zip(own[i], new, strict=True)) / 128


def test_fingerprints_hold_enough_samples(spark):
    docs = sorted(texts(spark))
    got = {r.doc_id: r for r in fingerprints.op2_weighted_fingerprints(spark, DATA).collect()}
    assert {len(r.fingerprint) for r in got.values()} == {128 * 4}
    off = []
    for (i, t), (_, n) in zip(docs, [*docs[1:], docs[0]], strict=True):
        half = len(t) // 2
        a, b = Counter(t.lower().split()), Counter((t[: len(t) - half] + n[:half]).lower().split())
        off.append(got[i].near_edited - sum((a & b).values()) / max(1, sum((a | b).values())))
    assert np.std(off) < 0.06


def test_base_scores_and_counts(spark):
    docs = texts(spark)
    counts = Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in tree_scoring.op3_context_tree_scoring(spark, DATA).collect()}
    for i, t in docs:
        w = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)


def plain_tree_scores(train, streams, depth):
    nodes, memo = {}, {}

    def steps(s):
        s = b"\n" * depth + s
        for i in range(depth, len(s)):
            for j in range(8):
                yield [(s[i - d : i], (1 << j) | (s[i] >> (8 - j))) for d in range(depth + 1)], (s[i] >> (7 - j)) & 1

    def own(k):
        z, o = nodes[k]
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    def weighted(k):
        if k not in nodes:
            return 0.0
        if k not in memo:
            memo[k] = own(k)
            if len(k[0]) < depth:
                memo[k] = np.logaddexp(own(k), sum(weighted((bytes([c]) + k[0], k[1])) for c in range(256))) + math.log(0.5)
        return memo[k]

    for s in train:
        for path, bit in steps(s):
            for k in path:
                nodes.setdefault(k, [0, 0])[bit] += 1
    out = []
    for s in streams:
        total = 0.0
        for path, bit in steps(s):
            p = None
            for k in reversed(path):
                n = nodes.get(k, [0, 0])
                estimate = (n[bit] + 0.5) / (sum(n) + 1)
                share = math.exp(math.log(0.5) + own(k) - weighted(k)) if k in nodes else 0.5
                p = estimate if p is None else share * estimate + (1 - share) * p
            total += math.log10(p)
        out.append(total)
    return out


@pytest.mark.parametrize("depth", [3, 5])
def test_tree_scores(spark, depth):
    docs = [(1, "The cat sat on the mat. The cat", False), (2, "a dog sat on a mat", False), (3, "the dog é sat", True), (4, None, False), (5, "", True)]
    got = tree_scoring.score(spark.createDataFrame(docs, "doc_id long, text string, held boolean"), depth=depth, chunk_bytes=20)
    streams = [tree_scoring.stream(t.encode() if t else None) for _, t, _ in docs]
    want = plain_tree_scores([s for s, d in zip(streams, docs, strict=True) if not d[2]], streams, depth)
    found = {r.doc_id: r.score for r in got.collect()}
    assert np.allclose([found[i] for i, _, _ in docs], want, atol=1e-6)


def test_toxicity_on_held_out_rows(spark):
    where = "/root/testdata/sf0.01"
    got = toxicity.op4_toxicity(spark, where).join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in got)
    assert right >= 0.95 * len(got)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)


def test_block_max_neighbours_are_exact():
    rng = np.random.default_rng(1)
    examples = [(tuple((int(t), int(rng.integers(1, 4))) for t in sorted(rng.choice(60, 5, replace=False))), int(i % 3 == 0), 1, [i]) for i in range(500)]
    index = toxicity.Index([b"%d" % i for i in range(60)], rng.uniform(0.5, 3, 60), examples, 7, 8)
    matrix = np.zeros((500, 60))
    for i in range(index.blocks * 60):
        s = slice(index.start[i], index.start[i + 1])
        matrix[index.at[s], i % 60] = index.weight[s]
    for counted, *_ in examples[:50]:
        term, weight = index.vector(counted)
        plain = np.sort(matrix[:, term] @ weight)[::-1][:7]
        assert np.allclose(index.nearest(term, weight)[1], plain)


def test_toxicity_scores_match_brute_force(spark):
    where = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = spark.read.parquet(f"{where}/labels.parquet").select("doc_id", F.col("toxic").cast("int").alias("toxic")).collect()
    learnt = {r.doc_id: r.toxic for r in labels if not held(r.doc_id)}
    index = toxicity.learn(docs, spark.createDataFrame(list(learnt.items()), "doc_id long, toxic int"), 20_000, 15, 64)
    rows = {r.doc_id: r.text for r in docs.collect()}
    counted = {i: dict(index.count(t.encode())) for i, t in rows.items()}
    n_terms = len(index.idf)
    df = np.zeros(n_terms)
    for c in counted.values():
        df[list(c)] += 1
    assert np.allclose(index.idf, np.log((len(rows) + 1) / (df + 1)) + 0.1)  # over all documents

    def unit(c):
        v = np.zeros(n_terms)
        for t, n in c.items():
            v[t] = (1 + math.log(n)) * index.idf[t]
        return v / (np.linalg.norm(v) or 1)

    got = {r.doc_id: r for r in toxicity.op4_toxicity(spark, where).collect()}
    assert got.keys() == rows.keys() and all(r.held_out == held(i) for i, r in got.items())
    examples = {}
    for i, y in learnt.items():
        entry = examples.setdefault(tuple(sorted(counted[i].items())), [0, 0])
        entry[0], entry[1] = entry[0] + y, entry[1] + 1
    none = examples.pop((), [0, 0])
    matrix, toxic, total = np.array([unit(dict(k)) for k in examples]), *np.array(list(examples.values()), float).T
    rate = (toxic.sum() + none[0] + 0.5) / (total.sum() + none[1] + 1)
    a, b = index.curve
    checked = 0
    for i in sorted(rows):
        cosine = matrix @ unit(counted[i])
        order = np.sort(cosine)[::-1]
        if not counted[i] or (len(order) > 15 and order[14] > 1e-9 and order[14] - order[15] < 1e-9):
            continue  # no term, or a tie at the last place
        best = np.argsort(-cosine)[:15]
        best = best[cosine[best] > 1e-12]
        vote = (cosine[best] @ toxic[best] + 0.2 * rate) / (cosine[best] @ total[best] + 0.2)
        assert abs(got[i].score - 1 / (1 + math.exp(-(a * (vote - 0.5) + b)))) < 1e-6
        checked += 1
    assert checked > 20


def plain_shards(docs, shards=8, seed=7):
    """doc_id, text -> shard, slot, by sorting all rows by fractional rank."""

    def signed(n):
        return n - (1 << 64) if n >> 63 else n

    def draw(i, crc, size):
        state = 42
        for value, width in ((seed, 4), (i, 8), (crc, 8), (size, 8)):
            state = xxhash.xxh64_intdigest(value.to_bytes(width, "little", signed=True), state)
        return signed(state)

    sources = defaultdict(list)
    for i, text, source in docs:
        data = (text or "").encode()
        crc, size = zlib.crc32(data), len(data) + 1
        sources["" if source is None else "=" + source].append((draw(i, crc, size), i, crc, size))
    placed = []
    for source, rows in sources.items():
        placed += [((k + 0.5) / len(rows), *row, source) for k, row in enumerate(sorted(rows))]
    out = {}
    for place, row in enumerate(sorted(placed)):
        shard = place * shards // len(placed)
        out[row[2]] = (shard, place - -(-shard * len(placed) // shards))
    return out


def test_sharding_matches_the_plain_order(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows += [(50_000 + i, "same text", None if i % 2 else "src0") for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(table).collect()} == plain_shards(rows)


def test_sharding_law(spark):
    rows = sharding.op7_stratified_sharding(spark, DATA).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_quality_measures(spark):
    import re

    got = {r.doc_id: r for r in quality.op8_quality_rules(spark, DATA).collect()}
    for i, t in texts(spark):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c, covered = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)), set()
        for j in range(len(w) - 4):
            if c[tuple(w[j : j + 5])] > 1:
                covered.update(range(j, j + 5))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want
        assert got[i].base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_frequent_lines_go(spark):
    rows = [(i, "shared footer line\n" + " ".join(chr(97 + i % 26) * (2 + i // 26 + j) for j in range(14)), "h") for i in range(30)]
    rows += [(100 + i, "shared footer line\n" + f"only {i}", "h") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.text for r in quality.apply_rules(docs, least_docs=5, share=0.1).collect()}
    assert set(kept) == set(range(30))
    assert "footer" in kept[0] and "footer" not in kept[1]


def test_frequent_lines_of_large_and_small_hosts(spark):
    def body(i):
        return " ".join(f"{x}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for x in "abcdefghijklmn")

    rows = [(i, ("footer of one in a hundred\n" if i % 100 == 0 else "") + body(i), "large") for i in range(3000)]
    rows += [(5000 + i, ("small footer\n" if i < 8 else "") + body(i), "small") for i in range(40)]
    rows += [(6000 + i, "a text with its exact copy\n" + body(0), "tiny") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.text for r in quality.apply_rules(docs).collect()}
    assert kept.keys() == {r[0] for r in rows}
    assert [i for i, t in sorted(kept.items()) if "footer" in t] == [0, 5000]
    assert all("exact copy" in kept[i] for i in (6000, 6001))


def test_token_files_round_trip(spark, folder):
    docs = sorted(texts(spark, f"{folder}/odd"), key=lambda x: (x[0], x[1] or ""))
    direct = encoder(vocabulary_path()).tokenizer
    got = sorted(tuple(r) for r in binary_tokens.op9_binary_tokens(spark, f"{folder}/odd").collect())
    start = 0
    for (i, t), row in zip(docs, got, strict=True):
        ids = np.array([*direct.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert row == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_packing_covers_all_ids(spark):
    rows = packing.op6_packing(spark, DATA).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length, r.doc_tokens))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_doc.values():
        at = 0
        for start, length, _ in sorted(parts):
            assert start == at
            at += length
        assert at == parts[0][2]
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_plan_holds_the_histogram_and_is_close_to_the_bound():
    rng = np.random.default_rng(2)
    histogram = dict(Counter(int(x) for x in rng.integers(1, 65, 5000)))
    made = packing.plan(histogram, 64)
    total = Counter()
    for pattern, times in made:
        assert sum(c * n for c, n in pattern.items()) <= 64
        for c, n in pattern.items():
            total[c] += n * times
    assert dict(total) == histogram
    assert sum(t for _, t in made) <= 1.01 * sum(c * n for c, n in histogram.items()) / 64 + 2


def test_mixture(spark):
    rows = mixing.op10_source_mixing(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source")
    per = rows.join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t"), F.sum("size").alias("s"), F.first("source_size").alias("ss"))
    for r in per.collect():
        assert r.s == r.ss and abs(r.n - r.t) <= max(130, 0.03 * r.t)
    assert rows.where("taken > 2 * size").count() == 0
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, mixing.op10_source_mixing(spark, DATA).collect()))


def plain_mix(docs, block=64, shards=16, seed=11):
    """doc_id -> taken, by one loop over shards, sources and slots."""

    def draw(i, text):
        state = 42
        for data in (seed.to_bytes(4, "little", signed=True), i.to_bytes(8, "little", signed=True), text.encode()):
            state = xxhash.xxh64_intdigest(data, state)
        return state - (1 << 64) if state >> 63 else state

    streams = defaultdict(list)
    for i, text, source in docs:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        streams[source].append((draw(i, text or ""), i, size))
    order = sorted(streams, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for *_, n in streams[s]) for s in order}
    wanted = mixing.targets(list(sizes.items()))
    blocks = [-(-sizes[s] // block) for s in order]
    quotas = [min(round(wanted[s] / (sizes[s] / max(1, b))) if sizes[s] else 0, 2 * b) for s, b in zip(order, blocks, strict=True)]
    times, given = [Counter() for _ in order], [0] * len(order)
    for got in mixing.draws(quotas, shards, seed):
        for k, n in enumerate(got):
            for slot in range(given[k], given[k] + n):
                turn, at = divmod(slot, blocks[k])
                times[k][int(mixing.permuted(np.array([at]), blocks[k], (seed * 1_000_003 + k) * 8 + turn)[0])] += 1
            given[k] += n
    out = {}
    for k, s in enumerate(order):
        at = 0
        for _, i, size in sorted(streams[s]):
            out[i] = sum(times[k][(at + w) // block] for w in range(size))
            at += size
    return out, {s: (sizes[s], wanted[s]) for s in order}


def test_mixture_matches_a_plain_loop(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows += [(60_000, None, "src1"), (60_001, "", None), (60_002, "a few words of no source", None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, sources = plain_mix(rows)
    assert {r.doc_id: r.taken for r in got} == taken
    by_id = {i: s for i, _, s in rows}
    assert all((r.source_size, r.target) == pytest.approx(sources[by_id[r.doc_id]]) for r in got)


def test_equal_rows_get_pieces_of_their_own(spark):
    text = " ".join(f"w{i}" for i in range(640))
    table = spark.createDataFrame([(1, text, "a")] * 3 + [(2, text + " end", "a")], "doc_id long, text string, source string")
    table = table.withColumn("_pieces", F.lit(1)).withColumn("_draw", F.lit("x")).withColumn("_id", F.lit(0))
    want = sorted(r.taken for r in mixing.mix(table).collect())
    kept = mixing.apply_mix(table)
    assert kept.columns == table.columns and sorted(len(r.text.split()) for r in kept.collect()) == [n for n in want if n]


def test_quality_keeps_rows_apart(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, "junk junk", "h"), (1, good, "h"), (2, good + " more", None), (2, good + " more", None), (None, good + " none", "h"), (3, None, "h")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    table = table.withColumn("_id", F.lit(1)).withColumn("frequent", F.lit("f")).withColumn("_lines", F.lit(2)).withColumn("copy", F.lit(3))
    kept = quality.apply_rules(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(1, good), (2, good + " more"), (2, good + " more"), (0, good + " none")])
    verdicts = [(r.doc_id, r.kept) for r in quality.judge(table.select("doc_id", "text", "source")).collect()]
    assert sorted(verdicts, key=str) == sorted([(1, False), (1, True), (2, True), (2, True), (None, True), (3, False)], key=str)


def test_quality_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = quality.op8_quality_rules(spark, DATA)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({SQL['op8_quality_rules']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_targets_and_permutations():
    got = mixing.targets([("a", 10), ("b", 100), (None, 100)])
    assert got["a"] == 20 and got["b"] == 295 * 2 / 3 and math.isclose(sum(got.values()), 315)
    for size in (1, 2, 3, 64, 1000):
        assert sorted(mixing.permuted(np.arange(size), size, 3)) == list(range(size))
    drawn = np.array(mixing.draws([5, 0, 90, 13], 7, 1))
    assert drawn.sum(0).tolist() == [5, 0, 90, 13] and drawn.min() >= 0
