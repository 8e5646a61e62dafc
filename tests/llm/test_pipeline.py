"""The pipeline: what each stage keeps of its own input."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from catalume.llm.tokens import encoder, vocabulary_path

DATA = "/root/testdata/sf0.001"


def test_stages_in_turn(spark, tmp_path):
    from test_operators import plain_components

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert after.columns == columns
            seen[name] = (before, {r.doc_id: r.text for r in after.select("doc_id", "text").collect()})
            docs = after
    before, after = seen["quality"]
    assert after == plain_quality(docs_of(spark))
    before, after = seen["line_dedup"]
    assert before.keys() == after.keys()
    before, after = seen["near_duplicates"]
    assert set(after) == {c for _, c in plain_components(before.items()).values()}
    before, after = seen["mixing"]
    for i, text in after.items():
        words = before[i].split()
        assert len(text.split()) <= 2 * len(words) and set(text.split()) <= set(words)
    tokens = defaultdict(int)
    for r in after_rows(spark, f"{tmp_path}/packing"):
        tokens[r.doc_id] += r.length
    known = encoder(vocabulary_path())
    assert dict(tokens) == {i: len(b"".join(known.encode([t.encode()]))) // 4 + 1 for i, t in after.items()}


def after_rows(spark, path):
    return spark.read.parquet(path).collect()


def docs_of(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").collect()]


def plain_quality(docs, least_docs=20, share=0.1):
    """doc_id -> text of the documents that the rules keep, by plain loops."""
    norm = lambda line: " ".join(re.sub("[1-9]", "0", line).translate({c: c + 32 for c in range(65, 91)}).split(None))
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    holders, first, hosts = defaultdict(set), {}, defaultdict(set)
    for i, text, host in docs:
        hosts[host].add(text)
        for line in {norm(x) for x in text.split("\n") if words(x)}:
            holders[host, line].add(text)
            first[host, line] = min(i, first.get((host, line), i))
    out = {}
    for i, text, host in docs:
        limit = min(least_docs, max(1, share * len(hosts[host])))
        own = words(text)
        windows = Counter(tuple(own[k : k + 5]) for k in range(len(own) - 4))
        repeated = {k + d for k in range(len(own) - 4) if windows[tuple(own[k : k + 5])] > 1 for d in range(5)}
        often = lambda x: len(holders[host, norm(x)]) > limit and i != first[host, norm(x)]
        left = [x for x in text.split("\n") if not words(x) or not often(x)]
        n = sum(len(words(x)) for x in left)
        if len(own) >= 10 and 100 * len(repeated) <= 20 * len(own) and n >= 10 and n >= 0.2 * len(own):
            out[i] = "\n".join(left)
    return out


def test_run_packs_every_kept_token_once(spark):
    out = corpus_pipeline.run(spark, DATA).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in pieces.values():
        at = 0
        for start, length, total in sorted(own):
            assert start == at
            at += length
        assert at == total
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    tokens = sum(n for own in pieces.values() for _, n, _ in own)
    assert len(sequences) <= 1.1 * tokens / 4096 + 2


def test_stages_on_awkward_tables(spark):
    """Clashing names, nulls, repeated rows, a long text and an empty table: no stage but the last changes the columns."""
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(1, good, "en", "s", 5), (1, good, "en", "s", 5), (2, None, None, None, None), (None, good + " x", "en", None, 1), (3, "", "en", "s", 0), (4, " ".join(f"v{i % 9000}x{i}" for i in range(30_000)), "en", "s", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("frequent", "_id", "gone_1", "_gone", "pieces", "_draw", "copy", "host", "line", "shard", "part", "_key"):
        table = table.withColumn(name, F.lit(name))
    for docs in (table, table.where("false")):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            if name != "packing":
                assert out.columns == columns
                out = spark.createDataFrame(out.collect(), docs.schema)
            docs = out
        docs.collect()
