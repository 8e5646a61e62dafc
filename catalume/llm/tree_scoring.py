"""Language-model scores by context-tree weighting over bytes.

A text is read as its lower-cased words, each with a space after it, and one end byte. Each byte is eight binary decisions;
every decision has a tree of contexts of 0 to ``depth`` earlier bytes, and the probability mixes Krichevsky-Trofimov
estimates of all depths by their posterior weights (each node: half its own estimate, half its children's product).
After training the mixture is fixed, so a byte's code length depends on its context only.

Training counts and requests go by chunks: a chunk is a bounded run of whole documents of one task. It sends each of its
context-and-byte strings once, with its training count, as packed sorted integers, one row for each part of the strings that
it has. A part holds all strings of some latest three context bytes, so every subtree below depth 3 is whole in one part and
no common context gathers in one task by itself. Parts merge the counts, and their sums go up: depth 2 is evaluated in
groups of one latest byte, depths 1 and 0 on the driver. The levels above depth 3 have a size that the input cannot pass
(255 nodes for each context of up to two bytes) and are broadcast. Each part then evaluates its subtrees and answers each
chunk with one packed row of code lengths. Words of the base score travel the same way, by ranges of their hashes.

Defined results: a null or empty text is the end alone; rows with one doc_id are scored one by one, and a null doc_id is
kept; ties do not arise; texts of any length are scored whole; without training documents all estimates are even; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.llm.common import Scratch, delete, load, scramble, shared_folder, slices, task_count, word_hash

END = b"\n"
TOP = 3  # subtrees from this depth on are whole in one part


def stream(text: bytes | None) -> bytes:
    """Words with a space after each, then the end byte, which no word contains."""
    words = (text or b"").lower().split()
    return b" ".join([*words, END]) if words else END


def strings(streams: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of all streams its context, latest byte first, and itself as one integer; and each stream's length."""
    pad = END * depth
    data = np.frombuffer(pad + pad.join(streams), np.uint8)
    lengths = np.array([len(s) for s in streams], np.int64)
    n = len(data) - depth
    key = data[depth:].astype(np.uint64)
    for i in range(1, depth + 1):
        key |= data[depth - i : depth - i + n].astype(np.uint64) << np.uint64(8 * (depth + 1 - i))
    keep = np.ones(n, bool)
    gaps = np.cumsum(lengths[:-1] + depth) - depth
    for i in range(depth):
        keep[gaps + i] = False
    return key[keep], lengths


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: Stirling's series, eight steps up."""
    y, up = x + 8, np.ones_like(x)
    for i in range(8):
        up *= x + i
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(up)


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    a, b = zeros.astype(float), ones.astype(float)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)


HALF = np.log(0.5)


class Subtree:
    """Nodes of depths TOP to ``depth`` for the sorted strings of a part."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.depth, self.rows, self.counts, self.up = depth, {depth: keys}, {depth: counts}, {}
        for d in range(depth - 1, TOP - 1, -1):  # the same strings with the earliest context byte dropped
            parent = ((self.rows[d + 1] >> np.uint64(16)) << np.uint64(8)) | (self.rows[d + 1] & np.uint64(255))
            found, self.up[d] = np.unique(parent, return_inverse=True)
            self.rows[d], self.counts[d] = found, np.bincount(self.up[d], self.counts[d + 1], len(found)).astype(np.int64)

    def level(self, j: int):
        """For decision j of a byte: yields depth, row -> node, bit, zeros, ones, own and weighted log estimates, first rows, from the deepest up."""
        below = None
        for d in range(self.depth, TOP - 1, -1):
            rows, n = self.rows[d], self.counts[d]
            nodes = rows >> np.uint64(8 - j)
            fresh = np.concatenate([[True], nodes[1:] != nodes[:-1]])
            node, start = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
            bit = ((rows >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64)
            ones, total = np.add.reduceat(n * bit, start), np.add.reduceat(n, start)
            own = log_estimate(total - ones, ones)
            if below is None:
                weighted = own
            else:
                child_start, child_weighted = below
                children = np.bincount(node[self.up[d][child_start]], child_weighted, len(start))
                weighted = np.logaddexp(HALF + own, HALF + children)
            below = start, weighted
            yield d, node, bit, total - ones, ones, own, weighted, start

    def tops(self) -> np.ndarray:
        """Columns (two latest bytes and node, zeros, ones, log weighted probability), summed over the nodes of depth TOP."""
        keys, sums = [], []
        for j in range(8):
            for d, _, _, zeros, ones, _, weighted, start in self.level(j):
                if d == TOP:
                    rows = self.rows[d][start]
                    keys.append(((rows >> np.uint64(16)) << np.uint64(8)).astype(np.int64) | (1 << j) | ((rows & np.uint64(255)).astype(np.int64) >> (8 - j)))
                    sums.append(np.stack([zeros, ones, weighted]).astype(float))
        return merged(np.concatenate(keys), np.concatenate(sums, axis=1))

    def code_lengths(self, above: "Above") -> np.ndarray:
        """Bits of each string's byte."""
        keys = self.rows[self.depth]
        byte, bits = (keys & np.uint64(255)).astype(np.int64), np.zeros(len(keys))
        latest, two = (keys >> np.uint64(8 * self.depth)).astype(np.int64), (keys >> np.uint64(8 * (self.depth - 1))).astype(np.int64)
        for j in range(8):
            p, back, chain = None, np.arange(len(keys)), []
            for d, node, bit, zeros, ones, own, weighted, _ in self.level(j):
                if d < self.depth:
                    back = self.up[d][back]
                at = node[back]
                hit = np.where(bit[back] == 1, ones[at], zeros[at])
                estimate = (hit + 0.5) / (zeros[at] + ones[at] + 1)
                if d == self.depth:
                    p = estimate
                else:
                    chain.append((np.exp(HALF + own - weighted)[at], estimate))
            for w, estimate in chain:  # from depth - 1 up to TOP
                p = w * estimate + (1 - w) * p
            prefix, value = (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1
            for w, one in above.levels(latest, two, prefix):
                p = w * np.where(value == 1, one, 1 - one) + (1 - w) * p
            bits -= np.log2(p)
        return bits


def merged(keys: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """``sums`` (rows: values) added up by key; the keys, sorted, are the first row."""
    found, at = np.unique(keys, return_inverse=True)
    return np.stack([found.astype(float), *(np.bincount(at, x, len(found)) for x in sums)])


class Above:
    """Weights and estimates of depths 0 to 2: tables of 256, 256 x 256 and a sparse one of the two-byte contexts seen."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]]):
        found = sorted(rows)
        table = np.concatenate([np.frombuffer(x, float).reshape(3, -1) for _, x, _ in found], axis=1) if found else np.zeros((3, 0))
        self.keys, self.w2, self.p2 = table[0].astype(np.int64), table[1], table[2]
        zeros, ones, children = np.zeros((3, 256, 256))
        for latest, _, sums in found:
            zeros[latest], ones[latest], children[latest] = np.frombuffer(sums, float).reshape(3, 256)
        own = log_estimate(zeros, ones)
        seen = np.logaddexp(HALF + own, HALF + children)
        self.w1, self.p1 = np.exp(HALF + own - seen), (ones + 0.5) / (zeros + ones + 1)
        z0, o0 = zeros.sum(0), ones.sum(0)
        self.w0 = np.exp(-np.logaddexp(0, seen.sum(0) - log_estimate(z0, o0)))
        self.p0 = (o0 + 0.5) / (z0 + o0 + 1)

    def levels(self, latest: np.ndarray, two: np.ndarray, prefix: np.ndarray):
        """Weight and probability of a one at depths 2, 1 and 0."""
        at = np.searchsorted(self.keys, (two << 8) | prefix)
        yield self.w2[at], self.p2[at]
        yield self.w1[latest, prefix], self.p1[latest, prefix]
        yield self.w0[prefix], self.p0[prefix]


def squeezed(numbers: np.ndarray) -> bytes:
    """Integers or floats as bytes, compressed; ranks of bytes stand together. ``loose`` reverses it."""
    width = numbers.dtype.itemsize
    flat = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, width).T.tobytes()
    return len(flat).to_bytes(8, "little") + pa.compress(flat, codec="zstd", asbytes=True)


def loose(data: bytes, kind: str) -> np.ndarray:
    flat = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def gaps(keys: np.ndarray) -> bytes:
    """Sorted integers, squeezed as differences."""
    return squeezed(np.diff(keys.astype(np.uint64), prepend=np.uint64(0)).astype("<u8"))


def summed(data: bytes) -> np.ndarray:
    return np.cumsum(loose(data, "<u8"), dtype=np.uint64)


def parts_of(keys: np.ndarray, kind: int, parts: int, depth: int) -> np.ndarray:
    """The part of each sorted string (kind 1: by its three latest context bytes) or word hash (kind 2: by ranges)."""
    if kind == 2:
        return ((keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.uint16)
    context = keys >> np.uint64(8 * (depth - TOP + 1))
    start = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    own = (scramble(context[start] + np.uint64(1)) % np.uint64(parts)).astype(np.uint16)  # sorted by radix
    return np.repeat(own, np.diff(start, append=len(keys)))


FIELDS = ["kind", "chunk", "part", "a", "b", "ids", "held"]
SCHEMA = "kind int, chunk long, part int, a binary, b binary, ids array<long>, held array<boolean>"


def rows_of(kind: int, chunk: int, part, a, b, ids=None, held=None) -> pa.RecordBatch:
    n = len(a)
    lists = [pa.nulls(n, pa.list_(t)) if x is None else pa.array(x, pa.list_(t)) for x, t in ((ids, pa.int64()), (held, pa.bool_()))]
    columns = [pa.array(np.full(n, kind), pa.int32()), pa.array(np.full(n, chunk), pa.int64()), pa.array(part, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())]
    return pa.RecordBatch.from_arrays([*columns, *lists], FIELDS)


def chunked(docs: DataFrame, depth: int, parts: int, chunk_bytes: int, folder: str) -> None:
    """Writes, by kind: 0 documents (a, b: streams and their lengths), 1 strings and 2 words (a, b: keys and training counts)."""

    def tally(kind: int, chunk: int, found: list[tuple[np.ndarray, np.ndarray]]):
        keys = np.concatenate([p[0] for p in found])
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.concatenate([p[1] for p in found])[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[start], np.add.reduceat(counts, start).astype("<u8")
        own = parts_of(keys, kind, parts, depth)
        order = np.argsort(own, kind="stable")
        keys, counts, own = keys[order], counts[order], own[order]
        cut = [*np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])).tolist(), len(own)]
        for some in (range(i, min(i + 256, len(cut) - 1)) for i in range(0, len(cut) - 1, 256)):
            spans = [slice(cut[i], cut[i + 1]) for i in some]
            yield rows_of(kind, chunk, [int(own[s.start]) for s in spans], [gaps(keys[s]) for s in spans], [squeezed(counts[s]) for s in spans])

    def counted(keys: np.ndarray, trained: np.ndarray):
        for own, sign in ((keys[trained], 1), (keys[~trained], 0)):
            if len(own):
                found, n = np.unique(own, return_counts=True)
                yield found, n * sign

    def task(batches):
        part, made, size, grams, words = TaskContext.get().partitionId(), 0, 0, [], []
        for batch in slices(batches, 2 << 20):
            chunk = (part << 24) + made
            held = batch.column("held").to_pylist()
            own = [stream(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            sizes = np.array([len(s) for s in own], "<u4")
            yield rows_of(0, chunk, [0], [squeezed(np.frombuffer(b"".join(own), np.uint8))], [squeezed(sizes)], [batch.column("doc_id").to_pylist()], [held])
            trained = ~np.array(held, bool)
            keys, lengths = strings(own, depth)
            grams += counted(keys, np.repeat(trained, lengths))
            split = [s[:-1].split() for s in own]
            words += counted(word_hash().array([w for s in split for w in s]), np.repeat(trained, [len(s) for s in split]))
            size += int(sizes.sum())
            if size >= chunk_bytes:
                yield from tally(1, chunk, grams)
                if words:
                    yield from tally(2, chunk, words)
                grams, words, size, made = [], [], 0, made + 1
        if grams:
            yield from tally(1, (part << 24) + made, grams)
            if words:
                yield from tally(2, (part << 24) + made, words)

    docs.mapInArrow(task, SCHEMA).write.option("compression", "none").partitionBy("kind").parquet(folder)


def merge(asked: DataFrame, depth: int) -> DataFrame:
    """A row for each part. Strings: merged keys and counts, the places of each chunk's keys, and the sums for the levels above.
    Words: each chunk's counts, and how many trained tokens and distinct words there are.
    """

    def group(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        keys = [summed(x) for x in table.column("a").to_pylist()]
        flat, counts = np.concatenate(keys), np.concatenate([loose(x, "<u8") for x in table.column("b").to_pylist()]).astype(np.int64)
        found, at = np.unique(flat, return_inverse=True)
        n = np.zeros(len(found), np.int64)
        np.add.at(n, at, counts)
        ends = np.cumsum([len(k) for k in keys])
        own = [at[hi - len(k) : hi] for k, hi in zip(keys, ends, strict=True)]
        row = {"kind": [kind], "part": [table.column("part")[0].as_py()], "chunks": [table.column("chunk").to_pylist()], "tokens": [int(n.sum())], "distinct": [int((n > 0).sum())]}
        if kind == 1:
            top = Subtree(found, n, depth).tops()
            row |= {"places": [[gaps(p) for p in own]], "keys": [gaps(found)], "counts": [squeezed(n)], "tops": [top.tobytes()]}
        else:
            row |= {"places": [[squeezed(n[p].astype("<u8")) for p in own]], "keys": [None], "counts": [None], "tops": [None]}
        kinds = {"kind": pa.int32(), "part": pa.int32(), "chunks": pa.list_(pa.int64()), "places": pa.list_(pa.binary()), "keys": pa.binary(), "counts": pa.binary(), "tops": pa.binary()}
        return pa.table({c: pa.array(row[c], kinds.get(c, pa.int64())) for c in PART_FIELDS})

    return asked.groupBy("kind", "part").applyInArrow(group, PART_SCHEMA)


PART_FIELDS = ["kind", "part", "chunks", "places", "keys", "counts", "tops", "tokens", "distinct"]
PART_SCHEMA = "kind int, part int, chunks array<long>, places array<binary>, keys binary, counts binary, tops binary, tokens long, distinct long"


def levels_above(parts: DataFrame) -> Above:
    """Depth 2 from the parts' sums, in groups of one latest byte; one row for each of them goes to the driver."""

    def split(batches):
        for batch in batches:
            for data in batch.column("tops").to_pylist():
                table = np.frombuffer(data, float).reshape(4, -1)
                latest = table[0].astype(np.int64) >> 16
                found = np.unique(latest)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([table[:, latest == x].tobytes() for x in found], pa.binary())], ["latest", "sums"])

    def group(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x, float).reshape(4, -1) for x in table.column("sums").to_pylist()], axis=1)
        key, zeros, ones, children = merged(rows[0], rows[1:])
        own = log_estimate(zeros, ones)
        seen = np.logaddexp(HALF + own, HALF + children)
        below = np.stack([key, np.exp(HALF + own - seen), (ones + 0.5) / (zeros + ones + 1)])
        node = key.astype(np.int64) & 255
        sums = np.stack([np.bincount(node, x, 256) for x in (zeros, ones, seen)])
        return pa.table({"latest": table.column("latest")[:1], "below": pa.array([below.tobytes()], pa.binary()), "sums": pa.array([sums.tobytes()], pa.binary())})

    sums = parts.where("kind = 1").select("tops").mapInArrow(split, "latest int, sums binary")
    return Above([tuple(r) for r in sums.groupBy("latest").applyInArrow(group, "latest int, below binary, sums binary").collect()])  # 256 rows at most


def answers(parts: DataFrame, above, depth: int) -> DataFrame:
    """chunk, kind, part, data: code lengths (kind 1, as 32-bit floats) and word counts (kind 2) of what each chunk asked for, in its order."""

    def task(batches):
        for batch in batches:
            for kind, part, chunks, places, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "chunks", "places", "keys", "counts")), strict=True):
                if kind == 1:
                    bits = Subtree(summed(keys), loose(counts, "<i8"), depth).code_lengths(above.value).astype("<f4")
                    places = [squeezed(bits[summed(p).astype(np.int64)]) for p in places]
                n = len(chunks)
                yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(places, pa.binary())], ["chunk", "kind", "part", "data"])

    columns = ("kind", "part", "chunks", "places", "keys", "counts")
    return parts.select(*columns).mapInArrow(task, "chunk long, kind int, part int, data binary")


def score(docs: DataFrame, depth: int = 6, chunk_bytes: int = 12 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of ``docs`` (doc_id, text, held)."""
    if not TOP <= depth <= 7:
        raise ValueError(f"depth must be {TOP} to 7")
    spark, scratch, folder = docs.sparkSession, Scratch(docs.sparkSession, "tree-scoring"), shared_folder(docs.sparkSession, "tree-chunks")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts_ = max(4 * task_count(spark), min(1 << 16, size >> 24))
    chunked(docs, depth, parts_, chunk_bytes, folder)
    whole = spark.read.schema(SCHEMA).parquet(folder)
    texts = whole.where("kind = 0").select("chunk", "a", "b", "ids", "held")
    parts = scratch.save(merge(whole.where("kind > 0").select("kind", "chunk", "part", "a", "b"), depth), "parts")
    for kind in (1, 2):
        delete(spark, f"{folder}/kind={kind}")
    trained = texts.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0))).first()[0]
    tokens, distinct = parts.where("kind = 2").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    tokens, distinct = tokens + trained, distinct + (trained > 0)
    above = spark.sparkContext.broadcast(levels_above(parts))
    even = np.log10(tokens + 0.5 * (distinct + 1))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        slices_, known_grams, known_words = [], [], []
        for data, sizes, ids, held in zip(*(left.column(c).to_pylist() for c in ("a", "b", "ids", "held")), strict=True):
            ends = np.cumsum(loose(sizes, "<u4").astype(np.int64))
            flat = loose(data, "u1").tobytes()
            own = [flat[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
            grams, at = np.unique(strings(own, depth)[0], return_inverse=True)
            split = [s[:-1].split() for s in own]
            marks, word_at = np.unique(word_hash().array([w for s in split for w in s]), return_inverse=True)
            slices_.append((ids, held, np.array([len(s) for s in own]), np.array([len(s) for s in split]), grams, at.astype(np.int32), marks, word_at.astype(np.int32)))
            known_grams.append(grams)
            known_words.append(marks)
        tables = []
        kind, part = np.asarray(right.column("kind")), np.asarray(right.column("part"))
        for k, known, form in ((1, known_grams, "<f4"), (2, known_words, "<u8")):
            keys = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)
            rows = np.flatnonzero(kind == k)
            values = [loose(right.column("data")[int(i)].as_py(), form) for i in rows[np.argsort(part[rows], kind="stable")]]
            values = np.concatenate(values).astype(float) if values else np.zeros(0)
            placed = np.empty(len(keys))
            placed[np.argsort(parts_of(keys, k, parts_, depth), kind="stable") if len(keys) else slice(0)] = values
            tables.append((keys, placed))
        (grams, bits), (marks, counts) = tables
        out = []
        for ids, held, lengths, n_words, own, at, own_marks, word_at in slices_:
            cost = np.add.reduceat(bits[np.searchsorted(grams, own)][at], np.cumsum(lengths) - lengths)
            c = counts[np.searchsorted(marks, own_marks)][word_at] if len(word_at) else np.zeros(0)
            edges = np.cumsum(n_words)
            logs, seen = (np.concatenate([[0], np.cumsum(x)]) for x in (np.log10(c + 0.5), c > 0))
            base = logs[edges] - logs[edges - n_words] + np.log10(trained + 0.5) - even * (n_words + 1)
            out.append((ids, held, n_words + 1, seen[edges] - seen[edges - n_words] + (trained > 0), base, -cost * np.log10(2), cost / lengths))
        ids, held = ([x for o in out for x in o[i]] for i in (0, 1))
        columns = [np.concatenate([o[i] for o in out]) for i in range(2, 7)]
        total = np.full(len(ids), tokens, np.int64)
        arrays = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(total), *(pa.array(c, pa.float64()) for c in columns[2:])]
        return pa.table(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    fields = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return texts.groupBy("chunk").cogroup(answers(parts, above, depth).groupBy("chunk")).applyInArrow(finish, fields)


def op3_context_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held, F.lit(False)).alias("held")))
