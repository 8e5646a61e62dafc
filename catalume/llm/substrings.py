"""Repeated substrings, found by sorting suffixes.

A byte of a document goes if a string of ``WIDTH`` bytes that covers it also starts in a document with a smaller doc_id.
Such strings are called windows here. A suffix array over all positions would be many times as large as the texts, so only
suffixes at anchors are sorted: a window's anchor is the first of its ``GRAM``-byte strings with the least hash. Equal windows
have equal anchors at equal places, so two windows are equal if the texts agree before and after their anchors far enough.

1. A chunk is a bounded run of texts of one task (long texts are cut into overlapping pieces). It is saved with its anchors,
   and sends the hashes of the strings at its anchors to parts by ranges, and a digest of each text. Parts answer which are
   in other chunks too, which occur more than ``hot`` times, and which texts are copies of a document with a smaller doc_id.
2. Each chunk extracts the suffixes of anchors that are shared, with the bytes before them, each distinct one once with its
   smallest doc_id. Splitters, sampled from the suffixes of a few chunks, range-partition them by their leading bytes. Suffixes
   that start with a hot string are not kept together by it: each of their windows is a suffix by itself and is dealt by all
   its bytes. So a bucket gets at most ``hot`` suffixes of one beginning and each window once from a chunk.
   The chunks looked at grow with the table, as its parts may differ.
3. A bucket sorts its suffixes, in portions of whole beginnings if it is large, by multikey quicksort, eight bytes at a time among
   those still tied, and the reversed bytes before them likewise. Windows with one offset from their anchors are equal if they are
   in one run of both orders, runs being cut where the common prefix is too short. Each suffix is answered with a bit for each
   offset: a smaller doc_id has it.
4. Chunks mark the bytes that go; pieces of long texts are put together again.

Chunks and pieces overlap by ``WIDTH`` - 1 bytes and buckets are cut between different leading bytes only, so no window is lost
at a boundary.

Defined results: a null or empty text has no bytes; a null doc_id neither covers nor loses bytes; rows with one doc_id are one
document and do not cover each other; texts of any length are processed whole; an empty table gives an empty result; other
columns are ignored. Bytes are removed as such, so what is left need not be UTF-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.llm.common import Scratch, delete, free_shuffles, load, scramble, shared_folder, slices, task_count
from catalume.llm.tree_scoring import gaps, loose, squeezed, summed

WIDTH = 50
GRAM = 24
BACK = WIDTH - GRAM  # an anchor stands 0 to BACK bytes after the start of its window
BLOCK = 1 << 16  # suffixes whose bytes are looked at together
LATER = np.iinfo(np.int64).max


def gram_hash(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Hash of three words of eight bytes; never 0."""
    with np.errstate(over="ignore"):
        h = first * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h += second
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h += third
        h *= np.uint64(0xA0761D6478BD642F)
        h ^= h >> np.uint64(32)
    return h | np.uint64(1)


def all_grams(data: bytes) -> np.ndarray:
    """gram_hash at each position that has GRAM bytes."""
    n = len(data) - 7
    words = np.empty(n, np.uint64)
    for s in range(8):
        words[s::8] = np.frombuffer(data, "<u8", (n - s + 7) // 8, s)
    return gram_hash(words[:-16], words[8:-8], words[16:])


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def next_below(at: np.ndarray, h: np.ndarray, step: int, equal: bool) -> np.ndarray:
    """The nearest anchor on one side, at most BACK bytes away, whose hash is smaller (or ``equal``); far away if none."""
    found, open_, t = np.full(len(at), step * (1 << 60)), np.arange(len(at)), step
    while len(open_):
        k = open_ + t
        inside = (k >= 0) & (k < len(at))
        open_, k = open_[inside], k[inside]
        near = np.abs(at[k] - at[open_]) <= BACK
        open_, k = open_[near], k[near]
        hit = h[k] <= h[open_] if equal else h[k] < h[open_]
        found[open_[hit]] = at[k[hit]]
        open_, t = open_[~hit], t + step
    return found


def anchors(data: bytes, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of the pieces data[start:end], and each one's least and greatest distance from a start of its windows.

    The bytes are gone through in blocks, each with as many bytes around it as its anchors depend on, so hashes are not held for all.
    """
    none = np.zeros(0, np.int64)
    whole = ends - starts >= WIDTH
    if not whole.any():
        return none, none, none
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[whole]] += 1
    edge[ends[whole] - WIDTH + 1] -= 1
    inside, around, found = np.cumsum(edge, dtype=np.int8) > 0, 4 * BACK, []
    for base in range(0, len(data), block):
        lo, hi = max(0, base - around), min(len(data), base + block + around)
        if not inside[lo:hi].any():
            continue
        h = all_grams(data[lo : hi + WIDTH])
        least = sliding(h, BACK + 1, np.minimum)
        least[~inside[lo : lo + len(least)]] = 0
        most = sliding(np.concatenate([np.zeros(BACK, np.uint64), least, np.zeros(BACK, np.uint64)]), BACK + 1, np.maximum)
        at = np.flatnonzero(h == most)
        own, at = h[at], at + lo
        piece = np.searchsorted(starts, at, "right") - 1
        low = np.maximum(np.maximum(next_below(at, own, -1, True) + 1, at - BACK), starts[piece])
        high = np.minimum(np.minimum(next_below(at, own, 1, False) - BACK - 1, at), ends[piece] - WIDTH)
        some = (low <= high) & (at >= base) & (at < base + block)
        found.append((at[some], (at - high)[some], (at - low)[some]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def range_part(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(bits - 24)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def by_part(part: np.ndarray):
    """(part, slice) of each run of equal parts."""
    if not len(part):
        return []
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return [(int(part[lo]), slice(int(lo), int(hi))) for lo, hi in zip(cut, [*cut[1:], len(part)], strict=True)]


SLICE = 256 << 10  # bytes of a saved text in one row; Spark holds rows, their pages and row groups as a whole
ROW_GROUP = {"compression": "zstd", "parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 10, "parquet.page.size.row.check.min": 10, "parquet.enable.dictionary": "false"}
SCHEMA = "kind int, chunk long, part int, a binary, b binary, c binary, ids array<long>, rows array<long>, pieces array<int>"
TEXT, GRAMS, COPIES, SUFFIXES, STATE = range(5)


def message(kind: int, chunk: int, part: list[int], a: list, b: list, c: list, lists=(None, None, None)) -> pa.RecordBatch:
    n = len(part)
    tail = [pa.nulls(n, pa.list_(t)) if x is None else pa.array([x] + [None] * (n - 1), pa.list_(t)) for x, t in zip(lists, (pa.int64(), pa.int64(), pa.int32()), strict=True)]
    head = [pa.array(np.full(n, kind), pa.int32()), pa.array(np.full(n, chunk), pa.int64()), pa.array(part, pa.int32()), *(pa.array(x, pa.binary()) for x in (a, b, c))]
    return pa.RecordBatch.from_arrays([*head, *tail], ["kind", "chunk", "part", "a", "b", "c", "ids", "rows", "pieces"])


def chunked(docs: DataFrame, parts: int, bits: int, chunk_bytes: int, folder: str) -> None:
    """Writes, by kind: TEXT (a: lengths of pieces, parts of their digests and the bytes, in slices numbered by part; in the first, b: anchors, c: their
    distances; lists: doc_id, row and number of each piece), GRAMS (a: sorted hashes, b: counts) and COPIES (a, b: digests of texts, c: doc_ids)."""

    def close(chunk: int, held: list):
        texts, ids, rows, pieces, digests = (list(x) for x in zip(*held, strict=True))
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        data = b"".join(texts)
        known = np.array([i is not None for i in ids])
        at, near, far = anchors(data + bytes(64), (ends - lengths)[known], ends[known])
        digest = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        part = range_part(digest[:, 0], 64, parts)
        blob = len(lengths).to_bytes(8, "little") + np.stack([lengths, part]).astype("<i8").tobytes() + data
        blobs = [blob[i : i + SLICE] for i in range(0, len(blob), SLICE)]
        none = [None] * (len(blobs) - 1)
        yield message(TEXT, chunk, list(range(len(blobs))), blobs, [gaps(at), *none], [squeezed(np.stack([near, far]).astype(np.uint8).reshape(-1)), *none], (ids, rows, pieces))
        keys, counts = np.unique(anchor_keys(data, at, bits), return_counts=True)
        cuts = by_part(range_part(keys, bits, parts))
        for i in range(0, len(cuts), 256):
            some = cuts[i : i + 256]
            yield message(GRAMS, chunk, [p for p, _ in some], [gaps(keys[s]) for _, s in some], [squeezed(np.minimum(counts[s], 65535).astype("<u2")) for _, s in some], [None] * len(some))
        order = np.argsort(part, kind="stable")
        owner = np.array([LATER if i is None else i for i in ids], "<i8")
        for p, s in by_part(part[order]):
            yield message(COPIES, chunk, [p], [squeezed(digest[order[s], 0])], [squeezed(digest[order[s], 1])], [squeezed(owner[order[s]])])

    def task(batches):
        base, made, row, held, size = TaskContext.get().partitionId() << 24, 0, 0, [], 0
        for batch in slices(batches, 2 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                text = text or b""
                digest = xxhash.xxh3_128_digest(text)
                for i in range(max(1, -(-len(text) // chunk_bytes))):
                    piece = text[i * chunk_bytes : (i + 1) * chunk_bytes + WIDTH - 1]
                    last = (i + 1) * chunk_bytes >= len(text)
                    held.append((piece, doc_id, (base << 16) + row, -1 if last and i == 0 else i, digest))
                    size += len(piece)
                    if size >= chunk_bytes:
                        yield from close(base + made, held)
                        held, size, made = [], 0, made + 1
                row += 1
        if held:
            yield from close(base + made, held)

    docs.mapInArrow(task, SCHEMA).write.options(**ROW_GROUP).partitionBy("kind").parquet(folder)


def anchor_keys(data: bytes, at: np.ndarray, bits: int) -> np.ndarray:
    words = np.ascontiguousarray(sliding_window_view(np.frombuffer(data, np.uint8), GRAM)[at]).view("<u8") if len(at) else np.zeros((0, 3), np.uint64)
    return scramble(gram_hash(words[:, 0].copy(), words[:, 1].copy(), words[:, 2].copy())) >> np.uint64(64 - bits)


def merge(asked: DataFrame, hot: int) -> DataFrame:
    """chunk, kind, part, data: the answers to GRAMS (1: in another chunk too, 2: hot) and COPIES (1: a smaller doc_id has the text)."""

    def group(table: pa.Table) -> pa.Table:
        kind, blobs = table.column("kind")[0].as_py(), [table.column(c).to_pylist() for c in ("a", "b", "c")]
        if kind == GRAMS:
            lists = [summed(x) for x in blobs[0]]
            flat = np.concatenate(lists)
            _, place, chunks = np.unique(flat, return_inverse=True, return_counts=True)
            seen = np.bincount(place, np.concatenate([loose(x, "<u2") for x in blobs[1]]))
            answer = ((chunks > 1) + 2 * (seen > hot)).astype(np.uint8)[place]
        else:
            lists = [loose(x, "<u8") for x in blobs[0]]
            first, second = np.concatenate(lists), np.concatenate([loose(x, "<u8") for x in blobs[1]])
            doc = np.concatenate([loose(x, "<i8") for x in blobs[2]])
            order = np.lexsort((doc, second, first))
            fresh = np.concatenate([[True], (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])])
            answer = np.empty(len(doc), np.uint8)
            answer[order] = doc[order] > doc[order][fresh][np.cumsum(fresh) - 1]
        ends = np.cumsum([len(x) for x in lists])
        data = [squeezed(answer[hi - len(x) : hi]) for x, hi in zip(lists, ends, strict=True)]
        return pa.table([table.column("chunk"), table.column("kind"), table.column("part"), pa.array(data, pa.binary())], names=["chunk", "kind", "part", "data"])

    return asked.groupBy("kind", "part").applyInArrow(group, "chunk long, kind int, part int, data binary")


class Chunk:
    """A saved chunk."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("part")
        blob = b"".join(table.column("a").to_pylist())
        n = int.from_bytes(blob[:8], "little")
        self.lengths, self.asked = np.frombuffer(blob, "<i8", 2 * n, 8).reshape(2, n)
        self.data = blob[8 + 16 * n :]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.ids = table.column("ids")[0].as_py()
        self.known = np.array([i is not None for i in self.ids])
        self.docs = np.array([LATER if i is None else i for i in self.ids], np.int64)
        self.rows, self.pieces = (table.column(c)[0].as_py() for c in ("rows", "pieces"))
        self.at = summed(table.column("b")[0].as_py()).astype(np.int64)
        self.near, self.far = loose(table.column("c")[0].as_py(), "u1").reshape(2, -1).astype(np.int64)
        self.piece = np.searchsorted(self.starts, self.at, "right") - 1


def answers_of(table: pa.Table, kind: int, form: str = "u1") -> np.ndarray:
    """The answers of one kind, in the order of their parts."""
    rows = sorted(zip(table.column("part").to_pylist(), table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True), key=lambda r: r[:2])
    found = [loose(x, form) for _, k, x in rows if k == kind]
    return np.concatenate(found) if found else np.zeros(0, form)


class Suffixes:
    """The suffixes that a chunk sends, each distinct one once, and where they occur."""

    def __init__(self, chunk: Chunk, answers: pa.Table, bits: int):
        keys, place = np.unique(anchor_keys(chunk.data, chunk.at, bits), return_inverse=True)
        status = answers_of(answers, GRAMS) if len(keys) else np.zeros(0, np.uint8)
        self.copy = np.zeros(len(chunk.docs), bool)
        self.copy[np.argsort(chunk.asked, kind="stable")] = answers_of(answers, COPIES) == 1
        self.copy &= chunk.known
        alive = ~self.copy[chunk.piece]
        doc = chunk.docs[chunk.piece]
        least, most = np.full(len(keys), LATER), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(least, place[alive], doc[alive])
        np.maximum.at(most, place[alive], doc[alive])
        shared, hot = ((status & 1) == 1) | (most > least), (status & 2) == 2
        plain = np.flatnonzero(alive & shared[place] & ~hot[place])
        split = np.flatnonzero(alive & (shared & hot)[place])
        spans = chunk.far[split] - chunk.near[split] + 1
        each = np.repeat(split.astype(np.int32), spans)
        start = (chunk.at - chunk.near).astype(np.int32)[each] - (np.arange(len(each), dtype=np.int32) - np.repeat((np.cumsum(spans) - spans).astype(np.int32), spans))
        nil = np.zeros(len(each), np.uint8)
        self.at = np.concatenate([chunk.at[plain].astype(np.int32), start])
        self.near, self.far = (np.concatenate([x[plain].astype(np.uint8), nil]) for x in (chunk.near, chunk.far))
        self.piece = np.concatenate([chunk.piece[plain], chunk.piece[each]]).astype(np.int32)
        whole = np.concatenate([np.zeros(len(plain), bool), np.ones(len(each), bool)])
        order = np.argsort(chunk.docs[self.piece], kind="stable").astype(np.int32)
        self.at, self.near, self.far, self.piece, whole = (x[order] for x in (self.at, self.near, self.far, self.piece, whole))
        self.contexts, first, self.record = self.distinct(chunk.data)
        self.owner = chunk.docs[self.piece[first]]
        lead = self.contexts[:, BACK : BACK + WIDTH].copy()
        lead[~whole[first], GRAM:] = 0
        self.leading = lead.view(f"S{WIDTH}").reshape(-1)

    def distinct(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct contexts, sorted, where each is first, and which one each suffix has. Blocks are made distinct one by one, as repeats are many."""
        room = sliding_window_view(np.frombuffer(bytes(BACK) + data + bytes(WIDTH), np.uint8), BACK + WIDTH)
        kind, found, held = f"S{BACK + WIDTH + 2}", [], 0
        record = np.empty(len(self.at), np.int32)
        for lo in range(0, max(1, len(self.at)), BLOCK):
            some = slice(lo, lo + BLOCK)
            contexts = self.cut(room, some)
            _, first, inverse = np.unique(contexts.view(kind).reshape(-1), return_index=True, return_inverse=True)
            record[some] = inverse + held
            found.append((contexts[first], first + lo))
            held += len(first)
        contexts, first = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(found) > 1:  # blocks follow one another in the order of documents, so the first is the smallest here too
            _, least, inverse = np.unique(contexts.view(kind).reshape(-1), return_index=True, return_inverse=True)
            contexts, first, record = contexts[least], first[least], inverse.astype(np.int32)[record]
        return contexts, first, record

    def cut(self, room: np.ndarray, some: slice) -> np.ndarray:
        """BACK bytes before each suffix, WIDTH of it, and its two distances; bytes that no window needs are 0."""
        at, near, far = self.at[some], self.near[some], self.far[some]
        out = np.zeros((len(at), BACK + WIDTH + 2), np.uint8)
        if len(at):
            out[:, :-2] = room[at]
            column = np.arange(BACK + WIDTH, dtype=np.uint8)
            out[:, :-2] *= (column >= BACK - far[:, None]) & (column < BACK + WIDTH - near[:, None])
            out[:, -2], out[:, -1] = near, far
        return out


SENT = "kind int, chunk long, part int, a binary, b binary, c binary"


def splitters(texts: DataFrame, answers: DataFrame, bits: int, sampled: int, each: int, bytes_: int, target: int) -> np.ndarray:
    """Leading bytes that cut the suffixes into buckets of about ``target`` bytes, from at most ``sampled`` chunks and ``each`` suffixes of one."""
    chosen = [r.chunk for r in texts.where("part = 0").select("chunk").orderBy(F.xxhash64("chunk")).limit(sampled).collect()]

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        found, seen = [], 0
        if left.num_rows:
            chunk = Chunk(left)
            leading = Suffixes(chunk, right, bits).leading
            seen, step = len(chunk.data), max(1, -(-len(leading) // each))
            found = [(x.ljust(WIDTH, b"\0"), step) for x in leading[::step].tolist()]
        return pa.table([pa.array([x for x, _ in found] + [None], pa.binary()), pa.array([n for _, n in found] + [seen], pa.int64())], names=["lead", "n"])

    pair = (x.where(F.col("chunk").isin(chosen)).groupBy("chunk") for x in (texts, answers))
    rows = next(pair).cogroup(next(pair)).applyInArrow(look, "lead binary, n long").toArrow()  # sampled * each rows at most
    leads, n = rows.column("lead").to_pylist(), rows.column("n").to_numpy()
    given = np.array([x is not None for x in leads], bool)
    seen = int(n[~given].sum())
    leads, n = np.frombuffer(b"".join(x for x in leads if x is not None), f"S{WIDTH}"), n[given]
    if not len(leads):
        return np.zeros(0, f"S{WIDTH}")
    order = np.argsort(leads, kind="stable")
    leads, weight = leads[order], np.cumsum(n[order])
    buckets = int(min(len(leads), max(1, weight[-1] * (BACK + WIDTH + 10) * (bytes_ / max(1, seen)) // target)))
    cuts = np.searchsorted(weight, weight[-1] * np.arange(1, buckets) / buckets)
    return np.unique(leads[cuts])


def extract(texts: DataFrame, answers: DataFrame, bits: int, cuts, folder: str) -> None:
    """Writes, by kind: SUFFIXES of each bucket (a: contexts, b: least doc_ids) and each chunk's STATE (a: places of what it sent, b: copies, c: owners)."""

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left)
        own = Suffixes(chunk, right, bits)
        part = np.searchsorted(cuts.value, own.leading, "right")
        order = np.argsort(part, kind="stable")
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order))
        where = np.empty((5, len(own.at)), "<u4")
        for i, x in enumerate((own.at, own.near, own.far, own.piece, back[own.record])):
            where[i] = x
        rows = [(STATE, 0, squeezed(where.reshape(-1)), own.copy.astype(np.uint8).tobytes(), squeezed(own.owner[order]))]
        rows += [(SUFFIXES, p, squeezed(own.contexts[order[s]].view(f"V{BACK + WIDTH + 2}").reshape(-1)), squeezed(own.owner[order[s]]), None) for p, s in by_part(part[order])]
        kind, part, a, b, c = zip(*rows, strict=True)
        number = pa.array(np.full(len(rows), left.column("chunk")[0].as_py()), pa.int64())
        return pa.table([pa.array(kind, pa.int32()), number, pa.array(part, pa.int32()), *(pa.array(x, pa.binary()) for x in (a, b, c))], names=["kind", "chunk", "part", "a", "b", "c"])

    sent = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(task, SENT)
    sent.write.options(**ROW_GROUP).partitionBy("kind").parquet(folder)


def sorted_runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of equally long byte rows: their order, and how many bytes each shares with the one before it.

    Rows still tied are sorted by their next eight bytes, all tied runs at once.
    """
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order, fresh = np.arange(n), np.zeros(n + 1, bool)
    fresh[[0, n]] = True
    for w in range(words.shape[1]):
        tied = np.flatnonzero(~(fresh[:-1] & fresh[1:]))
        if not len(tied):
            break
        run, key = np.cumsum(fresh[:-1])[tied], words[order[tied], w]
        by = np.lexsort((key, run))
        order[tied], key = order[tied][by], key[by]
        fresh[tied[1:]] |= key[1:] != key[:-1]
    shared = np.zeros(n, np.int64)
    for lo in range(1, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        differ = rows[order[lo:hi]] != rows[order[lo - 1 : hi - 1]]
        shared[lo:hi] = np.where(differ.any(1), differ.argmax(1), width)
    return order, shared


def runs_of(order: np.ndarray, shared: np.ndarray, length: int) -> np.ndarray:
    """A number for each row, equal for rows that agree in their first ``length`` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < length) if length else 0
    return out


def judged(contexts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each suffix a bit for each distance from the start of a window: the window is in a document with a smaller doc_id."""
    after, before = sorted_runs(contexts[:, BACK : BACK + WIDTH]), sorted_runs(np.ascontiguousarray(contexts[:, BACK - 1 :: -1]))
    near, far = contexts[:, -2], contexts[:, -1]
    bits = np.zeros(len(docs), np.uint32)
    for back in range(BACK + 1):
        own = np.flatnonzero((near <= back) & (back <= far))
        if len(own) < 2:
            continue
        window = runs_of(*after, WIDTH - back)[own] * (len(docs) + 1) + runs_of(*before, back)[own]
        order = np.argsort(window, kind="stable")
        fresh = np.concatenate([[True], window[order][1:] != window[order][:-1]])
        least = np.minimum.reduceat(docs[own[order]], np.flatnonzero(fresh))
        later = own[order][docs[own[order]] > least[np.cumsum(fresh) - 1]]
        bits[later] |= np.uint32(1 << back)
    return bits


def portions(contexts: np.ndarray, most: int = BLOCK) -> list[np.ndarray]:
    """Places of suffixes that are judged together: those that start with one string of GRAM bytes, and fewer than ``most`` others."""
    n = len(contexts)
    if n <= most:
        return [np.arange(n)]
    lead = np.ascontiguousarray(contexts[:, BACK : BACK + GRAM]).view(">u8").astype(np.uint64)
    order = np.lexsort((lead[:, 2], lead[:, 1], lead[:, 0]))
    lead = lead[order]
    starts = np.flatnonzero(np.concatenate([[True], (lead[1:] != lead[:-1]).any(1)]))
    cuts = starts[np.unique(np.searchsorted(starts, np.arange(most, n, most), "right") - 1)]
    return [x for x in np.split(order, cuts) if len(x)]


def sort_buckets(sent: DataFrame) -> DataFrame:
    """chunk, kind, part, data: bits for the suffixes of each chunk and bucket. A bucket that is larger than meant is judged in portions."""

    def group(table: pa.Table) -> pa.Table:
        width = BACK + WIDTH + 2
        contexts = [loose(x, f"V{width}").view(np.uint8).reshape(-1, width) for x in table.column("a").to_pylist()]
        docs = np.concatenate([loose(x, "<i8") for x in table.column("b").to_pylist()])
        sizes = [len(x) for x in contexts]
        contexts, bits = np.concatenate(contexts), np.empty(len(docs), np.uint32)
        for some in portions(contexts):
            bits[some] = judged(contexts[some], docs[some])
        data = [squeezed(bits[hi - n : hi].astype("<u4")) for n, hi in zip(sizes, np.cumsum(sizes), strict=True)]
        return pa.table([table.column("chunk"), pa.array([SUFFIXES] * len(data), pa.int32()), table.column("part"), pa.array(data, pa.binary())], names=["chunk", "kind", "part", "data"])

    return sent.groupBy("part").applyInArrow(group, "chunk long, kind int, part int, data binary")


MARKED = "doc_id long, row long, piece int, own long, starts array<long>, ends array<long>, kept binary"


def marked(texts: DataFrame, state: DataFrame, answers: DataFrame, chunk_bytes: int) -> DataFrame:
    """For each piece: the spans that go, by their places in the whole text; what is left of a text in one piece, or the piece's own bytes."""

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left)
        kinds = right.column("kind").to_pylist()
        a, b, c = (right.column(n)[kinds.index(STATE)].as_py() for n in ("a", "b", "c"))
        at, near, far, piece, record = loose(a, "<u4").reshape(5, -1).astype(np.int64)
        copy, owner = np.frombuffer(b, bool), loose(c, "<i8")
        bits = answers_of(right, SUFFIXES, "<u4")
        later = chunk.docs[piece] > owner[record] if len(at) else np.zeros(0, bool)
        bits = np.where(later, np.uint32((1 << (BACK + 1)) - 1), bits[record]) if len(at) else bits
        n = len(chunk.data)
        edge = np.zeros(n + WIDTH + 1, np.int32)
        for back in range(BACK + 1):
            gone = (near <= back) & (back <= far) & ((bits >> np.uint32(back)) & np.uint32(1) == 1)
            start = (at - back)[gone]  # each window is met once
            edge[start] += 1
        covered = np.cumsum(edge[: n + 1])
        covered = covered[:n] - np.concatenate([np.zeros(min(WIDTH, n), np.int64), covered[: max(0, n - WIDTH)]]) > 0
        starts, ends, kept, own = [], [], [], []
        for i, (lo, size) in enumerate(zip(chunk.starts.tolist(), chunk.lengths.tolist(), strict=True)):
            gone = covered[lo : lo + size]
            if copy[i] and (size >= WIDTH or chunk.pieces[i] >= 0):
                gone = np.ones(size, bool)
            turns = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
            base = max(0, chunk.pieces[i]) * chunk_bytes
            starts.append((turns[::2] + base).tolist())
            ends.append((turns[1::2] + base).tolist())
            whole = chunk.data[lo : lo + size]
            if chunk.pieces[i] < 0:
                kept.append(np.frombuffer(whole, np.uint8)[~gone].tobytes() if len(turns) else whole)
                own.append(size)
            else:
                kept.append(whole[:chunk_bytes])
                own.append(len(kept[-1]))
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)]
        return pa.table([pa.array(chunk.ids, pa.int64()), pa.array(chunk.rows, pa.int64()), pa.array(chunk.pieces, pa.int32()), pa.array(own, pa.int64()), *lists, pa.array(kept, pa.binary())], names=["doc_id", "row", "piece", "own", "starts", "ends", "kept"])

    told = state.select("chunk", F.lit(STATE).alias("kind"), "part", "a", "b", "c", F.lit(None).cast("binary").alias("data"))
    told = told.unionByName(answers.select("*", *(F.lit(None).cast("binary").alias(n) for n in ("a", "b", "c"))))
    return texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(task, MARKED)


def joined(pieces: DataFrame) -> DataFrame:
    """The texts that were cut, put together: one task has the pieces of one text."""

    def group(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
        data = np.frombuffer(b"".join(r["kept"] for r in rows), np.uint8)
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, [s for r in rows for s in r["starts"]], 1)
        np.add.at(edge, [e for r in rows for e in r["ends"]], -1)
        gone = np.cumsum(edge[:-1]) > 0
        turns = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
        lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (turns[::2], turns[1::2])]
        return pa.table([table.column("doc_id")[:1], table.column("row")[:1], pa.array([-1], pa.int32()), pa.array([len(data)], pa.int64()), *lists, pa.array([data[~gone].tobytes()], pa.binary())], names=table.column_names)

    return pieces.groupBy("row").applyInArrow(group, MARKED)


def dedup_substrings(docs: DataFrame, hot: int = 20_000, chunk_bytes: int = 4 << 20, bucket_bytes: int = 4 << 20, sampled: int = 12) -> DataFrame:
    """doc_id, n_bytes, starts, ends (of maximal removed runs), kept (the bytes left) of ``docs`` (doc_id, text)."""
    spark, folder, sent = docs.sparkSession, *(shared_folder(docs.sparkSession, f"substrings-{n}") for n in ("chunks", "suffixes"))
    scratch = Scratch(spark, "substrings")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(64, max(32, int(size).bit_length() + 6))
    parts = min(1 << 24, max(task_count(spark), size >> 25))
    chunked(docs, parts, bits, chunk_bytes, folder)
    whole = spark.read.schema(SCHEMA).parquet(folder)
    texts = whole.where(F.col("kind") == TEXT).select("chunk", "part", "a", "b", "c", "ids", "rows", "pieces")
    answers = scratch.save(merge(whole.where(F.col("kind").isin(GRAMS, COPIES)).select("kind", "chunk", "part", "a", "b", "c"), hot), "answers")
    for kind in (GRAMS, COPIES):
        delete(spark, f"{folder}/kind={kind}")
    looked = max(sampled, size // (16 * chunk_bytes))  # leads grow with the buckets, and chunks with the table, whose parts may differ
    cuts = spark.sparkContext.broadcast(splitters(texts, answers, bits, looked, max(4000 * sampled, sampled * size >> 20) // looked, size, bucket_bytes))
    free_shuffles(spark)
    extract(texts, answers, bits, cuts, sent)
    scratch.drop(answers)
    free_shuffles(spark)
    messages = spark.read.schema(SENT).parquet(sent)
    bits_ = scratch.save(sort_buckets(messages.where(F.col("kind") == SUFFIXES).select("chunk", "part", "a", "b")), "bits")
    delete(spark, f"{sent}/kind={SUFFIXES}")
    free_shuffles(spark)
    found = scratch.save(marked(texts, messages.where(F.col("kind") == STATE), bits_, chunk_bytes), "marked")
    delete(spark, folder)
    out = found.where("piece < 0").unionByName(joined(found.where("piece >= 0")))
    return out.select("doc_id", F.col("own").alias("n_bytes"), "starts", "ends", "kept")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(load(spark, sf_dir, "doc_id", "text"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
