"""Packing token sequences as a cutting-stock problem, solved by column generation.

Documents are cut at the sequence length; the pieces left are counted by length class (lengths rounded up to ``unit``
tokens). The linear program chooses how often to use each pattern, a multiset of classes that fits into one sequence; new
patterns come from a knapsack dynamic program on the dual prices until none pays. Pattern counts are rounded down, and the
few pieces left over are packed first-fit, largest first. Pieces of a class are ranked, and rank decides pattern and place.

The histogram has at most length / unit classes, whatever the input, so the program is solved on the driver. Ranks come
from window functions inside hash buckets, so no class is sorted in one task.

Defined results: a null or empty text is the end id alone; equal rows are separate documents, so a repeated doc_id repeats
its pieces; a null doc_id is kept; a text of any length is encoded whole and cut into pieces; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalume.llm.common import Scratch, load, lots, running_start, slices
from catalume.llm.tokens import crc32, encoder, vocabulary_path


def pieces(docs: DataFrame, vocabulary: str, end_id: int, length: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, _draw (a hash of the document) for each piece of ``docs``."""

    def task(batches):
        for batch in slices(batches):
            found = []
            ids, draws = batch.column("doc_id").to_pylist(), batch.column("_draw").to_pylist()
            end = end_id.to_bytes(4, "little")
            for doc, draw, data in zip(ids, draws, encoder(vocabulary).encode(batch.column("text").cast(pa.binary()).to_pylist()), strict=True):
                data += end
                n = len(data) // 4
                for at in range(0, n, length):
                    part = data[4 * at : 4 * (at + length)]
                    found.append((doc, at, len(part) // 4, crc32(part), n, draw))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_draw"]
            columns = list(zip(*found, strict=True)) if found else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("_draw", F.xxhash64("doc_id", "text"))
    return rows.mapInArrow(task, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _draw long")


def best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of ``sizes`` within ``room``, by dynamic programming over room."""
    value, choice = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(sizes, kind="stable")
    by_size, worth = sizes[order], prices[order]
    for r in range(1, room + 1):
        n = int(np.searchsorted(by_size, r, "right"))
        value[r] = value[r - 1]
        if n:
            gains = value[r - by_size[:n]] + worth[:n]
            k = int(np.argmax(gains))
            if gains[k] > value[r] + 1e-12:
                value[r], choice[r] = gains[k], order[k]
    used, r = np.zeros(len(sizes)), room
    while r > 0:
        if choice[r] < 0:
            r -= 1
        else:
            used[choice[r]] += 1
            r -= int(sizes[choice[r]])
    return float(value[room]), used


def generate_columns(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 800, gap: float = 0.001) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often the linear program uses each; a revised simplex whose entering column is priced by knapsack.

    Dual prices divided by the best pattern's value are feasible, which bounds the optimum from below; within ``gap`` of the
    bound, or half a sequence, or when steps long stay without gain, it stops. Any state is a feasible plan.
    """
    n = len(sizes)
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    amount = (inverse * demand).sum(axis=1)
    low, best, since = 0.0, np.inf, 0
    for step in range(rounds):
        if step % 100 == 99:
            error = np.einsum("ij,jk->ik", basis, inverse)  # a Newton step takes rounding errors out
            inverse = 2 * inverse - np.einsum("ij,jk->ik", inverse, error)
            amount = (inverse * demand).sum(axis=1)
        value, column = best_pattern(inverse.sum(axis=0), sizes, room)  # each pattern costs one sequence
        total = float(amount.sum())
        low = max(low, float(inverse.sum(axis=0) @ demand) / max(value, 1.0))
        best, since = (total, step) if total < best - 1e-6 else (best, since)
        if value <= 1 + 1e-7 or total - low <= max(0.5, gap * total) or step - since > 60:
            break
        change = (inverse * column).sum(axis=1)
        rows = np.flatnonzero(change > 1e-9)
        ratio = np.maximum(amount[rows], 0) / change[rows]
        out = int(rows[np.argmin(ratio)])
        basis[:, out] = column
        pivot = inverse[out] / change[out]
        inverse -= np.outer(change, pivot)
        inverse[out] = pivot
        enter = amount[out] / change[out]
        amount -= change * enter
        amount[out] = enter
    return basis, np.maximum(amount, 0)


def plan(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (class -> pieces) with the sequences that use them; together they hold exactly the histogram's pieces."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[s] for s in sizes], np.int64)
    columns, amount = generate_columns(sizes, left.astype(float), room)
    made = []
    for j in np.argsort(-amount, kind="stable"):
        column = np.round(columns[:, j]).astype(np.int64)
        used = np.flatnonzero(column)
        times = int(min(np.floor(amount[j] + 1e-6), (left[used] // column[used]).min())) if len(used) else 0
        if times > 0:
            made.append(({int(sizes[i]): int(column[i]) for i in used}, times))
            left = left - column * times
    while left.any():  # rounding leaves less than one sequence for each pattern: first fit, largest first
        free, pattern = room, {}
        for i in range(len(sizes) - 1, -1, -1):
            n = min(int(left[i]), free // int(sizes[i]))
            if n:
                pattern[int(sizes[i])] = n
                free -= n * int(sizes[i])
                left[i] -= n
        made.append((pattern, 1))
    return made


def pack(found: DataFrame, length: int, unit: int) -> DataFrame:
    """Adds sequence_id and offset to ``found``, the saved pieces."""
    room = length // unit
    found = found.withColumn("_class", F.expr(f"cast((length + {unit - 1}) div {unit} as int)"))
    histogram = {r["_class"]: r["n"] for r in found.groupBy("_class").agg(F.count("*").alias("n")).collect()}  # <= room rows
    places: dict[int, list[tuple[int, int, int, int]]] = {c: [] for c in histogram}  # class: first rank, pieces a sequence, first sequence, first place
    ranks, sequences = dict.fromkeys(histogram, 0), 0
    for pattern, times in plan(histogram, room):
        at = 0
        for c, n in pattern.items():
            places[c].append((ranks[c], n, sequences, at))
            ranks[c] += n * times
            at += n
        sequences += times
    tables = {c: np.array(rows, np.int64).T for c, rows in places.items()}

    def task(batches):
        for batch in batches:
            classes = batch.column("_class").to_numpy()
            rank = batch.column("_rank").to_numpy()
            sequence, place = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for c in np.unique(classes):
                at = np.flatnonzero(classes == c)
                first, each, base, start = tables[int(c)]
                k = np.searchsorted(first, rank[at], "right") - 1
                turn, rest = np.divmod(rank[at] - first[k], each[k])
                sequence[at], place[at] = base[k] + turn, start[k] + rest
            columns = [batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "_place"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(place)], names)

    ranked = found.withColumn("_lot", F.shiftright("_draw", 65 - lots(sum(histogram.values()), least=128).bit_length()))
    ranked = running_start(ranked, ["_class"], "_lot", ["_draw", "doc_id", "start"], F.lit(1).cast("long"), "_rank")
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, _place long"
    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_class", "_rank").mapInArrow(task, fields)
    before = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("_place")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, length: int = 4096, unit: int = 16) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "packing")
    found = scratch.save(pieces(docs, vocabulary or vocabulary_path(), end_id, length), "pieces")
    return pack(found, length, unit)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "doc_id", "text"))
