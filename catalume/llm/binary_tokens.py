"""Token ids as flat unsigned integer files with 64-bit document offsets.

Layout of a folder: for each part ``P`` the files ``P.ids`` (unsigned 16- or 32-bit little-endian ids, one document after
the other) and ``P.docs`` (signed 64-bit: document ids, then one offset more than documents, in ids). Parts and documents
ascend by doc_id. ``parts.json`` lists documents and ids of each part; their prefix sums are the parts' bases.

A part is written by one task under a name of its own attempt and renamed when complete, so lost or repeated tasks do no
harm. Files go to a folder that executors share, through pyarrow's file systems; local ones are memory-mapped for reading.

Defined results: null and empty texts are the end id alone; equal doc_ids follow each other in the order of their texts;
a null doc_id comes first and stays null; texts of any length are written whole; an empty table has no rows; other columns
are ignored.
"""

from __future__ import annotations

import json
import os
import uuid


import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.llm.common import load, shared_folder, slices, task_count
from catalume.llm.tokens import crc32, encoder, vocabulary_path

NO_ID = np.iinfo(np.int64).min


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int, parts: int, wide: bool = False) -> None:
    """Encodes ``docs`` (doc_id, text) into ``folder`` (a URI). ``wide``: 32-bit ids; 16-bit ones need ids below 65,536."""

    def task(batches):
        at, kind = TaskContext.get(), "<u4" if wide else "<u2"
        place, root = pafs.FileSystem.from_uri(folder)
        place.create_dir(root, recursive=True)
        name, own = f"{root}/{at.partitionId():06d}", f"{uuid.uuid4().hex}.tmp"
        ids, lengths = [], []
        with place.open_output_stream(f"{name}.ids.{own}") as out:
            for batch in slices(batches):
                ids.append(batch.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype("<i8"))
                for data in encoder(vocabulary).encode(batch.column("text").cast(pa.binary()).to_pylist()):
                    found = np.frombuffer(data, "<u4")
                    if not wide and len(found) and found.max() > 0xFFFF:
                        raise ValueError("an id needs 32 bits: write with wide=True")
                    out.write(found.astype(kind).tobytes() + np.array([end_id], kind).tobytes())
                    lengths.append(len(found) + 1)
        offsets = np.concatenate([[0], np.cumsum(np.array(lengths, "<i8"))]).astype("<i8")
        with place.open_output_stream(f"{name}.docs.{own}") as out:
            out.write(np.concatenate([*ids, offsets]).astype("<i8").tobytes())
        for kind in ("ids", "docs"):
            place.move(f"{name}.{kind}.{own}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": [at.partitionId()], "docs": [len(lengths)], "ids": [int(offsets[-1])]})

    text = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    made = sorted(text.mapInArrow(task, "part long, docs long, ids long").collect())  # a row for each part
    place, root = pafs.FileSystem.from_uri(folder)
    place.create_dir(root, recursive=True)
    with place.open_output_stream(f"{root}/parts.json") as out:
        out.write(json.dumps({"width": 4 if wide else 2, "parts": [[*row] for row in made]}).encode())


def read_tokens(spark: SparkSession, folder: str, per_batch: int = 4096) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (over 32-bit ids) of each document of ``folder``, from its files."""
    place, root = pafs.FileSystem.from_uri(folder)
    with place.open_input_stream(f"{root}/parts.json") as f:
        found = json.loads(f.read())
    width, base, parts = found["width"], 0, []
    for part, docs, ids in found["parts"]:
        parts.append((part, docs, base))
        base += ids

    def opened(name: str, kind: str):
        """A function from a range of entries to the array of them: memory-mapped locally, else read in that range only."""
        place, root = pafs.FileSystem.from_uri(folder)
        path, size = f"{root}/{name}", np.dtype(kind).itemsize
        if isinstance(place, pafs.LocalFileSystem):
            whole = np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
            return lambda lo, hi: whole[lo:hi]
        file = place.open_input_file(path)
        return lambda lo, hi: np.frombuffer(file.read_at((hi - lo) * size, lo * size), kind)

    def task(batches):
        for batch in batches:
            for part, docs, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index, ids = opened(f"{part:06d}.docs", "<i8"), opened(f"{part:06d}.ids", f"<u{width}")
                for lo in range(0, docs, per_batch):
                    hi = min(docs, lo + per_batch)
                    names, offsets = np.asarray(index(lo, hi)), np.asarray(index(docs + lo, docs + hi + 1))
                    sums = [crc32(ids(a, b).astype("<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, mask=names == NO_ID), pa.array(offsets[:-1] + base), pa.array(np.diff(offsets)), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    listed = spark.createDataFrame(parts, "part long, docs long, base long").repartition(max(1, len(parts)))
    return listed.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_binary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    docs = load(spark, sf_dir, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    write_tokens(docs, folder, vocabulary_path(), end_id=1, parts=task_count(spark))
    return read_tokens(spark, folder)
