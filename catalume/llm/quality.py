"""Quality rules: text measures, and lines that too many documents of a host share.

Lines are normalised (A-Z lower-cased, digits to 0, white space to single spaces) and hashed. For each host the distinct
documents holding a line are counted. Exact copies of a text count as one document: copies of a clean text are no
boilerplate, and counting each would empty the text in all its copies; they are left to deduplication. A line above the
host's limit is removed from all documents of the host but the one of smallest doc_id that holds it. The limit is
``least_docs`` documents however large the host is; in small hosts it is ``share`` of their documents if that is less, but
never below one. A document is depleted, and rejected, if fewer than ``least_words`` words or less than ``least_left`` of
its words are left. Only hashes and counts are shuffled, and copies are counted before they meet.

Defined results: null and empty texts have no words and fail; a null host is a host of its own; rows with one doc_id are
judged row by row, and a null doc_id owns no line; repeated rows get the same verdict; texts of any length are read whole,
a bounded run of texts at a time; an empty table gives an empty result; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.llm.common import SPACES, Scratch, fresh, load, scramble, slices, source_key, windows, word_hash

SYMBOL_BYTES = b"#*$%&|<>"
DIGITS = bytes.maketrans(b"123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0" * 9 + b"abcdefghijklmnopqrstuvwxyz")
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"



def normal_line(line: bytes) -> int:
    """Signed 64-bit hash of the normalised line."""
    found = xxhash.xxh3_64_intdigest(b" ".join(line.translate(DIGITS).split()))
    return found - (1 << 64) if found >> 63 else found


def repeat_words(hashes: list[np.ndarray], width: int = 5) -> np.ndarray:
    """For each text, given by its words' hashes: the words in windows of ``width`` that occur twice or more in it."""
    counts = np.array([len(h) for h in hashes], np.int64)
    total = int(counts.sum())
    out = np.zeros(len(hashes), np.int64)
    if total < width:
        return out
    owner = np.repeat(np.arange(len(hashes)), counts)
    keys = windows(np.concatenate(hashes), width)
    start = np.flatnonzero(owner[: len(keys)] == owner[width - 1 :])  # windows inside one text
    keys = scramble(keys[start] ^ scramble(owner[start].astype(np.uint64) + np.uint64(1)))
    ranked = np.sort(keys)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if len(twice):
        at = start[twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys]
        edge = np.zeros(total + width + 1, np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + width, -1)
        out += np.bincount(owner[np.cumsum(edge)[:total] > 0], minlength=len(hashes))
    return out


def keyed(docs: DataFrame) -> list:
    """doc_id as a long, the host, and a hash of the text: what tells rows apart."""
    return [F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy")]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, host, copy (hash of the text), the measures, and the distinct normal lines with their words (parallel arrays)."""

    def task(batches):
        for batch in slices(batches):
            found, hashes, lines, words_in = [], [], [], []
            for text in batch.column("text").to_pylist():
                data = (text or "").encode()
                words = data.split()
                spaces = len(data) - len(data.translate(None, SPACES))
                seen, again, own = set(), 0, {}
                for line in data.split(b"\n"):
                    n = len(line.split())
                    if n:
                        again += line in seen
                        seen.add(line)
                        key = normal_line(line)
                        own[key] = own.get(key, 0) + n
                hashes.append(word_hash().array(words))
                lines.append(list(own))
                words_in.append(list(own.values()))
                found.append((len(words), len(text or "") - spaces, len(data) - len(data.translate(None, SYMBOL_BYTES)), again))
            columns = [pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("host"), batch.column("copy"), *columns, pa.array(repeat_words(hashes)), pa.array(lines, pa.list_(pa.int64())), pa.array(words_in, pa.list_(pa.int64()))],
                ["doc_id", "host", "copy", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"],
            )

    return docs.select(*keyed(docs), "text").mapInArrow(task, f"doc_id long, host string, copy long, {MEASURES}, lines array<long>, line_words array<long>")


def judge(docs: DataFrame, least_docs: int = 20, share: float = 0.1, least_words: int = 10, least_left: float = 0.2) -> DataFrame:
    """doc_id, host, copy, the measures, base_failed, kept, and ``frequent``: the normal lines that are removed from the document."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.save(measure(docs), "measured")
    each = rows.select("host", "copy", "doc_id", F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
    each = each.select("host", "copy", "doc_id", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    copies = each.groupBy("host", "line", "copy").agg(F.min("doc_id").alias("first"))
    held = copies.groupBy("host", "line").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    sizes = rows.select("host", "copy").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    limit = F.least(F.lit(float(least_docs)), F.greatest(F.lit(1.0), share * F.col("host_docs")))
    often = held.where("n > 1").join(sizes, "host").where(F.col("n") > limit)
    often = scratch.save(often.select("host", "line", "first"), "frequent")
    hits = each.join(often, ["host", "line"]).where("first is null or doc_id is null or doc_id != first")
    lost = hits.groupBy("doc_id", "host", "copy").agg(F.collect_set(F.struct("line", "words")).alias("gone"))  # a set: repeated rows count once
    lost = lost.select(*[F.col(k).alias(f"_{k}") for k in ("doc_id", "host", "copy")], "gone")
    out = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("copy") == F.col("_copy")) & (F.col("host") == F.col("_host")), "left")
    left = F.col("n_words") - F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda n, x: n + x["words"]), F.lit(0))
    out = out.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    depleted = (left < least_words) | (left < least_left * F.col("n_words"))
    out = out.withColumn("kept", ~(F.col("base_failed") | depleted)).withColumn("frequent", F.col("gone.line"))
    return out.select("doc_id", "host", "copy", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "frequent")


def apply_rules(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) without rejected documents, and without the frequent lines of the others."""
    names = docs.columns
    key, host, copy, lines = fresh(docs, "_id", "_host", "_copy", "_lines")

    def task(batches):
        for batch in slices(batches):
            texts = []
            for text, often in zip(batch.column("text").to_pylist(), batch.column(lines).to_pylist(), strict=True):
                if often:
                    gone = set(often)
                    text = b"\n".join(x for x in text.encode().split(b"\n") if not x.split() or normal_line(x) not in gone).decode()
                texts.append(text)
            columns = {n: pa.array(texts, batch.column(n).type) if n == "text" else batch.column(n) for n in names}
            if "n_chars" in columns:
                changed = [len(f) if o.is_valid else n for f, o, n in zip(texts, batch.column(lines), columns["n_chars"].to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(changed, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    verdicts = judge(docs, **limits).where("kept").select(F.col("doc_id").alias(key), F.col("host").alias(host), F.col("copy").alias(copy), F.col("frequent").alias(lines))
    verdicts = verdicts.dropDuplicates([key, host, copy])
    own = keyed(docs)
    found = docs.join(verdicts, own[0].eqNullSafe(F.col(key)) & (own[1] == F.col(host)) & (own[2] == F.col(copy)))
    return found.select(*names, lines).mapInArrow(task, docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "doc_id", "text", "source")).drop("host", "copy", "frequent")


OP8_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, spot, array_to_string(words[spot:spot + 4], ' ') AS five
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS spot FROM docs)),
repeats AS (
  SELECT doc_id, count(DISTINCT word) AS n FROM (
    SELECT doc_id, unnest(range(spot, spot + 5)) AS word
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, five) AS times FROM windows) WHERE times > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, host, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (
    SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM docs)),
dup AS (
  SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, line, count(*) AS n FROM lines WHERE n > 0 GROUP BY doc_id, line) GROUP BY doc_id),
norm AS (
  SELECT doc_id, host, text, n, trim(regexp_replace(translate(line, '123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', '000000000abcdefghijklmnopqrstuvwxyz'),
                                     '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM lines WHERE n > 0),
often AS (
  SELECT host, line, first FROM (
    SELECT host, line, count(DISTINCT text) AS n, min(doc_id) AS first FROM norm GROUP BY host, line)
  JOIN (SELECT host, count(DISTINCT text) AS host_docs FROM docs GROUP BY host) USING (host)
  WHERE n > 1 AND n > least(20, greatest(1, 0.1 * host_docs))),
lost AS (SELECT doc_id, sum(n) AS n FROM norm JOIN often USING (host, line) WHERE doc_id <> first GROUP BY doc_id),
found AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_lost
  FROM docs LEFT JOIN dup USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND n_words - n_lost >= 10 AND n_words - n_lost >= 0.2 * n_words AS kept
FROM found
"""
