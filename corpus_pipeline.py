"""A training corpus from raw documents: each stage applies one operator to what the stage before it kept.

1. quality: rejected documents go, and the others lose lines that too many documents of their host share.
2. line_dedup: repeated lines go.
3. near_duplicates: of each component of near-duplicate documents the smallest doc_id stays.
4. mixing: documents keep the words that the mixture takes.
5. packing: token pieces and their places in sequences.

Nulls: a null or blank text is rejected by quality, so later stages see words only; rows with a null doc_id pass all
stages; equal rows are judged alike and, as exact copies under one doc_id, stay together until mixing, which takes each by
itself. Very long texts are processed whole. An empty table passes through empty. Further columns, whatever their names,
pass through to the last stage but one.

SQL cannot express the tokenizer of the last stage, so ORACLE_SQL is None; tests run the stages in turn and check what each one
keeps, and that run() packs every kept token once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalume.llm.common import delete, scratch_scope, shared_folder
from catalume.llm.line_dedup import dedup_lines
from catalume.llm.mixing import apply_mix
from catalume.llm.ngram_join import keep_first
from catalume.llm.packing import pack_documents
from catalume.llm.quality import apply_rules

STAGES = [
    ("quality", lambda spark, docs, sf_dir: apply_rules(docs)),
    ("line_dedup", lambda spark, docs, sf_dir: dedup_lines(docs)),
    ("near_duplicates", lambda spark, docs, sf_dir: keep_first(docs)),
    ("mixing", lambda spark, docs, sf_dir: apply_mix(docs)),
    ("packing", lambda spark, docs, sf_dir: pack_documents(docs)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; each result is written to the shared folder and read again, the one before it deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = shared_folder(spark, "pipeline"), None
    for name, stage in STAGES:
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs
