"""Snapshots and change logs: (old snapshot, changes, clock) -> new snapshot. The clock is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and ``change`` (insert, update, delete, same) of a full outer comparison; values compare null-safely."""
    a = old.select(*keys, F.struct(*values).alias("_old"), F.lit(True).alias("_was"))
    b = new.select(*keys, F.struct(*values).alias("_new"), F.lit(True).alias("_is"))
    both = a.join(b, keys, "full")
    change = F.when(F.col("_was").isNull(), "insert").when(F.col("_is").isNull(), "delete")
    return both.withColumn("change", change.when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("update"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], prune: bool = True) -> DataFrame:
    """The next snapshot: new rows win; rows missing from ``new`` go if ``prune``."""
    both = classify(old, new, keys, values)
    if prune:
        both = both.where("change != 'delete'")
    return both.select(*keys, F.coalesce("_new", "_old").alias("_v")).select(*keys, "_v.*")


def decision_log(old: DataFrame, new: DataFrame, key: str, fields: list[str], now: Column) -> DataFrame:
    """New decisions, with the old ``decided_at`` where all fields are unchanged and ``now`` elsewhere."""
    before = old.select(F.col(key).alias("_k"), F.struct(*fields).alias("_f"), F.col("decided_at").alias("_at"))
    out = new.join(before, F.col(key) == F.col("_k"), "left")
    same = F.col("_k").isNotNull() & F.struct(*fields).eqNullSafe(F.col("_f"))
    return out.select(key, *fields, F.when(same, F.col("_at")).otherwise(now).alias("decided_at"))


def merge_fields(current: str, incoming: str, fields: list[str], prefer: Column) -> list[Column]:
    """Columns that take the incoming field if preferred and present, else the current one, else the incoming."""
    out = []
    for f in fields:
        old, new = F.col(f"{current}.{f}"), F.col(f"{incoming}.{f}")
        has = lambda c: c.isNotNull() & (F.trim(c.cast("string")) != "")
        out.append(F.when(prefer & has(new), new).when(has(old), old).otherwise(new).alias(f))
    return out


def orphans(parents: DataFrame, key: str, children: list[tuple[DataFrame, str]]) -> DataFrame:
    """Parents that no child references: one anti join against all references."""
    used = None
    for df, column in children:
        part = df.select(F.col(column).alias("_ref"))
        used = part if used is None else used.union(part)
    return parents.join(used.distinct(), F.col(key) == F.col("_ref"), "left_anti")
