"""Cutting lineage: what several later steps read is computed once and kept in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in spark.checkpoint.dir (a local folder only where that is unset and the master is local)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}")
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables that later steps read, below spark.checkpoint.dir; local only as in ``cut``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-tables-')}"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
