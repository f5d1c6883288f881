"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..session import scratch_path


def reuse(df: DataFrame) -> DataFrame:
    """Persist an intermediate that several branches of one plan read
    (ranks read their input twice: bucket counts and rows).  Memory and
    disk, so a lost executor's blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder, read back and kept:
    what runs on it has a scan for a plan.  Spark's driver keeps the text of
    the last 1,000 plans, and that of a persisted table holds all plans below."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return reuse(df.sparkSession.read.schema(df.schema).parquet(path))
