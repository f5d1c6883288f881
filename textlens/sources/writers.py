"""Sinks: CSV, JSON Lines, corpus text, partitioned stores, idempotent
result appends, whole-file JSON maps and a fit-or-load model cache."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import path_exists


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line (``to_json`` of the whole row)."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_corpus(df: DataFrame, path: str, text_col: str = "text") -> None:
    """One document per line (embedded newlines folded to spaces)."""
    df.select(F.regexp_replace(text_col, r"[\r\n]+", " ").alias("value")) \
      .write.mode("overwrite").text(path)


#: Files that a task of a partitioned write holds open at most.
OPEN_FILES = 64


def write_partitioned(df: DataFrame, path: str, partition_cols: list[str], fmt: str = "parquet",
                      mode: str = "overwrite", **options: str) -> None:
    """Partitioned layout (e.g. encoding/vector_size/split): readers that
    filter on the keys read only the matching directories.  A task of few keys
    writes their files side by side; Spark would sort (and spill) its rows."""
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, str(max(int(before), OPEN_FILES)))
    try:
        df.write.mode(mode).partitionBy(*partition_cols).format(fmt).options(**options).save(path)
    finally:
        conf.set(name, before)


def append_results(df: DataFrame, path: str, partition_cols: list[str], fmt: str = "parquet") -> None:
    """Append a run's results; writing the same run again replaces its
    partitions (dynamic partition overwrite) instead of duplicating rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
      .partitionBy(*partition_cols).format(fmt).save(path)


def write_json_map(df: DataFrame, path: str, key_col: str, rows_per_file: int = 10000) -> None:
    """Files each holding one JSON object ``{key: record}``.  Rows are spread
    over ceil(n / rows_per_file) hash buckets, so one file (one group) holds
    a bounded number of records whatever the table size."""
    n = df.count()
    buckets = max(1, math.ceil(n / rows_per_file))
    value_cols = [c for c in df.columns if c != key_col]
    rec = F.struct(F.col(key_col).cast("string").alias("k"), F.struct(*value_cols).alias("v"))
    grouped = df.withColumn("_b", F.pmod(F.xxhash64(key_col), F.lit(buckets))) \
                .groupBy("_b").agg(F.map_from_entries(F.collect_list(rec)).alias("m"))
    # one directory per bucket: every file holds exactly one JSON object
    grouped.select("_b", F.to_json("m").alias("value")).write.mode("overwrite") \
           .partitionBy("_b").text(path)


def write_json_array(df: DataFrame, path: str, key_col: str, rows_per_file: int = 10000) -> None:
    """Files each holding one JSON array of records.  Rows are spread over
    ceil(n / rows_per_file) hash buckets of the whole row, so a file holds a
    bounded number of records even if one key has many."""
    n = df.count()
    buckets = max(1, math.ceil(n / rows_per_file))
    grouped = df.withColumn("_b", F.pmod(F.xxhash64(*df.columns), F.lit(buckets))) \
                .groupBy("_b").agg(F.sort_array(F.collect_list(F.struct(key_col, *[c for c in df.columns if c != key_col]))).alias("a"))
    grouped.select("_b", F.to_json("a").alias("value")).write.mode("overwrite") \
           .partitionBy("_b").text(path)


def corpus_fingerprint(df: DataFrame, cols: list[str]) -> str:
    """Row count and order-free hash sum of the given columns: a cache key
    that changes when the corpus changes."""
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}-{row['h']}"


def fit_or_load(estimator, df: DataFrame, root: str, name: str, fingerprint: str):
    """Load ``root/name-fingerprint`` if it exists, else fit and save it."""
    from pyspark.ml import PipelineModel
    path = f"{root.rstrip('/')}/{name}-{fingerprint}"
    spark = df.sparkSession
    if path_exists(spark, path):
        return PipelineModel.load(path), True
    from pyspark.ml import Pipeline
    model = Pipeline(stages=[estimator]).fit(df)
    model.write().overwrite().save(path)
    return model, False
