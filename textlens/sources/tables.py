"""Readers for the parquet tables the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


# Session setting: partitions that tables of few row groups are spread over
# after reading.  Unset (the default) leaves the scan's own partitions, which
# is right for inputs of many files.
INPUT_PARTITIONS = "spark.textlens.inputPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(name)
    df = spark.read.parquet(table_path(sf_dir, name))
    n = spark.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(n), df.columns[0]) if n and name in ("documents", "pages", "conversations") else df


def labelled_corpus(spark: SparkSession, sf_dir: str, label: str = "toxic") -> DataFrame:
    """``(doc_id, text, label)``: documents that carry a label.

    Equi-join on ``doc_id``; with AQE the labels side is broadcast when its
    runtime size is small, otherwise a shuffle join runs (and the runtime
    bloom filter from the labels side prunes document rows before the
    shuffle)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))
    return docs.join(labels, "doc_id", "inner")
