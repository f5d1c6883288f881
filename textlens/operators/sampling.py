"""Exact, repeatable sampling and splitting.

Rows are ordered by a seeded md5 of their key.  Sizes are exact (unlike
``randomSplit``/``sample``), the result does not depend on partitioning,
and ranks come from ``ranking.hash_rank`` (bucketed, no single-task window).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import hash_rank, seeded_hash, top_n, top_n_per_group


def sample_exact_n(df: DataFrame, n: int, key_cols: Sequence[str] | str, seed=42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the first ``n`` in seeded-hash order
    (a bounded top-n per task, then one small merge)."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    tagged = df.withColumn("_h", seeded_hash(keys, seed))
    return top_n(tagged, [F.col("_h"), *[F.col(k) for k in keys]], n).drop("_h")


def undersample(df: DataFrame, label_col: str, key_cols: Sequence[str] | str,
                seed=42) -> DataFrame:
    """Sample every class down to the size of the smallest class, without
    replacement.  The per-class sizes are the rank totals; the target is a
    scalar subquery over the small (one row per class) size table."""
    ranked = hash_rank(df, key_cols, seed, partition_cols=label_col, rank_col="_rank")
    sizes = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"))
    target = sizes.agg(F.min("_n").alias("_target")).scalar()
    return ranked.filter(F.col("_rank") <= target).drop("_rank", "_rank_total")


def split_sizes(n: int, test_size: float) -> tuple[int, int]:
    """(train, test) row counts: test = ceil(test_size * n)."""
    n_test = int(math.ceil(test_size * n))
    return n - n_test, n_test


def train_test_split(df: DataFrame, key_cols: Sequence[str] | str, test_size: float = 0.2,
                     seed=42, labels: tuple[str, str] = ("train", "test"),
                     split_col: str = "split") -> DataFrame:
    """Add ``split``: the first ceil(test_size * n) rows in seeded-hash order
    are the test part.  n comes from the bucket-count table of the rank, so
    no separate count job runs."""
    ranked = hash_rank(df, key_cols, seed, rank_col="_rank")
    n_test = F.ceil(F.lit(float(test_size)) * F.col("_rank_total"))
    return ranked.withColumn(split_col, F.when(F.col("_rank") <= n_test, F.lit(labels[1]))
                             .otherwise(F.lit(labels[0]))).drop("_rank", "_rank_total")


def per_iteration_samples(df: DataFrame, key_cols: Sequence[str] | str, iterations: int,
                          n: int) -> DataFrame:
    """``n`` rows for each iteration 0..iterations-1, seeded by the iteration
    (samples of different iterations may overlap)."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    rep = df.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    rep = rep.withColumn("_h", seeded_hash(keys, F.col("iteration")))
    out = top_n_per_group(rep, "iteration", [F.col("_h"), *[F.col(k) for k in keys]], n)
    return out.drop("_h")
