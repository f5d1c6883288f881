"""Distributed ordinals: ranks, top-n per group and running maxima without a
single-partition window.

A window partitioned only by a low-cardinality key (a class label, a study)
sends every row of that key to one task.  The helpers here split each key
into buckets that follow the sort order, compute the small table of bucket
counts (or maxima), turn it into per-bucket offsets, and finish with a
window partitioned by (key, bucket).  Work per task is bounded by the bucket
size, and the offsets table is bounded by (#keys x #buckets).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(cols) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def seeded_hash(key_cols: Sequence[str] | str, seed) -> Column:
    """Hex md5 of ``key|seed``: a uniform, reproducible sort key.  ``seed``
    may be a constant or a Column (one seed per row, e.g. an iteration)."""
    parts = [F.col(c).cast("string") for c in _cols(key_cols)]
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", *parts, seed_col.cast("string")))


def hash_bucket(hash_col: Column, hex_digits: int = 4) -> Column:
    """Leading hex digits of an md5 as an int bucket, monotone in the hash."""
    return F.conv(F.substring(hash_col, 1, hex_digits), 16, 10).cast("int")


RANGE_BUCKETS = 256   # ranges of a sort column; offsets have at most this many rows per group


def range_bucket(df: DataFrame, col: str, n_buckets: int = RANGE_BUCKETS, out_col: str = "_bk") -> DataFrame:
    """Add a bucket number monotone in a numeric or time column: ranges
    between approximate quantiles, so buckets are about equal and their
    number is fixed however much data there is.  Nulls get the bucket -1."""
    from pyspark.ml.feature import Bucketizer
    value = F.col(col)
    if df.schema[col].dataType.typeName() in ("timestamp", "timestamp_ntz", "date"):
        value = value.cast("timestamp")
    value = value.cast("double")
    keyed = df.withColumn("_range_value", value)
    bounds = keyed.approxQuantile("_range_value", [i / n_buckets for i in range(1, n_buckets)], 1 / (4 * n_buckets))
    splits = [float("-inf"), *(sorted(set(bounds)) or [0.0]), float("inf")]
    out = Bucketizer(splits=splits, inputCol="_range_value", outputCol=out_col, handleInvalid="keep").transform(keyed)
    number = F.when(F.col("_range_value").isNull(), F.lit(-1)).otherwise(F.col(out_col).cast("int"))
    return out.withColumn(out_col, number).drop("_range_value")


def global_rank(df: DataFrame, order_cols: Sequence[str], bucket_col: str,
                partition_cols: Sequence[str] | str = (), rank_col: str = "rank") -> DataFrame:
    """1-based rank by ``order_cols`` within ``partition_cols``, plus
    ``<rank_col>_total``, the row count of the partition.

    ``bucket_col`` must be monotone in ``order_cols`` (rows of a lower bucket
    sort first) and ``order_cols`` must be a total order.  The offsets table
    has one row per (partition, bucket) and is broadcast; its size is fixed
    by the bucket count the caller chose, not by the data volume.
    """
    part = _cols(partition_cols)
    counts = df.groupBy(*part, bucket_col).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*part).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, bucket_col,
                            F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"),
                            F.sum("_n").over(Window.partitionBy(*part)).alias(f"{rank_col}_total"))
    joined = df.join(F.broadcast(offsets), on=[*part, bucket_col], how="inner")
    inner = Window.partitionBy(*part, bucket_col).orderBy(*order_cols)
    return joined.withColumn(rank_col, (F.col("_off") + F.row_number().over(inner)).cast("long")) \
                 .drop("_off")


def hash_rank(df: DataFrame, key_cols: Sequence[str] | str, seed=42,
              partition_cols: Sequence[str] | str = (), rank_col: str = "rank",
              hex_digits: int = 4) -> DataFrame:
    """Rank rows in seeded-md5 order (ties impossible: the key is unique).
    ``hex_digits`` hex digits give 16**hex_digits buckets per partition."""
    keys = _cols(key_cols)
    out = df.withColumn("_h", seeded_hash(keys, seed)) \
            .withColumn("_b", hash_bucket(F.col("_h"), hex_digits))
    out = global_rank(out, ["_h", *keys], "_b", partition_cols, rank_col)
    return out.drop("_h", "_b")


# Catalyst's InferWindowGroupLimit handles row_number() <= n up to this n.
WINDOW_GROUP_LIMIT_THRESHOLD = 1000


def top_n(df: DataFrame, order_cols: Sequence[Column | str], n: int) -> DataFrame:
    """Global top-``n`` rows: planned as TakeOrderedAndProject (a bounded heap
    per task, then one merge of at most tasks x n rows), never a full sort."""
    return df.orderBy(*order_cols).limit(n)


def top_n_per_group(df: DataFrame, group_cols: Sequence[str] | str, order_cols: Sequence[Column | str],
                    n: int, salt_buckets: int = 64, rank_col: str | None = None,
                    salt_cols: Sequence[str] | None = None) -> DataFrame:
    """Exact top-``n`` rows per group; ``order_cols`` must be a total order.

    For n up to the window-group-limit threshold, Catalyst inserts a partial
    per-group limit before the shuffle, so a hot group sends at most n rows
    per task.  Above it, rows are first ranked inside (group, salt) buckets
    and only the local top-n of each bucket reaches the per-group ranking.
    """
    groups = _cols(group_cols)
    name = rank_col or "_r2"
    w2 = Window.partitionBy(*groups).orderBy(*order_cols)
    if n <= WINDOW_GROUP_LIMIT_THRESHOLD:
        out = df.withColumn(name, F.row_number().over(w2)).filter(F.col(name) <= n)
        return out if rank_col else out.drop(name)
    if salt_cols is None:
        salt_cols = [f.name for f in df.schema.fields
                     if f.name not in groups and f.dataType.typeName() != "map"]
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(salt_buckets))
    w1 = Window.partitionBy(*groups, "_salt").orderBy(*order_cols)
    stage1 = df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1)) \
               .filter(F.col("_r1") <= n).drop("_r1", "_salt")
    out = stage1.withColumn(name, F.row_number().over(w2)).filter(F.col(name) <= n)
    return out if rank_col else out.drop(name)


def running_max(df: DataFrame, partition_cols: Sequence[str] | str, order_col: str,
                value_col: str, bucket_col: str, out_col: str = "running_max") -> DataFrame:
    """max(value) over rows up to the current one, ordered by ``order_col``.

    ``bucket_col`` must be monotone in ``order_col``.  Per-bucket running
    maxima are combined with the maximum of all earlier buckets, taken from
    the small (partition, bucket) table.
    """
    part = _cols(partition_cols)
    bmax = df.groupBy(*part, bucket_col).agg(F.max(value_col).alias("_bmax"))
    wprev = Window.partitionBy(*part).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    prev = bmax.select(*part, bucket_col, F.max("_bmax").over(wprev).alias("_prev"))
    joined = df.join(F.broadcast(prev), on=[*part, bucket_col], how="inner")
    wrun = Window.partitionBy(*part, bucket_col).orderBy(order_col) \
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = F.max(value_col).over(wrun)
    return joined.withColumn(out_col, F.when(F.col("_prev").isNull(), local)
                             .otherwise(F.greatest(local, F.col("_prev")))).drop("_prev")
