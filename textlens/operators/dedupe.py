"""Keep-first de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType


def keep_first(df: DataFrame, subset: Sequence[str] | str, order_col: str,
               count_col: str | None = None) -> DataFrame:
    """One row per distinct ``subset``: the row with the smallest ``order_col``.

    Expressed as a hash aggregate, so duplicates are collapsed map-side before
    the shuffle: a text repeated in a third of all rows costs one partial row
    per task, not a skewed partition.  Numeric columns come along by
    ``min_by``; other columns would turn that into a sort aggregate, so the
    rows are then found again by a null-safe equi-join on the key,
    ``order_col`` and a hash of the other columns; of equal rows one stays.
    Null keys are a group, a null ``order_col`` goes last, and rows that tie
    in ``order_col`` give any one of them.
    """
    keys = [subset] if isinstance(subset, str) else list(subset)
    others = [c for c in df.columns if c not in keys and c != order_col]
    aggs = [F.min(order_col).alias(order_col)]
    if any(not isinstance(df.schema[c].dataType, (NumericType, BooleanType)) for c in others):
        return _first_rows(df, keys, order_col, others, count_col)
    # min_by passes over rows without an order; a group of such rows gives any one of them
    aggs += [F.when(F.min(order_col).isNull(), F.first(c)).otherwise(F.min_by(c, order_col)).alias(c) for c in others]
    cols = list(df.columns)
    if count_col:   # number of copies, in the same aggregation
        aggs.append(F.count(F.lit(1)).alias(count_col))
        cols.append(count_col)
    return df.groupBy(*keys).agg(*aggs).select(*cols)


def _first_rows(df: DataFrame, keys: Sequence[str], order_col: str, others: Sequence[str],
                count_col: str | None) -> DataFrame:
    """``keep_first`` by a join with the first row's hash in each group.

    Key, order and hash travel as one struct: structs compare null-safe, and
    the rows that come out of the join stay dealt by it for the last step."""
    maps = [c for c in others if "map<" in df.schema[c].dataType.simpleString()]  # neither hashed nor compared
    held = df.withColumn("_pick", F.xxhash64(*[F.to_json(F.struct(c)) if c in maps else F.col(c) for c in others]))

    def place(order: str, pick: str):
        return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(order).alias("order"), F.col(pick).alias("pick")).alias("_place")

    first = held.groupBy(*keys).agg(
        F.min(order_col).alias("_first"), F.count(F.lit(1)).alias("_copies"),
        F.coalesce(F.min_by("_pick", order_col), F.min("_pick"), F.lit(0)).alias("_picked")).select(place("_first", "_picked"), "_copies")
    rows = held.select(place(order_col, "_pick"), *others).join(first, "_place", "inner" if count_col else "left_semi")
    rows = rows.dropDuplicates(["_place", *[c for c in others if c not in maps], *(["_copies"] if count_col else [])])
    of = {order_col: "_place.order", **{k: f"_place.k{i}" for i, k in enumerate(keys)}}
    return rows.select(*[F.col(of.get(c, c)).alias(c) for c in df.columns], *([F.col("_copies").alias(count_col)] if count_col else []))
