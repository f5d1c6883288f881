"""Corpus profile: class balance, length distribution, vocabulary, top words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import top_n_per_group

DECILES = [round(0.1 * i, 1) for i in range(1, 11)]


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def class_share(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Counts, share and share in percent; the window runs over the per-label
    aggregate (one row per label), not over the input rows."""
    counts = class_counts(df, label_col)
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return counts.select(label_col, "n", F.round(share, 6).alias("share"),
                         F.round(share * 100, 2).alias("share_pct"))


def distinct_labels(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.select(label_col).distinct()


def length_profile(df: DataFrame, text_col: str = "text",
                   thresholds: tuple[int, ...] = (128, 64)) -> DataFrame:
    """Word-count deciles (exact, linear interpolation), min/max/mean and the
    share of texts longer than each threshold, in one aggregation.  The exact
    percentile keeps a value->count map; word counts have few distinct
    values, so the partial states stay small at any row count."""
    n = T.word_count(text_col)
    pct = F.percentile(n, F.array(*[F.lit(p) for p in DECILES]))
    aggs = [F.count(F.lit(1)).alias("n_docs"), pct.alias("_p"),
            F.min(n).cast("long").alias("min_words"), F.max(n).cast("long").alias("max_words"),
            F.avg(n).alias("mean_words")]
    aggs += [F.avg((n > k).cast("double")).alias(f"share_gt_{k}") for k in thresholds]
    out = df.agg(*aggs)
    cols = ["n_docs", "min_words", "max_words", F.round("mean_words", 6).alias("mean_words")]
    cols += [F.round(F.col("_p")[i], 6).alias(f"p{int(round(p * 100))}") for i, p in enumerate(DECILES)]
    cols += [F.round(f"share_gt_{k}", 6).alias(f"share_gt_{k}") for k in thresholds]
    return out.select(*cols)


def word_rows(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, F.explode(T.words(text_col)).alias("word"))


def vocabulary(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)``; partial aggregation combines hot words map-side."""
    return word_rows(df, text_col).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def vocabulary_size(df: DataFrame, text_col: str = "text") -> DataFrame:
    return vocabulary(df, text_col).agg(F.count(F.lit(1)).alias("n_words"))


def vocabulary_min_count(df: DataFrame, min_count: int = 5, text_col: str = "text") -> DataFrame:
    return vocabulary(df, text_col).filter(F.col("n") >= min_count)


def term_counts_by_class(df: DataFrame, label_col: str = "label", text_col: str = "text") -> DataFrame:
    return word_rows(df, text_col, (label_col,)).groupBy(label_col, "word") \
        .agg(F.count(F.lit(1)).alias("n"))


def top_words_per_class(df: DataFrame, k: int = 200, label_col: str = "label",
                        text_col: str = "text") -> DataFrame:
    counts = term_counts_by_class(df, label_col, text_col)
    return top_n_per_group(counts, label_col, [F.desc("n"), F.asc("word")], k, rank_col="rank")
