"""Evaluation: token-level highlight metrics and class-level metrics.

Token metrics are counts per record followed by one grouped average; class metrics reduce to a confusion table (one row per
(label, prediction) pair) before any per-class arithmetic, so the shuffle
carries at most k*k partial rows per task.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import scratch_path


# ------------------------------------------------------------ token level --

#: Records whose words are compared at a time.
RECORDS_AT_ONCE = 2_000


def _case_code(w: str) -> int:
    """1 = all cased characters upper (and at least one), -1 = all lower, 0 = neither."""
    if w.upper() == w:
        return 1 if w.lower() != w else 0
    return -1 if w.lower() == w else 0


def _wildcard(c: str) -> bool:
    return c != "_" and unicodedata.category(c)[0] not in "LN"


def _alike(gold: str, predicted: str) -> bool:
    """Words of equal length that are equal but for non-word characters."""
    return len(gold) == len(predicted) and all(
        x == y or _wildcard(x) or _wildcard(y) for x, y in zip(gold, predicted))


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts, the text each is of, and the words of each text."""
    lists = pc.utf8_split_whitespace(texts)
    flat, text = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    some = pc.binary_length(flat).to_numpy() > 0
    flat, text = flat.filter(pa.array(some)), text[some]
    return flat, text, np.bincount(text, minlength=len(texts))


def _first(flat: pa.Array, text: np.ndarray, n: np.ndarray, most: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The first ``most`` words of each text."""
    keep = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) < most[text]
    return flat.filter(pa.array(keep)), text[keep]


PAIR_COUNTS = "struct<n_real:long,m:long,tp:long,fp:long,fn:long>"


def _pair_counts(real: pa.Array, pred: pa.Array) -> pa.Array:
    (r, r_text, r_n), (p, p_text, p_n) = _split(real), _split(pred)
    least = np.minimum(r_n, p_n)
    (r, text), (p, _) = _first(r, r_text, r_n, least), _first(p, p_text, p_n, least)
    both = pa.concat_arrays([r, p]).dictionary_encode()
    words, at = both.dictionary.to_pylist(), both.indices.to_numpy().astype(np.int64)
    gold, predicted = at[: len(r)], at[len(r) :]
    case = np.array([_case_code(w) for w in words], np.int64)
    matched = gold == predicted
    # other pairs: the distinct ones are compared once
    other = np.flatnonzero(~matched)
    pairs, place = np.unique(gold[other] * len(words) + predicted[other], return_inverse=True)
    alike = np.array([_alike(words[k // len(words)], words[k % len(words)]) for k in pairs.tolist()], bool)
    matched[other] = alike[place]
    code = 3 * case[gold] + case[predicted]
    counts = [np.bincount(text[hit], minlength=len(real)) for hit in (matched, code == 4, code == -2, code == 2)]
    no_gold = real.is_null().to_numpy(zero_copy_only=False)
    none = no_gold | pred.is_null().to_numpy(zero_copy_only=False)
    columns = [pa.array(r_n, pa.int64(), mask=no_gold), *[pa.array(c, pa.int64(), mask=none) for c in counts]]
    return pa.StructArray.from_arrays(columns, names=["n_real", "m", "tp", "fp", "fn"])


def pair_counts(real: pa.Array, pred: pa.Array) -> pa.Array:
    """Words of the gold text, and its word pairs with the predicted text that
    match, are both upper (tp), lower and upper (fp), upper and lower (fn);
    null if a text is."""
    parts = [_pair_counts(real.slice(k, RECORDS_AT_ONCE), pred.slice(k, RECORDS_AT_ONCE))
             for k in range(0, len(real) or 1, RECORDS_AT_ONCE)]
    return pa.concat_arrays(parts)


def token_metrics(df: DataFrame, real_col: str = "real_output",
                  pred_col: str = "pred_output") -> DataFrame:
    """Per record: token accuracy %, highlight precision %, highlight recall %.

    accuracy  = matched words / gold words * 100 (0 without gold words)
    precision = TP / (TP + FP) * 100, TP = both upper, FP = gold lower and
                predicted upper (0 when undefined)
    recall    = TP / (TP + FN) * 100, FN = gold upper and predicted lower

    Word pairs are zipped up to the shorter list.  Each word gets one case
    code (+1 upper, -1 lower, 0 neither); a pair code 3*gold + pred then
    identifies TP (4), FP (-2) and FN (2).
    """
    df = df.withColumn("_c", F.arrow_udf(pair_counts, PAIR_COUNTS)(real_col, pred_col))
    n_real, m, tp, fp, fn = (F.col(f"_c.{c}") for c in ("n_real", "m", "tp", "fp", "fn"))
    return df.withColumns({
        "token_accuracy": F.when(n_real > 0, m * 100.0 / n_real).otherwise(F.lit(0.0)),
        "highlight_precision": F.when(tp + fp > 0, tp * 100.0 / (tp + fp)).otherwise(F.lit(0.0)),
        "highlight_recall": F.when(tp + fn > 0, tp * 100.0 / (tp + fn)).otherwise(F.lit(0.0)),
    }).drop("_c")


def macro_metrics(scored: DataFrame, group_cols: Sequence[str] = ("family", "model")) -> DataFrame:
    """Averages per model; F1 from the averaged precision and recall
    (NULL when both are 0)."""
    g = scored.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.avg("token_accuracy").alias("average_accuracy"),
        F.avg("highlight_precision").alias("average_precision"),
        F.avg("highlight_recall").alias("average_recall"))
    p, r = F.col("average_precision"), F.col("average_recall")
    return g.withColumn("average_f1", F.try_divide(2 * p * r, p + r))


def length_agreement(df: DataFrame, real_col: str = "real_output",
                     pred_col: str = "pred_output") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): predictions must have as many words as the gold
    text; rejected rows carry a ``reason``.  A row without one of the texts is
    rejected: every row is on one side."""
    same = F.coalesce((T.word_count(real_col) == T.word_count(pred_col)) & F.col(real_col).isNotNull()
                      & F.col(pred_col).isNotNull(), F.lit(False))
    ok = df.filter(same)
    bad = df.filter(~same).withColumn("reason", F.lit("word counts differ"))
    return ok, bad


def model_series(macro: DataFrame, is_base, group_col: str = "family", order_col: str = "model") -> DataFrame:
    """Adds ``is_base`` and ``position``: fine-tuned models in name order
    from 1, base models (where the condition ``is_base`` holds) last."""
    flagged = macro.withColumn("is_base", F.coalesce(is_base, F.lit(False)))
    w = Window.partitionBy(group_col).orderBy(F.col("is_base"), F.col(order_col))
    return flagged.withColumn("position", F.row_number().over(w))


# ------------------------------------------------------------ class level --

def argmax(scores) -> F.Column:
    """0-based index of the largest score (first one on ties)."""
    s = F.col(scores) if isinstance(scores, str) else scores
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def confusion(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
              group_cols: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_cols, F.col(label_col).alias("label"),
                      F.col(pred_col).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def binary_metrics(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                   positive=1, group_cols: Sequence[str] = ()) -> DataFrame:
    """accuracy, precision, recall, F1 for the positive class (0 when
    undefined), and balanced accuracy (what ROC AUC returns on hard labels)."""
    cm = confusion(df, label_col, pred_col, group_cols)
    lab, pre, n = F.col("label") == positive, F.col("prediction") == positive, F.col("n")
    z = F.lit(0)
    agg = cm.groupBy(*group_cols).agg(
        F.sum(n).alias("n"),
        F.sum(F.when(F.col("label") == F.col("prediction"), n).otherwise(z)).alias("_c"),
        F.sum(F.when(lab & pre, n).otherwise(z)).alias("_tp"),
        F.sum(F.when(~lab & pre, n).otherwise(z)).alias("_fp"),
        F.sum(F.when(lab & ~pre, n).otherwise(z)).alias("_fn"),
        F.sum(F.when(~lab & ~pre, n).otherwise(z)).alias("_tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("_tp", "_fp", "_fn", "_tn"))
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    tnr = F.coalesce(F.try_divide(tn, tn + fp), F.lit(0.0))
    return agg.select(
        *group_cols, F.col("n").cast("long").alias("n"),
        (F.col("_c") / F.col("n")).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"),
        F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0)).alias("f1"),
        ((rec + tnr) / 2).alias("balanced_accuracy"))


def weighted_metrics(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """Support-weighted precision / recall / F1 over all classes seen in
    labels or predictions, plus accuracy.  Weighted recall equals accuracy."""
    cm = confusion(df, label_col, pred_col, group_cols)
    as_true = cm.select(*group_cols, F.col("label").alias("cls"), F.col("n").alias("support"),
                        F.when(F.col("label") == F.col("prediction"), F.col("n"))
                        .otherwise(F.lit(0)).alias("tp"), F.lit(0).cast("long").alias("predicted"))
    as_pred = cm.select(*group_cols, F.col("prediction").alias("cls"),
                        F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("tp"),
                        F.col("n").alias("predicted"))
    per = as_true.unionByName(as_pred).groupBy(*group_cols, "cls").agg(
        F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("predicted").alias("pred"))
    tp, sup, prd = (F.col(c).cast("double") for c in ("tp", "support", "pred"))
    p = F.coalesce(F.try_divide(tp, prd), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, sup), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    per = per.select(*group_cols, "support", "tp", (p * sup).alias("wp"), (r * sup).alias("wr"),
                     (f * sup).alias("wf"))
    tot = per.groupBy(*group_cols).agg(
        F.sum("support").alias("n"), F.sum("tp").alias("_c"),
        F.sum("wp").alias("_wp"), F.sum("wr").alias("_wr"), F.sum("wf").alias("_wf"))
    n = F.col("n").cast("double")
    return tot.select(*group_cols, F.col("n").cast("long").alias("n"),
                      (F.col("_c") / n).alias("accuracy"), (F.col("_wp") / n).alias("precision"),
                      (F.col("_wr") / n).alias("recall"), (F.col("_wf") / n).alias("f1"))


def roc_auc_from_scores(df: DataFrame, label_col: str = "label", score_col: str = "score",
                        positive=1, n_buckets: int = 1024) -> DataFrame:
    """Exact ROC AUC from real-valued scores (ties count one half).

    Rows are reduced to one row per distinct score with positive/negative
    counts.  The negatives below each score are a running sum over the sorted
    distinct scores; that sum is computed per score-range bucket (buckets from
    approximate quantiles only need to be monotone, not exact) plus the
    negatives of all lower buckets from the small bucket table.
    """
    from pyspark.ml.feature import Bucketizer
    from pyspark.sql import Window

    per = df.groupBy(F.col(score_col).cast("double").alias("s")).agg(
        F.count_if(F.col(label_col) == positive).alias("pos"),
        F.count_if(F.col(label_col) != positive).alias("neg"))
    path = scratch_path(df.sparkSession, "score-counts")  # read three times below
    per.write.parquet(path)
    per = df.sparkSession.read.schema(per.schema).parquet(path)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    bounds = sorted(set(per.approxQuantile("s", probs, 0.001)))
    splits = [float("-inf"), *(bounds or [0.0]), float("inf")]
    per = Bucketizer(splits=splits, inputCol="s", outputCol="_b").transform(per)
    bneg = per.groupBy("_b").agg(F.sum("neg").alias("_bn"))
    off = bneg.select("_b", F.coalesce(F.sum("_bn").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    per = per.join(F.broadcast(off), "_b")
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("_b").orderBy("s")
                                         .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_below", below + F.col("_off"))
    tot = per.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
                  F.sum(F.col("pos") * (F.col("_below") + F.col("neg") * 0.5)).alias("_u"))
    return tot.select(F.col("n_pos").cast("long"), F.col("n_neg").cast("long"),
                      F.try_divide(F.col("_u"), F.col("n_pos") * F.col("n_neg")).alias("auc"))
