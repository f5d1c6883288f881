"""Training-log analytics: route log records, number the steps, sample
every N-th step, pick the best checkpoint, align train and eval curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import RANGE_BUCKETS, global_rank, range_bucket


def route(logs: DataFrame, eval_key: str = "eval_loss", train_key: str = "loss") -> DataFrame:
    """``kind`` = eval when the eval key is present, else train when the
    train key is present, else ignored."""
    return logs.withColumn("kind", F.when(F.col(eval_key).isNotNull(), "eval")
                           .when(F.col(train_key).isNotNull(), "train").otherwise("ignored"))


def number_steps(logs: DataFrame, ts_col: str = "ts", tie_col: str = "event_id",
                 group_cols=("model", "kind"), n_buckets: int = RANGE_BUCKETS) -> DataFrame:
    """1-based ``step`` per (model, kind) in time order.  Ranks are bucketed
    by ranges of time that hold about equal numbers of records, so neither a
    long log nor a busy hour is numbered in one task."""
    t = range_bucket(logs, ts_col, n_buckets)
    return global_rank(t, [ts_col, tie_col], "_bk", list(group_cols), "step") \
        .withColumnRenamed("step_total", "n_steps").drop("_bk")


EVAL_KEYS = ("eval_loss", "eval_accuracy", "eval_f1", "eval_precision", "eval_recall")


def eval_record(logs: DataFrame, keys=EVAL_KEYS, prefix: str = "eval_") -> DataFrame:
    """Eval records with only their metric keys: columns of the prefix that
    are not in ``keys`` (timings and the like) are left out."""
    keep = [c for c in logs.columns if not c.startswith(prefix) or c in keys]
    return logs.where(F.col("kind") == "eval").select(*keep)


def step_interval(n_rows, epochs, batch, accumulation, divisor: int = 10) -> F.Column:
    """Steps between two records: total optimizer steps (rows / (batch *
    accumulation), rounded down, one at least, times epochs) over ``divisor``,
    one at least.  Arguments are columns."""
    per_epoch = F.greatest(F.lit(1), F.floor(n_rows / (batch * accumulation)))
    return F.greatest(F.lit(1), F.floor(per_epoch * epochs / divisor)).cast("long")


def metric_curves(eval_steps: DataFrame, metrics=EVAL_KEYS) -> DataFrame:
    """Long form ``(model, step, metric, value)`` of the eval metrics."""
    pairs = ", ".join(f"'{m}', `{m}`" for m in metrics)
    long = eval_steps.selectExpr("model", "step", f"stack({len(metrics)}, {pairs}) AS (metric, value)")
    return long.where(F.col("value").isNotNull())


def every_nth(steps: DataFrame, divisor: int = 10, group_cols=("model", "kind")) -> DataFrame:
    """Keep steps that are multiples of N = max(1, steps // divisor) per
    group (the logging interval rule)."""
    if "n_steps" in steps.columns:   # group sizes already known from numbering
        n = F.greatest(F.lit(1), F.floor(F.col("n_steps") / divisor)).cast("long")
        return steps.filter(F.col("step") % n == 0)
    sizes = steps.groupBy(*group_cols).agg(
        F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / divisor)).cast("long").alias("_n"))
    return steps.join(sizes, list(group_cols)).filter(F.col("step") % F.col("_n") == 0).drop("_n")


def best_checkpoint(eval_steps: DataFrame, loss_col: str = "eval_loss") -> DataFrame:
    """Step with the lowest eval loss per model (ties: earliest step).  A
    model without any loss gives its earliest step and null."""
    best = eval_steps.groupBy(F.col("model").alias("_model")).agg(F.min(loss_col).alias("_best"))  # one row per model
    on = F.col("model").eqNullSafe(F.col("_model")) & F.col(loss_col).eqNullSafe(F.col("_best"))
    return (eval_steps.join(best, on, "left_semi").groupBy("model", loss_col)
            .agg(F.min("step").alias("step")).select("model", "step", loss_col))


def aligned_curves(train_steps: DataFrame, eval_steps: DataFrame) -> DataFrame:
    """Train loss and eval loss side by side per (model, step); a full outer
    join keeps steps present on one side only."""
    t = train_steps.select("model", "step", F.col("loss").alias("train_loss"))
    e = eval_steps.select("model", "step", "eval_loss")
    return t.join(e, ["model", "step"], "full_outer")
