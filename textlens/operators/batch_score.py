"""Batch scoring through a pluggable model function.

``predict_fn(list[str]) -> list[str | None]`` runs inside ``mapInPandas``
on Arrow batches, one call per batch, on the executors.  ``None`` marks a
failed call; those rows are reported, not silently dropped.

``PredictionStore`` keeps predictions by text across runs: texts that already
have one are not sent again, and each slice of the rest is stored as soon as it
is scored, so a run that stops keeps what it paid for.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..session import scratch_path
from ..sources.readers import committed


def require_string(df: DataFrame, col: str) -> None:
    """The model function takes a list of strings: reject other input types
    before any task runs."""
    dt = df.schema[col].dataType
    if not isinstance(dt, StringType):
        raise ValueError(f"column {col!r} must be a string column, got {dt.simpleString()}")


def batch_predict(df: DataFrame, predict_fn: Callable[[list[str]], list], text_col: str,
                  out_col: str = "pred_output") -> DataFrame:
    require_string(df, text_col)
    schema = StructType([*df.schema.fields, StructField(out_col, StringType(), True)])

    def run(batches):
        for pdf in batches:
            preds = predict_fn(pdf[text_col].tolist())
            if len(preds) != len(pdf):
                raise ValueError("predict_fn must return one output per input")
            pdf[out_col] = pd.Series(preds, index=pdf.index, dtype="object")
            yield pdf

    return df.mapInPandas(run, schema)


def score_and_check(df: DataFrame, predict_fn, text_col: str, real_col: str,
                    out_col: str = "pred_output") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) after prediction; rejected rows are failed calls
    and predictions whose word count differs from the gold text."""
    scored = score_table(df, predict_fn, text_col, real_col, out_col)
    ok = scored.filter(F.col("status") == "accepted").drop("status", "reason")
    return ok, scored.filter(F.col("status") == "rejected").drop("status")


def score_table(df: DataFrame, predict_fn, text_col: str, real_col: str,
                out_col: str = "pred_output") -> DataFrame:
    """All rows with ``status`` (accepted / rejected) and ``reason``.

    The model runs once per row: the scored rows are written to the shared
    scratch folder and read back, so later filters see one set of outputs
    even if the model answers differently each time."""
    scored = _checked(batch_predict(df, predict_fn, text_col, out_col), real_col, out_col)
    path = scratch_path(df.sparkSession, "scored")
    scored.write.parquet(path)
    return df.sparkSession.read.schema(scored.schema).parquet(path)


def _checked(scored: DataFrame, real_col: str, out_col: str) -> DataFrame:
    """``scored`` with ``reason`` and ``status``."""
    same = T.word_count(real_col) == T.word_count(out_col)
    reason = F.when(F.col(out_col).isNull(), F.lit("call failed")).when(
        F.coalesce(same, F.lit(False)), F.lit(None)).otherwise(F.lit("word counts differ"))
    scored = scored.withColumn("reason", reason)
    return scored.withColumn("status", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected"))


class PredictionStore:
    """Predictions of one model by the SHA-256 of the text, below ``root``.

    A slice of the texts is one job that writes a directory of its own,
    ``<root>/attempt=<id>``; a directory without a commit is not read.  Two
    runs at the same time may both score a text; the same of their
    predictions is then read every time.  Failed calls are stored but count as
    missing, the next run sends them again."""

    SCHEMA = "text_key string, prediction string, run string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self) -> DataFrame:
        """One row per text that has been sent: a prediction if there is one."""
        done = committed(self.spark, f"{self.root}/attempt=*")
        if not done:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = (self.spark.read.schema(self.SCHEMA + ", attempt string").option("basePath", self.root).parquet(*done))
        best = F.struct(F.col("prediction").isNull().alias("failed"), "attempt")
        return (rows.groupBy("text_key").agg(F.min_by(F.struct("prediction", "run"), best).alias("best"))
                .select("text_key", "best.*"))

    def fill(self, texts: DataFrame, predict_fn: Callable[[list[str]], list], text_col: str, run: str,
             slice_texts: int = 100_000) -> int:
        """Score the different texts that have no prediction, about
        ``slice_texts`` at a time; how many there were.  Null texts are not
        sent.  A failing model ends the run, the finished slices stay."""
        require_string(texts, text_col)
        wanted = (texts.select(F.col(text_col).alias("text")).where("text IS NOT NULL")
                  .withColumn("text_key", _text_key("text")).groupBy("text_key").agg(F.first("text").alias("text")))
        known = self.read().where("prediction IS NOT NULL").select("text_key")
        todo = scratch_path(self.spark, "to-score")
        wanted.join(known, "text_key", "left_anti").write.parquet(todo)
        rest = self.spark.read.schema("text_key string, text string").parquet(todo)
        n = rest.count()
        slices = math.ceil(n / slice_texts)
        for i in range(slices):
            part = rest.where(F.pmod(F.xxhash64("text_key"), F.lit(slices)) == i)
            scored = batch_predict(part, predict_fn, "text", "prediction")
            (scored.select("text_key", "prediction", F.lit(run).alias("run"))
             .write.parquet(f"{self.root}/attempt={uuid.uuid4().hex}"))
        return n

    def score_table(self, df: DataFrame, predict_fn: Callable[[list[str]], list], text_col: str, real_col: str,
                    run: str, slice_texts: int = 100_000, out_col: str = "pred_output") -> DataFrame:
        """All rows of ``df`` as ``score_table`` gives them, with the run that
        scored the text in ``scored_run``.  A text on many rows is sent once;
        a null text has no prediction."""
        self.fill(df, predict_fn, text_col, run, slice_texts)
        found = self.read().select(F.col("text_key").alias("_text_key"), F.col("prediction").alias(out_col),
                                   F.col("run").alias("scored_run"))
        joined = df.withColumn("_text_key", _text_key(text_col)).join(found, "_text_key", "left").drop("_text_key")
        return _checked(joined, real_col, out_col)


def _text_key(col: str):
    return F.sha2(F.col(col), 256)


def highlight_long_words(min_len: int = 6) -> Callable[[list[str]], list[str]]:
    """A deterministic local stand-in for a remote model: upper-case words of
    at least ``min_len`` characters, lower-case the rest."""
    def fn(texts: list[str]) -> list[str]:
        return [None if t is None else
                " ".join(w.upper() if len(w) >= min_len else w.lower() for w in t.split())
                for t in texts]
    return fn
