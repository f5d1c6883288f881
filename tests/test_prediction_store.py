"""Stored predictions: sent once, kept when a run stops."""

import os

import pytest
from pyspark.sql import functions as F

from textlens.operators.batch_score import PredictionStore
from textlens.session import scratch_path


def _model(log, fail_on=None, none_on=None):
    """Upper-cases; every text sent leaves a file, as tasks are other processes."""
    def fn(texts):
        for t in texts:
            if t == fail_on:
                raise RuntimeError("service down")
            with open(os.path.join(log, t.replace(" ", "_")), "a") as f:
                f.write("x")
        return [None if t == none_on else t.upper() for t in texts]
    return fn


def _sent(log):
    return {f: os.path.getsize(os.path.join(log, f)) for f in os.listdir(log)}


def test_texts_are_sent_once(spark, tmp_path):
    log = str(tmp_path)
    store = PredictionStore(spark, scratch_path(spark, "store"))
    rows = [(1, "a b", "x"), (2, "a b", "y"), (3, "c", "z"), (4, None, "n"), (5, "", "e"), (6, "bad", "b")]
    df = spark.createDataFrame(rows, "id long, text string, attempt string")
    first = store.score_table(df.where("id < 3"), _model(log), "text", "text", "r1")
    assert {(r["id"], r["pred_output"], r["status"]) for r in first.collect()} == {(1, "A B", "accepted"), (2, "A B", "accepted")}
    assert _sent(log) == {"a_b": 1}
    both = store.score_table(df.where("id <> 5"), _model(log, none_on="bad"), "text", "text", "r2")
    got = {r["id"]: (r["pred_output"], r["status"], r["scored_run"], r["attempt"]) for r in both.collect()}
    assert got == {1: ("A B", "accepted", "r1", "x"), 2: ("A B", "accepted", "r1", "y"), 3: ("C", "accepted", "r2", "z"),
                   4: (None, "rejected", None, "n"), 6: (None, "rejected", "r2", "b")}
    # the failed call is sent again, the others are not
    assert store.fill(df.where("id <> 5"), _model(log), "text", "r3") == 1
    assert _sent(log) == {"a_b": 1, "c": 1, "bad": 2}
    assert store.read().where("prediction = 'BAD'").first()["run"] == "r3"


def test_a_stopped_run_keeps_its_slices(spark, tmp_path):
    log = str(tmp_path)
    store = PredictionStore(spark, scratch_path(spark, "store"))
    df = spark.createDataFrame([(f"text {i}",) for i in range(40)], "text string")
    last = df.where(F.pmod(F.xxhash64(F.sha2("text", 256)), F.lit(8)) == 7).first()["text"]
    with pytest.raises(Exception, match="service down"):
        store.fill(df, _model(log, fail_on=last), "text", "r1", slice_texts=5)
    kept = {r["prediction"].lower().replace(" ", "_") for r in store.read().collect()}
    assert len(kept) >= 20 and last.replace(" ", "_") not in kept
    before = _sent(log)
    assert store.fill(df, _model(log), "text", "r2", slice_texts=5) == 40 - len(kept)
    after = _sent(log)
    assert all(after[t] == before[t] for t in kept) and len(after) == 40
    assert store.read().where("prediction IS NOT NULL").count() == 40


def test_no_rows(spark):
    store = PredictionStore(spark, scratch_path(spark, "store"))
    df = spark.createDataFrame([], "text string")
    assert store.fill(df, lambda t: t, "text", "r") == 0 and store.read().count() == 0
    assert store.score_table(df, lambda t: t, "text", "text", "r").count() == 0
