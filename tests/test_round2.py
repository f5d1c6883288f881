"""Rows are neither lost nor scored twice, plans stay hash-aggregated, and
offset tables stay small."""

import pytest
from pyspark.sql import functions as F

from textlens import session
from textlens.operators import batch_score as B
from textlens.operators import clean as C
from textlens.operators import consensus as K
from textlens.operators import curves as CV
from textlens.operators import evaluation as E
from textlens.operators import ranking as R
from textlens.operators import trials as TR
from textlens.operators import vectors as V
from textlens.operators.dedupe import keep_first


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_scored_once_even_by_a_random_model(spark):
    def model(texts):
        import random
        return [random.choice([None, t, t + " more"]) for t in texts]

    docs = spark.range(300).select(F.col("id"), F.lit("a b c").alias("text"))
    ok, bad = B.score_and_check(docs, model, "text", "text")
    ids = [r.id for r in ok.collect()] + [r.id for r in bad.collect()]
    assert sorted(ids) == list(range(300))
    assert {r.reason for r in bad.collect()} == {"call failed", "word counts differ"}


def test_posts_without_usable_rationale_are_quarantined(spark):
    hate = [("hatespeech",)]
    rows = [("ok", hate, [[1, 0], [1, 0]], ["A", "b"]), ("none", hate, [], ["A", "b"]), ("short", hate, [[1], [1]], ["A", "b"]),
            ("differ", hate, [[1, 0], [0, 1]], ["A", "b"]), ("normal", [("normal",)], [], ["A"])]
    posts = spark.createDataFrame(rows, K.ANNOTATED_SCHEMA)
    kept, bad = K.rationale_consensus(posts)
    assert [r.post_id for r in kept.collect()] == ["ok"]
    assert {r.post_id: r.reason for r in bad.collect()} == {"none": "no rationale", "short": "rationale shorter than tokens"}
    counts = K.consensus_counters(posts).first()
    assert (counts.n_posts, counts.label_agreed, counts.kept, counts.quarantined) == (5, 4, 1, 2)


def test_best_of_and_keep_first_use_hash_aggregates(spark):
    t = spark.createDataFrame([("s", 1, 0.5), ("s", 2, 0.9), ("s", 3, 0.9)], "study string, trial int, value double")
    best = TR.best_trial(t)
    assert tuple(best.first()) == ("s", 2, 0.9) and "SortAggregate" not in plan_of(best)
    e = spark.createDataFrame([("m", 1, 0.5), ("m", 2, 0.1), ("m", 3, 0.1)], "model string, step int, eval_loss double")
    first = CV.best_checkpoint(e)
    assert tuple(first.first()) == ("m", 2, 0.1) and "SortAggregate" not in plan_of(first)
    d = spark.createDataFrame([(2, "t", "b", 1), (1, "t", "a", 0), (3, "u", "c", 1)], "id int, text string, lang string, n int")
    kept = keep_first(d, "text", "id")
    assert sorted(map(tuple, kept.collect())) == [(1, "t", "a", 0), (3, "u", "c", 1)] and "SortAggregate" not in plan_of(kept)
    counted = keep_first(d, "text", "id", count_col="copies")
    assert sorted((r.id, r.copies) for r in counted.collect()) == [(1, 2), (3, 1)]


def test_range_buckets_are_bounded_and_monotone(spark):
    df = spark.range(20_000).select((F.col("id") * 37 % 20_000).alias("x"))
    b = R.range_bucket(df, "x", 16).groupBy("_bk").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    rows = sorted(b.collect())
    assert len(rows) <= 16 and all(p.hi < q.lo for p, q in zip(rows, rows[1:])) and max(r.n for r in rows) < 4000
    few = R.range_bucket(spark.createDataFrame([(None,), (1,)], "x int"), "x").collect()
    assert sorted(r._bk for r in few)[0] == -1
    assert R.range_bucket(df.where("x < 0"), "x").count() == 0


def test_running_best_under_few_and_many_buckets(spark):
    t = spark.range(500).select(F.lit("s").alias("study"), F.col("id").alias("trial"), ((F.col("id") * 7919) % 501).cast("double").alias("value"))
    few, many = (sorted(map(tuple, TR.running_best(t, n_buckets=n).collect())) for n in (2, 64))
    assert few == many


def test_score_auc_of_no_rows(spark):
    df = spark.createDataFrame([], "label int, score double")
    assert E.roc_auc_from_scores(df).first().auc is None


def test_lenient_cast_marks_bad_values(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "label string")
    got = C.cast_column(df, "label", "int", lenient=True).select("label", "label_rejected").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, False), (None, True), (None, False)], key=str)


def test_step_interval_and_model_series(spark):
    df = spark.createDataFrame([(1000,), (3,)], "n int")
    every = CV.step_interval(F.col("n"), F.lit(3), F.lit(4), F.lit(2), 10)
    assert sorted(r[0] for r in df.select(every).collect()) == [1, 37]
    m = spark.createDataFrame([("f", "b"), ("f", "a-base"), ("f", "c")], "family string, model string")
    s = E.model_series(m, F.col("model") == "a-base")
    assert [r.model for r in s.orderBy("position").collect()] == ["b", "c", "a-base"]


def test_named_columns_round_trip(spark):
    df = spark.createDataFrame([(i, [float(i + j) for j in range(12)]) for i in range(3)], "id int, v array<double>")
    back = V.assembled(V.named_columns(df, "v", 12))
    assert [list(r.features) for r in back.orderBy("id").collect()] == [r.v for r in df.orderBy("id").collect()]


def test_shared_folder_is_required_beyond_local_mode(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())


def test_mean_vectors_by_matrix_and_by_join_agree(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "zz"), (3, None), (4, "b")], "doc_id long, text string")
    vecs = spark.createDataFrame([("a", [1.0, 0.25]), ("b", [0.5, 2.0])], "word string, vec array<double>")
    wide, joined = (sorted(map(tuple, V.mean_vectors(docs, vecs, 2, max_broadcast_bytes=n).collect())) for n in (1 << 20, 0))
    assert wide == joined == [(1, [2.5 / 3, 2.5 / 3]), (2, [0.0, 0.0]), (3, [0.0, 0.0]), (4, [0.5, 2.0])]


def test_contractions_between_punctuation_and_with_typographic_apostrophe(spark):
    from textlens.functions import text as T
    df = spark.createDataFrame([("\"don't\" ('it’s) isn't. o'x '' can't",)], "t string")
    got = df.select(T.expand_contractions("t", {"don't": "do not", "it's": "it is", "isn't": "is not", "can't": "cannot"})).first()[0]
    assert got == "\"do not\" ('it is) is not. o'x '' cannot"
