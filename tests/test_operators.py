"""Operator semantics on hand-written rows (FIXTURES.md) and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from textlens.operators import clean as C
from textlens.operators import consensus as K
from textlens.operators import evaluation as E
from textlens.operators import profile as P
from textlens.operators import sampling as U
from textlens.operators import trials as TR
from textlens.operators import vectors as V
from textlens.operators.dedupe import keep_first
from textlens.operators.ranking import hash_rank, running_max, top_n_per_group


def test_header_rows_keep_null(spark):
    df = spark.createDataFrame([("Label",), (None,), ("0",)], "label string")
    got = [r[0] for r in C.drop_header_rows(df).collect()]
    assert sorted(got, key=str) == sorted([None, "0"], key=str)


def test_url_filter_case_sensitive(spark):
    df = spark.createDataFrame([(t,) for t in ["http://a", "https://b", "HTTP://c", "ftp://d"]], "text string")
    assert sorted(r[0] for r in C.url_filter(df).collect()) == ["HTTP://c", "ftp://d"]
    assert [r[0] for r in C.url_filter(df, ignore_case=True).collect()] == ["ftp://d"]


def test_max_words(spark):
    df = spark.createDataFrame([(" ".join(["w"] * 64),), (" ".join(["w"] * 65),)], "text string")
    assert C.max_words_filter(df, 64).count() == 1


def test_keep_first(spark):
    df = spark.createDataFrame([(2, "x", 1), (1, "x", 0), (3, "y", 1)], "doc_id long, text string, label int")
    got = sorted(tuple(r) for r in keep_first(df, "text", "doc_id").collect())
    assert got == [(1, "x", 0), (3, "y", 1)]


def test_clean_corpus_single_dedupe_equals_three(spark):
    rows = [(1, "Hello @bob", 0), (2, "hello @alice", 1), (3, "HELLO   @carol", 1), (4, "the", 0),
            (5, "x http://u", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = sorted(tuple(r) for r in C.clean_corpus(df).collect())
    assert got == [(1, "hello @user", 0)]


def test_undersample_exact(spark):
    df = spark.createDataFrame([(i, 0) for i in range(7)] + [(10 + i, 1) for i in range(3)],
                               "doc_id long, label int")
    out = U.undersample(df, "label", "doc_id", 42)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0: 3, 1: 3}


@pytest.mark.parametrize("n,expected_test", [(10, 2), (11, 3)])
def test_split_sizes(spark, n, expected_test):
    df = spark.createDataFrame([(i,) for i in range(n)], "doc_id long")
    out = U.train_test_split(df, "doc_id", 0.2, 42)
    assert out.filter("split = 'test'").count() == expected_test
    assert out.count() == n


def test_split_deterministic_under_repartition(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    a = {r[0] for r in U.train_test_split(df, "doc_id").filter("split='test'").collect()}
    b = {r[0] for r in U.train_test_split(df.repartition(7), "doc_id").filter("split='test'").collect()}
    assert a == b and len(a) == 100


def test_hash_rank_is_dense(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    ranks = sorted(r[0] for r in hash_rank(df, "k", 3, hex_digits=2).select("rank").collect())
    assert ranks == list(range(1, 1001))


def test_top_n_per_group_skewed(spark):
    rows = [("hot", i) for i in range(2000)] + [("cold", i) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, v long")
    out = top_n_per_group(df, "g", [F.desc("v")], 5, rank_col="r")
    got = {(r["g"], r["v"]) for r in out.collect()}
    assert got == {("hot", v) for v in range(1995, 2000)} | {("cold", v) for v in range(3)}


def test_running_max_across_buckets(spark):
    vals = [5, 1, 7, 3, 2, 9, 0, 4]
    df = spark.createDataFrame([("s", i, float(v), i // 3) for i, v in enumerate(vals)],
                               "study string, trial long, value double, b long")
    got = [r["running_max"] for r in running_max(df, "study", "trial", "value", "b").orderBy("trial").collect()]
    exp, m = [], -math.inf
    for v in vals:
        m = max(m, v)
        exp.append(m)
    assert got == exp


def test_length_deciles(spark):
    df = spark.createDataFrame([(" ".join(["w"] * n),) for n in [1, 2, 3, 4, 7, 9, 50]], "text string")
    r = P.length_profile(df).first()
    assert (r["p10"], r["p50"], r["p90"]) == (1.6, 4.0, 25.4)


def _posts(spark, rows):
    return spark.createDataFrame(rows, K.ANNOTATED_SCHEMA)


def test_consensus_upper_lower(spark):
    hs = [{"label": "hatespeech"}] * 2
    posts = _posts(spark, [("p1", hs, [[1, 0], [1, 0]], ["A", "b"])])
    ok, bad = K.rationale_consensus(posts)
    r = ok.first()
    assert r["hate_tokens"] == ["A", "b"] and bad.count() == 0


def test_consensus_disagreement_and_counters(spark):
    hs = [{"label": "hatespeech"}] * 2
    posts = _posts(spark, [("p1", hs, [[1, 0], [0, 1]], ["a", "b"]), ("p2", hs, [[]], [])])
    ok, _ = K.rationale_consensus(posts)
    assert [r["post_id"] for r in ok.collect()] == ["p2"]
    c = K.consensus_counters(posts).first()
    assert (c["label_agreed"], c["rationale_agreed"]) == (2, 0)


def test_short_rationale_quarantined(spark):
    hs = [{"label": "hatespeech"}]
    posts = _posts(spark, [("p1", hs, [[1]], ["a", "b"])])
    ok, bad = K.rationale_consensus(posts)
    assert ok.count() == 0 and bad.count() == 1


def _tm(spark, real, pred):
    df = spark.createDataFrame([(real, pred)], "real_output string, pred_output string")
    return E.token_metrics(df).first()


def test_token_metrics_golden(spark):
    assert round(_tm(spark, "you BAD dog", "you BAD cat")["token_accuracy"], 6) == 66.666667
    assert _tm(spark, "you BAD dog", "YOU BAD dog")["highlight_precision"] == 50.0
    assert _tm(spark, "you BAD DOG", "you BAD dog")["highlight_recall"] == 50.0
    r = _tm(spark, "123 !!", "123 !!")
    assert (r["highlight_precision"], r["highlight_recall"]) == (0.0, 0.0)


def test_length_agreement_partition(spark):
    df = spark.createDataFrame([("a b c", "A B"), ("a b", "A b")], "real_output string, pred_output string")
    ok, bad = E.length_agreement(df)
    assert ok.count() == 1 and bad.count() == 1


def test_hard_label_auc_is_balanced_accuracy(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "label int, prediction int")
    r = E.binary_metrics(df).first()
    assert r["balanced_accuracy"] == 0.75


def test_weighted_recall_equals_accuracy(spark):
    rows = [(i % 3, (i * 7) % 3) for i in range(50)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    r = E.weighted_metrics(df).first()
    assert abs(r["recall"] - r["accuracy"]) < 1e-12


def test_roc_auc_ties_half(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "label int, score double")
    r = E.roc_auc_from_scores(df).first()
    # pairs: tie 0.5, 1, 0, 1 -> 2.5 / 4
    assert r["auc"] == 0.625


def test_bins_right_vs_left_closed(spark):
    df = spark.createDataFrame([("s", 0.0, 1.0), ("s", 1.0, 1.0), ("s", 3.0, 1.0)],
                               "study string, p double, value double")
    b = {r["bin"]: r["n"] for r in TR.binned_score(df, ["p"]).collect()}
    h = {r["bin"]: r["n"] for r in TR.param_histogram(df, ["p"]).collect()}
    assert sum(b.values()) == 3 and sum(h.values()) == 3
    # 1.0 sits exactly on the edge between bins 9 and 10 of 29 over [0, 3]
    assert b[1] == 1 and b[29] == 1 and h[1] == 1 and h[29] == 1


def test_penalty_solver_mask(spark):
    df = spark.createDataFrame([("l1", "lbfgs"), ("elasticnet", "saga"), ("none", "liblinear"), ("l2", "liblinear")],
                               "penalty string, solver string")
    got = [r[0] for r in df.select(TR.penalty_solver_valid()).collect()]
    assert got == [False, True, False, True]


def test_mean_vectors_skip_unknown(spark):
    vecs = spark.createDataFrame([("known", [1.0, 3.0])], "word string, vec array<double>")
    docs = spark.createDataFrame([(1, "known unknown"), (2, "unknown")], "doc_id long, text string")
    got = {r["doc_id"]: r["vec"] for r in V.mean_vectors(docs, vecs, 2).collect()}
    assert got == {1: [1.0, 3.0], 2: [0.0, 0.0]}


def test_batch_predict_requires_strings(spark):
    from textlens.operators import batch_score as B
    df = spark.createDataFrame([(1,)], "text int")
    with pytest.raises(ValueError):
        B.batch_predict(df, B.highlight_long_words(), "text")


def test_batch_predict_failures_reported(spark):
    from textlens.operators import batch_score as B
    df = spark.createDataFrame([("aa bb",), ("fail",), ("cc",)], "text string")

    def fn(texts):
        return [None if t == "fail" else t.upper() for t in texts]
    ok, bad = B.score_and_check(df, fn, "text", "text")
    assert ok.count() == 2 and bad.count() == 1
    assert bad.first()["reason"] == "call failed"
