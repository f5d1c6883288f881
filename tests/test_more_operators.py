"""Small-fixture checks for readers, features, lexicon and log operators."""

import math

from pyspark.sql import functions as F

from textlens.operators import curves as CV
from textlens.operators import ids as I
from textlens.operators import lexicon as L
from textlens.operators import models as M
from textlens.operators import tfidf as TF
from textlens.session import scratch_path
from textlens.sources import readers as R
from textlens.sources import writers as W


def test_csv_multiline_quotes_and_na(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text('Content,Label\n"line one\nline ""two""",1\nNA,0\n"x, y",Label\n', encoding="utf-8")
    df = R.read_csv(spark, str(p), "Content string, Label string").collect()
    assert [r["Content"] for r in df] == ['line one\nline "two"', None, "x, y"]
    assert [r["Label"] for r in df] == ["1", "0", "Label"]


def test_tfidf_idf_and_norm(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (3, "x")], "doc_id long, text string")
    vocab = TF.fit_vocabulary(docs, 10)
    v = {r["term"]: r for r in vocab.collect()}
    assert set(v) == {"aa", "bb", "cc"}            # 'x' is a single character
    assert math.isclose(v["bb"]["idf"], math.log(4 / 3) + 1)
    assert [v[t]["feature"] for t in ("aa", "bb", "cc")] == [0, 1, 2]
    w = {(r["doc_id"], r["term"]): r["weight"] for r in TF.transform_long(docs, vocab).collect()}
    a, b = 2 * (math.log(4 / 2) + 1), 1 * (math.log(4 / 3) + 1)
    assert math.isclose(w[(1, "aa")], a / math.hypot(a, b))
    norms = {r["doc_id"]: r["n"] for r in TF.transform_long(docs, vocab).groupBy("doc_id")
             .agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n")).collect()}
    assert all(math.isclose(n, 1.0) for n in norms.values()) and 3 not in norms


def test_top_features_cap(spark):
    docs = spark.createDataFrame([(1, "aa aa aa bb bb cc")], "doc_id long, text string")
    assert [r["term"] for r in TF.fit_vocabulary(docs, 2).orderBy("feature").collect()] == ["aa", "bb"]


def test_encode_ids_pad_truncate(spark):
    vocab = spark.createDataFrame([("aa", 0), ("bb", 1)], "term string, feature int")
    docs = spark.createDataFrame([(1, "aa zz bb"), (2, "aa " * 10), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["input_ids"], r["attention_mask"]) for r in I.encode_ids(docs, vocab, 4).collect()}
    assert got[1] == ([2, 1, 3, 0], [1, 1, 1, 0])
    assert got[2] == ([2, 2, 2, 2], [1, 1, 1, 1])
    assert got[3] == ([0, 0, 0, 0], [0, 0, 0, 0])


def test_noun_lemmas(spark):
    words = spark.createDataFrame([(w,) for w in ["cats", "buses", "glass", "men", "xyzs"]], "form string")
    known = spark.createDataFrame([(w,) for w in ["cat", "bus", "buse", "glass", "man", "men"]], "word string")
    got = {r["form"]: r["lemma"] for r in L.noun_lemmas(words, known).collect()}
    # shortest known candidate wins; a known form beats an equally long
    # rewrite ('men' vs 'man'), and unchanged forms are not listed
    assert got == {"cats": "cat", "buses": "bus"}


def test_route_and_steps(spark):
    rows = [(1, "2024-01-01 00:00:01", "m", 0.5, None), (2, "2024-01-01 00:00:02", "m", None, 0.4),
            (3, "2024-01-01 00:00:03", "m", 0.3, 0.2), (4, "2024-01-01 00:00:04", "m", None, None)]
    df = spark.createDataFrame(rows, "event_id long, ts string, model string, loss double, eval_loss double") \
              .withColumn("ts", F.to_timestamp("ts"))
    steps = CV.number_steps(CV.route(df))
    got = {(r["event_id"]): (r["kind"], r["step"]) for r in steps.collect()}
    assert got == {1: ("train", 1), 2: ("eval", 1), 3: ("eval", 2), 4: ("ignored", 1)}
    best = CV.best_checkpoint(steps.filter("kind = 'eval'")).first()
    assert (best["step"], best["eval_loss"]) == (2, 0.2)


def test_sample_trials_deterministic(spark):
    a = M.sample_trials(spark, M.LREG_SPACE, 20, 7).collect()
    b = M.sample_trials(spark, M.LREG_SPACE, 20, 7).collect()
    assert a == b
    for r in a:
        assert 1e-4 <= r["C"] <= 1e2 and 50 <= r["max_iter"] <= 500
        assert r["penalty"] in ("l1", "l2", "elasticnet", "none")


def test_grid_resume_and_failures(spark):
    rows = [([float(i % 2), float(i)], float(i % 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "vec array<double>, label double")
    ds = {("toy", 2): (M.as_features(df, "vec"), M.as_features(df, "vec"))}
    store = M.grid_store(spark, scratch_path(spark, "test-grid"))
    first = M.run_grid(spark, ds, ["LREG"], store)
    assert [r["status"] for r in first.collect()] == ["ok"]
    again = M.run_grid(spark, ds, ["LREG"], store)
    assert again.count() == 1


def test_json_map_roundtrip(spark):
    df = spark.createDataFrame([("p1", 1, "a"), ("p2", 2, "b")], "post_id string, n int, s string")
    path = scratch_path(spark, "test-jsonmap")
    W.write_json_map(df, path, "post_id", rows_per_file=1)
    back = R.read_json_map(spark, path, "n int, s string")
    assert sorted(tuple(r) for r in back.select("post_id", "n", "s").collect()) == [("p1", 1, "a"), ("p2", 2, "b")]


def test_knn_blocked_equals_single_block(spark):
    from textlens.operators.neighbors import knn_predict
    rows = [(i, [float((i * 7) % 11), float((i * 3) % 5)], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    train, test = df.filter("vec_id < 45"), df.filter("vec_id >= 45")
    one = {r["vec_id"]: r["prediction"] for r in knn_predict(test, train, 5).collect()}
    many = {r["vec_id"]: r["prediction"] for r in knn_predict(test, train, 5, block_rows=4).collect()}
    assert one == many and len(one) == 15


def test_knn_brute_force(spark):
    """Against a plain-Python brute force on a small fixture."""
    from textlens.operators.neighbors import knn_predict
    pts = [(i, [float(i % 4), float(i // 4)], (i * 5) % 3) for i in range(16)]
    df = spark.createDataFrame(pts, "vec_id long, embedding array<double>, label int")
    train, test = df.filter("vec_id % 4 <> 0"), df.filter("vec_id % 4 = 0")
    got = {r["vec_id"]: r["prediction"] for r in knn_predict(test, train, 3).collect()}
    tr = [p for p in pts if p[0] % 4 != 0]
    for vid, v, _ in (p for p in pts if p[0] % 4 == 0):
        near = sorted(tr, key=lambda t: ((t[1][0] - v[0]) ** 2 + (t[1][1] - v[1]) ** 2, t[0]))[:3]
        votes = {}
        for t in near:
            votes[t[2]] = votes.get(t[2], 0) + 1
        want = min(lab for lab, n in votes.items() if n == max(votes.values()))
        assert got[vid] == want


def test_load_or_empty_and_idempotent_append(spark):
    path = scratch_path(spark, "test-results")
    schema = "model string, accuracy double, run string"
    empty = R.load_or_empty(spark, path, schema)
    assert empty.count() == 0 and empty.columns == ["model", "accuracy", "run"]
    rows = spark.createDataFrame([("LREG", 0.5, "r1"), ("NB", 0.4, "r1")], schema)
    W.append_results(rows, path, ["run"])
    W.append_results(rows, path, ["run"])                       # rerun: replaced, not duplicated
    W.append_results(rows.withColumn("run", F.lit("r2")), path, ["run"])
    back = spark.read.schema(schema).parquet(path)
    assert back.filter("run = 'r1'").count() == 2 and back.count() == 4


def test_write_corpus_one_line_per_document(spark):
    path = scratch_path(spark, "test-corpus")
    df = spark.createDataFrame([("a\nb",), ("c",)], "text string")
    W.write_corpus(df, path)
    assert sorted(r["value"] for r in spark.read.text(path).collect()) == ["a b", "c"]


def test_length_agreement_keeps_every_row(spark):
    from textlens.operators.evaluation import length_agreement
    df = spark.createDataFrame([(1, "a b", "x y"), (2, "a", "x y"), (3, None, "x"), (4, "a", None), (5, None, None)],
                               "i int, real_output string, pred_output string")
    ok, bad = length_agreement(df)
    assert [r.i for r in ok.collect()] == [1] and sorted(r.i for r in bad.collect()) == [2, 3, 4, 5]
