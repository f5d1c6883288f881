"""Findings of the third round."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa

from textlens.functions import text as T
from textlens.llm import bpe
from textlens.operators import evaluation as E
from textlens.operators import vectors as V
from textlens.plans import cleaning as CL
from textlens.sources import writers as W


def _means(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.vec) for r in df.collect())


def test_short_vectors_are_expanded_where_they_are_added_up(spark):
    rows = [(1, "a b b zz"), (2, "C a"), (3, None), (4, ""), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = spark.createDataFrame([("a",), ("b",), ("c",)], "word string")
    full, seeds = V.hashed_vectors(words, 5), V.hashed_seeds(words)
    for bound in (1 << 20, 0):
        want = _means(V.mean_vectors(docs, full, 5, max_broadcast_bytes=bound))
        assert _means(V.mean_vectors(docs, seeds, 5, max_broadcast_bytes=bound, expand=V.expand_seeds)) == want
    by_word = {r.word: r.vec for r in full.collect()}
    assert dict(want)[1] == [(a + 2 * b) / 3 for a, b in zip(by_word["a"], by_word["b"])]


def test_mean_vectors_beyond_the_bound_send_a_vector_once_a_block(spark):
    docs = spark.createDataFrame([(i, "a b " * (i % 3)) for i in range(40)], "doc_id long, text string")
    words = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "word string, vec array<double>")
    got = V.mean_vectors(docs, words, 2, max_broadcast_bytes=0)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.vec for r in got.collect()} == {i: [2.0, 3.0] if i % 3 else [0.0, 0.0] for i in range(40)}


def test_pair_counts_of_odd_records():
    real = pa.array(["Abc DEF ghi", "ONE two\x1cthree 12", "", None, "x y", " ÉTÉ a.c  straße"])
    pred = pa.array(["Abc DEF GHI", "one TWO three 1? more", "a", "a", None, "été a?c\tSTRASSE"])
    got = [tuple(r.values()) for r in E.pair_counts(real, pred).to_pylist()]
    assert got == [(3, 2, 1, 1, 0), (4, 2, 0, 1, 1), (0, 0, 0, 0, 0), (None,) * 5, (2, None, None, None, None), (3, 1, 0, 1, 1)]


def test_token_metrics_of_missing_texts(spark):
    rows = [(1, "ONE two", "ONE TWO"), (2, None, "a"), (3, "a", None), (4, "", "")]
    got = {r[0]: tuple(r)[3:] for r in E.token_metrics(spark.createDataFrame(rows, "i int, real_output string, pred_output string")).collect()}
    assert got == {1: (50.0, 50.0, 100.0), 2: (0.0, 0.0, 0.0), 3: (None, 0.0, 0.0), 4: (0.0, 0.0, 0.0)}


def test_partitioned_write_does_not_sort(spark, tmp_path):
    spark.createDataFrame([(i % 3, str(i)) for i in range(30)], "k int, v string").createOrReplaceTempView("r3_rows")
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    W.write_partitioned(spark.table("r3_rows"), f"{tmp_path}/out", ["k"], fmt="json", compression="gzip")
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    assert all(f.suffix == ".gz" for f in tmp_path.glob("out/k=*/part-*"))
    assert spark.read.schema("v string, k int").json(f"{tmp_path}/out").count() == 30


def test_contractions_look_up_only_words_that_can_be_one(spark):
    df = spark.createDataFrame([("don't (it’s) cant  can't. d'oh",), (None,), ("",)], "t string")
    out = df.select(T.expand_contractions("t", {"don't": "do not", "it's": "it is", "can't": "cannot"}).alias("t"))
    assert [r.t for r in out.collect()] == ["do not (it is) cant  cannot. d'oh", None, ""]
    assert "CASE WHEN ((Contains(" in out._jdf.queryExecution().analyzed().toString()
    some = df.select(T.expand_contractions("t", {"cant": "cannot", "d'oh": "oh"}).alias("t"))   # no letter in common
    assert some.first().t == "don't (it’s) cannot  can't. oh"


def test_lemmas_read_the_tokenized_corpus_once(spark, tmp_path):
    spark.createDataFrame([(1, "boy boy boy boy boy boys")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = CL.lemmatize_lexicon(spark, str(tmp_path))
    assert "InMemoryRelation" in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [(1, "boy boy boy boy boy boy")]


def test_ids_are_decoded_by_positions_in_the_joined_tokens():
    path = public_tokenizers.path(bpe.VOCABULARY)
    ranks = bpe.read_ranks(path)
    rows = [[ranks[b" the"], ranks[b"a"]], [], None, [ranks[b"\xff"]] * 3, [max(ranks.values()), 0]]
    tokens = {v: k for k, v in ranks.items()}
    want = [b"".join(tokens[i] for i in row or ()) for row in rows]
    column = pa.array([[1], *rows], pa.list_(pa.int32()))
    assert bpe._Decoder(path)(column.slice(1)).to_pylist() == want
    assert bpe._Decoder(path)(column.slice(0, 0)).to_pylist() == []
