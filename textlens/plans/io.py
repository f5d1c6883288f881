"""Registered queries: round trips through every source/sink format.

Each query writes Spark-derived data below the shared checkpoint folder,
reads it back with the matching reader and returns it, so the oracle can
compare it with the same data computed straight from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import evaluation as E
from ..operators import tfidf as TF
from ..operators import vectors as V
from ..session import scratch_path
from ..sources import large_files as L
from ..sources import readers as R
from ..sources import writers as W
from ..sources.tables import labelled_corpus, table
from . import sqlparts as S
from .annotation import COVERED, POSTS_SQL, annotated_posts
from .evaluation import MACRO_SQL, predictions
from .features import (TF_SQL, VECTOR_DIM, VOCAB_SQL, fitted_vocab, split_docs,
                       vector_table)
from .registry import register
from .sampling import TRAIN_CORPUS_SQL, train_corpus


@register("csv_roundtrip", f"SELECT doc_id, text, label FROM ({S.CORPUS}) c")
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    W.write_csv(labelled_corpus(spark, sf_dir), path)
    return R.read_csv(spark, path, "doc_id bigint, text string, label int").select("doc_id", "text", "label")


@register("jsonl_roundtrip", "SELECT conv_id, turn, role, text FROM conversations")
def jsonl_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    W.write_jsonl(table(spark, sf_dir, "conversations"), path)
    return R.read_jsonl(spark, path, "conv_id bigint, turn bigint, role string, text string")


ANN_DDL = ("annotators array<struct<label:string>>, rationales array<array<int>>, "
           "post_tokens array<string>")


@register("json_map_roundtrip", f"""
SELECT post_id, CAST(len(toks) AS INTEGER) AS n_tokens,
       CAST(CASE WHEN lang = 'fr' THEN 0 ELSE len(list_filter({COVERED}, lambda t: length(t) >= 6)) END AS INTEGER) AS n_flagged
FROM ({POSTS_SQL}) p
""")
def json_map_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "jsonmap")
    W.write_json_map(annotated_posts(spark, sf_dir), path, "post_id", rows_per_file=100)
    back = R.read_json_map(spark, path, ANN_DDL, "post_id")
    r0 = F.get(F.col("rationales"), 0)
    return back.select("post_id", F.size("post_tokens").alias("n_tokens"),
                       F.when(r0.isNull(), F.lit(0)).otherwise(F.size(F.filter(r0, lambda x: x == 1))).alias("n_flagged"))


@register("json_array_roundtrip", "SELECT conv_id, turn, role, text FROM conversations")
def json_array_roundtrip(spark, sf_dir):
    """Files of one JSON array each, written with a bounded number of records
    per file and read back as one table."""
    path = scratch_path(spark, "jsonarray")
    W.write_json_array(table(spark, sf_dir, "conversations"), path, "conv_id", rows_per_file=1000)
    back = R.read_json_array(spark, path, "conv_id bigint, turn bigint, role string, text string")
    return back.select("conv_id", "turn", "role", "text")


#: small enough that the test tables' files are read by several tasks
SPLIT_BYTES = 1 << 20


@register("large_csv_roundtrip", f"SELECT doc_id, text, label FROM ({S.CORPUS}) c")
def large_csv_roundtrip(spark, sf_dir):
    """CSV files read in splits, whatever line ends their fields hold."""
    path = scratch_path(spark, "largecsv")
    W.write_csv(labelled_corpus(spark, sf_dir), path)
    return L.read_large_csv(spark, path, "doc_id bigint, text string, label int", split_bytes=SPLIT_BYTES)


@register("large_json_map_roundtrip", """
SELECT post_id, CAST(len(toks) AS INTEGER) AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM ({POSTS_SQL}) p
""".replace("{POSTS_SQL}", POSTS_SQL))
def large_json_map_roundtrip(spark, sf_dir):
    """Files of one JSON object each, read in splits."""
    path = scratch_path(spark, "largemap")
    W.write_json_map(annotated_posts(spark, sf_dir), path, "post_id", rows_per_file=1000)
    back = L.read_large_json_map(spark, path, ANN_DDL, "post_id", split_bytes=SPLIT_BYTES)
    return back.select("post_id", F.size("post_tokens").alias("n_tokens"),
                       F.md5(F.array_join("post_tokens", " ")).alias("tokens_md5"))


@register("large_json_array_roundtrip", "SELECT conv_id, turn, role, text FROM conversations")
def large_json_array_roundtrip(spark, sf_dir):
    """Files of one JSON array each, read in splits."""
    path = scratch_path(spark, "largearray")
    W.write_json_array(table(spark, sf_dir, "conversations"), path, "conv_id")
    return L.read_large_json_array(spark, path, "conv_id bigint, turn bigint, role string, text string",
                                   split_bytes=SPLIT_BYTES)


@register("feature_store_roundtrip", f"""
WITH v AS ({VOCAB_SQL}),
w AS (SELECT t.doc_id, t.split, v.feature, t.tf * v.idf AS w FROM ({TF_SQL}) t JOIN v ON t.term = v.term)
SELECT doc_id, feature, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight
FROM w WHERE split = 'test'
""")
def feature_store_roundtrip(spark, sf_dir):
    docs = split_docs(spark, sf_dir)
    long = TF.transform_long(docs, fitted_vocab(spark, sf_dir, docs))
    long = long.join(docs.select("doc_id", "split"), "doc_id").select(
        "doc_id", "feature", "weight", F.lit("tfidf").alias("encoding"),
        F.lit(3000).alias("vector_size"), "split")
    path = scratch_path(spark, "features")
    W.write_partitioned(long, path, ["encoding", "vector_size", "split"])
    back = spark.read.parquet(path).filter(
        (F.col("encoding") == "tfidf") & (F.col("vector_size") == 3000) & (F.col("split") == "test"))
    return back.select("doc_id", "feature", F.round("weight", 6).alias("weight"))


@register("vector_text_roundtrip", f"""
WITH vocab AS (SELECT word FROM (SELECT unnest({S.words('lower(text)')}) AS word FROM documents) t
               GROUP BY word HAVING count(*) >= 2)
SELECT word, {VECTOR_DIM} AS n_dims,
       round(sum((('0x' || substr(md5(word), 1, 8))::BIGINT * (i + 1)
                  + ('0x' || substr(md5(word), 9, 8))::BIGINT) % 4096 / 4096.0), 6) AS total
FROM vocab, range({VECTOR_DIM}) r(i) GROUP BY word
""")
def vector_text_roundtrip(spark, sf_dir):
    """Word vectors written as ``word v1 v2 ...`` lines and parsed back."""
    vt = vector_table(spark, sf_dir)
    line = F.concat_ws(" ", F.col("word"), F.array_join(F.col("vec").cast("array<float>").cast("array<string>"), " "))
    path = scratch_path(spark, "vectors")
    vt.select(line.alias("value")).write.mode("overwrite").text(path)
    back = V.read_vector_text(spark, path)
    return back.select("word", F.size("vec").alias("n_dims"),
                       F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 6)
                       .alias("total"))


@register("results_dir_roundtrip", f"""
SELECT family, model, n_records, round(average_accuracy, 6) AS average_accuracy,
       round(average_f1, 6) AS average_f1
FROM ({MACRO_SQL}) m
""")
def results_dir_roundtrip(spark, sf_dir):
    """Predictions stored per family/model directory, read back as one table
    (the keys come from the paths) and evaluated."""
    path = scratch_path(spark, "predictions")
    preds = predictions(spark, sf_dir).select("family", "model", "real_output", "pred_output")
    W.write_partitioned(preds, path, ["family", "model"], fmt="json", compression="gzip")
    back = R.read_partitioned(spark, path, "json",
                              "real_output string, pred_output string, family string, model string")
    m = E.macro_metrics(E.token_metrics(back))
    return m.select("family", "model", "n_records", F.round("average_accuracy", 6).alias("average_accuracy"),
                    F.round("average_f1", 6).alias("average_f1"))


@register("results_append", f"SELECT label, count(*) AS n FROM ({S.CLEAN_CORPUS}) c GROUP BY label")
def results_append(spark, sf_dir):
    """Missing results file -> empty table; the same run written twice keeps
    one copy (dynamic partition overwrite)."""
    from ..operators.profile import class_counts
    path = scratch_path(spark, "results")
    schema = "label int, n bigint, run string"
    before = R.load_or_empty(spark, path, schema)
    counts = class_counts(C.clean_corpus(labelled_corpus(spark, sf_dir))).withColumn("run", F.lit("r1"))
    W.append_results(before.unionByName(counts), path, ["run"])
    W.append_results(counts, path, ["run"])
    return spark.read.schema(schema).parquet(path).filter(F.col("run") == "r1").select("label", "n")


@register("corpus_text_roundtrip", f"SELECT text AS value FROM ({TRAIN_CORPUS_SQL}) c")
def corpus_text_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "corpus")
    W.write_corpus(train_corpus(spark, sf_dir), path)
    return spark.read.text(path)


@register("model_cache", """
SELECT FALSE AS first_loaded, TRUE AS second_loaded,
       CAST(least(3000, (SELECT count(DISTINCT t) FROM (SELECT unnest(string_split(lower(text), ' ')) AS t FROM documents) x)) AS INTEGER) AS vocab
""")
def model_cache(spark, sf_dir):
    """Fit-or-load keyed by a corpus fingerprint: the second call loads."""
    from pyspark.ml.feature import CountVectorizer
    root = scratch_path(spark, "models")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    toks = docs.select(F.split(F.lower("text"), " ").alias("toks"))
    fp = W.corpus_fingerprint(docs, ["doc_id", "text"])
    est = CountVectorizer(inputCol="toks", outputCol="tf", vocabSize=3000)
    _, loaded1 = W.fit_or_load(est, toks, root, "countvec", fp)
    m, loaded2 = W.fit_or_load(est, toks, root, "countvec", fp)
    return spark.createDataFrame([(loaded1, loaded2, len(m.stages[0].vocabulary))],
                                 "first_loaded boolean, second_loaded boolean, vocab int")
