"""Registered queries: TF-IDF, word-vector encoding, co-occurrence, ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import charclass as cc
from ..functions import text as T
from ..operators import cooccur as CO
from ..operators import ids as I
from ..operators import sampling as U
from ..operators import tfidf as TF
from ..operators import vectors as V
from ..sources.tables import table
from . import sqlparts as S
from .common import reuse
from .registry import register
from .sampling import TRAIN_CORPUS_SQL, train_corpus

MAX_FEATURES = 3000      # smallest TF-IDF size of the feature grid
SPLIT_SEED = 42
TEST_SIZE = 0.2
VECTOR_DIM = 300         # smallest dense size of the feature grid
VECTOR_MIN_COUNT = 2     # words seen once have no vector (exercises unknown words)
WINDOW = 10
MIN_COUNT = 5
MAX_LENGTH = 64


def split_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return reuse(U.train_test_split(docs, "doc_id", TEST_SIZE, SPLIT_SEED))


def fitted_vocab(spark, sf_dir, docs=None):
    docs = docs if docs is not None else split_docs(spark, sf_dir)
    return TF.fit_vocabulary(docs.filter(F.col("split") == "train"), MAX_FEATURES)


SPLIT_SQL = f"""
SELECT doc_id, text,
       CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '{SPLIT_SEED}')), doc_id)
                 <= ceil({TEST_SIZE} * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
FROM documents
"""
TF_SQL = f"""
SELECT doc_id, split, term, count(*) AS tf
FROM (SELECT doc_id, split, unnest(regexp_extract_all(lower(text), {S.q(cc.TOKEN2)})) AS term FROM ({SPLIT_SQL}) s) t
GROUP BY doc_id, split, term
"""
VOCAB_SQL = f"""
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS feature, df,
       ln((1 + (SELECT count(*) FROM ({SPLIT_SQL}) s WHERE split = 'train')) / (df + 1.0)) + 1 AS idf, total
FROM (SELECT term, sum(tf) AS total, count(*) AS df FROM ({TF_SQL}) t WHERE split = 'train'
      GROUP BY term ORDER BY total DESC, term LIMIT {MAX_FEATURES}) k
"""
WEIGHTS_SQL = f"""
SELECT doc_id, term, feature, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight
FROM (SELECT t.doc_id, t.term, v.feature, t.tf * v.idf AS w FROM ({TF_SQL}) t JOIN ({VOCAB_SQL}) v ON t.term = v.term) x
"""


@register("tfidf_top_features", f"""
SELECT term, feature, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf, CAST(total AS BIGINT) AS total
FROM ({VOCAB_SQL}) v
""")
def tfidf_top_features(spark, sf_dir):
    v = fitted_vocab(spark, sf_dir)
    return v.select("term", "feature", "df", F.round("idf", 6).alias("idf"), "total")


@register("tfidf_weights", f"SELECT doc_id, feature, round(weight, 6) AS weight FROM ({WEIGHTS_SQL}) w")
def tfidf_weights(spark, sf_dir):
    docs = split_docs(spark, sf_dir)
    long = TF.transform_long(docs, fitted_vocab(spark, sf_dir, docs))
    return long.select("doc_id", "feature", F.round("weight", 6).alias("weight"))


@register("tfidf_vectors", f"""
SELECT d.doc_id, coalesce(w.nnz, 0) AS nnz, round(coalesce(w.norm, 0), 6) AS norm
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS nnz, sqrt(sum(weight * weight)) AS norm
                            FROM ({WEIGHTS_SQL}) x GROUP BY doc_id) w ON d.doc_id = w.doc_id
""")
def tfidf_vectors(spark, sf_dir):
    """Sparse feature vectors from the ML transformers; checked by their
    number of non-zeros and L2 norm (1, or 0 for documents without terms)."""
    from pyspark.ml.functions import vector_to_array
    docs = split_docs(spark, sf_dir)
    vecs = TF.transform_vectors(docs, fitted_vocab(spark, sf_dir, docs))
    arr = vector_to_array("features")
    return vecs.select(
        "doc_id", F.size(F.filter(arr, lambda x: x != 0)).cast("long").alias("nnz"),
        F.round(F.sqrt(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


# --------------------------------------------------------- word vectors ---

def vector_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    toks = docs.select(F.explode(V.encode_tokens("text")).alias("word"))
    vocab = toks.groupBy("word").count().filter(F.col("count") >= VECTOR_MIN_COUNT).select("word")
    return reuse(vocab)


def vector_table(spark, sf_dir):
    return V.hashed_vectors(vector_words(spark, sf_dir), VECTOR_DIM)


ENC_TOK = f"(SELECT doc_id, unnest({S.words('lower(text)')}) AS word FROM documents)"
VEC_VOCAB = f"(SELECT word FROM {ENC_TOK} t GROUP BY word HAVING count(*) >= {VECTOR_MIN_COUNT})"


@register("doc_vectors_mean", f"""
WITH wc AS (SELECT doc_id, word, count(*) AS cnt FROM {ENC_TOK} t
            WHERE word IN (SELECT word FROM {VEC_VOCAB} v) GROUP BY doc_id, word),
dims AS (SELECT CAST(range AS INTEGER) AS dim FROM range({VECTOR_DIM})),
hw AS (SELECT word, ('0x' || substr(md5(word), 1, 8))::BIGINT AS h1,
              ('0x' || substr(md5(word), 9, 8))::BIGINT AS h2 FROM {VEC_VOCAB} v),
m AS (SELECT wc.doc_id, dims.dim,
             sum(wc.cnt * ((hw.h1 * (dims.dim + 1) + hw.h2) % 4096) / 4096.0) / sum(wc.cnt) AS value
      FROM wc JOIN hw ON wc.word = hw.word, dims GROUP BY wc.doc_id, dims.dim)
SELECT d.doc_id, dims.dim, floor(coalesce(m.value, 0) * 1000000.0 + 0.5) / 1000000.0 AS value
FROM documents d CROSS JOIN dims LEFT JOIN m ON m.doc_id = d.doc_id AND m.dim = dims.dim
""")
def doc_vectors_mean(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the table holds two numbers a word: its vectors are made where they are added up
    seeds = V.hashed_seeds(vector_words(spark, sf_dir))
    m = V.mean_vectors(docs, seeds, VECTOR_DIM, expand=V.expand_seeds)
    return m.select("doc_id", F.posexplode("vec").alias("dim", "value")) \
            .select("doc_id", F.col("dim").cast("int"), T.round_half_up("value", 6).alias("value"))


@register("vector_columns", """
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n_dims, embedding[1] AS first, embedding[-1] AS last,
       round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings
""")
def vector_columns(spark, sf_dir):
    """Vectors stored as named scalar columns and assembled again."""
    from pyspark.ml.functions import vector_to_array
    from ..session import scratch_path
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    size = emb.agg(F.max(F.size("embedding"))).first()[0] or 0
    path = scratch_path(spark, "columns")
    V.named_columns(emb, "embedding", size).write.parquet(path)
    back = V.assembled(spark.read.parquet(path)).withColumn("v", vector_to_array("features"))
    return back.select("vec_id", F.size("v").alias("n_dims"), F.col("v")[0].cast("float").alias("first"),
                       F.element_at("v", -1).cast("float").alias("last"),
                       F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@register("oov_report", f"""
SELECT word, count(*) AS n FROM {ENC_TOK} t
WHERE word NOT IN (SELECT word FROM {VEC_VOCAB} v) GROUP BY word
""")
def oov_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return V.oov_report(docs, vector_table(spark, sf_dir))


# ---------------------------------------------------------- co-occurrence --

@register("cooccurrence", f"""
WITH c AS ({TRAIN_CORPUS_SQL}),
tok AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos
        FROM (SELECT doc_id, {S.words('text')} AS ws FROM c) x),
vocab AS (SELECT word FROM tok GROUP BY word HAVING count(*) >= {MIN_COUNT}),
inv AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k
        FROM tok WHERE word IN (SELECT word FROM vocab)),
pairs AS (SELECT a.word AS x, b.word AS y, CAST(1.0 AS DOUBLE) / (b.k - a.k) AS wt
          FROM inv a JOIN inv b ON a.doc_id = b.doc_id AND b.k > a.k AND b.k <= a.k + {WINDOW}),
sym AS (SELECT x AS w1, y AS w2, wt FROM pairs UNION ALL SELECT y, x, wt FROM pairs)
SELECT w1, w2, round(sum(wt), 6) AS weight FROM sym GROUP BY w1, w2
""")
def cooccurrence(spark, sf_dir):
    co = CO.cooccurrence(train_corpus(spark, sf_dir), WINDOW, MIN_COUNT)
    return co.select("w1", "w2", F.round("weight", 6).alias("weight"))


# ------------------------------------------------------------------- ids --

@register("fixed_length_ids", f"""
WITH v AS ({VOCAB_SQL}),
t AS (SELECT doc_id, unnest(toks) AS term, unnest(range(1, len(toks) + 1)) AS pos
      FROM (SELECT doc_id, list_slice(regexp_extract_all(lower(text), {S.q(cc.TOKEN2)}), 1, {MAX_LENGTH}) AS toks
            FROM documents) x),
ids AS (SELECT t.doc_id, list(coalesce(v.feature + 2, 1) ORDER BY t.pos) AS ids
        FROM t LEFT JOIN v ON t.term = v.term GROUP BY t.doc_id)
SELECT d.doc_id,
       array_to_string(list_concat(coalesce(ids.ids, []),
                       list_transform(range({MAX_LENGTH} - len(coalesce(ids.ids, []))), lambda i: 0)), ',') AS input_ids,
       CAST(len(coalesce(ids.ids, [])) AS BIGINT) AS n_tokens
FROM documents d LEFT JOIN ids ON d.doc_id = ids.doc_id
""")
def fixed_length_ids(spark, sf_dir):
    docs = split_docs(spark, sf_dir)
    enc = I.encode_ids(docs, fitted_vocab(spark, sf_dir, docs), MAX_LENGTH)
    return enc.select("doc_id", F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",")
                      .alias("input_ids"),
                      F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x)
                      .alias("n_tokens"))
