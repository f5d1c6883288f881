"""Registered queries: corpus profile on the cleaned corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import profile as P
from ..sources.tables import labelled_corpus, table
from . import sqlparts as S
from .registry import register

TOP_K = 200  # words kept per class (word-cloud default)
MIN_COUNT = 5


def cleaned(spark, sf_dir):
    return C.clean_corpus(labelled_corpus(spark, sf_dir))


CC = f"({S.CLEAN_CORPUS}) c"
WORDS = f"(SELECT label, unnest({S.words('text')}) AS word FROM {CC}) w"


@register("class_counts", f"SELECT label, count(*) AS n FROM {CC} GROUP BY label")
def class_counts(spark, sf_dir):
    return P.class_counts(cleaned(spark, sf_dir))


@register("class_share", f"""
SELECT label, n, round(n / sum(n) OVER (), 6) AS share, round(n / sum(n) OVER () * 100, 2) AS share_pct
FROM (SELECT label, count(*) AS n FROM {CC} GROUP BY label) t
""")
def class_share(spark, sf_dir):
    return P.class_share(cleaned(spark, sf_dir))


@register("distinct_labels", "SELECT DISTINCT toxic AS label FROM labels")
def distinct_labels(spark, sf_dir):
    return P.distinct_labels(table(spark, sf_dir, "labels").select(F.col("toxic").alias("label")))


def _profile_sql(src: str) -> str:
    n = S.word_count("text")
    p = ", ".join(f"round(q[{i + 1}], 6) AS p{(i + 1) * 10}" for i in range(10))
    return f"""
SELECT n_docs, min_words, max_words, round(mean_words, 6) AS mean_words, {p},
       round(share_gt_128, 6) AS share_gt_128, round(share_gt_64, 6) AS share_gt_64
FROM (SELECT count(*) AS n_docs, min(n) AS min_words, max(n) AS max_words, avg(n) AS mean_words,
             quantile_cont(n, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS q,
             avg(CASE WHEN n > 128 THEN 1.0 ELSE 0.0 END) AS share_gt_128,
             avg(CASE WHEN n > 64 THEN 1.0 ELSE 0.0 END) AS share_gt_64
      FROM (SELECT {n} AS n FROM {src}) x) t
"""


@register("length_profile", _profile_sql(CC))
def length_profile(spark, sf_dir):
    return P.length_profile(cleaned(spark, sf_dir))


@register("length_profile_raw", _profile_sql("documents"))
def length_profile_raw(spark, sf_dir):
    return P.length_profile(table(spark, sf_dir, "documents"))


@register("vocabulary_size", f"SELECT count(DISTINCT word) AS n_words FROM {WORDS}")
def vocabulary_size(spark, sf_dir):
    return P.vocabulary_size(cleaned(spark, sf_dir))


@register("vocabulary_min_count", f"""
SELECT word, count(*) AS n FROM {WORDS} GROUP BY word HAVING count(*) >= {MIN_COUNT}
""")
def vocabulary_min_count(spark, sf_dir):
    return P.vocabulary_min_count(cleaned(spark, sf_dir), MIN_COUNT)


@register("top_words_per_class", f"""
SELECT label, word, n, rank FROM (
  SELECT label, word, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, word) AS rank
  FROM (SELECT label, word, count(*) AS n FROM {WORDS} GROUP BY label, word) t) r
WHERE rank <= {TOP_K}
""")
def top_words_per_class(spark, sf_dir):
    out = P.top_words_per_class(cleaned(spark, sf_dir), TOP_K)
    return out.withColumn("rank", F.col("rank").cast("long"))
