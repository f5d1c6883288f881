"""Registered queries: token-level highlight evaluation and class metrics.

Predictions are derived from documents by a fixed rule, written once in
Spark and once in SQL: the gold text upper-cases words of >= 6 characters;
each model upper-cases words of >= k characters, and the wildcard model
also writes '?' for every 'a'/'A'.  family = document language.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..sources.tables import table
from . import sqlparts as S
from .common import reuse
from .registry import register

# (model, threshold, wildcard)
MODELS = [("ft-01", 5, False), ("ft-02", 6, True), ("ft-03", 7, False), ("gpt-base", 8, False)]
SERIES_HEAD = 10
BASE_MODEL = "gpt-base"


def _case(w, k):
    return F.when(F.length(w) >= k, F.upper(w)).otherwise(F.lower(w))


def predictions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    spec = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("k"),
                                        F.lit(wc).alias("wc")) for m, k, wc in MODELS]))
    # words and the gold text are computed once per document, before the
    # per-model rows are generated
    per_doc = docs.select("doc_id", F.col("lang").alias("family"), T.words("text").alias("_t"))
    per_doc = per_doc.withColumn("real_output", T.join_words(F.transform("_t", lambda w: _case(w, 6))))
    rows = per_doc.select("doc_id", "family", "_t", "real_output", spec.alias("m"))
    real = F.col("real_output")
    pred = T.join_words(F.transform("_t", lambda w: _case(w, F.col("m.k"))))
    wild = F.replace(F.replace(pred, F.lit("a"), F.lit("?")), F.lit("A"), F.lit("?"))
    return rows.select("doc_id", "family", F.col("m.model").alias("model"), real.alias("real_output"),
                       F.when(F.col("m.wc"), wild).otherwise(pred).alias("pred_output"))


def _case_sql(w: str, k: str) -> str:
    return f"CASE WHEN length({w}) >= {k} THEN {S.upper(w)} ELSE lower({w}) END"


MODELS_SQL = " UNION ALL ".join(
    f"SELECT '{m}' AS model, {k} AS k, {str(wc).upper()} AS wc" for m, k, wc in MODELS)
PRED_SQL = f"""
SELECT d.doc_id, d.lang AS family, m.model,
       array_to_string(list_transform({S.words('d.text')}, lambda w: {_case_sql('w', '6')}), ' ') AS real_output,
       array_to_string(list_transform({S.words('d.text')}, lambda w:
           CASE WHEN m.wc THEN regexp_replace({_case_sql('w', 'm.k')}, '[aA]', '?', 'g')
                ELSE {_case_sql('w', 'm.k')} END), ' ') AS pred_output
FROM documents d, ({MODELS_SQL}) m
"""

NOTW = r"[^\p{L}\p{N}_]"


def _upper_sql(w):
    return f"({S.upper(w)} = {w} AND lower({w}) <> {w})"


def _lower_sql(w):
    return f"(lower({w}) = {w} AND {S.upper(w)} <> {w})"


PAIRS = ("list_zip(list_slice(rw, 1, least(len(rw), len(pw))), "
         "list_slice(pw, 1, least(len(rw), len(pw))))")
MATCH = (f"(length(z[1]) = length(z[2]) AND list_bool_and(list_transform("
         f"list_zip(string_split(z[1], ''), string_split(z[2], '')), lambda c: "
         f"c[1] = c[2] OR regexp_matches(c[1], '{NOTW}') OR regexp_matches(c[2], '{NOTW}'))))")
# an empty word list has no pairs: list_bool_and of [] is NULL, so guard with len
MATCH = f"(length(z[1]) = 0 AND length(z[2]) = 0 OR {MATCH})"
TOKEN_SQL = f"""
SELECT doc_id, family, model,
       CASE WHEN len(rw) > 0 THEN m * 100.0 / len(rw) ELSE 0.0 END AS token_accuracy,
       CASE WHEN tp + fp > 0 THEN tp * 100.0 / (tp + fp) ELSE 0.0 END AS highlight_precision,
       CASE WHEN tp + fn > 0 THEN tp * 100.0 / (tp + fn) ELSE 0.0 END AS highlight_recall
FROM (SELECT *, len(list_filter({PAIRS}, lambda z: {MATCH})) AS m,
             len(list_filter({PAIRS}, lambda z: {_upper_sql('z[1]')} AND {_upper_sql('z[2]')})) AS tp,
             len(list_filter({PAIRS}, lambda z: {_lower_sql('z[1]')} AND {_upper_sql('z[2]')})) AS fp,
             len(list_filter({PAIRS}, lambda z: {_upper_sql('z[1]')} AND {_lower_sql('z[2]')})) AS fn
      FROM (SELECT *, {S.words('real_output')} AS rw, {S.words('pred_output')} AS pw FROM ({PRED_SQL}) p) x) y
"""


def token_scores(spark, sf_dir):
    return E.token_metrics(predictions(spark, sf_dir))


def macro_table(spark, sf_dir):
    """The per-model table: a few rows, read by several branches of a plan."""
    return reuse(E.macro_metrics(token_scores(spark, sf_dir)))


def _r(c):
    return F.round(c, 6).alias(c)


@register("token_metrics", f"""
SELECT doc_id, family, model, round(token_accuracy, 6) AS token_accuracy,
       round(highlight_precision, 6) AS highlight_precision, round(highlight_recall, 6) AS highlight_recall
FROM ({TOKEN_SQL}) t
""")
def token_metrics(spark, sf_dir):
    s = token_scores(spark, sf_dir)
    return s.select("doc_id", "family", "model", _r("token_accuracy"), _r("highlight_precision"),
                    _r("highlight_recall"))


MACRO_SQL = f"""
SELECT family, model, count(*) AS n_records, avg(token_accuracy) AS average_accuracy,
       avg(highlight_precision) AS average_precision, avg(highlight_recall) AS average_recall,
       CASE WHEN avg(highlight_precision) + avg(highlight_recall) <> 0 THEN
            2 * avg(highlight_precision) * avg(highlight_recall) / (avg(highlight_precision) + avg(highlight_recall))
       END AS average_f1
FROM ({TOKEN_SQL}) t GROUP BY family, model
"""


@register("model_macro_metrics", f"""
SELECT family, model, n_records, round(average_accuracy, 6) AS average_accuracy,
       round(average_precision, 6) AS average_precision, round(average_recall, 6) AS average_recall,
       round(average_f1, 6) AS average_f1
FROM ({MACRO_SQL}) m
""")
def model_macro_metrics(spark, sf_dir):
    m = E.macro_metrics(token_scores(spark, sf_dir))
    return m.select("family", "model", "n_records", _r("average_accuracy"), _r("average_precision"),
                    _r("average_recall"), _r("average_f1"))


@register("model_series", f"""
SELECT family, model, position, is_base, round(average_f1, 6) AS average_f1
FROM (SELECT family, model, average_f1, model = '{BASE_MODEL}' AS is_base,
             row_number() OVER (PARTITION BY family ORDER BY model = '{BASE_MODEL}', model) AS position
      FROM ({MACRO_SQL}) m) s
WHERE position <= {SERIES_HEAD} OR is_base
""")
def model_series(spark, sf_dir):
    """First ten fine-tuned models of each family in name order, plus the base
    model wherever its name sorts.  Runs on the per-model table."""
    s = E.model_series(macro_table(spark, sf_dir), F.col("model") == BASE_MODEL)
    return s.filter((F.col("position") <= SERIES_HEAD) | F.col("is_base")).select(
        "family", "model", F.col("position").cast("long").alias("position"), "is_base", _r("average_f1"))


# ------------------------------------------------------------ class level --

def _labels(spark, sf_dir):
    """Gold = toxic; the hard prediction is 'low quality' (quality = 0)."""
    lab = table(spark, sf_dir, "labels")
    return lab.select(F.col("toxic").alias("label"), (1 - F.col("quality")).alias("prediction"))


BIN_SQL = """
SELECT count(*) AS n,
       avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy,
       coalesce(sum(CASE WHEN label = 1 AND prediction = 1 THEN 1.0 END) /
                nullif(sum(CASE WHEN prediction = 1 THEN 1.0 ELSE 0 END), 0), 0) AS precision,
       coalesce(sum(CASE WHEN label = 1 AND prediction = 1 THEN 1.0 END) /
                nullif(sum(CASE WHEN label = 1 THEN 1.0 ELSE 0 END), 0), 0) AS recall,
       coalesce(sum(CASE WHEN label = 0 AND prediction = 0 THEN 1.0 END) /
                nullif(sum(CASE WHEN label = 0 THEN 1.0 ELSE 0 END), 0), 0) AS tnr
FROM (SELECT toxic AS label, 1 - quality AS prediction FROM labels) t
"""


@register("accuracy_binary_prf", f"""
SELECT n, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1
FROM ({BIN_SQL}) b
""")
def accuracy_binary_prf(spark, sf_dir):
    m = E.binary_metrics(_labels(spark, sf_dir))
    return m.select("n", _r("accuracy"), _r("precision"), _r("recall"), _r("f1"))


@register("hard_label_auc", f"SELECT round((recall + tnr) / 2, 6) AS auc FROM ({BIN_SQL}) b")
def hard_label_auc(spark, sf_dir):
    m = E.binary_metrics(_labels(spark, sf_dir))
    return m.select(F.round("balanced_accuracy", 6).alias("auc"))


def _weighted_sql(src: str) -> str:
    return f"""
WITH t AS ({src}),
cls AS (SELECT label AS c FROM t UNION SELECT prediction FROM t),
per AS (SELECT c,
          (SELECT count(*) FROM t WHERE label = c) AS sup,
          (SELECT count(*) FROM t WHERE prediction = c) AS prd,
          (SELECT count(*) FROM t WHERE label = c AND prediction = c) AS tp FROM cls),
m AS (SELECT sup, coalesce(tp * 1.0 / nullif(prd, 0), 0) AS p, coalesce(tp * 1.0 / nullif(sup, 0), 0) AS r FROM per)
SELECT (SELECT count(*) FROM t) AS n,
       round((SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM t), 6) AS accuracy,
       round(sum(p * sup) / sum(sup), 6) AS precision, round(sum(r * sup) / sum(sup), 6) AS recall,
       round(sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * sup) / sum(sup), 6) AS f1
FROM m
"""


@register("weighted_prf", _weighted_sql("SELECT toxic AS label, 1 - quality AS prediction FROM labels"))
def weighted_prf(spark, sf_dir):
    m = E.weighted_metrics(_labels(spark, sf_dir))
    return m.select("n", _r("accuracy"), _r("precision"), _r("recall"), _r("f1"))


ARGMAX_SRC = ("SELECT label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS prediction "
              "FROM embeddings")


@register("argmax_metrics", _weighted_sql(ARGMAX_SRC))
def argmax_metrics(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    scored = emb.select("label", E.argmax("embedding").alias("prediction"))
    m = E.weighted_metrics(scored)
    return m.select("n", _r("accuracy"), _r("precision"), _r("recall"), _r("f1"))


LOGITS = """SELECT label % 2 AS label,
  list_sum([embedding[i] FOR i IN range(1, len(embedding) + 1) IF i % 2 = 1]::DOUBLE[]) AS a,
  list_sum([embedding[i] FOR i IN range(1, len(embedding) + 1) IF i % 2 = 0]::DOUBLE[]) AS b FROM embeddings"""


@register("argmax_binary_metrics", f"""
WITH t AS (SELECT label, CASE WHEN b > a THEN 1 ELSE 0 END AS prediction FROM ({LOGITS}) x),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = prediction) AS c,
             count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM t),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r,
             coalesce(tn / nullif(tn + fp, 0), 0) AS s FROM c)
SELECT n, round(c / n, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall,
       round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round((r + s) / 2, 6) AS roc_auc FROM m
""")
def argmax_binary_metrics(spark, sf_dir):
    """Two logits per row (sums of the odd and the even components of the whole
    vector), argmax, and all five metrics; ROC AUC of hard labels is the mean
    of both classes' recalls."""
    emb = table(spark, sf_dir, "embeddings")
    part = lambda odd: F.aggregate(F.filter("embedding", lambda x, i: i % 2 == odd), F.lit(0.0),
                                   lambda a, x: a + x.cast("double"))
    scored = emb.select((F.col("label") % 2).alias("label"), E.argmax(F.array(part(0), part(1))).alias("prediction"))
    m = E.binary_metrics(scored).withColumnRenamed("balanced_accuracy", "roc_auc")
    return m.select("n", *[_r(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")])


@register("score_auc", """
WITH t AS (SELECT l.toxic AS label, CAST(d.n_chars AS DOUBLE) AS s
           FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
per AS (SELECT s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
        FROM t GROUP BY s),
cum AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM per)
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
       round(sum(pos * (below + neg * 0.5)) / (sum(pos) * sum(neg)), 6) AS auc
FROM cum
""")
def score_auc(spark, sf_dir):
    """Real ROC AUC of document length as a toxicity score."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = lab.join(docs, "doc_id")
    a = E.roc_auc_from_scores(j, "toxic", "n_chars")
    return a.select("n_pos", "n_neg", F.round("auc", 6).alias("auc"))


# ---------------------------------------------------- results bookkeeping --
# The per-model table above plays the role of a stored run-results table.

TOP_RUNS = 10
DONE_ACCURACY = 85.0   # runs at or above this accuracy count as stored results


@register("top_runs", f"""
SELECT family, model, round(average_accuracy, 6) AS average_accuracy FROM ({MACRO_SQL}) m
ORDER BY average_accuracy DESC, family, model LIMIT {TOP_RUNS}
""")
def top_runs(spark, sf_dir):
    """The best runs by accuracy (a top-k report)."""
    from ..operators.ranking import top_n
    m = macro_table(spark, sf_dir)
    best = top_n(m, [F.desc("average_accuracy"), "family", "model"], TOP_RUNS)
    return best.select("family", "model", _r("average_accuracy"))


@register("run_keys", f"""
SELECT key, split_part(key, '_', 1) AS key_model, split_part(key, '_', 2) AS key_family,
       CAST(split_part(key, '_', 3) AS INTEGER) AS key_size
FROM (SELECT concat_ws('_', model, family, CAST(n_records AS VARCHAR), '2') AS key FROM ({MACRO_SQL}) m) k
""")
def run_keys(spark, sf_dir):
    """Compose run keys ``model_family_size_2`` and parse them back."""
    m = macro_table(spark, sf_dir)
    k = m.select(F.concat_ws("_", "model", "family", F.col("n_records").cast("string"), F.lit("2"))
                 .alias("key"))
    part = lambda i: F.split_part("key", F.lit("_"), F.lit(i))
    return k.select("key", part(1).alias("key_model"), part(2).alias("key_family"),
                    part(3).cast("int").alias("key_size"))


@register("resume_antijoin", f"""
SELECT g.family, g.model FROM (SELECT DISTINCT family, model FROM ({PRED_SQL}) p) g
WHERE NOT EXISTS (SELECT 1 FROM ({MACRO_SQL}) r
                  WHERE r.family = g.family AND r.model = g.model AND r.average_accuracy >= {DONE_ACCURACY})
""")
def resume_antijoin(spark, sf_dir):
    """Runs of the grid without a stored result (anti-join on the keys)."""
    from ..operators.models import pending_runs
    grid = predictions(spark, sf_dir).select("family", "model").distinct() \
        .withColumnRenamed("family", "encoding_type").withColumn("vector_size", F.lit(0)) \
        .withColumnRenamed("model", "model")
    done = macro_table(spark, sf_dir).filter(F.col("average_accuracy") >= DONE_ACCURACY) \
        .select(F.col("family").alias("encoding_type"), F.lit(0).alias("vector_size"), "model")
    todo = pending_runs(grid, done)
    return todo.select(F.col("encoding_type").alias("family"), "model")
