"""Registered queries: rationale consensus, chat records, prompts, scoring.

Annotated posts are derived from documents joined with labels by a fixed
rule, written once in Spark and once in SQL:
  tokens      = whitespace words of the text
  annotators  = [toxic=1 ? hatespeech : normal,
                 quality=1 ? hatespeech : offensive, hatespeech]
  rationales  = [len>=6, len>=6, len>=(lang='en' ? 6 : 7)] per token;
                none for lang='fr', the last token left out for lang='es'
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import (PREDICT_PROMPT_TEMPLATE, TRAIN_PROMPT_TEMPLATE,
                                  TRAIN_SYSTEM_MESSAGE)
from ..operators import batch_score as B
from ..operators import consensus as K
from ..operators import evaluation as E
from ..operators import sampling as U
from ..session import scratch_path
from ..sources.tables import labelled_corpus, table
from . import sqlparts as S
from .common import reuse
from .registry import register

SPLIT_SEED = 42
TEST_SIZE = 0.2


def annotated_posts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    j = docs.join(labels, "doc_id")
    toks = T.words("text")
    flag = lambda k: F.transform(toks, lambda t: F.when(F.length(t) >= k, 1).otherwise(0))
    lang_k = F.when(F.col("lang") == "en", 6).otherwise(7)
    ann = F.array(
        F.struct(F.when(F.col("toxic") == 1, "hatespeech").otherwise("normal").alias("label")),
        F.struct(F.when(F.col("quality") == 1, "hatespeech").otherwise("offensive").alias("label")),
        F.struct(F.lit("hatespeech").alias("label")))
    cut = lambda k: F.slice(flag(k), F.lit(1), F.greatest(F.size(toks) - 1, F.lit(0)))
    rationales = (F.when(F.col("lang") == "fr", F.array().cast("array<array<int>>"))
                  .when(F.col("lang") == "es", F.array(cut(6), cut(6), cut(7)))
                  .otherwise(F.array(flag(6), flag(6), flag(lang_k))))
    return j.select(F.col("doc_id").cast("string").alias("post_id"), ann.alias("annotators"),
                    rationales.alias("rationales"),
                    toks.alias("post_tokens"))


def _words(x):
    return S.words(x)


POSTS_SQL = f"""
SELECT CAST(d.doc_id AS VARCHAR) AS post_id, d.lang, l.toxic, l.quality, {_words('d.text')} AS toks
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""
AGREED = "(toxic = 1 AND quality = 1)"
# tokens that the rationales cover; none of length 6 if the third differs
COVERED = "(CASE WHEN lang = 'es' THEN toks[1:len(toks) - 1] ELSE toks END)"
RAT_SAME = f"(lang = 'en' OR lang IS DISTINCT FROM 'fr' AND len(list_filter({COVERED}, lambda t: length(t) = 6)) = 0)"
WELL_FORMED = f"(lang IS DISTINCT FROM 'fr' AND len({COVERED}) >= len(toks))"
CONSENSUS_SQL = f"""
SELECT post_id, array_to_string(toks, ' ') AS post_text,
       array_to_string(list_transform(toks, lambda t: CASE WHEN length(t) >= 6 THEN {S.upper('t')}
                                                      ELSE lower(t) END), ' ') AS hate_text
FROM ({POSTS_SQL}) p WHERE {AGREED} AND {RAT_SAME} AND {WELL_FORMED}
"""


def consensus(spark, sf_dir):
    ok, _ = K.rationale_consensus(reuse(annotated_posts(spark, sf_dir)))
    return ok


@register("rationale_consensus", CONSENSUS_SQL)
def rationale_consensus(spark, sf_dir):
    return consensus(spark, sf_dir).select(
        "post_id", T.join_words("post_tokens").alias("post_text"),
        T.join_words("hate_tokens").alias("hate_text"))


@register("consensus_counters", f"""
SELECT count(*) AS n_posts, count(*) FILTER (WHERE {AGREED}) AS label_agreed,
       count(*) FILTER (WHERE {AGREED} AND {RAT_SAME} AND len({COVERED}) > 0) AS rationale_agreed,
       count(*) FILTER (WHERE {AGREED} AND {RAT_SAME} AND {WELL_FORMED}) AS kept,
       count(*) FILTER (WHERE {AGREED} AND NOT {WELL_FORMED}) AS quarantined
FROM ({POSTS_SQL}) p
""")
def consensus_counters(spark, sf_dir):
    return K.consensus_counters(reuse(annotated_posts(spark, sf_dir)))


def _tpl_sql(template: str, x: str) -> str:
    head, _, tail = template.partition("{text}")
    return f"({S.q(head)} || {x} || {S.q(tail)})"


@register("chat_records", f"""
SELECT post_id, split,
       CASE WHEN split = 'train' THEN {S.q(TRAIN_SYSTEM_MESSAGE)} END AS system_content,
       CASE WHEN split = 'train' THEN {_tpl_sql(TRAIN_PROMPT_TEMPLATE, 'post_text')} ELSE post_text END AS user_content,
       hate_text AS assistant_content
FROM (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', post_id, '{SPLIT_SEED}')), post_id)
                      <= ceil({TEST_SIZE} * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
      FROM ({CONSENSUS_SQL}) c) s
""")
def chat_records(spark, sf_dir):
    split = U.train_test_split(reuse(consensus(spark, sf_dir)), "post_id", TEST_SIZE, SPLIT_SEED)
    train = K.chat_training_records(split.filter(F.col("split") == "train")).select(
        "post_id", F.lit("train").alias("split"),
        F.col("messages")[0]["content"].alias("system_content"),
        F.col("messages")[1]["content"].alias("user_content"),
        F.col("messages")[2]["content"].alias("assistant_content"))
    test = K.chat_test_records(split.filter(F.col("split") == "test")).select(
        "post_id", F.lit("test").alias("split"), F.lit(None).cast("string").alias("system_content"),
        F.col("input").alias("user_content"), F.col("output").alias("assistant_content"))
    return train.unionByName(test)


def prompt_pairs(spark, sf_dir):
    """User turns paired with the assistant turn that follows (equi-join on
    (conv_id, turn + 1), no grouping of whole conversations)."""
    conv = table(spark, sf_dir, "conversations")
    user = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("user_text"))
    asst = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return user.join(asst, ["conv_id", "turn"], "inner")


PAIRS_SQL = """
SELECT u.conv_id, u.turn, u.text AS user_text, a.text AS reply
FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'
"""


@register("prompt_build", f"""
SELECT conv_id, turn, {_tpl_sql(PREDICT_PROMPT_TEMPLATE, 'user_text')} AS prompt, reply FROM ({PAIRS_SQL}) p
""")
def prompt_build(spark, sf_dir):
    p = prompt_pairs(spark, sf_dir)
    return p.select("conv_id", "turn", T.format_template(PREDICT_PROMPT_TEMPLATE, F.col("user_text"))
                    .alias("prompt"), "reply")


@register("length_mismatch_quarantine", f"""
SELECT conv_id, turn,
       CASE WHEN {S.word_count('user_text')} = {S.word_count('reply')} THEN 'accepted' ELSE 'rejected' END AS status
FROM ({PAIRS_SQL}) p
""")
def length_mismatch_quarantine(spark, sf_dir):
    p = prompt_pairs(spark, sf_dir)
    ok, bad = E.length_agreement(p, "user_text", "reply")
    return ok.select("conv_id", "turn", F.lit("accepted").alias("status")).unionByName(
        bad.select("conv_id", "turn", F.lit("rejected").alias("status")))


@register("batch_score", f"""
SELECT doc_id,
       array_to_string(list_transform({S.words('text')}, lambda w: CASE WHEN length(w) >= 6
                       THEN {S.upper('w')} ELSE lower(w) END), ' ') AS pred_output,
       'accepted' AS status
FROM documents
""")
def batch_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return B.score_table(docs, B.highlight_long_words(6), "text", "text").select(
        "doc_id", "pred_output", "status")


@register("resumed_scoring", f"""
WITH first_run AS (SELECT DISTINCT d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.text IS NOT NULL)
SELECT d.doc_id,
       array_to_string(list_transform({S.words('d.text')}, lambda w: CASE WHEN length(w) >= 6
                       THEN {S.upper('w')} ELSE lower(w) END), ' ') AS pred_output,
       CASE WHEN d.text IS NULL THEN 'rejected' ELSE 'accepted' END AS status,
       CASE WHEN f.text IS NOT NULL THEN 'labelled' WHEN d.text IS NOT NULL THEN 'all' END AS scored_run
FROM documents d LEFT JOIN first_run f ON d.text = f.text
""")
def resumed_scoring(spark, sf_dir):
    """A run over the labelled documents, then one over all: the second sends
    only texts that have no stored prediction."""
    store = B.PredictionStore(spark, scratch_path(spark, "predictions"))
    model = B.highlight_long_words(6)
    store.fill(labelled_corpus(spark, sf_dir), model, "text", "labelled")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = store.score_table(docs, model, "text", "text", "all")
    return scored.select("doc_id", "pred_output", "status", "scored_run")


@register("length_agreement_nulls", f"""
SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n
FROM (SELECT CASE WHEN reply IS NULL OR user_text IS NULL THEN 'a text is missing'
                  WHEN {S.word_count('user_text')} <> {S.word_count('reply')} THEN 'word counts differ' END AS reason
      FROM (SELECT u.text AS user_text, a.text AS reply FROM conversations u
            LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
            WHERE u.role = 'user') p) q
GROUP BY 1
""")
def length_agreement_nulls(spark, sf_dir):
    """User turns with and without an answer: every row is either accepted or
    rejected with a reason, a missing text is a rejection."""
    conv = table(spark, sf_dir, "conversations")
    user = conv.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user_text"))
    reply = conv.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                    F.col("text").alias("reply"))
    ok, bad = E.length_agreement(user.join(reply, ["conv_id", "turn"], "left"), "user_text", "reply")
    missing = F.col("user_text").isNull() | F.col("reply").isNull()
    outcome = F.when(missing, "a text is missing").otherwise("word counts differ")
    return (ok.select(F.lit("accepted").alias("outcome")).unionByName(bad.select(outcome.alias("outcome")))
            .groupBy("outcome").agg(F.count("*").alias("n")))
