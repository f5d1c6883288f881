"""Annotator consensus over token rationales, and chat-style records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import (HATE_LABEL, PREDICT_PROMPT_TEMPLATE, PREDICT_SYSTEM_MESSAGE,
                                  TRAIN_PROMPT_TEMPLATE, TRAIN_SYSTEM_MESSAGE)

ANNOTATED_SCHEMA = ("post_id string, annotators array<struct<label:string>>, "
                    "rationales array<array<int>>, post_tokens array<string>")


def consensus_flags(posts: DataFrame, label: str = HATE_LABEL) -> DataFrame:
    """Add ``label_agreed``, ``rationale_agreed``, ``rationale_nonempty`` and
    ``well_formed`` to annotated posts.

    Label agreement holds when every annotator gave ``label`` (true for no
    annotators).  Rationale agreement holds when all rationales equal the
    first.  A rationale shorter than the token list cannot be applied; such
    posts are flagged ``well_formed = false`` instead of failing the job.
    """
    r0 = F.get(F.col("rationales"), 0)
    label_agreed = F.forall("annotators", lambda a: a["label"] == F.lit(label))
    same = (F.size("rationales") > 0) & F.forall("rationales", lambda r: r == r0)
    return posts.withColumns({
        "label_agreed": label_agreed,
        "rationale_agreed": label_agreed & same,
        "rationale_nonempty": F.coalesce(F.size(r0) > 0, F.lit(False)),
        "well_formed": F.coalesce(F.size(r0) >= F.size("post_tokens"), F.lit(False)),
    })


def hate_tokens(tokens="post_tokens", rationale=None):
    """Upper-case tokens flagged 1 in the rationale, lower-case the rest."""
    r0 = rationale if rationale is not None else F.get(F.col("rationales"), 0)
    return F.transform(F.col(tokens) if isinstance(tokens, str) else tokens,
                       lambda t, i: F.when(F.get(r0, i) == 1, F.upper(t)).otherwise(F.lower(t)))


def rationale_consensus(posts: DataFrame, label: str = HATE_LABEL) -> tuple[DataFrame, DataFrame]:
    """Split annotated posts into (consensus, quarantine).

    consensus: ``post_id, post_tokens, hate_tokens`` for posts whose
    annotators agree on ``label`` and on one well-formed rationale.
    quarantine: posts with an agreed label whose first rationale is missing or
    does not cover the tokens, whatever the others say."""
    flagged = consensus_flags(posts, label).filter("label_agreed")
    ok = flagged.filter(F.col("rationale_agreed") & F.col("well_formed")).select(
        "post_id", "post_tokens", hate_tokens().alias("hate_tokens"))
    reason = F.when(F.coalesce(F.size("rationales"), F.lit(0)) <= 0, "no rationale").otherwise(
        "rationale shorter than tokens")
    bad = flagged.filter(~F.col("well_formed")).select("post_id", reason.alias("reason"))
    return ok, bad


def consensus_counters(posts: DataFrame, label: str = HATE_LABEL) -> DataFrame:
    """One pass: posts, label-agreed, rationale-agreed with a non-empty
    rationale, kept, quarantined."""
    f = consensus_flags(posts, label)
    return f.agg(
        F.count(F.lit(1)).alias("n_posts"),
        F.count_if("label_agreed").alias("label_agreed"),
        F.count_if(F.col("rationale_agreed") & F.col("rationale_nonempty")).alias("rationale_agreed"),
        F.count_if(F.col("rationale_agreed") & F.col("well_formed")).alias("kept"),
        F.count_if(F.col("label_agreed") & ~F.col("well_formed")).alias("quarantined"))


def chat_training_records(consensus: DataFrame, template: str = TRAIN_PROMPT_TEMPLATE,
                          system: str = TRAIN_SYSTEM_MESSAGE) -> DataFrame:
    """``post_id, messages`` with system / user prompt / assistant answer."""
    post_text = T.join_words("post_tokens")
    return consensus.select(
        "post_id",
        T.chat_messages(F.lit(system), T.format_template(template, post_text),
                        T.join_words("hate_tokens")).alias("messages"))


def chat_test_records(consensus: DataFrame) -> DataFrame:
    return consensus.select("post_id", T.join_words("post_tokens").alias("input"),
                            T.join_words("hate_tokens").alias("output"))


def prediction_request(text_col, template: str = PREDICT_PROMPT_TEMPLATE,
                       system: str = PREDICT_SYSTEM_MESSAGE):
    """Messages sent to a chat model for one input text."""
    return T.chat_messages(F.lit(system), T.format_template(template, F.col(text_col)))
