"""Fixed-length id encoding for sequence models: truncate, map through a
vocabulary, pad, attention mask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PAD_ID = 0
UNK_ID = 1
FIRST_ID = 2


def encode_ids(df: DataFrame, vocab: DataFrame, max_length: int = 64, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``(id, input_ids, attention_mask)``, both arrays of ``max_length``.

    ``vocab`` is ``(term, feature)``; a term maps to ``feature + 2``, unknown
    terms to 1, padding is 0.  Only the first ``max_length`` tokens of each
    text are exploded, so the per-document group is bounded by
    ``max_length``; the vocabulary join is a broadcast of a table bounded by
    its own size parameter."""
    toks = df.select(id_col, F.posexplode(F.slice(T.tfidf_tokens(text_col), 1, max_length))
                     .alias("pos", "term"))
    ids = toks.join(F.broadcast(vocab.select("term", "feature")), "term", "left").select(
        id_col, "pos", F.coalesce(F.col("feature") + FIRST_ID, F.lit(UNK_ID)).cast("int").alias("tid"))
    seq = ids.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "tid"))).alias("_s"))
    seq = seq.select(id_col, F.transform("_s", lambda s: s["tid"]).alias("_ids"))
    full = df.select(id_col).join(seq, id_col, "left").select(
        id_col, F.coalesce("_ids", F.array().cast("array<int>")).alias("_ids"))
    n = F.size("_ids")
    pad = F.array_repeat(F.lit(PAD_ID), F.lit(max_length) - n)
    return full.select(
        id_col, F.concat("_ids", pad).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length) - n))
        .alias("attention_mask"))
