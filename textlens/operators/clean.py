"""The corpus cleaning job: row filters, text rewrites, keep-first dedupe and
the length filter, plus the per-stage row funnel."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import charclass as cc
from ..functions import text as T
from ..functions.lexicons import ENGLISH_STOPWORDS
from .dedupe import keep_first


@dataclass
class CleanConfig:
    stopwords: Iterable[str] = field(default_factory=lambda: list(ENGLISH_STOPWORDS))
    contractions: Mapping[str, str] | None = None
    retweet_mode: str = "substring"
    emoji_only: bool = False
    url_ignore_case: bool = False
    keep_empty: bool = False
    tokenize: bool = False          # regex word tokenizer (``@`` detached)
    lemmas: DataFrame | None = None  # (form, lemma) table applied per token
    max_words: int | None = None


def drop_header_rows(df: DataFrame, label_col: str = "label", header: str = "Label") -> DataFrame:
    """Drop repeated CSV header rows; NULL labels are kept (null-safe compare)."""
    return df.filter(~F.col(label_col).eqNullSafe(F.lit(header)))


def cast_column(df: DataFrame, col: str, dtype: str, lenient: bool = False) -> DataFrame:
    """``col`` cast to ``dtype``.  Strict (the default) fails on a value that
    does not parse; lenient gives NULL and marks the row in ``<col>_rejected``."""
    if not lenient:
        return df.withColumn(col, F.col(col).cast(dtype))
    typed = F.col(col).try_cast(dtype)
    return df.withColumns({f"{col}_rejected": F.col(col).isNotNull() & typed.isNull(), col: typed})


def url_filter(df: DataFrame, text_col: str = "text", ignore_case: bool = False) -> DataFrame:
    pattern = ("(?i)" if ignore_case else "") + cc.URL
    return df.filter(~F.col(text_col).rlike(pattern))


def max_words_filter(df: DataFrame, max_words: int, text_col: str = "text") -> DataFrame:
    return df.filter(T.word_count(text_col) <= max_words)


def apply_lemmas(df: DataFrame, lemmas: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Map each token through a (form, lemma) table; unknown tokens stay.

    Token rows are joined on the word (the table lists only words that
    change; AQE broadcasts it when small and splits hot-word partitions
    otherwise) and regrouped per row -- a group is one text's tokens.  The
    other columns ride along in the grouping key, so no join back."""
    others = [c for c in df.columns if c not in (id_col, text_col)]
    toks = df.select(id_col, *others, F.posexplode(F.split(text_col, " ")).alias("pos", "form"))
    mapped = toks.join(lemmas.select("form", "lemma"), "form", "left") \
                 .select(id_col, *others, "pos", F.coalesce("lemma", "form").alias("w"))
    rebuilt = mapped.groupBy(id_col, *others).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))),
                                 lambda s: s["w"]), " ").alias(text_col))
    return rebuilt.select(*df.columns)


def evaluate_once(df: DataFrame, name: str, expr) -> DataFrame:
    """Replace column ``name`` by ``expr`` behind a one-element generator.

    Later filters on the column (non-empty, max words, the dedupe key)
    cannot be pushed below a generator's output, so Catalyst does not inline
    the expensive expression into a scan filter and evaluate it again in the
    projection: the chain runs exactly once per row."""
    return df.select(*[F.explode(F.array(expr)).alias(c) if c == name else F.col(c)
                       for c in df.columns])


def clean_corpus(df: DataFrame, config: CleanConfig | None = None, id_col: str = "doc_id",
                 text_col: str = "text", label_col: str = "label") -> DataFrame:
    """Clean a labelled corpus ``(id, text, label)``.

    Order: drop nulls, URL filter, text rewrites, optional tokenize/lemma
    map, drop texts that cleaned to '' (unless ``keep_empty``), keep-first
    dedupe, optional max-words filter.

    The original job de-duplicates three times (raw, cleaned, lemmatized
    text).  Every rewrite is a function of the text, so all copies of a text
    share one fate and keep-first on the final text keeps exactly the rows
    the three passes keep.  One shuffle instead of three.
    """
    cfg = config or CleanConfig()
    out = df.select(id_col, text_col, label_col).dropna(subset=[text_col, label_col])
    out = url_filter(out, text_col, cfg.url_ignore_case)
    cleaned = T.clean_text(text_col, stopwords=cfg.stopwords, contractions=cfg.contractions,
                           retweet_mode=cfg.retweet_mode, emoji_only=cfg.emoji_only)
    out = evaluate_once(out, text_col, cleaned)
    if cfg.tokenize:
        out = out.withColumn(text_col, T.join_words(T.word_tokenize(text_col)))
    if not cfg.keep_empty:
        out = out.filter(F.col(text_col) != "")
    out = keep_first(out, text_col, id_col)
    if cfg.lemmas is not None:
        # lemmas are a function of the text: map the distinct texts only,
        # then collapse texts that became equal (same rows as mapping all)
        out = keep_first(apply_lemmas(out, cfg.lemmas, id_col, text_col), text_col, id_col)
    if cfg.max_words is not None:
        out = max_words_filter(out, cfg.max_words, text_col)
    return out


def class_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows per label and their share in percent (2 decimals)."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(label_col, "n", F.round(F.col("n") * 100.0 / total, 2).alias("share_pct"))


def stage_funnel(df: DataFrame, config: CleanConfig | None = None, id_col: str = "doc_id",
                 text_col: str = "text", label_col: str = "label") -> DataFrame:
    """Rows left after each stage of the cleaning job, as ``(step, stage, rows)``.

    Two aggregations instead of one pass per stage: rows are first grouped by
    raw text (map-side combined), each raw text carries its cleaned form and
    URL flag; a second, much smaller aggregation groups by cleaned text.
    """
    cfg = config or CleanConfig()
    base = df.select(id_col, text_col, label_col)
    nonnull = base.filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    pattern = ("(?i)" if cfg.url_ignore_case else "") + cc.URL
    by_raw = nonnull.groupBy(text_col).agg(F.count(F.lit(1)).alias("copies")) \
        .withColumn("has_url", F.col(text_col).rlike(pattern)) \
        .withColumn("cleaned", T.clean_text(text_col, stopwords=cfg.stopwords,
                                            contractions=cfg.contractions,
                                            retweet_mode=cfg.retweet_mode,
                                            emoji_only=cfg.emoji_only))
    kept = by_raw.filter(~F.col("has_url"))
    by_clean = kept.groupBy("cleaned").agg(F.count(F.lit(1)).alias("raw_texts"))
    def one(step, stage, agg_df, expr):
        return agg_df.agg(expr.cast("long").alias("rows")).select(
            F.lit(step).alias("step"), F.lit(stage).alias("stage"), "rows")

    parts = [
        one(0, "input", base, F.count(F.lit(1))),
        one(1, "drop_null", by_raw, F.sum("copies")),
        one(2, "dedupe_raw", by_raw, F.count(F.lit(1))),
        one(3, "drop_url", by_raw, F.count_if(~F.col("has_url"))),
        one(4, "dedupe_clean", by_clean, F.count(F.lit(1))),
        one(5, "drop_empty", by_clean, F.count_if(F.col("cleaned") != "")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("step").cast("int"), "stage", F.coalesce("rows", F.lit(0)).alias("rows"))


def late_stages(lemmatized: DataFrame, max_words: int, text_col: str = "text") -> DataFrame:
    """``(step, stage, rows)`` of the last cleaning stages, from texts after
    tokenizing and lemmas: distinct texts, and those of at most ``max_words``
    words.  One aggregation by text and one over it."""
    texts = lemmatized.where(F.col(text_col) != "").groupBy(text_col).agg(F.count(F.lit(1)).alias("_n"))
    counts = texts.agg(F.count(F.lit(1)).alias("a"), F.count_if(T.word_count(text_col) <= max_words).alias("b"))
    return counts.selectExpr("stack(2, 6, 'dedupe_lemmas', a, 7, 'max_words', b) AS (step, stage, rows)")
