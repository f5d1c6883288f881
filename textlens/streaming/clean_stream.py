"""Incremental cleaning of a stream of labelled texts.

The row filters and text rewrites are stateless Column expressions, so the
batch definitions apply unchanged to a streaming DataFrame.  De-duplication
is the only stateful step: ``dropDuplicates`` on the cleaned text keeps the
first arrival (arrival order, not id order, across micro-batches); with an
event-time column and a watermark the state is bounded by
``dropDuplicatesWithinWatermark``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.clean import CleanConfig, url_filter

DEFAULT_SCHEMA = "doc_id bigint, text string, label int"


def cleaned_stream(src: DataFrame, config: CleanConfig | None = None, text_col: str = "text",
                   label_col: str = "label", event_time: str | None = None,
                   watermark: str | None = None) -> DataFrame:
    cfg = config or CleanConfig()
    if cfg.tokenize or cfg.lemmas is not None:
        raise ValueError("a stream is cleaned without tokenizing and lemmas: unset them, or clean in a batch")
    out = src.dropna(subset=[text_col, label_col])
    out = url_filter(out, text_col, cfg.url_ignore_case)
    out = out.withColumn(text_col, T.clean_text(text_col, stopwords=cfg.stopwords,
                                                contractions=cfg.contractions,
                                                retweet_mode=cfg.retweet_mode,
                                                emoji_only=cfg.emoji_only))
    if not cfg.keep_empty:
        out = out.filter(F.col(text_col) != "")
    if cfg.max_words is not None:
        out = out.filter(T.word_count(text_col) <= cfg.max_words)
    if event_time and watermark:
        return out.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark([text_col])
    return out.dropDuplicates([text_col])


def clean_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                 schema: str = DEFAULT_SCHEMA, fmt: str = "json", config: CleanConfig | None = None,
                 available_now: bool = True):
    """Read new files from ``source_dir``, clean them and append Parquet to
    ``sink_dir``; progress and dedupe state live in ``checkpoint_dir`` (a
    shared folder), so a restarted query resumes where it stopped."""
    src = spark.readStream.schema(schema).format(fmt).load(source_dir)
    q = cleaned_stream(src, config).writeStream.format("parquet") \
        .option("checkpointLocation", checkpoint_dir).outputMode("append")
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start(sink_dir)
