"""Token counts by a map-side two-tier lookup.

The first tier is a broadcast table of the lengths of frequent pre-tokens;
the second is a cache in each worker, filled by encoding the pre-tokens that
the table misses.  Counting is one pass of map tasks: no pre-token is
shuffled, no document leaves its task.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches
from .tokens import CACHE_CHARS, tokenizer, vocabulary_path, worker_cache

#: Entries of the broadcast table, and about how many rows it is chosen from.
#: Both bound what is broadcast and decide speed only: every count is exact.
TABLE_ENTRIES = 50_000
SAMPLE_ROWS = 4_000
#: Tokens above which a document is over the limit.
TOKEN_LIMIT = 1024


def _pieces(text: str | None) -> list[str]:
    return [p for p in (text or "").split(" ")[1:] if p and not p[0].isspace() and len(p) <= CACHE_CHARS]


def frequent_lengths(docs: DataFrame, path: str, entries: int = TABLE_ENTRIES, sample_rows: int = SAMPLE_ROWS) -> dict[str, int]:
    """Token lengths of the pre-tokens most frequent in a sample of about
    ``sample_rows`` rows; each task hands on its own most frequent ones."""
    rows = docs.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(_pieces(text))
        top = seen.most_common(entries)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()),
                                          pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    sample = docs.select("text").sample(min(1.0, sample_rows / max(rows, 1)), seed=1)
    best = (sample.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
            .orderBy(F.col("n").desc(), "piece").limit(entries))
    pieces = [r.piece for r in best.collect()]
    coded = tokenizer(path).encode_batch([" " + p for p in pieces], add_special_tokens=False)
    return {p: len(c.ids) for p, c in zip(pieces, coded)}


def token_counts(docs: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT, table: dict[str, int] | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row of ``docs(doc_id, text)``.

    Tokens as the library gives them for the whole text, without added special
    tokens; special strings in a text count as the library takes them.  Null
    counts as empty: 0 bytes, 0 tokens.  Rows may repeat; an empty table gives
    no rows; other columns are ignored.
    """
    path = path or vocabulary_path()
    spark = docs.sparkSession
    table = frequent_lengths(docs, path) if table is None else table
    shared, key = spark.sparkContext.broadcast(table), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(key, path, len, shared.value)
        for batch in slices(batches, key):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            counts = [sum(cache.values(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
