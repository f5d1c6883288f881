"""Exact dedup with counting quotient filters.

Every map task puts the 64-bit fingerprints of its texts into a counting
quotient filter: the high bits (the quotient) choose a run, the low bits (the
remainder) stand sorted in it, each with a counter.  A filter is cut into
ranges of quotients, and the pieces of one range merge losslessly: runs of
equal quotients are merged by their sorted remainders and counters add up.
Fingerprints whose counter exceeds one go to byte verification; all other
texts are known to be single without being compared with anything.

A text that fills a third of the table is one slot with a counter in each
filter, and one row per task in the byte verification (partial aggregation by
the text itself), so no task receives the copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, map_arrow, row_key, staying_rows, stored, text_bytes

#: Fingerprints that one quotient range of the merged filter holds on average.
RANGE_SLOTS = 400_000
#: A map task hands on its filter when it holds this many slots and starts another.
FILTER_SLOTS = 1_000_000
#: At most so many repeated fingerprints (8 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Quotient bits of a filter: a slot is a 24-bit quotient and a 40-bit remainder.
QUOTIENT_BITS = 24
REMAINDER_BITS = 64 - QUOTIENT_BITS
_MASK = np.uint64((1 << REMAINDER_BITS) - 1)


def build_filter(fingerprints: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Counting quotient filter of fingerprints (uint64): the occupied
    quotients, the length of each one's run, the sorted remainders of all runs
    and their counters."""
    if counts is None:
        fp, n = np.unique(fingerprints, return_counts=True)
    else:
        order = np.argsort(fingerprints, kind="stable")
        fp, starts = np.unique(fingerprints[order], return_index=True)
        n = np.add.reduceat(counts[order], starts) if len(fp) else counts
    quotient, run = np.unique((fp >> np.uint64(REMAINDER_BITS)).astype(np.uint32), return_counts=True)
    return quotient, run.astype(np.uint32), fp & _MASK, n.astype(np.uint64)


def filter_fingerprints(quotient, run, remainder) -> np.ndarray:
    """The distinct fingerprints that a filter holds, in order."""
    return (np.repeat(quotient.astype(np.uint64), run) << np.uint64(REMAINDER_BITS)) | remainder


def pack_filter(parts: tuple[np.ndarray, ...]) -> bytes:
    """Bytes of a filter: 5 bytes per remainder, 1 per counter below 255 (a
    larger one is 255 followed by 8 bytes at the end)."""
    quotient, run, remainder, n = parts
    five = remainder.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    small = np.minimum(n, 255).astype(np.uint8)
    head = np.array([len(quotient), len(remainder)], dtype="<u8")
    return b"".join(x.tobytes() for x in (head, quotient.astype("<u4"), run.astype("<u4"),
                                          np.ascontiguousarray(five), small, n[n >= 255].astype("<u8")))


def unpack_filter(data: bytes) -> tuple[np.ndarray, ...]:
    nq, nr = (int(x) for x in np.frombuffer(data, "<u8", 2))
    at = 16
    quotient = np.frombuffer(data, "<u4", nq, at)
    run = np.frombuffer(data, "<u4", nq, at + 4 * nq)
    at += 8 * nq
    wide = np.zeros((nr, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8, 5 * nr, at).reshape(nr, 5)
    n = np.frombuffer(data, np.uint8, nr, at + 5 * nr).astype(np.uint64)
    n[n == 255] = np.frombuffer(data, "<u8", int((n == 255).sum()), at + 6 * nr)
    return quotient, run, wide.reshape(-1).view("<u8"), n


def merge_filters(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    """One filter holding what all of them hold."""
    parts = [unpack_filter(p) for p in payloads]
    fps = np.concatenate([filter_fingerprints(q, r, m) for q, r, m, _ in parts])
    return build_filter(fps, np.concatenate([n for *_, n in parts]))


def _normalised(batch: pa.RecordBatch) -> list[bytes]:
    return [t.translate(LOWER) for t in text_bytes(batch.column("text"))]


def _fingerprint(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _narrow(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = _normalised(batch)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("row_id"), batch.column("row_key"),
         _signed([_fingerprint(t) for t in texts]), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())],
        names=["doc_id", "row_id", "row_key", "fp", "sha"])


def _with_text(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = _normalised(batch)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), _signed([_fingerprint(t) for t in texts]), pa.array(texts, pa.binary())],
        names=["doc_id", "fp", "body"])


def _filter_pieces(bits: int):
    """Filters of a task's fingerprints, cut into 2**bits quotient ranges."""
    def emit(fps: list[np.ndarray]) -> pa.RecordBatch:
        fp, n = np.unique(np.concatenate(fps), return_counts=True)
        where = (fp >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(fp), np.int64)
        cuts = np.flatnonzero(np.diff(where)) + 1
        pieces = [(int(where[lo]), pack_filter(build_filter(fp[lo:hi], n[lo:hi])))
                  for lo, hi in zip([0, *cuts], [*cuts, len(fp)])]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pieces], pa.int64()),
                                           pa.array([p[1] for p in pieces], pa.binary())], names=["range", "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(np.asarray(batch.column("fp")).view(np.uint64))
            size += batch.num_rows
            if size >= FILTER_SLOTS:
                yield emit(held)
                held, size = [], 0
        if size:
            yield emit(held)
    return run


def _repeated(group: pd.DataFrame) -> pd.DataFrame:
    quotient, run, remainder, n = merge_filters(list(group["piece"]))
    fps = filter_fingerprints(quotient, run, remainder)[n > 1]
    return pd.DataFrame({"fp": fps.view(np.int64), "n": n[n > 1].astype(np.int64)})


def repeated_fingerprints(narrow: DataFrame, n_rows: int) -> DataFrame:
    """``(fp, n)``: fingerprints that more than one row of ``narrow(fp)`` has."""
    bits = max(4, (max(n_rows, 1) // RANGE_SLOTS).bit_length())
    pieces = narrow.select("fp").mapInArrow(_filter_pieces(bits), "range long, piece binary")
    return pieces.groupBy("range").applyInPandas(_repeated, "fp long, n long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` with its group of equal texts.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty.  The row with the largest ``doc_id`` of a group stays (a null id is
    smaller than any; of repeated rows with that id, one stays).  Returns
    ``row_key`` (see ``common``), ``doc_id, keep_id, group_size, kept,
    text_sha256``; an empty table gives no rows.  Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    numbered = docs.withColumn("row_id", F.monotonically_increasing_id()).withColumn("row_key", row_key())
    narrow = stored(map_arrow(numbered, "doc_id long, row_id long, row_key long, fp long, sha binary", _narrow), "exact-narrow")
    repeated = stored(repeated_fingerprints(narrow, narrow.count()), "exact-repeated")
    keys = repeated.select("fp")
    if repeated.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    bodies = map_arrow(docs, "doc_id long, fp long, body binary", _with_text)
    # bytes decide: one row per distinct text of a repeated fingerprint
    verified = (bodies.join(keys, "fp", "left_semi")
                .groupBy("fp", "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
                .where("group_size > 1")
                .select("fp", F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "group_size"))
    ties = (narrow.groupBy("sha", "doc_id").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))
            .where("n > 1").select(F.col("sha").alias("tie_sha"), F.col("doc_id").alias("tie_id"), "first_row"))
    rows = narrow.join(verified, ["fp", "sha"], "left")
    rows = rows.join(ties, (rows.sha == ties.tie_sha) & rows.doc_id.eqNullSafe(ties.tie_id), "left")
    single = F.col("group_size").isNull()
    return rows.select(
        "row_key", "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("doc_id").eqNullSafe(F.col("keep_id"))
                   & (F.col("first_row").isNull() | (F.col("first_row") == F.col("row_id"))))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    return staying_rows(docs, exact_groups(docs).select("row_key", "doc_id", F.col("kept").alias("stays")))
