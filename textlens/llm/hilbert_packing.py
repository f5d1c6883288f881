"""Packing along a space-filling curve.

A document's text is hashed to a vector (counts of its byte 4-grams), the
vector is projected to three dimensions, and the place of the projection on a
Hilbert curve is its key.  The table is cut into ranges of that key of about
equal bytes and sorted, so neighbours in a range are similar; each task
tokenizes its range and cuts the concatenated ids into full sequences.  What remains at the end of
a range is cut into lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import bisect
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, small_batches, text_bytes
from .tokens import ids_bytes, vocabulary_path, worker_cache

SEQUENCE_TOKENS = 2048
#: Id that ends each document.
END_ID = 1
#: Length of the hashed vectors, and dimensions and bits of the curve.
HASHED = 512
DIMS = 3
BITS = 10
#: Bits of a sequence id below the number of its range.
LOCAL_BITS = 38
#: Text of a range on average, what a document counts besides its text, and
#: rows that the bounds of ranges are taken from.
RANGE_BYTES = 16 << 20
DOCUMENT_BYTES = 200
SAMPLE_ROWS = 20_000

_PROJECTION = np.random.default_rng(7).standard_normal((HASHED, DIMS)).astype(np.float32)
_ROWS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n x d, below 2**bits)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def document_points(texts: list[bytes]) -> np.ndarray:
    """Grid points (n x DIMS) of texts: hashed 4-gram counts, square roots,
    unit length, random projection, scaled to the grid."""
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    for row, text in enumerate(texts):
        if len(text) < 4:
            continue
        b = np.frombuffer(text, np.uint8)
        grams = np.frombuffer(text + b"\0" * (-len(text) % 4), "<u4")  # aligned 4-grams
        grams = np.concatenate([grams[: len(b) // 4], np.frombuffer(text[2 : 2 + (len(b) - 2) // 4 * 4], "<u4")])
        counts = np.bincount((grams * np.uint32(2654435761)) >> np.uint32(23), minlength=HASHED)
        vector = np.sqrt(counts, dtype=np.float32)
        out[row] = (vector / np.linalg.norm(vector)) @ _PROJECTION
    top = (1 << BITS) - 1
    return np.clip((out + 3.0) / 6.0 * top, 0, top).astype(np.int64)


def _keys(texts: list[bytes]) -> np.ndarray:
    return hilbert_key(document_points(texts)) if texts else np.zeros(0, np.int64)


def _tie(doc_ids: list) -> np.ndarray:
    """Spreads copies, which share a curve key, over ranges by their ids."""
    return np.array([xxhash.xxh3_64_intdigest(b"" if d is None else str(d).encode()) >> 1 for d in doc_ids], np.int64)


def range_bounds(docs: DataFrame, range_bytes: int = RANGE_BYTES, partitions: int | None = None) -> np.ndarray:
    """Ends of ranges along the curve, ``(curve_key, tie)``, that hold about the
    same number of bytes; their number follows the table's bytes unless it is
    given.  They are taken from some SAMPLE_ROWS rows and decide the balance
    of tasks only."""
    rows = docs.count()
    sample = docs.select("doc_id", "text").sample(min(1.0, SAMPLE_ROWS / max(rows, 1)), seed=1)

    def narrow(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_bytes(batch.column("text"))
        return pa.RecordBatch.from_arrays([pa.array(_keys(texts)), pa.array(_tie(batch.column("doc_id").to_pylist())),
                                           pa.array([len(t) + DOCUMENT_BYTES for t in texts], pa.int64())],
                                          names=["curve_key", "tie", "size"])
    held = map_arrow(sample, "curve_key long, tie long, size long", narrow).orderBy("curve_key", "tie").toArrow()
    if not held.num_rows:
        return np.zeros((0, 2), np.int64)
    size = held.column("size").to_numpy()
    n = partitions or max(1, round(size.mean() * rows / range_bytes))
    upto = np.cumsum(size)
    cuts = np.searchsorted(upto, upto[-1] * np.arange(1, n) / n)
    return np.stack([held.column(c).to_numpy()[cuts] for c in ("curve_key", "tie")], axis=1)


def ranged(docs: DataFrame, bounds: np.ndarray) -> DataFrame:
    """``docs(doc_id, text)`` dealt to the ranges between ``bounds`` and sorted along the curve."""
    shared = docs.sparkSession.sparkContext.broadcast(list(map(tuple, bounds.tolist())))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, tie = _keys(text_bytes(batch.column("text"))), _tie(batch.column("doc_id").to_pylist())
        at = [bisect.bisect_left(shared.value, row) for row in zip(key.tolist(), tie.tolist())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(key), pa.array(tie), pa.array(at, pa.int32())],
                                          names=["doc_id", "text", "curve_key", "tie", "range"])
    keyed = map_arrow(docs.select("doc_id", "text"), "doc_id long, text string, curve_key long, tie long, range int", place)
    order = ["curve_key", "tie", "row"]
    keyed = keyed.withColumn("row", F.monotonically_increasing_id())
    return keyed.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions(*order).select("doc_id", "text")


class _Packer:
    """Cuts a stream of documents into sequences; holds one open sequence."""

    def __init__(self, size: int, first_id: int, with_ids: bool):
        self.size, self.next_id, self.with_ids = size, first_id, with_ids
        self.open: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of the open sequence
        self.filled = 0

    def _close(self, pieces: list[tuple], out: list[tuple]) -> None:
        at = 0
        for doc, start, ids, n in pieces:
            out.append((doc, start, len(ids) // 4, zlib.crc32(ids), n, self.next_id, at)
                       + ((ids,) if self.with_ids else ()))
            at += len(ids) // 4
        self.next_id += 1

    def add(self, doc, ids: bytes, out: list[tuple]) -> None:
        total, start = len(ids) // 4, 0
        while start < total:
            n = min(total - start, self.size - self.filled)
            self.open.append((doc, start, ids[4 * start : 4 * (start + n)], total))
            self.filled += n
            start += n
            if self.filled == self.size:
                self._close(self.open, out)
                self.open, self.filled = [], 0

    def finish(self, out: list[tuple]) -> None:
        """The open sequence, cut into lengths that are powers of two."""
        left, self.open = self.open, []
        while self.filled:
            room = 1 << (self.filled.bit_length() - 1)
            self.filled -= room
            pieces = []
            while room:
                doc, start, ids, n = left.pop(0)
                take = min(room, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * take], n))
                if 4 * take < len(ids):
                    left.insert(0, (doc, start + take, ids[4 * take :], n))
                room -= take
            self._close(pieces, out)


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SEQUENCE_TOKENS, end_id: int = END_ID,
                   partitions: int | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs(doc_id, text)`` packed into sequences.

    A document is its token ids and ``end_id``; null text counts as empty and
    is that id alone.  Returns per piece ``doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset`` and, if asked for, ``ids`` (little-endian
    unsigned 32-bit).  Repeated rows are documents of their own; an empty
    table gives no rows; other columns are ignored.
    """
    path, job = path or vocabulary_path(), uuid.uuid4().hex
    along = ranged(docs, range_bounds(docs, partitions=partitions))
    schema = _ROWS + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(job, path, ids_bytes)
        end = ids_bytes([end_id])
        packer = _Packer(size, TaskContext.get().partitionId() << LOCAL_BITS, with_ids)

        def table(rows):
            columns = list(zip(*rows)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in slices(batches, job):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                packer.add(doc, b"".join(cache.values(text.as_py() or "")) + end, out)
            yield table(out)
        out = []
        packer.finish(out)
        yield table(out)

    return small_batches(along).mapInArrow(run, schema)
