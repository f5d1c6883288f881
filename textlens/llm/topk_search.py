"""Exact top-k inner products by norm buckets.

Vectors are put into buckets by length (ranges of the norm), and a bucket is
cut into blocks of a bounded number of rows.  For a query q with a known
lower bound t on its k-th best product, a bucket whose longest vector has
length l can only help if the cosine reaches t / (|q| l), its local threshold:

* above 1, the bucket is skipped;
* if it is small, few vectors are excluded by direction: the bucket's vectors
  are cut by length alone (those of at least t / |q|);
* else by coordinates: on the query's largest coordinates a vector that
  reaches the cosine lies in an interval around the query's own value, and
  vectors outside one of the intervals are left out.

What remains is verified with exact integer products.  A first pass over each
query's share of the longest vectors gives t; the second pass goes through
every bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TOP = 5
QUERY_STEP = 50
SCALE = 256
#: Norms of a bucket lie within this factor.
NORM_RATIO = 1.05
#: Rows of a block of vectors and of queries.
BLOCK_ROWS = 4096
QUERY_ROWS = 512
#: Blocks of queries that a task holds beside a block of vectors, on average.
SET_BLOCKS = 16
#: Blocks of the longest vectors that give each query its first bound.
FIRST_BLOCKS = 2
#: From this local cosine threshold on a bucket is pruned by coordinates.
COORDINATE_FROM = 0.3
#: Coordinates that an interval is put on.
COORDINATES = 4
_SLACK = 1e-9


def quantised(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)``: floor(256 * x) of each component, as double; vectors
    that are null or hold null or non-finite components are left out, as are
    rows without an id; repeated rows count once."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(math.inf)))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("double"))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite).select("vec_id", v.alias("v")).distinct()


def _matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of any lengths, padded with zeros."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _packed(m: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold them, others as doubles."""
    most = float(np.abs(m).max(initial=0))
    return m.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64).tobytes()


def _blocks(group: pd.DataFrame) -> pd.DataFrame:
    """One row that holds a block's vectors, longest first."""
    width = max(map(len, group["v"]))
    m = _matrix(list(group["v"]), width)
    order = np.lexsort((group["vec_id"].to_numpy(), -(m * m).sum(axis=1)))
    return pd.DataFrame({"block": [group["block"].iloc[0]], "rows": [len(group)], "width": [width],
                         "ids": [group["vec_id"].to_numpy(np.int64)[order].tobytes()],
                         "values": [_packed(m[order])]})


def packed_blocks(vectors: DataFrame, block_rows: int) -> DataFrame:
    """``(block, rows, width, ids, values)``: norm buckets cut into blocks of
    about ``block_rows`` rows, numbered from the longest vectors on."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    bucket = F.when(norm > 0, F.floor(F.log(norm) / math.log(NORM_RATIO))).otherwise(F.lit(-1)).cast("long")
    keyed = vectors.withColumn("bucket", bucket)
    counts = keyed.groupBy("bucket").count()  # one row per norm range: a few hundred at most
    longest = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.withColumn("parts", F.ceil(F.col("count") / block_rows))
    parts = parts.select("bucket", "parts", F.coalesce(F.sum("parts").over(longest), F.lit(0)).alias("first"))
    keyed = keyed.join(F.broadcast(parts), "bucket")
    block = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    keyed = keyed.select(block.alias("block"), "vec_id", "v")
    return keyed.groupBy("block").applyInPandas(_blocks, "block long, rows long, width long, ids binary, values binary")


def _unpack(ids: bytes, values: bytes, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    kind = {2: np.int16, 4: np.int32}.get(len(values) // max(1, rows * width), np.float64)
    return np.frombuffer(ids, np.int64), np.frombuffer(values, kind).astype(np.float64).reshape(rows, width)


def candidates(q: np.ndarray, bound: float, unit: np.ndarray, norms: np.ndarray) -> np.ndarray | slice | None:
    """Rows of a block (longest first) that may have a product of at least
    ``bound`` with q; None if none may."""
    size = math.sqrt(float(q @ q))
    if bound <= 0 or size == 0:
        return slice(None) if bound <= 0 else None
    if norms[0] == 0:
        return None
    local = bound / (size * norms[0])
    if local > 1 + _SLACK:
        return None
    upto = int(np.searchsorted(-norms, -(bound / size) * (1 - _SLACK), side="right"))
    if local < COORDINATE_FROM:
        return slice(0, upto)  # by length
    angle = math.acos(min(1.0, local)) + 1e-7
    keep = np.ones(upto, bool)
    cosines = q / size
    for f in np.argsort(-np.abs(cosines), kind="stable")[:COORDINATES]:
        at = math.acos(max(-1.0, min(1.0, cosines[f])))
        lo, hi = math.cos(min(math.pi, at + angle)), math.cos(max(0.0, at - angle))
        column = unit[f, :upto]
        keep &= (column >= lo - _SLACK) & (column <= hi + _SLACK)
    return np.flatnonzero(keep)


def _products(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products (doubles hold them while below 2**53)."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(len(q), 1)
    if top < 2 ** 53:
        return (vectors @ q).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(row, q)) for row in vectors], dtype=np.int64)


def _search(top: int):
    """Best products of a block of vectors for each of a set of query blocks."""
    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        for b in blocks.to_pylist() if queries.num_rows else []:   # one row, or none
            ids, m = _unpack(b["ids"], b["values"], b["rows"], b["width"])
            norms = np.sqrt((m * m).sum(axis=1))
            unit = np.ascontiguousarray((m / np.where(norms, norms, 1)[:, None]).T)
            for at in range(queries.num_rows):
                r = queries.slice(at, 1).to_pylist()[0]
                q_ids, qs = _unpack(r["q_ids"], r["q_values"], r["q_rows"], r["q_width"])
                bounds = np.frombuffer(r["bounds"], np.float64)
                wide = max(qs.shape[1], m.shape[1])
                qs = np.pad(qs, ((0, 0), (0, wide - qs.shape[1])))
                if m.shape[1] < wide:
                    m = np.pad(m, ((0, 0), (0, wide - m.shape[1])))
                    unit = np.pad(unit, ((0, wide - len(unit)), (0, 0)))
                for q_id, q, bound in zip(q_ids.tolist(), qs, bounds.tolist()):
                    rows = candidates(q, bound, unit, norms)
                    if rows is None:
                        continue
                    found = ids[rows]
                    score = _products(m[rows], q)
                    ok = (found != q_id) & (score >= bound)
                    found, score = found[ok], score[ok]
                    best = np.lexsort((found, -score))
                    first = np.sort(np.unique(found[best], return_index=True)[1])[:top]  # an id once, with its best
                    best = best[first]
                    out_q.append(np.full(len(best), q_id)), out_v.append(found[best]), out_s.append(score[best])
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"query_id": cat(out_q), "vec_id": cat(out_v), "score": cat(out_s)})
    return run


def _pair(blocks: DataFrame, queries: DataFrame, parts: int, top: int) -> DataFrame:
    """``query_id, vec_id, score``: each row of ``queries`` (which names its
    block ``to_block``) searched in that block's vectors.  A block meets a set
    of about SET_BLOCKS rows at a time and goes once to each set, not beside
    each row: a task holds a block and a set, whatever the number of queries."""
    sets = max(1, math.ceil(parts / SET_BLOCKS))
    left = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("to_set"))
    right = queries.withColumn("of_set", F.pmod(F.col("part"), F.lit(sets)).cast("int"))
    return left.groupBy("block", "to_set").cogroup(right.groupBy("to_block", "of_set")).applyInArrow(
        _search(top), "query_id long, vec_id long, score long")


def _query_blocks(queries: DataFrame, block_rows: int, parts: int) -> DataFrame:
    """Queries ``(vec_id, v, bound)`` packed into blocks; a block's binary
    columns hold ids, values and bounds."""
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, group["v"]))
        return pd.DataFrame({"part": [group["part"].iloc[0]], "q_rows": [len(group)], "q_width": [width],
                             "q_ids": [group["vec_id"].to_numpy(np.int64).tobytes()],
                             "q_values": [_packed(_matrix(list(group["v"]), width))],
                             "bounds": [group["bound"].to_numpy(np.float64).tobytes()]})
    return (queries.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts))).groupBy("part")
            .applyInPandas(pack, "part long, q_rows long, q_width long, q_ids binary, q_values binary, bounds binary"))


def _best(scores: DataFrame, top: int) -> DataFrame:
    """The ``top`` best of each query, an id once: ``query_id, rank, vec_id, score``."""
    once = scores.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, top: int = TOP, step: int = QUERY_STEP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` best inner products of
    each query (a row whose id is divisible by ``step``) with all other rows
    of ``vectors(vec_id, embedding)``; ties go to the smaller id.

    See ``quantised`` for what takes part.  Shorter vectors count as padded
    with zeros.  An id that has several different vectors is one candidate and
    one query with its best product.  Empty input gives no rows; other columns
    are ignored.
    """
    rows = stored(quantised(vectors), "topk-vectors")
    blocks = stored(packed_blocks(rows, block_rows), "topk-blocks")
    queries = rows.where(F.col("vec_id") % step == 0)
    n = queries.count()
    parts = max(1, math.ceil(n / QUERY_ROWS))
    last = blocks.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0]
    to_blocks = lambda upto: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(upto, 0)).cast("long"))).alias("to_block")
    start = _query_blocks(queries.withColumn("bound", F.lit(-math.inf)), QUERY_ROWS, parts)
    start = start.select("*", to_blocks(min(last, FIRST_BLOCKS - 1)))
    found = _pair(blocks, start, parts, top)
    known = _best(found, top).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    known = stored(known.where(F.col("n") >= top).select("query_id", F.col("least").cast("double").alias("least")), "topk-bounds")
    bounded = queries.join(known, F.col("vec_id") == F.col("query_id"), "left").select(
        "vec_id", "v", F.coalesce("least", F.lit(-math.inf)).alias("bound"))
    # the stated query set against all blocks: each block of queries goes once to each block of vectors
    sent = _query_blocks(bounded, QUERY_ROWS, parts).select("*", to_blocks(last))
    return _best(_pair(blocks, sent, parts, top), top)
