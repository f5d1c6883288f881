"""Near-duplicate documents by b-bit MinHash.

A document is its set of 5-word shingles.  128 minima are kept as their low 4
bits in eight longs, and 32 bands of 4 minima propose pairs: documents that
share a band.  A pair's similarity is estimated from the number of equal
4-bit values, corrected for values that agree by chance (1 in 16), and pairs
within five standard errors of the threshold are confirmed on the full sets.

Documents with the same words are one class with one signature, so copies
cost nothing beyond a count.  In a band the members are first compared with
one hub; members that end up in its component need no further comparison, the
others meet another hub of the band's largest component, and so on while that
finds links.  In bands that then still hold several components each member
outside the largest is compared with all others, in blocks.  No links are lost
and a large group of near copies costs about as many comparisons as members.

A pair at the threshold shares no band with probability (1 - 0.75**4)**32,
about 5 in a million; above it, less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, map_arrow, row_key, small_batches, staying_rows, stored, text_bytes
from .components import connected_components

SHINGLE_WORDS = 5
#: Links have 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
MINIMA = 128
BITS = 4
BAND_ROWS = 4
BANDS = MINIMA // BAND_ROWS
LANES = MINIMA * BITS // 64
#: Members that meet in blocks are estimated by a second, longer signature.
LONG_MINIMA = 1024
LONG_BITS = 2
#: Standard errors below the threshold at which an estimate still is a candidate.
MARGIN = 5
#: Turns in which a band's members meet one hub; what is left then meets in blocks.
ROUNDS = 2
#: Rows of a block in which members of a band meet.
BLOCK = 1024
#: At most so many row ids (8 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Shingles that one pass over the hash functions takes.
_CHUNK = 1 << 16

_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(0, 1 << 32, MINIMA + LONG_MINIMA, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, MINIMA + LONG_MINIMA, dtype=np.uint64).astype(np.uint32)
_SIG = [f"s{i}" for i in range(LANES)]


def words(text: bytes) -> list[bytes]:
    """The lower-cased (A-Z) words of a text."""
    return text.translate(LOWER).split()


def shingles(text: bytes) -> tuple[np.ndarray, bytes]:
    """The sorted distinct 64-bit shingle hashes of a text, and the 128-bit
    hash of its word sequence (empty without words)."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64), b""
    joined = b" ".join(w)
    if len(w) < SHINGLE_WORDS:
        hashes = [xxhash.xxh3_64_intdigest(joined)]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        starts = np.concatenate([[0], ends[: -SHINGLE_WORDS]])
        digest = xxhash.xxh3_64_intdigest
        hashes = [digest(joined[i:j]) for i, j in zip(starts.tolist(), (ends[SHINGLE_WORDS - 1:] - 1).tolist())]
    return np.unique(np.array(hashes, dtype=np.uint64)), xxhash.xxh3_128_digest(joined)


def minima(sets: list[np.ndarray], functions: range = range(MINIMA)) -> np.ndarray:
    """Functions x documents: the least value of each hash function over each
    set (sets must not be empty)."""
    out = np.empty((len(functions), len(sets)), np.uint32)
    at = 0
    while at < len(sets):
        upto, size = at, 0
        while upto < len(sets) and (upto == at or size + len(sets[upto]) <= _CHUNK):
            size += len(sets[upto])
            upto += 1
        flat = np.concatenate(sets[at:upto])
        flat = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at:upto]])[:-1]])
        for k, f in enumerate(functions):
            out[k, at:upto] = np.minimum.reduceat((flat ^ _XOR[f]) * _MULTIPLY[f], starts)
        at = upto
    return out


def _scramble(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    v = (v ^ (v >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return v ^ (v >> np.uint32(16))


def packed_bits(mixed: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of each value (functions x documents), packed into longs
    (documents x lanes)."""
    low = (mixed & np.uint32((1 << bits) - 1)).astype(np.uint64).T
    low = low.reshape(len(low), -1, 64 // bits)
    return np.bitwise_or.reduce(low << np.arange(0, 64, bits, dtype=np.uint64), axis=2)


def signatures(mins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits (documents x LANES) and band keys (documents x BANDS)."""
    mixed = _scramble(mins)
    packed = packed_bits(mixed, BITS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) * np.ones_like(mins[:1], np.uint64)
    for row in range(BAND_ROWS):
        keys = (keys ^ mixed.reshape(BANDS, BAND_ROWS, -1)[:, row].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return packed, np.ascontiguousarray(keys.T)


def least_estimate(similarity: int = SIMILARITY, values: int = MINIMA, bits: int = BITS) -> int:
    """The least number of equal b-bit values at which a pair is a candidate."""
    s, chance = similarity / 100, 1 / (1 << bits)
    equal = chance + (1 - chance) * s
    return int(np.floor(values * equal - MARGIN * np.sqrt(values * equal * (1 - equal))))


def estimated_similarity(equal):
    """Similarity from the number of equal values, corrected for chance."""
    chance = 1 / (1 << BITS)
    return (equal / MINIMA - chance) / (1 - chance)


def _equal_values(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Equal b-bit values (b 2 or 4) of packed signatures, by bit counts."""
    x = a ^ b
    if bits == 4:
        x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    ones = np.uint64(0x1111111111111111 if bits == 4 else 0x5555555555555555)
    return x.shape[-1] * (64 // bits) - np.bitwise_count(x & ones).sum(axis=-1, dtype=np.int64)


def _equal_columns(left: str, right: str) -> F.Column:
    """The same of two rows' columns, in codegen."""
    total = F.lit(MINIMA)
    for lane in _SIG:
        x = F.col(f"{left}.{lane}").bitwiseXOR(F.col(f"{right}.{lane}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        total = total - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _sign(batch: pa.RecordBatch) -> pa.RecordBatch:
    done = [shingles(t) for t in text_bytes(batch.column("text"))]
    full = [i for i, (s, _) in enumerate(done) if len(s)]
    packed = np.zeros((len(done), LANES), np.uint64)
    keys = np.zeros((len(done), BANDS), np.uint64)
    if full:
        packed[full], keys[full] = signatures(minima([done[i][0] for i in full]))
    bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), _signed(keys.ravel()))
    return pa.RecordBatch.from_arrays(
        [batch.column("row_id"), batch.column("row_key"), batch.column("doc_id"), pa.array([len(s) for s, _ in done], pa.int64()),
         pa.array([d for _, d in done], pa.binary()), *[_signed(packed[:, i]) for i in range(LANES)], bands],
        names=["row_id", "row_key", "doc_id", "n_shingles", "seq", *_SIG, "bands"])


def _full_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    done = [shingles(t) for t in text_bytes(batch.column("text"))]
    ends = np.cumsum([0] + [len(s) for s, _ in done])
    flat = np.concatenate([s for s, _ in done]) if done else np.zeros(0, np.uint64)
    sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(flat))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([d for _, d in done], pa.binary()), sets],
                                      names=["doc_id", "seq", "shingles"])


def _long_signatures(batch: pa.RecordBatch) -> pa.RecordBatch:
    done = [shingles(t) for t in text_bytes(batch.column("text"))]
    full = [i for i, (s, _) in enumerate(done) if len(s)]
    packed = np.zeros((len(done), LONG_MINIMA * LONG_BITS // 64), np.uint64)
    if full:
        mins = minima([done[i][0] for i in full], range(MINIMA, MINIMA + LONG_MINIMA))
        packed[full] = packed_bits(_scramble(mins), LONG_BITS)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array([d for _, d in done], pa.binary()),
         pa.array([p.tobytes() for p in packed], pa.binary())], names=["doc_id", "seq", "long_sig"])


def _cross_pairs(least: int, long_least: int):
    """Candidate pairs of the rows of each (key, i, j) block, which arrive
    together: small members (side 0) against all (side 1) of other labels.  A
    pair is looked at in the first band that it shares."""
    def block(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sig = np.stack([np.asarray(rows.column(c)).view(np.uint64) for c in _SIG], axis=1)
        wide = lambda c: np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint64).reshape(len(sig), -1)
        long_sig, bands = wide("long_sig"), wide("band_bytes")
        node, label, side = (np.asarray(rows.column(c)) for c in ("node", "label", "side"))
        key = np.asarray(rows.column("key")).view(np.uint64)[0]
        small, every = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = []
        for i in small:
            j = every[label[every] != label[i]]
            j = j[_equal_values(sig[j], sig[i]) >= least]
            j = j[_equal_values(long_sig[j], long_sig[i], LONG_BITS) >= long_least]
            j = j[bands[j, np.argmax(bands[j] == bands[i], axis=1)] == key]
            found.append((np.full(len(j), node[i]), node[j]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            ids = np.stack([np.asarray(table.column(c)) for c in ("key", "i", "j")])
            cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts[:-1]], cuts):
                yield out(*block(table.slice(lo, hi - lo)))
            held = table.slice(cuts[-1] if len(cuts) else 0)
        if held is not None:
            yield out(*block(held))

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough; each pair's
    rows meet at b first, so a node with many pairs is only a joined side."""
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    met = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - F.col("shared")
    return met.withColumn("shared", shared).where(F.col("shared") * 100 >= union * similarity).select("a", "b")


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """``row_id, row_key, doc_id, n_shingles, label, component_id, kept`` of each
    row of ``docs(doc_id, text)``.

    ``row_id`` numbers the rows in this run, ``label`` names the component by
    one of them, ``row_key`` is that of ``common``.
    ``component_id`` is the smallest doc_id reachable over links, ``kept``
    tells whether the row has it (of repeated rows, all that have it).  Null
    texts count as empty; documents without words have no shingles and no
    links.  A null doc_id is never a component's id unless all its ids are
    null.  An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    numbered = docs.withColumn("row_id", F.monotonically_increasing_id()).withColumn("row_key", row_key())
    schema = ("row_id long, row_key long, doc_id long, n_shingles long, seq binary, "
              + "".join(f"{c} long, " for c in _SIG) + "bands array<long>")
    signed = stored(map_arrow(numbered, schema, _sign), "near-signatures")
    # one node per word sequence, named by its smallest row_id
    classes = signed.where("n_shingles > 0").groupBy("seq").agg(F.min("row_id").alias("node"))
    classes = stored(classes, "near-classes")
    nodes = signed.join(classes.select(F.col("node").alias("row_id")), "row_id", "left_semi")
    nodes = stored(nodes.withColumnRenamed("row_id", "node"), "near-nodes")
    members = nodes.select("node", F.explode("bands").alias("key"))
    hubs = members.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = stored(members.join(hubs, "key").select("key", "node", "hub", "n"), "near-members")

    least = least_estimate(similarity)
    sig = nodes.select("node", *_SIG)
    labels = nodes.select("node", F.col("node").alias("label"))
    tested = None
    for turn in range(ROUNDS):
        # one star a band: its hub against the members that are not in its component
        near = stored(_estimated(_stars(members, labels, turn), sig, least), "near-stars")
        tested = near if tested is None else tested.unionByName(near)
        links = stored(_confirmed(near, _sets_of(docs, nodes, near), similarity), "near-links")
        if links.limit(1).count() == 0:
            break
        labels = _merged(labels, links)
    cross = _cross(docs, nodes, members, labels, similarity)
    more = stored(cross.join(tested, ["a", "b"], "left_anti"), "near-cross")
    links = stored(_confirmed(more, _sets_of(docs, nodes, more), similarity), "near-links")
    labels = _merged(labels, links)
    named = nodes.select("node", "seq").join(labels, "node").select("seq", "label")

    # row 0 and above are components; documents without words are their own
    rows = signed.select("row_id", "row_key", "doc_id", "n_shingles", "seq").join(named, "seq", "left")
    rows = stored(rows.withColumn("label", F.coalesce("label", "row_id")).drop("seq"), "near-rows")
    least_id = rows.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least_id, "label").select("row_id", "row_key", "doc_id", "n_shingles", "label", "component_id",
                                               F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``(key, node, label, rank, all_n, small_n)`` of the bands that hold
    several components; rank 1 is a band's largest, 2 any other, and
    ``small_n`` counts the members outside the largest.  Sizes are added up
    by partial aggregation, no band's rows or components meet in a window."""
    labelled = members.select("key", "node").join(labels, "node")
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("own_n"))
    largest = F.min(F.struct((-F.col("own_n")).alias("less"), F.col("label"))).alias("largest")
    bands = (sizes.groupBy("key").agg(F.count("*").alias("labels"), F.sum("own_n").alias("all_n"), largest)
             .where("labels > 1").select("key", "all_n", (F.col("all_n") + F.col("largest.less")).alias("small_n"),
                                         F.col("largest.label").alias("top")))
    rank = F.when(F.col("label") == F.col("top"), 1).otherwise(2).alias("rank")
    return labelled.join(bands, "key").select("key", "node", "label", rank, "all_n", "small_n")


def _stars(members: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Pairs ``(a, b)`` of a band's hub and each member outside the hub's
    component.  The first hub is the smallest member, later ones are members
    of the band's largest component, another each turn."""
    if turn == 0:
        return members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    rows = stored(_open_members(members, labels).select("key", "node", "rank"), "near-open")
    pick = F.min(F.struct(F.xxhash64("node", F.lit(turn)), F.col("node"))).alias("pick")
    hubs = rows.where("rank = 1").groupBy("key").agg(pick).select("key", F.col("pick.node").alias("hub"))
    return (rows.where("rank > 1").join(hubs, "key")
            .select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct())


def _estimated(pairs: DataFrame, sig: DataFrame, least: int) -> DataFrame:
    """The pairs with at least so many equal values."""
    return (pairs.alias("p").join(sig.alias("x"), F.col("p.b") == F.col("x.node"))
            .join(sig.alias("y"), F.col("p.a") == F.col("y.node"))
            .where(_equal_columns("x", "y") >= least).select("p.a", "p.b"))


def _cross(docs: DataFrame, nodes: DataFrame, members: DataFrame, labels: DataFrame, similarity: int) -> DataFrame:
    """Candidate pairs of members of a band in different components: each
    member outside the largest against all, in blocks, by both signatures."""
    rows = stored(_open_members(members, labels), "near-open")
    long_sig = _of_texts(docs, nodes, rows.select("node").distinct(), "long_sig binary", _long_signatures)
    band_bytes = F.to_binary(F.array_join(F.transform("bands", _little_endian), ""), F.lit("hex"))
    own = nodes.join(long_sig, "node").select("node", *_SIG, band_bytes.alias("band_bytes"), "long_sig")
    spread = lambda n: F.pmod(F.xxhash64("node"), F.ceil(F.col(n) / BLOCK))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / BLOCK) - 1))
    rows = stored(rows.join(own, "node"), "near-blocks")
    one = rows.where("rank > 1").withColumn("side", F.lit(0)).withColumn("i", spread("small_n")).withColumn("j", upto("all_n"))
    every = rows.withColumn("side", F.lit(1)).withColumn("j", spread("all_n")).withColumn("i", upto("small_n"))
    columns = ["key", "i", "j", "side", "node", "label", *_SIG, "long_sig", "band_bytes"]
    least, long_least = least_estimate(similarity), least_estimate(similarity, LONG_MINIMA, LONG_BITS)
    met = one.select(columns).unionByName(every.select(columns)).repartition("key", "i", "j")
    return small_batches(met.sortWithinPartitions("key", "i", "j")).mapInArrow(_cross_pairs(least, long_least), "a long, b long").distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` with the components that ``links`` join made one."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
    ends = ends.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    tops = connected_components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    tops = tops.select(F.col("node").alias("label"), F.col("label").alias("top"))
    return stored(labels.join(tops, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "near-labels")


def _little_endian(x) -> F.Column:
    """16 hex digits of a long's bytes, lowest first."""
    digits = F.lpad(F.hex(x), 16, "0")
    return F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)])


def _sets_of(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(node, shingles)`` of the nodes in ``pairs``."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    return _of_texts(docs, nodes, ends, "shingles array<long>", _full_sets)


def _of_texts(docs: DataFrame, nodes: DataFrame, ends: DataFrame, column: str, compute) -> DataFrame:
    """``(node, <column>)`` of the nodes in ``ends``, computed from their texts."""
    wanted = stored(nodes.join(ends, "node", "left_semi").select("node", "doc_id", "seq"), "near-wanted")
    ids = wanted.select(F.col("doc_id").alias("wanted_id")).distinct()
    if wanted.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    made = map_arrow(texts, f"doc_id long, seq binary, {column}", compute)
    w, s = wanted.alias("w"), made.alias("s")
    met = s.join(w, (F.col("s.seq") == F.col("w.seq")) & F.col("s.doc_id").eqNullSafe(F.col("w.doc_id")))
    return stored(met.select("node", column.split()[0]).dropDuplicates(["node"]), "near-texts")


def drop_near_copies(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component, all columns kept: the one with
    the smallest doc_id (of repeated rows with it, one)."""
    found = stored(near_duplicates(docs, similarity).where("n_shingles > 0"), "near-found")
    stay = found.where("kept").groupBy("label").agg(F.min("row_id").alias("stay_id"))
    decided = found.join(stay, "label").select("row_key", "doc_id", (F.col("row_id") == F.col("stay_id")).alias("stays"))
    return staying_rows(docs, decided)
