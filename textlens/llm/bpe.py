"""Byte-level BPE encoding and decoding with numpy matrices.

A text is split into pre-tokens.  The distinct ones that a worker has not seen
are put into matrices of ids, one row each, padded to the width of their length
bucket.  In each round every row merges its leftmost pair of minimum rank; the
pair ranks come from a hash table in numpy arrays, only the two pairs beside a
merge are looked up again, and the matrix is compacted: each row loses one
column, finished rows leave.

A pre-token longer than ``MATRIX_BYTES`` is a row of its own whose rounds take
all merges of the minimum rank, as far as the one-at-a-time order would.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, text_bytes, worker_state

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Longer pre-tokens are rows of their own; cells of one matrix at most.
MATRIX_BYTES = 128
MATRIX_CELLS = 1 << 20
#: Entries that a worker's cache takes (then it stays as it is), and the longest pre-token kept, in characters.
CACHE_ENTRIES = 600_000
CACHE_CHARS = 64

_NONE = np.int64(1) << 40  # rank of a pair that never merges
_EMPTY = np.int64(-1)
#: Up to here the libraries' character classes agree.
_LATIN = "ɐ"


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank (and id) of each token of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PairTable:
    """Open-addressing hash table from a pair of ids to the merged id."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        key = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        bits = max(4, (4 * len(key)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self._keys = np.full(1 << bits, _EMPTY)
        self._ranks = np.full(1 << bits, _NONE)
        waiting, slot = np.arange(len(key)), self._slot(key)
        while len(waiting):
            # of the keys that want a free slot the first takes it, the others go on
            free = np.flatnonzero(self._keys[slot] == _EMPTY)
            taken, first = np.unique(slot[free], return_index=True)
            winners = free[first]
            self._keys[taken] = key[waiting[winners]]
            self._ranks[taken] = np.array(merged, np.int64)[waiting[winners]]
            lost = np.ones(len(waiting), bool)
            lost[winners] = False
            waiting, slot = waiting[lost], (slot[lost] + 1) & self._mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; pads are negative and never merge."""
        key = (left << 32) | right
        slot = self._slot(key)
        held = self._keys[slot]
        out = np.where(held == key, self._ranks[slot], _NONE)
        open_ = np.flatnonzero((held != key) & (held != _EMPTY))
        while len(open_):
            slot.reshape(-1)[open_] = at = (slot.reshape(-1)[open_] + 1) & self._mask
            held, want = self._keys[at], key.reshape(-1)[open_]
            hit = held == want
            out.reshape(-1)[open_[hit]] = self._ranks[at[hit]]
            open_ = open_[~hit & (held != _EMPTY)]
        return np.where((left < 0) | (right < 0), _NONE, out)


class BytePairCoder:
    """Encodes pre-tokens with the ranks of a file, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.pairs = PairTable(ranks)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            known = self.ids.get(piece)
            if known is not None:
                out[i] = (known,)
            elif len(piece) > MATRIX_BYTES:
                out[i] = tuple(self.merge_row(self._of_byte[np.frombuffer(piece, np.uint8)]).tolist())
            elif piece:
                buckets.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            step = MATRIX_CELLS // width
            for lo in range(0, len(members), step):
                part = members[lo : lo + step]
                for i, ids in zip(part, self._merged([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _merged(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        padded = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        sizes = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < sizes[:, None], self._of_byte[padded], -1)
        done = self.merge_matrix(ids)
        lengths = (done >= 0).sum(axis=1).tolist()
        return [tuple(row[:n]) for row, n in zip(done.tolist(), lengths)]

    def merge_matrix(self, ids: np.ndarray) -> np.ndarray:
        """The merged rows of a matrix of ids, padded with -1."""
        done = np.full_like(ids, -1)
        rows = np.arange(len(ids))
        rank = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        while len(rows) and rank.shape[1]:
            at = rank.argmin(axis=1)  # the leftmost minimum
            best = rank[np.arange(len(rows)), at]
            live = best < _NONE
            if not live.all():
                done[rows[~live], : ids.shape[1]] = ids[~live]
                rows, ids, rank, at, best = rows[live], ids[live], rank[live], at[live], best[live]
                if not len(rows):
                    break
            row = np.arange(len(rows))
            ids[row, at] = best
            column = np.arange(ids.shape[1] - 1)
            before = column <= at[:, None]
            ids = np.where(before, ids[:, :-1], ids[:, 1:])
            rank = np.where(before[:, :-1], rank[:, :-1], rank[:, 1:])
            left, right = at > 0, at < rank.shape[1]
            r, a = row[left], at[left]
            rank[r, a - 1] = self.pairs.ranks(ids[r, a - 1], ids[r, a])
            r, a = row[right], at[right]
            rank[r, a] = self.pairs.ranks(ids[r, a], ids[r, a + 1])
        done[rows, : ids.shape[1]] = ids
        return done

    def merge_row(self, ids: np.ndarray) -> np.ndarray:
        """The merged ids of one long row.

        A round merges, from the left, all pairs of the minimum rank that do
        not overlap, up to the first whose merge makes a pair of a lower rank:
        one merge at a time would go on with that pair."""
        while len(ids) > 1:
            rank = self.pairs.ranks(ids[:-1], ids[1:])
            least = rank.min()
            if least == _NONE:
                break
            at = np.flatnonzero(rank == least)
            # in a chain of overlapping pairs every second one merges
            new = np.r_[True, np.diff(at) > 1]
            start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            beside = np.where(np.r_[False, np.diff(at) == 2], least, ids[at - 1])
            beside = np.where(at == 0, -1, beside)
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            merged = np.full(len(at), least)
            lower = (self.pairs.ranks(beside, merged) < least) | (self.pairs.ranks(merged, after) < least)
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
            ids = ids.copy()
            ids[at] = least
            ids = np.delete(ids, at + 1)
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Splitter:
    """Matches of a pattern, with the character classes of the rank files' own library.

    Unicode versions differ between the two regular-expression engines.
    Characters beyond Latin are probed once, and those that the engines class
    differently are matched as a stand-in of the right class."""

    #: kind -> a character before the probed one that it joins, and a stand-in beyond Latin
    KINDS = {"letter": ("a", "ɑ"), "number": ("1", "①"), "other": ("!", "☃")}
    SPACE = " "

    def __init__(self, pattern: str = public_tokenizers.PATTERN):
        self.pattern = pattern
        self.find = regex.compile(pattern).findall
        self.matches = regex.compile(pattern).finditer
        self.own = {kind: regex.compile(c).match for kind, c in
                    (("letter", r"\p{L}"), ("number", r"\p{N}"), ("space", r"\s"))}
        self.known: set[str] = set()
        self.stand_in: dict[int, str] = {}

    def _probe(self, chars: set[str]) -> None:
        single = {bytes([b]): b for b in range(256)}
        kind = dict.fromkeys(chars, "space")
        for name, (lead, _) in self.KINDS.items():
            pairs = {(lead + c).encode(): 256 + i for i, c in enumerate(sorted(chars))}
            coder = tiktoken.Encoding("probe", pat_str=self.pattern, mergeable_ranks=single | pairs, special_tokens={})
            for c in chars:
                if len(coder.encode_ordinary(lead + c)) == 1:
                    kind[c] = name
        for c, k in kind.items():
            mine = next((name for name, match in self.own.items() if match(c)), "other")
            if mine != k:
                self.stand_in[ord(c)] = self.SPACE if k == "space" else self.KINDS[k][1]
        self.known |= chars

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or max(text) < _LATIN:
            return self.find(text)
        fresh = {c for c in set(text) - self.known if c >= _LATIN}
        if fresh:
            self._probe(fresh)
        seen = text.translate(self.stand_in) if self.stand_in else text
        if seen == text:
            return self.find(text)
        return [text[m.start() : m.end()] for m in self.matches(seen)]


class _Worker:
    """What a worker keeps: the coder, the splitter and the ids of pre-tokens (as bytes)."""

    def __init__(self, path: str, pattern: str):
        self.coder = BytePairCoder(read_ranks(path))
        self.split = Splitter(pattern)
        self.kept: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian 32-bit; the pre-tokens not kept are encoded together."""
        pieces = [self.split(t) for t in texts]
        misses = sorted(set(chain.from_iterable(pieces)) - self.kept.keys())
        room = CACHE_ENTRIES - len(self.kept)
        ids = self.coder.encode([m.encode() for m in misses])
        self.kept.update(zip(misses, [struct.pack(f"<{len(i)}i", *i) for i in ids]))
        out = [b"".join(map(self.kept.__getitem__, p)) for p in pieces]
        for piece in misses:
            if room > 0 and len(piece) <= CACHE_CHARS:
                room -= 1
            else:
                del self.kept[piece]
        return out


class _Decoder:
    """The bytes of all tokens in a row, and where each one's are."""

    def __init__(self, path: str):
        tokens = {rank: token for token, rank in read_ranks(path).items()}
        self.sizes = np.zeros(max(tokens) + 1, np.int64)
        self.sizes[list(tokens)] = [len(t) for t in tokens.values()]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens[k] for k in sorted(tokens)), np.uint8)

    def __call__(self, ids: pa.ListArray) -> pa.Array:
        """The decoded bytes of each row; null ids count as none."""
        ids = ids.fill_null([]) if ids.null_count else ids
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        sizes = self.sizes[flat]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[flat] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        rows = np.cumsum(ids.value_lengths().to_numpy())
        offsets = np.r_[0, np.r_[0, ends][rows]].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(self.bytes[at])])


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, ids`` of each row of ``docs(doc_id, text)``.

    Whole texts by the ranks of the file, each match of ``pattern`` on its own,
    without special tokens.  Null counts as empty: no ids.  Bytes that are not
    UTF-8 count as U+FFFD.  Rows may repeat; an empty table gives no rows;
    other columns are ignored.
    """
    path, job = path or public_tokenizers.path(VOCABULARY), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, job):
            worker = worker_state(job, lambda: _Worker(path, pattern))
            ids = worker.encode([t.decode("utf-8", "replace") for t in text_bytes(batch.column("text"))])
            offsets = (np.cumsum([0, *map(len, ids)]) // 4).astype(np.int32)
            flat = np.frombuffer(b"".join(ids), "<i4")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, flat)],
                                             names=["doc_id", "ids"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes that the ids of
    ``encoded(doc_id, ids)`` stand for; null ids count as none."""
    path, job = path or public_tokenizers.path(VOCABULARY), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, job):
            decoded = worker_state(job, lambda: _Decoder(path))(batch.column("ids"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), decoded],
                                             names=["doc_id", "ids", "decoded"])

    return small_batches(encoded.select("doc_id", "ids")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row: the digest
    of the decimal ids joined by a space, and of the bytes decoded from them."""
    rows = decode(encode(docs, path), path)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
