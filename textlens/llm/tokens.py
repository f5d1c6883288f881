"""Byte-level BPE through pre-token caches.

The byte-level tokenizer never merges across a space that starts a word, so a
text is cut before such spaces and the pieces (space-led pre-tokens) are
encoded on their own; most of a corpus is a small vocabulary of them.  A cut
is exact unless white space meets white space at a space; such a text, and one
that holds a special string, goes through the library whole.
"""

from __future__ import annotations

import json
import struct

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from .common import worker_state

#: Entries that a worker's cache takes; the frequent ones come early, so it then stays as it is.
#: Texts of 158 MB took 30 s with these and with three times as many, which held 60 MB more a worker.
CACHE_ENTRIES = 200_000
#: Longer pre-tokens (in characters) are encoded but not kept.
CACHE_CHARS = 64
VOCABULARY = "byte_bpe_50k.json"
#: Up to here the libraries' character classes agree.
_LATIN = "\u0250"


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, without truncation and padding."""
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def byte_level_encoding(spec: dict) -> tiktoken.Encoding | None:
    """The same vocabulary for the faster encoder, if a tokenizer file's
    content is plain byte-level BPE whose merges are in the order of their ids."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and not model.get("byte_fallback") and not model.get("ignore_merges")
             and spec.get("normalizer") is None and cut.get("type") == "ByteLevel"
             and cut.get("use_regex", True) and not cut.get("add_prefix_space"))
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    ids = [model["vocab"].get(a + b) for a, b in merges]
    if not plain or ids != list(range(256, 256 + len(ids))):
        return None
    # byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(ids)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class PreTokenCache:
    """Values of pre-tokens, computed once per worker while the cache lasts.

    ``of_ids`` maps the ids of a pre-token to its value, ``first`` is a table
    of known values (the broadcast tier)."""

    def __init__(self, path: str, of_ids, first: dict | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self._library = path, None
        self.fast = byte_level_encoding(spec)
        # of the byte-level alphabet, U+0120 stands for the space
        self._spaced = {i for token, i in spec["model"].get("vocab", {}).items() if token.startswith("\u0120")} if self.fast else set()
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.of_ids = of_ids
        self.first = first or {}
        self.kept: dict = dict(self.first)

    @property
    def library(self) -> Tokenizer:
        """The tokenizer itself, loaded when a text first needs it."""
        if self._library is None:
            self._library = tokenizer(self.path)
        return self._library

    def whole(self, text: str):
        return self.of_ids(self.library.encode(text, add_special_tokens=False).ids)

    def values(self, text: str) -> list:
        """The values of a text's pre-tokens, in order."""
        if not text:
            return []
        if any(s in text for s in self.specials):
            return [self.whole(text)]
        kept = self.kept
        head, *rest = text.split(" ")
        # keys leave out the space that leads them
        found = [*map(kept.get, rest)]
        if None in found:
            misses = [*dict.fromkeys(p for p, v in zip(rest, found) if v is None)]
            if any(not p or p[0].isspace() for p in misses):
                return [self.whole(text)]
            fresh = dict(zip(misses, self._encode_spaced(misses)))
            found = [fresh[p] if v is None else v for p, v in zip(rest, found)]
            if len(kept) < CACHE_ENTRIES:
                kept.update((p, v) for p, v in fresh.items() if len(p) <= CACHE_CHARS)
        return ([self._encode(head)] if head else []) + found

    def _encode_spaced(self, pieces: list[str]) -> list:
        """The values of pieces that a space leads, through the encoder together
        where it can: a token with a leading space starts a piece."""
        if self.fast is not None:
            joined = " " + " ".join(pieces)
            if joined.isascii() or max(joined) < _LATIN:
                ids = self.fast.encode_ordinary(joined)
                starts = [i for i, id_ in enumerate(ids) if id_ in self._spaced]
                if len(starts) == len(pieces):
                    return [self.of_ids(ids[lo:hi]) for lo, hi in zip(starts, [*starts[1:], len(ids)])]
        return [self._encode(" " + p) for p in pieces]

    def _encode(self, piece: str):
        # beyond Latin letters the libraries' character classes may differ by Unicode version
        if self.fast is not None and (piece.isascii() or max(piece) < _LATIN):
            return self.of_ids(self.fast.encode_ordinary(piece))
        return self.of_ids(self.library.encode(piece, add_special_tokens=False).ids)


def ids_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def worker_cache(key: str, path: str, of_ids, first: dict | None = None) -> PreTokenCache:
    """A worker's cache for the job named ``key``, kept between its tasks."""
    return worker_state(key, lambda: PreTokenCache(path, of_ids, first))
