import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from textlens.llm.hilbert_packing import BITS, hilbert_key, pack_documents
from textlens.llm.token_counts import token_counts
from textlens.llm.tokens import PreTokenCache, ids_bytes, vocabulary_path

ODD = ["", " ", "  a", "a ", "a  b", "x\n b", "x \nb", "x \n y", "x \n  y", "a\tb \t c", "it's 's  's", "tab\t b",
       "é  b", "a  b", "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>", "naïve 中文 \U0001f600 ok",
       "12 345, 6.7 (x)", "a \x1c b", "\x85 z", "don't  'd we'll", "\n\n\n", "a\r\n b", "x" * 300 + " " + "y" * 5000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def test_pre_token_cache_equals_library(library):
    cache = PreTokenCache(vocabulary_path(), ids_bytes)
    for text in ODD + ODD:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(cache.values(text)), "<u4").tolist() == want, text


def test_token_counts_equal_library(documents, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(900, None), (7, "again"), (7, "again"), (None, "no id")]
    got = sorted(map(tuple, token_counts(documents(rows)).collect()), key=repr)
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=repr)
    assert token_counts(documents([])).count() == 0


def check_packing(rows, pieces, library, size):
    want = sorted([ids_bytes(library.encode(t or "", add_special_tokens=False).ids + [1]) for _, t in rows])
    by_doc, by_seq = {}, {}
    for p in pieces:
        assert p.length > 0 and zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        by_seq.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault(p.doc_id, []).append(p)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == size or at < size and at & (at - 1) == 0
    return want, by_doc


@pytest.mark.parametrize("partitions", [1, 3])
def test_packing_holds_each_id_once(documents, library, partitions):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "one two three " * i) for i in range(60)] + [(500, None)]
    pieces = pack_documents(documents(rows), size=64, partitions=partitions, with_ids=True).collect()
    _, by_doc = check_packing(rows, pieces, library, 64)
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        ps = sorted(by_doc[i], key=lambda p: p.start)
        assert b"".join(p.ids for p in ps) == ids_bytes(ids)
        assert [p.start for p in ps] == list(np.cumsum([0] + [p.length for p in ps])[:-1])
        assert {p.doc_tokens for p in ps} == {len(ids)}


def test_packing_repeated_rows_and_empty_table(documents, library):
    rows = [(1, "same text here")] * 5
    pieces = pack_documents(documents(rows), size=16, with_ids=True).collect()
    n = len(library.encode("same text here", add_special_tokens=False).ids) + 1
    assert sum(p.length for p in pieces) == 5 * n
    assert pack_documents(documents([])).count() == 0


def test_hilbert_neighbours_differ_by_one_step():
    axis = np.arange(8)
    grid = np.array([(a, b, c) for a in axis for b in axis for c in axis])
    key = hilbert_key(grid, bits=3)
    assert sorted(key) == list(range(512))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
    assert BITS * 3 < 63
