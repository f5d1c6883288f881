import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from textlens.llm import bpe

from .test_tokens_packing import ODD

MORE = ["ա՘ա ֋֌ ᳂", "日本語のテキスト。" * 40, "א" * 300, "1²③ ٣४ Ⅻ", "a᠎b ​ c d 　 e",
        "\x1c\x1d a\x1f  b\x85", "a" * 5000, "ab" * 700, " " * 700, "\n" * 300 + "x", "é" * 400, "ʼn ɐ ɑ ɐɑ", "x" + "!" * 999,
        "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyz", k=6000)), "\U0001f469‍\U0001f680" * 30, "𐕀𑙠ꟍ 𞤀 ೝ"]


def own_encoding(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def coder(ranks):
    return bpe.BytePairCoder(ranks)


def test_pair_table_holds_every_split(coder, ranks):
    wanted = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            if token[:cut] in ranks and token[cut:] in ranks:
                wanted[ranks[token[:cut]], ranks[token[cut:]]] = rank
    a, b = np.array(list(wanted)).T
    assert coder.pairs.ranks(a, b).tolist() == list(wanted.values())
    absent = [(x, y) for x in range(0, 3000, 37) for y in range(0, 3000, 41) if (x, y) not in wanted]
    a, b = np.array(absent).T
    assert (coder.pairs.ranks(a, b) == bpe._NONE).all()
    assert (coder.pairs.ranks(np.array([-1, 5]), np.array([7, -1])) == bpe._NONE).all()


def test_whole_table_equals_library(spark, documents, ranks):
    library = own_encoding(ranks)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [(i, t) for i, t in enumerate(ODD + MORE + texts)] + [(900, None), (7, "again"), (7, "again"), (None, "no id")]
    got = sorted(map(tuple, bpe.round_trip(documents(rows)).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_empty_table_and_clashing_columns(spark, documents):
    assert bpe.round_trip(documents([])).count() == 0
    docs = documents([(1, "some text")]).selectExpr("*", "7 AS ids", "'x' AS decoded", "1 AS n_tokens")
    assert bpe.round_trip(docs).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    row = bpe.decode(bpe.encode(docs)).first()
    assert bytes(row.decoded) == b"some text" and row.ids == list(row.ids)


def by_one_merge_at_a_time(ranks, piece):
    if piece in ranks:
        return (ranks[piece],)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return tuple(ranks[p] for p in parts)
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_any_ranks_matrix_and_long_rows(data):
    """Also ranks that no training gives, in which a merge makes a pair of lower rank."""
    tokens = data.draw(st.lists(st.text("abc", min_size=2, max_size=5).map(str.encode), unique=True, max_size=25))
    ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(tokens)}
    pieces = data.draw(st.lists(st.text("abc", min_size=1, max_size=24).map(str.encode), min_size=1, max_size=12))
    coder = bpe.BytePairCoder(ranks)
    want = [by_one_merge_at_a_time(ranks, p) for p in pieces]
    assert coder.encode(pieces) == want
    rows = [tuple(coder.merge_row(coder._of_byte[list(p)]).tolist()) for p in pieces]
    assert [w if p in ranks else r for w, p, r in zip(want, pieces, rows)] == want


def test_matrices_in_several_parts(coder, ranks, monkeypatch):
    monkeypatch.setattr(bpe, "MATRIX_CELLS", 64)
    words = [w.encode() for t in ODD + MORE for w in bpe.Splitter()(t)]
    assert coder.encode(words) == [by_one_merge_at_a_time(ranks, w) if len(w) < 300 else coder.encode([w])[0] for w in words]


def test_splitter_follows_the_library_beyond_latin(ranks):
    """Characters that the two regular-expression engines class differently."""
    split, library = bpe.Splitter(), own_encoding(ranks)
    text = "".join(map(chr, [*range(0x250, 0xD800, 7), *range(0xE000, 0x20000, 11)]))
    text = "".join(c + x for c, x in zip(text, "a1! \n" * len(text)))
    pieces = split(text)
    assert "".join(pieces) == text
    coder = bpe.BytePairCoder(ranks)
    assert [i for ids in coder.encode([p.encode() for p in pieces]) for i in ids] == library.encode_ordinary(text)
    assert split.stand_in


def test_full_cache_stays_exact(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    worker = bpe._Worker(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    library = own_encoding(ranks)
    for _ in range(2):
        got = [np.frombuffer(ids, "<i4").tolist() for ids in worker.encode(ODD)]
        assert got == [library.encode_ordinary(t) for t in ODD]
    assert len(worker.kept) == 3
