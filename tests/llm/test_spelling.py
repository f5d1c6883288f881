import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textlens.llm import spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_force(counts, ratio=2):
    forms, out = {}, {}
    for w, n in counts.items():
        others = [(-counts[o], o) for o in counts if near(w, o)]
        best = min(others, default=None)
        form = best[1] if best and -best[0] >= ratio * n else None
        forms[w] = form
        out[w] = [w, form, None, n, len(others), counts[form] if form else None]
    for w in out:
        at = w
        while forms[at]:
            at = forms[at]
        out[w][2] = at
    return sorted(map(tuple, out.values()))


def count_words(rows):
    seen = Counter()
    for i, t in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def table(spark, counts, partitions=3):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(partitions)


COUNTS = {"hello": 40, "hallo": 10, "helo": 7, "hhello": 3, "helllo": 4, "hellllo": 2, "hell": 9, "jello": 20, "jell": 1,
          "aaaaa": 5, "aaaa": 5, "aaaaaa": 80, "aaa": 5, "ab": 3, "ba": 3, "a": 2, "b": 2, "abc": 12, "été": 6, "ête": 2,
          "étée": 13, "ét": 1, "z": 1, "zyxw": 8, "zyxwv": 3, "x" * 300: 4, "x" * 299 + "y": 9, "x" * 301: 2, "é" * 40: 1}


def test_groups_equal_brute_force(spark):
    got = sorted(map(tuple, spelling.group_variants(table(spark, COUNTS)).collect()))
    assert got == brute_force(COUNTS)


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_numbers_line_up_over_ranges(spark, partitions):
    """The numbers of a trie don't depend on the ranges it is cut into."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = spelling.trie_nodes(table(spark, COUNTS), "t").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    prefixes = {}
    for r in rows:
        for depth, node in enumerate(r.nodes):
            assert prefixes.setdefault(node, r.word[:depth]) == r.word[:depth]
    assert len(set(prefixes.values())) == len(prefixes)
    shared = {w[:d] for w in COUNTS for d in range(len(w) + 1) if sum(v.startswith(w[:d]) for v in COUNTS) > 1}
    assert shared <= set(prefixes.values())
    for r in rows:  # and every shared node of a word is there
        assert all(len(r.nodes) > d for d in range(len(r.word) + 1) if r.word[:d] in shared)
    assert [r.word for r in sorted(rows, key=lambda r: r.wid)] == sorted(COUNTS)


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.text("abé", min_size=1, max_size=6), st.integers(1, 60), min_size=1, max_size=60))
def test_random_words(spark, counts):
    assert sorted(map(tuple, spelling.group_variants(table(spark, counts)).collect())) == brute_force(counts)


def test_documents(spark, documents):
    text = "Colour color COLOUR colours, colour's couleur l'été; naïve naive ÀÉÎ àéî ×÷×÷× x1y2z abc "
    rows = [(i, text * (1 + i % 4)) for i in range(60)]
    rows += [(None, "Colour without an id " * 9), (1, None), (2, ""), (7, "same row again " * 3), (7, "same row again " * 3)]
    rows += [(100 + i, "Q" * 20_000 + " " + "q" * 20_001 + " " + "longtail" * 3000) for i in range(4)]
    counts = count_words(rows)
    assert len(counts) > 10
    docs = documents(rows).selectExpr("*", "'x' AS word", "1 AS n", "2 AS wid")
    got = sorted(map(tuple, spelling.spelling_variants(docs).collect()))
    assert got == brute_force(counts)


def test_empty_tables(spark, documents):
    assert spelling.spelling_variants(documents([])).count() == 0
    assert spelling.spelling_variants(documents([(1, "too few words here"), (2, None)])).count() == 0


def test_task_hands_on_its_counts(spark, documents, monkeypatch):
    rows = [(i, f"alpha beta{chr(97 + i % 26)} gamma delta " * 5) for i in range(50)]
    want = count_words(rows)
    monkeypatch.setattr(spelling, "TASK_WORDS", 2)
    assert {r.word: r.n for r in spelling.word_counts(documents(rows)).collect()} == want
