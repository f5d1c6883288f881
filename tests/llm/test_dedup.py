import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlens.llm import exact_dedup as ex
from textlens.llm import minhash_dedup as nd
from textlens.llm.components import connected_components


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def test_counting_quotient_filters_merge_losslessly():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(3)]
    parts.append(np.repeat(parts[0][:3], [400, 2, 1]))  # a counter beyond one byte
    merged = ex.merge_filters([ex.pack_filter(ex.build_filter(p)) for p in parts])
    fps = ex.filter_fingerprints(*merged[:3])
    want, n = np.unique(np.concatenate(parts), return_counts=True)
    assert (fps == want).all() and (merged[3] == n).all()


EXACT = [(1, "Same Text"), (5, "same text"), (9, "SAME TEXT"), (2, "Éa"), (3, "éa"), (4, None), (6, ""), (7, "alone"),
         (8, "alone "), (11, "twice"), (11, "twice"), (None, "no id"), (None, "no id"), (12, "x" * 50_000), (13, "X" * 50_000)]


def test_exact_groups(documents):
    got = ex.exact_groups(documents(EXACT)).collect()
    assert len(got) == len(EXACT)
    groups = {}
    for i, t in EXACT:
        groups.setdefault(ascii_lower(t or ""), []).append(i)
    for t, ids in groups.items():
        rows = [r for r in got if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
        top = max((i for i in ids if i is not None), default=None)
        assert sorted(r.doc_id is None for r in rows) == sorted(i is None for i in ids)
        assert {(r.keep_id, r.group_size) for r in rows} == {(top, len(ids))}
        assert [r.doc_id for r in rows if r.kept] == [top]
    assert ex.exact_groups(documents([])).count() == 0


def test_exact_groups_without_broadcast(documents, monkeypatch):
    want = sorted(map(repr, ex.exact_groups(documents(EXACT)).drop("row_key").collect()))
    monkeypatch.setattr(ex, "BROADCAST_ROWS", -1)
    assert sorted(map(repr, ex.exact_groups(documents(EXACT)).drop("row_key").collect())) == want


def test_drop_exact_copies_keeps_columns(documents):
    docs = documents(EXACT)
    for clash in ("kept", "fp", "row_key", "row_id", "key", "id", "row", "sha"):
        docs = docs.withColumn(clash, F.lit("own column"))
    out = ex.drop_exact_copies(docs)
    assert out.dtypes == docs.dtypes
    assert sorted(r.doc_id for r in out.collect() if r.doc_id) == [2, 3, 6, 7, 8, 9, 11, 13]
    assert {r.row_key for r in out.collect()} == {"own column"}
    assert out.count() == 9


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)]
    root = {n: n for e in links for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for e in links for n in e if e[0] != e[1]}


def brute_near(rows):
    sets = []
    for _, t in rows:
        w = ascii_lower(t or "").encode().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def find(n):
        while up[n] != n:
            n = up[n]
        return n
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            up[max(find(a), find(b))] = min(find(a), find(b))
    members = {}
    for n in range(len(rows)):
        members.setdefault(find(n), []).append(rows[n][0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in members.items()}
    return sorted((rows[n][0], len(sets[n]), least[find(n)], rows[n][0] == least[find(n)]) for n in range(len(rows)))


def near_rows(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 60, 200]))]
        for _ in range(rng.choice([1, 3, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    return rows + [(900, ""), (901, None), (902, "a b"), (903, "A  b"), (904, "a b c d e"), (905, "  \n"), (906, "é É"),
                   (907, "dup row here " * 9), (907, "dup row here " * 9)]


@pytest.mark.parametrize("block,broadcast", [(1024, 1000), (4, -1)])
def test_near_duplicates_equal_brute_force(documents, monkeypatch, block, broadcast):
    monkeypatch.setattr(nd, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = near_rows()
    got = nd.near_duplicates(documents(rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute_near(rows)


def test_near_duplicates_of_few_or_no_rows(documents):
    assert nd.near_duplicates(documents([])).count() == 0
    got = nd.near_duplicates(documents([(None, "a b c d e f"), (None, "A B c d e f")])).collect()
    assert [(r.component_id, r.kept) for r in got] == [(None, True)] * 2
    docs = documents(near_rows()).withColumn("label", F.lit("own"))
    out = nd.drop_near_copies(docs)
    assert out.dtypes == docs.dtypes
    want = {r[0] for r in brute_near(near_rows()) if r[3]}
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_bbit_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for shared, want in ((3000, 0.75), (1000, 1000 / 7000), (0, 0.0)):
        a, b = pool, np.concatenate([pool[:shared], rng.integers(0, 1 << 63, (4000 - shared) if shared == 1000 or not shared else 0, dtype=np.uint64)])
        packed, _ = nd.signatures(nd.minima([a, b]))
        equal = int(nd._equal_values(packed[:1], packed[1:])[0])
        assert abs(float(nd.estimated_similarity(equal)) - want) < 0.2
    assert nd.least_estimate() < nd.MINIMA * 0.766


def test_open_bands_are_sized_without_windows(spark):
    """A band of one large component and a stranger: rows are labelled by a
    join with one row a band, none of its rows meet in a window."""
    from textlens.llm.minhash_dedup import _open_members
    rows = [(1, n) for n in range(500)] + [(2, 7), (2, 8)] + [(3, 499), (3, 600)]
    members = spark.createDataFrame(rows, "key long, node long")
    label = lambda n: 499 if n in (499, 600) else 0
    nodes = sorted({n for _, n in rows})
    labels = spark.createDataFrame([(n, label(n)) for n in nodes], "node long, label long")
    found = _open_members(members, labels)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["key"], r["node"], r["label"], r["rank"], r["all_n"], r["small_n"]) for r in found.collect()}
    assert got == {(1, n, label(n), 2 if n == 499 else 1, 500, 1) for n in range(500)}
