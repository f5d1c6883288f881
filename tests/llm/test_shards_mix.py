import math

import pytest
from pyspark.sql import functions as F

from textlens.llm import mixing, sharding

WORDS = "one two three four five six seven "


def test_shards_fit_and_only_large_buckets_split(documents):
    rows = [(i, "x" * (10 + i * 7 % 90)) for i in range(400)] + [(1000, "y" * 900), (1001, None), (1002, "")]
    got = sharding.shard_documents(documents(rows), limit=500).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    sizes = {}
    for r in got:
        key = (r.depth, r.prefix, r.page)
        sizes.setdefault(key, [0, r.shard_bytes])[0] += r.n_bytes
    assert all(a == b for a, b in sizes.values())
    assert all(a <= 500 for (d, *_), (a, _) in sizes.items() if d >= 0)
    assert [r.depth for r in got if r.doc_id == 1000] == [-1]
    names = [p for d, p, _ in sizes if d >= 0]
    assert all(not b.startswith(a) for a in names for b in names if a != b)  # a prefix code
    total = {n: sum(r.n_bytes for r in got if r.depth >= 0 and r.prefix.startswith(n)) for n in {p[:-1] for p in names if p}}
    assert all(t > 500 for t in total.values())  # a parent of a shard did not fit


def test_shards_of_one_hot_key(documents):
    rows = [(7, "z" * 40)] * 90 + [(None, "n" * 30)] * 40 + [(i, "q" * 10) for i in range(30)]
    got = sharding.shard_documents(documents(rows), limit=300).collect()
    sizes = {}
    for r in got:
        sizes.setdefault((r.depth, r.prefix, r.page), []).append(r.n_bytes)
    assert len(got) == len(rows) and all(sum(s) <= 300 for s in sizes.values())
    assert sharding.shard_documents(documents([]), limit=300).count() == 0


def test_write_shards(documents, spark, tmp_path):
    docs = documents([(i, WORDS * 3) for i in range(40)]).withColumn("depth", F.lit("own"))
    sharding.write_shards(docs, str(tmp_path / "s"), limit=600)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 40 and set(docs.columns) < set(back.columns)
    assert all(p.stat().st_size for p in (tmp_path / "s").glob("shard=*/*.parquet"))


def brute_targets(sizes, weights=(3, 1, 2)):
    """Shares dealt by weight again and again until no source is above twice its size."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = budget - sum(2 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        share = {s: w[s] * left / sum(w[f] for f in free) for s in free}
        more = {s for s in free if share[s] > 2 * sizes[s]}
        if not more:
            return {s: float(2 * sizes[s]) if s in full else share[s] for s in names}
        full |= more


MIX = ([(i, WORDS * (1 + i % 5), "big") for i in range(120)] + [(200 + i, WORDS * 2, "mid") for i in range(20)]
       + [(300 + i, WORDS, None) for i in range(9)] + [(400, "tiny", "a"), (401, None, "a"), (402, "", "nothing")]
       + [(500, WORDS, "twin"), (500, WORDS, "twin"), (None, WORDS, "twin")])


@pytest.mark.parametrize("block", [16, 512])
def test_mix_reaches_targets(documents, block):
    got = mixing.mix_counts(documents(MIX), block_words=block).collect()
    assert len(got) == len(MIX)
    sizes, taken = {}, {}
    for i, t, s in MIX:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(taken[s] == round(want[s]) for s in want)
    again = mixing.mix_counts(documents(MIX, partitions=7), block_words=block).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken, r.target)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_schedule_interleaves_sources(documents):
    rows, pieces = mixing.mix(documents(MIX), block_words=16)
    slots = pieces.join(rows.select("row_id", "source"), "row_id").select("slot", "source").distinct().collect()
    n = len({s.slot for s in slots})
    big = sorted(s.slot for s in slots if s.source == "big")
    share = len(big) / n
    for cut in (n // 4, n // 2, 3 * n // 4):  # every prefix holds about its share
        assert abs(sum(s < cut for s in big) - share * cut) <= 6


def test_mixed_documents_follow_the_counts(documents):
    docs = documents(MIX).withColumn("slot", F.lit(0))
    out = mixing.mixed_documents(docs, block_words=16)
    assert out.columns == docs.columns
    counts = {}
    for r in mixing.mix_counts(documents(MIX), block_words=16).collect():
        counts[r.source] = counts.get(r.source, 0) + r.taken
    held = {}
    for r in out.collect():
        assert r.n_chars == len(r.text)
        held[r.source] = held.get(r.source, 0) + len(r.text.split())
    assert held == {s: n for s, n in counts.items() if n}
    assert mixing.mix_counts(documents([])).count() == 0
    assert mixing.mixed_documents(documents([])).count() == 0
    assert mixing.mix_counts(documents([(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0


def test_a_column_named_row_id_is_not_the_key(documents):
    from textlens.llm import mixing, sharding
    docs = documents([(i, f"four words of {i}", f"s{i % 2}") for i in range(20)]).selectExpr("*", "7L AS row_id")
    plain = docs.drop("row_id")
    assert sharding.shard_documents(docs).count() == 20
    def counts(d):
        return sorted((r.doc_id, r.taken) for r in mixing.mix_counts(d).collect())
    assert counts(docs) == counts(plain) and all(t <= 8 for _, t in counts(docs))
    assert mixing.mixed_documents(docs).columns == docs.columns
