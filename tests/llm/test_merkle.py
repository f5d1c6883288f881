import hashlib
import zlib

import pytest

from textlens.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fanout):
    """Levels of the tree over nodes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def siblings(levels, at, fanout):
    out = []
    for level in levels[:-1]:
        lo = at - at % fanout
        out.append(("".join(level[lo:at]), "".join(level[at + 1 : lo + fanout])))
        at //= fanout
    return out


def brute_force(rows, fanout=2):
    trees = {}
    for doc_id, source, lang, n_chars, text in rows:
        leaf = H(*map(field, (doc_id, source, lang, n_chars, text)))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        other = H(*map(field, (doc_id, source, lang, n_chars if n_chars is None else n_chars + 1, text)))
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, other if hit else leaf, doc_id))
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    low = {k: (sorted(v), tree([x[2] for x in sorted(v)], fanout)) for k, v in trees.items()}
    high = tree([low[k][1][-1][0] for k in names], fanout)
    out = []
    for i, k in enumerate(names):
        for at, (_, _, leaf, start, doc_id) in enumerate(low[k][0]):
            proof = siblings(low[k][1], at, fanout) + siblings(high, i, fanout)
            h = start
            for a, b in proof:
                h = H(a, h, b)
            out.append((doc_id, leaf, low[k][1][-1][0], high[-1][0], H(*[a + b for a, b in proof]), h, h == high[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def result(docs, **how):
    from pyspark.sql import functions as F
    rows = merkle.verify_documents(docs, **how)
    both = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(both, 256), "folded_root", "verified")
    return sorted(map(tuple, rows.collect()), key=repr)


def corpus(n=300):
    rows = [(i * 3 % n, f"s{i % 3}", ["en", "de", "en", "fr"][i % 4], i, f"text {i} é") for i in range(n)]
    rows += [(None, None, None, None, None), (None, "s", "en", 5, "no id"), (7, "s", "en", None, "seven"), (14, "", "", 0, ""),
             (5, "s", "en", 9, "twice"), (5, "s", "en", 9, "twice"), (5, "s", "en", 9, "other"), (21, "s", "zh", 2**63 - 1, "x" * 70_000)]
    return rows


@pytest.mark.parametrize("fanout,block_levels", [(2, 10), (2, 2), (3, 2), (2, 1)])
def test_equals_brute_force(spark, fanout, block_levels):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(docs, fanout=fanout, block_levels=block_levels) == brute_force(rows, fanout)


def test_single_rows_and_empty_table(spark):
    one = [(1, "s", "en", 4, "text")]
    assert result(spark.createDataFrame(one, SCHEMA)) == brute_force(one)
    two = one + [(2, "s", "de", 4, "text")]
    assert result(spark.createDataFrame(two, SCHEMA)) == brute_force(two)
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_clashing_columns(spark):
    rows = corpus(40)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS tree", "2 AS pos", "3 AS row", "4 AS n", "5 AS leaf", "6 AS part")
    assert result(docs) == brute_force(rows)


def test_equal_rows_spread_over_ranges(spark):
    rows = [(5, "s", "en", 9, "twice")] * 400 + [(i, "s", "en", i, "x") for i in range(20)]
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(6), block_levels=3) == brute_force(rows)


def test_versions_share_what_they_don_t_change():
    leaves = [H(str(i)) for i in range(11)]
    t = merkle.PathCopyTree(leaves, merkle.levels_above(11))
    base = [list(level) for level in t.levels]
    first, second = t.change(3, H("a")), t.change(10, H("b"))
    assert t.levels == base  # the original stays
    for version, at, leaf in ((first, 3, "a"), (second, 10, "b")):
        want = tree([*leaves[:at], H(leaf), *leaves[at + 1 :]], 2)
        assert [[t.node(version, k, i) for i in range(len(level))] for k, level in enumerate(want)] == want
        assert len(t.paths[version - 1][1]) == len(want)  # one copied node a level
    assert t.top() == base[-1][0] and len({t.top(), t.top(first), t.top(second)}) == 3
