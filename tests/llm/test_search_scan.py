import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlens.llm import licenses, pii, topk_search, toxicity

VECTORS = "vec_id long, embedding array<float>, bucket string"


def brute_top(rows, step, top=5):
    held = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            held.setdefault(i, []).append([math.floor(256 * float(np.float32(x))) for x in v])
    out = []
    for q in held:
        if q % step == 0:
            score = {c: max(sum(a * b for a, b in zip(x, y)) for x in held[q] for y in held[c]) for c in held if c != q}
            best = sorted(score.items(), key=lambda s: (-s[1], s[0]))[:top]
            out += [(q, r, c, s) for r, (c, s) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block_rows,coordinates_from", [(4096, 0.3), (16, 0.0), (16, 2.0)])
def test_top_k_equals_brute_force(spark, monkeypatch, block_rows, coordinates_from):
    monkeypatch.setattr(topk_search, "COORDINATE_FROM", coordinates_from)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    rows = [(i, [float(x) for x in centres[i % 6] * rng.choice([0.1, 1, 5]) + rng.normal(size=12) * 0.1]) for i in range(150)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (210, [0.0] * 12), (211, None), (212, [None] * 12), (213, [float("nan")] * 12),
             (214, [float("inf")] * 12), (220, [1.0, 2.0]), (230, []), (10, rows[10][1]), (20, [0.5] * 12), (None, [1.0] * 12)]
    df = spark.createDataFrame([(i, v, "own") for i, v in rows], VECTORS).repartition(5)
    got = topk_search.top_k(df, step=10, block_rows=block_rows).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 10)


def test_top_k_of_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0], "b"), (1, [-2.0], "b"), (2, [3.0], "b")], VECTORS)
    assert sorted(map(tuple, topk_search.top_k(df, step=10).collect())) == [(0, 1, 2, 256 * 768), (0, 2, 1, -256 * 512)]
    assert topk_search.top_k(df.where("vec_id > 0"), step=10).count() == 0
    assert topk_search.top_k(df.where("vec_id > 9"), step=10).count() == 0


def test_a_vector_block_is_not_sent_beside_each_query_block(spark, monkeypatch):
    """No row holds a block of vectors and a block of queries; many sets, wide numbers."""
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 2)
    monkeypatch.setattr(topk_search, "SET_BLOCKS", 3)
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * rng.choice([1, 300, 1e5])]) for i in range(120)]
    df = spark.createDataFrame([(i, v, "own") for i, v in rows], VECTORS).repartition(3)
    out = topk_search.top_k(df, step=4, block_rows=20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan.replace("MapCoGroupsInArrow", "")
    assert sorted(map(tuple, out.collect())) == brute_top(rows, 4)
    for most, size in ((2**15 - 1, 2), (2**15, 4), (2**40, 8)):
        m = np.array([[most, -1.0], [0.0, 7.0]])
        held = topk_search._packed(m)
        assert len(held) == 4 * size and (topk_search._unpack(b"", held, 2, 2)[1] == m).all()


def test_pruning_keeps_all_that_reach_the_bound():
    rng = np.random.default_rng(6)
    m = np.round(rng.normal(size=(300, 8)) * 40)
    m = m[np.argsort(-(m * m).sum(axis=1))]
    norms = np.sqrt((m * m).sum(axis=1))
    unit = np.ascontiguousarray((m / norms[:, None]).T)
    for q in np.round(rng.normal(size=(40, 8)) * 40):
        scores = m @ q
        for bound in np.sort(scores)[[-1, -5, -60]]:
            rows = topk_search.candidates(q, float(bound), unit, norms)
            assert set(np.flatnonzero(scores >= bound)) <= set(np.arange(300)[rows])


def base_spans(text):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


PRIVATE = ["", "mail a.b+c@x-y.example.com.", "x@y", "a@b.c%d@e.f @g.h", "éü\U0001f600 q@é.com r@s.tu", "1.2.3.4 and 1.2.3.4.5.6.7.8",
           "256.1.1.1 000255.0.0.01 1.2.3", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "0" * 13, "4111111111111111 4111111111111111",
           "+1 (212) 555-0100, +44 20 7946 0958.", "+1 2", "+123456789012345678", "tel +1 (212) 555-0100 4111111111111111",
           "9" * 40_000, "a" * 40_000, "1 " * 30_000, "+1" + " " * 20_000 + "2", "a.b@" * 5_000, "1." * 20_000, "x@y.z " * 200]


def test_base_spans_equal_the_rules(documents):
    got = pii.span_digest(pii.find_private(documents(list(enumerate(PRIVATE)) + [(900, None)]), pii.Booster([], {}))).collect()
    assert {r.doc_id: r.spans for r in got} == {i: base_spans(t or "") for i, t in [*enumerate(PRIVATE), (900, None)]}
    assert pii.find_private(documents([])).count() == 0


def luhn(i):
    head = f"4{i:014d}"
    return next(head + str(c) for c in range(10) if base_spans(head + str(c)))


@pytest.fixture(scope="module")
def private_rows():
    rows = [(i, f"the words {i} {'card' if i % 2 else 'of'} {luhn(i * 7919)} then phone +1 ({200 + i % 700}) 555-{1000 + i} end") for i in range(240)]
    rows += [(1000 + i, f"{'card' if i % 2 else 'of'} {10 ** 15 + i * 7919 + (not i)} of 12-34-{i}") for i in range(120)]
    rows += [(2000, f"call +1 (212) 555-0100 {luhn(99)}"), (2001, f"{luhn(5)} {luhn(6)}"), (2002, "nothing here")]
    return rows


def test_boosted_trees_add_spans_that_the_rules_drop(documents, private_rows):
    docs = documents(private_rows + [(2000, private_rows[-3][1])]).withColumn("base", F.lit("own"))
    got = {}
    for r in pii.span_digest(pii.find_private(docs)).collect():
        got.setdefault(r.doc_id, []).append(r)
    texts = dict(private_rows)
    for i, rows in got.items():
        assert {r.spans for r in rows} == {rows[0].spans}
        assert {""} | set(base_spans(texts[i]).split(",")) <= {""} | set(rows[0].spans.split(","))
    assert got[2000][0].spans == "card:23:39,phone:5:22" and len(got[2000]) == 2
    assert got[2001][0].spans == "card:0:16,card:17:33"
    assert got[2002][0].spans == ""
    wrong = [r.spans for i, rows in got.items() if 1000 <= i < 2000 for r in rows if r.n_added]
    assert len(wrong) <= 12
    clean = {r.doc_id: r.text for r in pii.redacted(documents(private_rows)).collect()}
    assert clean[2000] == "call [phone] [card]" and clean[2002] == "nothing here"


def window_matches(text):
    """Each template's best window, by trying all windows."""
    cut = lambda t: [w for w in re.sub("[^A-Za-z0-9]+", " ", t).lower().split(" ") if w]
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    words, out = cut(text), {}
    for n, (name, template) in enumerate(licenses.TEMPLATES):
        t = cut(template)
        length = next(c for c in licenses.CLASSES if len(t) <= c)
        for at in range(0, max(len(words), 1), licenses.window_step(length)):
            shared = len(grams(t) & grams(words[at:at + licenses.window_words(length)]))
            if 100 * shared >= 75 * len(grams(t)) and shared > out.get(n, (0,))[0]:
                out[n] = (shared, len(grams(t)), at)
    return {(name, n, *v) for n, v in out.items() for name in [licenses.TEMPLATES[n][0]]}


def test_license_matches_equal_all_windows(documents):
    filler = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(filler[: i * 3]) + ". " + text + "\n" + " ".join(filler[100:140])) for i, (_, text) in enumerate(licenses.TEMPLATES)]
    rows += [(100 + i, " ".join(t.split()[:-2])) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    rows += [(200, None), (201, ""), (202, "mit"), (203, "nothing of that " * 2000), (204, licenses.TEMPLATES[8][1].upper().replace("free", "gratis")),
             (205, "\n".join(t for _, t in licenses.TEMPLATES) * 2)]
    rows += [(204, rows[-2][1])]
    docs = documents(rows).withColumn("license", F.lit("own"))
    got = {(r.doc_id, r.license, r.template, r.shared, r.template_shingles, r.first_word) for r in licenses.license_matches(docs).collect()}
    assert got == {(i, *m) for i, t in rows for m in window_matches(t or "")}
    assert licenses.license_matches(documents([])).count() == 0


def test_bands_guarantee_retrieval():
    for length in licenses.CLASSES:
        s, bands = licenses.least_similarity(length), licenses.band_count(length)
        assert (1 - s) ** bands <= licenses.MISS


@pytest.fixture(scope="module")
def toxic_rows():
    rng = np.random.default_rng(8)
    sylls = ["th", "an", "er", "on", "re", "he", "in", "ed", "nd", "ha"]
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice(sylls, 3)) for _ in range(40)]
        if i % 5 == 0:
            for at in rng.integers(0, 40, 3):
                words[at] = rng.choice(["idiot", "moron", "scum"])
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(i % 5 == 0)))
    return rows, labels


def test_toxicity_on_held_out_rows(documents, spark, toxic_rows):
    rows, labels = toxic_rows
    known = spark.createDataFrame(labels + [(5, 0, None), (None, 0, 1), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    odd = [(9000, None), (9001, ""), (9002, "x" * 100_000), (None, "idiot"), (9002, "x" * 100_000)]
    got = toxicity.toxicity_scores(documents(rows + odd).withColumn("score", F.lit("own")), known).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: y for i, _, y in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 150 and np.mean([a == b for a, b in held]) > 0.97


def test_labels_of_held_out_rows_are_not_used(documents, spark, toxic_rows):
    rows, labels = toxic_rows
    make = lambda ls: spark.createDataFrame(ls, "doc_id long, quality int, toxic int")
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, q, y in labels]
    a, b = (sorted(map(tuple, toxicity.toxicity_scores(documents(rows[:200]), make(ls)).collect())) for ls in (labels, turned))
    assert a == b


@pytest.mark.parametrize("labels", [[], [(1, 0, 0)], [(1, 0, 1), (2, 0, 1)]])
def test_toxicity_without_both_labels(documents, spark, labels):
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents([(1, "a"), (2, "b"), (3, None)])
    got = toxicity.toxicity_scores(docs, known).collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1
    assert toxicity.drop_toxic(docs, known).dtypes == docs.dtypes
    assert toxicity.toxicity_scores(documents([]), known).count() == 0


def test_calibration_puts_the_best_cut_at_the_threshold():
    margins, labels = np.array([3.0, 2.0, -1.0, -2.0, -2.0]), np.array([1, 1, 0, 0, 0])
    slope, shift = toxicity.calibrate(margins, labels)
    score = 1 / (1 + np.exp(-(slope * margins + shift)))
    assert ((score >= 0.7) == (labels == 1)).all()
    assert list(score) == sorted(score, reverse=True)


def test_repeated_ids_count_once_in_the_fit(documents, spark, toxic_rows):
    rows, labels = toxic_rows
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select("doc_id", F.col("toxic").alias("label"))
    once = toxicity.fit_model(documents(rows[:120]), known)
    again = toxicity.fit_model(documents(rows[:120] + [rows[0]] * 300 + [(rows[0][0], None if rows[0][1] == "" else "~" + rows[0][1])]), known)
    assert sorted(once.grams) == sorted(again.grams)
    assert np.allclose(np.sort(once.weights), np.sort(again.weights), atol=1e-6) and np.isclose(once.bias, again.bias, atol=1e-6)
