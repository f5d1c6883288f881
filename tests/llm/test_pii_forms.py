"""Spans that the base rules never match are added, however rare their kind is."""

import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from textlens.llm import pii

# a text for each generator but IPv4's (the base rule finds all of those), and the span that is added
FORMS = [("the mail bob@intranet now", "email:9:21"), ("write to bob [at] example [dot] org today", "email:9:35"),
         ("from 2001:0db8:0000:0000:0000:ff00:0042:8329 end", "ip:5:44"), ("paid 4111111111111111 12 times", "card:5:21"),
         ("paid 4111 1111 1111 1111 77 times", "card:5:24"), ("paid 3782 822463 10005 9 times", "card:5:22"),
         ("on +1 212 555 0100 9988776 or", "phone:3:18"), ("on 212-555-0100 now", "phone:3:15")]
NOT = ["we met bob@intranet there", "paid 4111111111111112 12 times", "on 112-055-0100 now", "at 300.1.2.3 and 1:2:3:4:5:6:7 o'clock"]


def added(docs):
    names = pii.KINDS
    found = pii.find_private(docs).collect()
    return {r.doc_id: [f"{names[s.kind]}:{s.start}:{s.end}" for s in r.added] for r in found}


@pytest.mark.parametrize("hot", [0, 4000])
def test_each_form_is_added_beside_a_hot_kind(documents, hot):
    rows = [(i, text) for i, (text, _) in enumerate(FORMS)] + [(100 + i, text) for i, text in enumerate(NOT)]
    rows += [(1000 + i, f"user{i}@site{i % 7}.example.com and {10 ** 12 + i * 7919} of {i % 90}") for i in range(hot)]
    got = added(documents(rows))
    assert {i: got[i] for i in range(len(FORMS))} == {i: [span] for i, (_, span) in enumerate(FORMS)}
    assert all(got[100 + i] == [] for i in range(len(NOT)))


def test_a_corpus_of_valid_proposals_only(documents):
    assert added(documents([(1, FORMS[2][0]), (2, FORMS[2][0])])) == {1: ["ip:5:44"], 2: ["ip:5:44"]}
    assert added(documents([(1, NOT[0]), (2, None)])) == {1: [], 2: []}


def test_added_spans_equal_all_pairs(documents):
    """The added spans by comparing every pair of a text's proposals, in Python."""
    rng = random.Random(5)
    words = [t for f, _ in FORMS for t in f.split(" ")] + ["a@b.c.de", "x@yy", "é@üü.zz", "1.2.3.4", "+1 (212) 555-0100", "212-555-0100", "4111-1111-1111-1111", "😀", ","]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 400))) for _ in range(40)]
    docs = documents(list(enumerate(texts)))
    booster = pii.Booster([(1.0, 0.0)], {g: 0.5 for g in range(len(pii.GENERATORS))})
    seen = {r.doc_id: r for r in pii.with_proposals(pii.with_base_spans(docs)).select("doc_id", "text", "base", "proposals").collect()}
    meets = lambda a, b: a.start < b.end and b.start < a.end
    for r in pii.find_private(docs, booster).collect():
        row = seen[r.doc_id]
        key = lambda i, c: (c.end - c.start, -c.start, -i)
        free = [(i, c) for i, c in enumerate(row.proposals) if not any(meets(b, c) for b in row.base)]
        kept = sorted((int(c.kind_id), c.start, c.end) for i, c in free
                      if not any(o.kind_id == c.kind_id and meets(o, c) and key(j, o) > key(i, c) for j, o in free))
        assert [tuple(s) for s in r.added] == kept
        for c in row.proposals:  # places and context are those of the text
            rule = regex.compile(pii.GENERATORS[c.generator_id][1])
            assert rule.match(row.text, c.start).end() == c.end
            assert c.context == len(regex.findall(pii.CONTEXT_WORDS, row.text[max(0, c.start - pii.CONTEXT):c.start]))


def test_many_spans_in_one_text(documents):
    n = 5_000
    text = " ".join(f"u{i}@host{i}.example.com 212-555-{1000 + i} of bob{i}@intranet" for i in range(n))
    booster = pii.Booster([(1.0, 0.0)], {g: 0.5 for g in range(len(pii.GENERATORS))})
    docs = documents([(1, text)])
    pii.find_private(documents([(1, "u@h.com 212-555-1000")]), booster).collect()
    started = time.time()
    row = pii.find_private(docs, booster).first()
    assert time.time() - started < 40
    assert len(row.base) == n and len(row.added) == 2 * n


def test_equal_bodies_part_by_context_and_both_classes_are_learned(documents):
    docs = documents([(i, text) for i, (text, _) in enumerate(FORMS)] + [(50, None), (51, "")])
    booster = pii.fit_booster(docs)
    assert set(booster.thresholds) == set(range(len(pii.GENERATORS)))

    def features(tree):
        return set() if isinstance(tree, float) else {pii.FEATURES[tree[0]]} | features(tree[2]) | features(tree[3])

    used = set().union(*[features(tree) for _, tree in booster.trees])
    assert used & set(pii.CONTEXT_FEATURES) and used & {"checksum", "parts", "dotted"}
    body = "bob@intranet"
    leads = ["mail me: ", "please write to ", "there were ", "", "on the way "]
    got = {r.doc_id: len(r.added) for r in pii.find_private(documents([(i, lead + body) for i, lead in enumerate(leads)]), booster).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0}
    # spans of other documents than those fitted on: injected with other contexts
    other = documents([(i, f"{i} ways to call or write to user{i}@host{i}.example.org from 10.0.{i}.1") for i in range(300)])
    spans = pii.injected(other).where("aside")
    p = F.expr(booster.probability())
    least = F.create_map(*[F.lit(x) for pair in booster.thresholds.items() for x in pair])
    taken = spans.withColumn("taken", p >= least[F.col("generator_id")]).where("taken").groupBy("generator_id")
    for r in taken.agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("hits")).collect():
        assert r.hits >= 0.85 * r.n, r
