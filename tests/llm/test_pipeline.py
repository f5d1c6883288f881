import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textlens.llm import queries
from textlens.llm.tokens import vocabulary_path
from tests.llm.test_dedup import ascii_lower, brute_near
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) < set(queries.QUERIES)


def test_entry_registers_queries_and_pipeline():
    import __spark_entry__ as entry
    found = entry.queries()
    assert found["pipeline"] is corpus_pipeline.run and set(queries.QUERIES) < set(found)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, as the driver runs them."""
    docs, held = spark.read.parquet(f"{SF}/documents.parquet").repartition(3), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        out = stage(spark, docs, SF)
        if name != "pack":
            assert out.dtypes == docs.dtypes
        out.write.parquet(path)
        held.append((docs.collect(), spark.read.parquet(path).collect()))
        docs = spark.read.parquet(path)
    return held


def test_toxic_stage_only_removes_rows(stages):
    before, after = stages[0]
    assert 0 < len(after) <= len(before) and set(after) <= set(before)


def test_exact_stage_equals_brute_force(stages):
    before, after = stages[1]
    top = {}
    for r in before:
        key = ascii_lower(r.text or "")
        top[key] = max(top.get(key, r), r, key=lambda x: x.doc_id)
    assert sorted(map(repr, after)) == sorted(map(repr, top.values()))


def test_near_stage_equals_brute_force(stages):
    before, after = stages[2]
    kept = [i for i, _, _, keep in brute_near([(r.doc_id, r.text) for r in before]) if keep]
    assert sorted(r.doc_id for r in after) == sorted(kept) and set(after) <= set(before)


def test_mix_stage_takes_its_budget(stages):
    before, after = stages[3]
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(words(after) - 1.5 * words(before)) <= len({r.source for r in before})
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}


def test_pack_stage_holds_all_tokens(stages):
    before, after = stages[4]
    t = Tokenizer.from_file(vocabulary_path())
    n = [len(e.ids) + 1 for e in t.encode_batch([r.text for r in before], add_special_tokens=False)]
    assert sum(r.length for r in after) == sum(n)


def test_stages_take_empty_tables_nulls_and_repeated_rows(spark, documents):
    rows = [(1, None), (None, "no id at all here"), (2, ""), (3, "the same words " * 30), (3, "the same words " * 30), (4, "x" * 60_000)]
    for make in ([], rows):
        docs = documents(make)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "pack":
                assert out.dtypes == docs.dtypes
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() == 0 or docs.agg(F.min("length")).first()[0] > 0
