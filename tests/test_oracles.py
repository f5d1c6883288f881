"""Every query with an oracle matches DuckDB on the smallest scale factor."""

import pytest

import __spark_entry__ as entry
from tests.harness import compare, duck

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
# many model fits each: too long here, the driver compares them at sf0.01
MANY_FITS = {"model_grid", "model_grid_word2vec", "model_grid_subword", "model_grid_glove", "boosted_search", "gbt", "glove_train", "top_run_search"}
FITS = MANY_FITS | {"random_search", "refit_best", "word2vec_docs", "subword_docs", "logreg"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - MANY_FITS))
def test_matches_oracle(spark, con, name):
    r = compare(spark, name, entry.queries()[name], ORACLES[name], SF, con)
    assert r["ok"], r["problems"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["label", "n", "share_pct"]
    assert df.count() >= 0


def test_every_query_has_a_callable():
    qs = entry.queries()
    assert set(ORACLES) <= set(qs)


_TYPES = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
          "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN", "FloatType()": "FLOAT"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - FITS))
def test_column_types_match_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    spark_types = {f.name: _TYPES.get(repr(f.dataType), repr(f.dataType)) for f in df.schema.fields}
    rel = con.sql(ORACLES[name])
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert spark_types == duck_types
