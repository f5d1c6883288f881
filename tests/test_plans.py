"""Physical-plan checks: native expressions, pruned scans, bounded broadcasts."""

from pyspark.sql import functions as F

from textlens.operators import clean as C
from textlens.operators import tfidf as TF
from textlens.sources.tables import labelled_corpus, table

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaning_plan_has_no_python(spark):
    p = plan(C.clean_corpus(labelled_corpus(spark, SF)))
    assert "Python" not in p and "ArrowEval" not in p


def test_documents_scan_is_pruned(spark):
    p = plan(C.clean_corpus(labelled_corpus(spark, SF)))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_vocabulary_join_is_broadcast(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    vocab = TF.fit_vocabulary(docs, 50)
    p = plan(TF.transform_long(docs, vocab))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_dedupe_is_hash_aggregate(spark):
    p = plan(C.clean_corpus(labelled_corpus(spark, SF)))
    assert "HashAggregate" in p and "Window" not in p


def test_filters_reach_scan(spark):
    df = table(spark, SF, "conversations").filter(F.col("role") == "user").select("conv_id")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in p


def test_cleaning_chain_evaluated_once(spark):
    """Filters on the cleaned text must not inline the chain into the scan."""
    spark.catalog.clearCache()   # a cached equal subplan would print its plan again
    df = C.clean_corpus(labelled_corpus(spark, SF), C.CleanConfig(max_words=512))
    p = df._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("regexp_replace(array_join(filter(") == 1


def test_top_words_has_partial_group_limit(spark):
    from textlens.operators import profile as P
    df = P.top_words_per_class(C.clean_corpus(labelled_corpus(spark, SF)), 200)
    p = plan(df)
    assert "WindowGroupLimit" in p and "Partial" in p
