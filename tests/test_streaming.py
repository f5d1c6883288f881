"""The streaming adapter produces the batch job's rows."""

from textlens.operators import clean as C
from textlens.session import scratch_path
from textlens.sources.tables import labelled_corpus
from textlens.streaming import clean_stream


def test_stream_matches_batch(spark):
    corpus = labelled_corpus(spark, "/root/testdata/sf0.001")
    src = scratch_path(spark, "stream-src")
    # two files arrive: the stream sees them as separate micro-batch input
    corpus.filter("doc_id % 2 = 0").write.json(src + "/a")
    corpus.filter("doc_id % 2 = 1").write.json(src + "/b")
    sink, ckpt = scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-ckpt")
    q = clean_stream(spark, src + "/*", sink, ckpt)
    q.awaitTermination(300)
    got = {r["text"] for r in spark.read.parquet(sink).collect()}
    want = {r["text"] for r in C.clean_corpus(corpus).collect()}
    assert got == want
