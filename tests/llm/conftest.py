import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOC = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                  StructField("lang", StringType()), StructField("source", StringType()),
                  StructField("n_chars", LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, source) rows."""
    def make(rows, partitions=4):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOC).repartition(partitions)
    return make
