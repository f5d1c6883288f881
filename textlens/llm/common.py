"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path

#: What separates words in every contract of this subpackage.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Lower-cases A-Z only (``bytes.translate``).
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back.

    Cuts the lineage with files that survive lost executors; later branches
    read the table instead of computing it again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text) -> F.Column:
    """Number of words of a text column; null counts as empty."""
    spaced = F.translate(F.coalesce(F.col(text), F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.size(F.array_remove(F.split(spaced, " ", -1), "")).cast("long")


def with_once(df: DataFrame, **columns: F.Column) -> DataFrame:
    """``df`` with columns that are computed once per row.

    They go through a one-element generator, which filters and later
    projections are not merged across, so an expensive expression is not
    evaluated again wherever its column is used."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    keep = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    held = df.select(*keep, F.explode(F.array(made)).alias("_once"))
    return held.select(*keep, *[F.col(f"_once.{n}").alias(n) for n in columns])


#: Rows that a Python function of texts sees at once, and rows that Spark sends
#: in one Arrow batch: both bound what a worker holds.
SLICE_ROWS = 256
BATCH_ROWS = 2_000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches at BATCH_ROWS rows at most:
    the default is made for numbers, texts are larger."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


_held: dict = {}


def worker_state(key, make):
    """What a job keeps in a worker between its tasks; a worker holds one."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def slices(batches: Iterable[pa.RecordBatch], keep=None) -> Iterator[pa.RecordBatch]:
    """The batches in slices of SLICE_ROWS rows.

    Workers are reused: what another job kept is dropped before, and freed
    memory goes back to the machine after the last row."""
    for key in [k for k in _held if k != keep]:
        del _held[key]
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
    _release()


def _release() -> None:
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def map_arrow(df: DataFrame, schema: StructType | str, rows: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``mapInArrow`` with a function of a small slice of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield rows(batch)
    return small_batches(df).mapInArrow(run, schema)


def row_key() -> F.Column:
    """Tells the rows of a document id apart by their texts."""
    return F.xxhash64("doc_id", "text")


#: Keys of rows to be dropped (16 bytes each) that are broadcast at most; beyond it the join shuffles.
BROADCAST_KEYS = 1_000_000


def staying_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` that stay by
    ``decided(row_key, doc_id, stays)``, which has a row for each of them.

    Few rows go, so their keys are anti-joined (broadcast if they are few
    enough) and the texts are not shuffled.  Of rows that are equal in id and
    text some may stay and some go: then one stays."""
    counts = decided.groupBy("row_key", "doc_id").agg(F.count_if("stays").alias("n_stay"), F.count("*").alias("n"))
    going = stored(counts.where("n_stay < n"), "going")
    few = going.count() <= BROADCAST_KEYS
    # the columns of docs travel as one, so none can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, row_key().alias("key"), F.col("doc_id").alias("id"))

    def on(keys: DataFrame, how: str) -> DataFrame:
        keys = F.broadcast(keys) if few else keys
        return keyed.join(keys, (keyed.key == keys.row_key) & keyed.id.eqNullSafe(keys.doc_id), how)

    out = on(going.select("row_key", "doc_id"), "left_anti")
    some = going.where("n_stay > 0").select("row_key", "doc_id")
    if some.limit(1).count():
        out = out.unionByName(on(some, "left_semi").dropDuplicates(["key", "id"]))
    return out.select("row.*")


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text of an Arrow string column; null gives b''."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]
