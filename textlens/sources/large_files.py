"""One large file read by many tasks, when records go across line ends.

A quoted CSV field may hold line ends and a JSON file may be a single line, so
a task that starts in the middle of a file can't tell where the next record
begins.  The text source still splits the file, at a delimiter that is one
byte: the line end for CSV, the closing brace for JSON.  Two passes then find
the records:

1. Every piece between delimiters is summed up by column functions (quotes
   modulo 2; brackets opened less closed, once as if it started outside a
   string and once inside).  A task adds its pieces up per split for both
   starts, which gives a few numbers a split.  Chained in file order they tell
   each split's true start.  As many rows reach the driver as the scan has
   splits, which the driver lists anyway.
2. Each split walks through its pieces from its true start and joins those of
   a record.  Records that a split's edge cuts are the only rows shuffled: the
   parts, at most two a split, are put together by file and record number.

The texts of the second pass are written once below the shared checkpoint
folder, so what is parsed doesn't depend on a third look at the splits.  A
task holds one Arrow batch and one record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..session import scratch_path
from .readers import NA_STRINGS

_SPLIT = "file string, block long"
_PART = f"{_SPLIT}, n long, value string, starts boolean, ends boolean"


@contextmanager
def _splits_of(spark: SparkSession, split_bytes: int | None) -> Iterator[None]:
    """The session's split size set for the time of the two passes."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    if split_bytes is not None:
        spark.conf.set(key, str(split_bytes))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _count(text: Column, characters: str) -> Column:
    """How many of ``characters`` the text holds."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _csv_state(value: Column) -> list[Column]:
    parity = F.pmod(_count(value, '"'), F.lit(2))
    zero = F.lit(0)
    return [parity.alias("parity"), zero.alias("outside"), zero.alias("inside")]


def _json_state(value: Column) -> list[Column]:
    """A piece lacks the brace that ended it: it closes one more bracket if
    the piece ends outside a string."""
    plain = F.regexp_replace(value, r"(?s)\\.", "")
    parity = F.pmod(_count(plain, '"'), F.lit(2))
    bare = lambda x: F.regexp_replace(x, r'"[^"]*("|$)', "")
    depth = lambda x: _count(x, "{[") - _count(x, "}]")
    after_string = F.regexp_replace(plain, r'^[^"]*("|$)', "")
    return [parity.alias("parity"), (depth(bare(plain)) - F.when(parity == 0, 1).otherwise(0)).alias("outside"),
            (depth(bare(after_string)) - F.when(parity == 1, 1).otherwise(0)).alias("inside")]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], slice]]:
    """The stretches of a batch that come from one split."""
    files, blocks = batch.column("file"), batch.column("block").to_numpy()
    codes = files.dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1
    for start, stop in zip([0, *cuts], [*cuts, len(blocks)]):
        if stop > start:
            yield (files[int(start)].as_py(), int(blocks[start])), slice(int(start), int(stop))


def _states(batch: pa.RecordBatch, part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy()[part].astype(np.int64) for c in ("parity", "outside", "inside"))


def _before(parity, outside, inside, quoted: int, depth: int):
    """State before each piece, and the state after the last."""
    after_q = (quoted + np.cumsum(parity)) % 2
    q = np.concatenate([[quoted], after_q])
    d = depth + np.concatenate([[0], np.cumsum(np.where(q[:-1] == 0, outside, inside))])
    return q, d


def _split_sums(batches):
    """One row per split: its parity and change of depth for both starts."""
    sums: dict = {}
    for batch in batches:
        for key, part in _runs(batch):
            parity, outside, inside = _states(batch, part)
            p, d0, d1 = sums.get(key, (0, 0, 0))
            _, ends0 = _before(parity, outside, inside, p, d0)
            _, ends1 = _before(parity, outside, inside, 1 - p, d1)
            sums[key] = (int(p + parity.sum()) % 2, int(ends0[-1]), int(ends1[-1]))
    rows = [(*key, *v) for key, v in sums.items()]
    names = ["file", "block", "parity", "outside", "inside"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _starts(sums: list) -> dict[tuple[str, int], tuple[int, int]]:
    """Start state of every split, chained along each file."""
    starts, file, quoted, depth = {}, None, 0, 0

    def close():
        if file is not None and (quoted or depth > 0):
            raise ValueError(f"{file} ends inside a quoted text or a bracket")

    for r in sorted(sums, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            close()
            file, quoted, depth = r["file"], 0, 0
        starts[r["file"], r["block"]] = (quoted, depth)
        depth += r["inside"] if quoted else r["outside"]
        quoted = (quoted + r["parity"]) % 2
    close()
    return starts


def _walk(starts: dict, end: str, level: int) -> Callable:
    """Pieces to records: one begins (and the last one ends) where the state
    is outside a string and no deeper than ``level``."""
    def walk(batches):
        key, number, held, begun = None, 0, [], False
        out: list = []

        def flush(ends: bool):
            nonlocal number
            if held:
                out.append((*key, number, end.join(held), begun, ends))
                number += 1
                held.clear()

        def batch_of():
            columns = list(zip(*out)) if out else [[] for _ in range(6)]
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                              ["file", "block", "n", "value", "starts", "ends"])
            out.clear()
            return made

        quoted = depth = 0
        for batch in batches:
            values = batch.column("value")
            for found, part in _runs(batch):
                if found != key:
                    flush(quoted == 0 and depth <= level)
                    if found not in starts:
                        raise RuntimeError(f"the splits of {found[0]} changed between the two passes: read it again")
                    key, number = found, 0
                    quoted, depth = starts[key]
                q, d = _before(*_states(batch, part), quoted, depth)
                free = (q == 0) & (d <= level)
                texts = values.slice(part.start, part.stop - part.start).to_pylist()
                for text, opens in zip(texts, free[:-1].tolist()):
                    if opens:
                        flush(True)
                    if not held:
                        begun = opens
                    held.append(text)
                quoted, depth = int(q[-1]), int(d[-1])
            yield batch_of()
        flush(quoted == 0 and depth <= level)
        yield batch_of()
    return walk


def _records(spark: SparkSession, path: str, end: str, state: Callable[[Column], list[Column]], level: int,
             split_bytes: int | None) -> DataFrame:
    """``(file, block, n, value)``: the text of every record."""
    with _splits_of(spark, split_bytes):
        text = spark.read.option("lineSep", end).option("recursiveFileLookup", True).text(path)
        pieces = text.select(F.col("_metadata.file_path").alias("file"),
                             F.col("_metadata.file_block_start").alias("block"), "value", *state(F.col("value")))
        sums = pieces.drop("value").mapInArrow(_split_sums, f"{_SPLIT}, parity long, outside long, inside long")
        starts = _starts(sums.collect())
        out = scratch_path(spark, "records")
        pieces.mapInArrow(_walk(starts, end, level), _PART).write.parquet(out)
    parts = spark.read.schema(_PART).parquet(out)
    whole = parts.where("starts AND ends").select("file", "block", "n", "value")
    cut = parts.where("NOT (starts AND ends)")
    number = F.sum(F.col("starts").cast("long")).over(Window.partitionBy("file").orderBy("block", "n"))
    ordered = F.sort_array(F.collect_list(F.struct("block", "n", "value")))
    joined = cut.withColumn("record", number).groupBy("file", "record").agg(ordered.alias("p"))
    first = F.col("p")[0]
    return whole.unionByName(joined.select("file", first["block"].alias("block"), first["n"].alias("n"),
                                           F.array_join(F.col("p.value"), end).alias("value")))


def _ddl(schema: StructType | str) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def read_large_csv(spark: SparkSession, path: str, schema: StructType | str,
                   na_strings: list[str] | None = NA_STRINGS, with_order: bool = False,
                   split_bytes: int | None = None) -> DataFrame:
    """CSV with a header, like ``read_csv``, with every file in splits.

    Quotes have to be as RFC 4180 has them: a field that holds a quote is
    quoted and doubles it.  A file that ends inside quotes is an error.  Empty
    lines between records are skipped, an empty file gives no rows.
    ``with_order`` adds ``_order`` = (file, block, n), the order in the file.
    ``split_bytes`` sets the size of a split for this read."""
    schema = _ddl(schema)
    records = _records(spark, path, "\n", _csv_state, 0, split_bytes)
    body = F.regexp_replace("value", "\r$", "")
    rows = records.where("NOT (block = 0 AND n = 0)").where(F.length(body) > 0)
    order = F.struct("file", "block", "n").alias("_order")
    parsed = rows.select(F.from_csv(body, schema.simpleString()[7:-1].replace(":", " "),
                                    {"escape": '"', "multiLine": "true"}).alias("r"), order)
    fields = []
    for f in schema.fields:
        c = F.col("r").getField(f.name)
        if na_strings and isinstance(f.dataType, StringType):
            c = F.when(c.isin(na_strings), F.lit(None)).otherwise(c)
        fields.append(c.alias(f.name))
    return parsed.select(*fields, *(["_order"] if with_order else []))


def _members(spark: SparkSession, path: str, first: str, split_bytes: int | None) -> DataFrame:
    """``body``: the text of each member of the top-level array or object.
    Each must be an object: what else is there is an error."""
    records = _records(spark, path, "}", _json_state, 1, split_bytes)
    body = F.regexp_replace("value", r"^\s*[\[{]?[\s,]*" if first == '"' else r"^[\s,\[]+", "")
    rows = records.select("file", "block", "n", F.concat(body, F.lit("}")).alias("body"))
    over = F.col("body").rlike(r"^[\]\s]*\}$")
    wrong = F.raise_error(F.concat(F.lit("not a member that is an object: "), F.substring("body", 1, 200)))
    keep = F.when(F.col("body").startswith(first), F.lit(True)).when(over, F.lit(False)).otherwise(wrong.cast("boolean"))
    return rows.where(keep)


def read_large_json_array(spark: SparkSession, path: str, schema: StructType | str,
                          split_bytes: int | None = None) -> DataFrame:
    """Files that hold one JSON array of objects each, like
    ``read_json_array``, with every file in splits.  A member that doesn't
    match the schema is an error; an empty array gives no rows."""
    rows = _members(spark, path, "{", split_bytes)
    return rows.select(F.from_json("body", _ddl(schema), {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_large_json_map(spark: SparkSession, path: str, value_schema: StructType | str, key_col: str = "post_id",
                        split_bytes: int | None = None) -> DataFrame:
    """Files that hold one JSON object ``{key: object}`` each, like
    ``read_json_map``, with every file in splits.  A member that doesn't match
    the schema is an error; an empty object gives no rows."""
    rows = _members(spark, path, '"', split_bytes)
    wrapped = F.concat(F.lit("{"), "body", F.lit("}"))
    of = f"map<string, {_ddl(value_schema).simpleString()}>"
    return (rows.select(F.explode(F.from_json(wrapped, of, {"mode": "FAILFAST"})).alias(key_col, "_v"))
            .select(key_col, "_v.*"))
