"""Spelling variants: words that differ by exactly one character.

The words are sorted and their trie's nodes are numbered along the order (a
node is a distinct prefix; the nodes that a word adds follow its common prefix
with the word before it); the reversed words give a second trie.  A word then
has an integer pair (prefix node, suffix node) for every position that is
skipped and for every gap between characters:

* two words of one *skip* pair differ by one replaced character,
* a word of a skip pair and the word of the same *gap* pair differ by one
  inserted character.

So neighbours meet exactly, by equality of two integers; no string is compared
and no candidate is verified.  A group of one pair has one word for each
character that can stand at the position, so it is bounded by the alphabet; it
is ranked, never expanded to its pairs of words.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, default_partitions, map_arrow, slices, small_batches, stored, text_bytes

#: Letters of a word, in characters.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Where this divides the checksum of a document's word, one character is deleted.
CHECKSUM_STEP = 97
MIN_CHARS = 5
MIN_COUNT = 3
#: A form occurs at least so many times as often as the word.
FORM_RATIO = 2
#: Words that a task counts before it hands them on.
TASK_WORDS = 500_000
#: Words of a sorted range at most, on average.
RANGE_WORDS = 500_000


def dropped_character(doc_id: int | None, word: str) -> str:
    """``word`` as it counts in a document: without one character where
    CHECKSUM_STEP divides the crc32 of ``<doc_id>:<word>`` (a null id is
    ``null``)."""
    h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{word}".encode())
    if h % CHECKSUM_STEP:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the words of ``docs(doc_id, text)``, whole texts, A-Z
    lower-cased, with at least ``min_chars`` characters and ``min_count``
    occurrences.  Tasks count before the shuffle.  Null texts have no words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                             names=["word", "n"])
            seen.clear()
            return out

        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
                runs = Counter(RUN.findall(text.translate(LOWER).decode("utf-8", "replace")))
                for run, n in runs.items():
                    word = dropped_character(doc_id, run)
                    if len(word) >= min_chars:
                        seen[word] += n
                if len(seen) >= TASK_WORDS:
                    yield emit()
        yield emit()

    counted = small_batches(docs.select("doc_id", "text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def shared_prefix(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


_NUMBERED = "part int, wid long, word string, n long, nodes array<long>, is_first boolean, last long"
_FIELDS = [c.split()[0] for c in _NUMBERED.split(", ")]


def _number_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the trie nodes of one sorted range of ``word`` from 1 (0 is the
    root) and gives each word its nodes by depth.

    Nodes that no other word of the range shares are left out, but for the
    range's first and last word; the last one has the number of nodes."""
    part, held = TaskContext.get().partitionId(), []
    nodes: list[int] = []
    total, before, word, rest = 0, 0, None, None

    def keep(after: int | None) -> None:
        whole = not seen or after is None
        held.append((part, rest[0], word, rest[1], [0, *(nodes if whole else nodes[: max(before, after)])], not seen,
                     total if after is None else None))

    def emit() -> pa.RecordBatch:
        columns = list(zip(*held)) if held else [()] * len(_FIELDS)
        held.clear()
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_FIELDS)

    seen = 0  # words handed on
    for batch in slices(batches):
        for now, *more in zip(*(batch.column(c).to_pylist() for c in ("word", "wid", "n"))):
            shared = 0
            if word is not None:
                shared = shared_prefix(word, now)
                keep(shared)
                seen += 1
            del nodes[shared:]
            nodes.extend(range(total + 1, total + 1 + len(now) - shared))
            total += len(now) - shared
            before, word, rest = shared, now, more
        yield emit()
    if word is not None:
        keep(None)
    yield emit()


def range_shifts(ends: list) -> list[tuple[int, list[int], int]]:
    """``(part, carried, shift)`` of each range, from its first and last rows
    in order: its numbers below ``len(carried)`` are nodes that the last word of
    the range before has already, the others are moved by ``shift``."""
    out, offset, word, nodes = [], 0, "", [0]
    for first, last in ends:
        shared = shared_prefix(word, first.word)
        carried = nodes[: shared + 1]
        shift = offset - shared
        out.append((first.part, carried, shift))
        word, nodes = last.word, [carried[j] if j < len(carried) else j + shift for j in last.nodes]
        offset += last.last - shared
    return out


def trie_nodes(words: DataFrame, name: str) -> DataFrame:
    """``wid, word, n, nodes`` of ``words(word, n)``, words distinct: ``nodes``
    are the numbers of the word's trie nodes by depth, as far as other words
    share them.  Without a column ``wid`` one is made that ascends with the
    words.

    Ranges number their nodes on their own; two rows of each range go to the
    driver, which lines the ranges up."""
    spark = words.sparkSession
    parts = max(default_partitions(spark), words.count() // RANGE_WORDS + 1)
    ranged = words.repartitionByRange(parts, "word").sortWithinPartitions("word")
    if "wid" not in words.columns:
        ranged = ranged.withColumn("wid", F.monotonically_increasing_id())
    rows = stored(ranged.select("word", "wid", "n").mapInArrow(_number_nodes, _NUMBERED), name)
    ends = rows.where("is_first or last is not null").orderBy("part", F.col("last").asc_nulls_first()).collect()
    pairs = {}
    for row in ends:
        pairs.setdefault(row.part, []).append(row)
    moved = range_shifts([(p[0], p[-1]) for p in pairs.values()])
    shifts = spark.createDataFrame(moved, "part int, carried array<long>, shift long")
    number = F.transform("nodes", lambda j: F.when(j < F.size("carried"), F.get("carried", j.cast("int")))
                         .otherwise(j + F.col("shift")))
    return rows.join(F.broadcast(shifts), "part").select("wid", "word", "n", number.alias("nodes"))


#: Kinds of pairs: a skipped character that repeats the one before it, another skipped character, a gap.
_REPEAT, _SKIP, _GAP = 0, 1, 2


def _pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
    prefix, suffix, kind, wid, n = [], [], [], [], []
    rows = zip(*(batch.column(c).to_pylist() for c in ("wid", "n", "word", "nodes", "back")))
    for word_id, count, word, ahead, back in rows:
        size, deep, far = len(word), len(ahead) - 1, len(back) - 1
        at = len(prefix)
        lo, hi = max(0, size - 1 - far), min(deep, size - 1)
        if lo <= hi:
            prefix += ahead[lo : hi + 1]
            suffix += back[size - 1 - hi : size - lo][::-1]
            kind += [_SKIP if i == 0 or word[i] != word[i - 1] else _REPEAT for i in range(lo, hi + 1)]
        lo, hi = max(0, size - far), min(deep, size)
        if lo <= hi:
            prefix += ahead[lo : hi + 1]
            suffix += back[size - hi : size - lo + 1][::-1]
            kind += [_GAP] * (hi - lo + 1)
        wid += [word_id] * (len(prefix) - at)
        n += [count] * (len(prefix) - at)
    return pa.RecordBatch.from_arrays([pa.array(prefix, pa.int64()), pa.array(suffix, pa.int64()), pa.array(kind, pa.int8()),
                                       pa.array(wid, pa.int64()), pa.array(n, pa.int64())],
                                      names=["prefix", "suffix", "kind", "wid", "n"])


def node_pairs(numbered: DataFrame) -> DataFrame:
    """``prefix, suffix, kind, wid, n``: the pairs of the words of
    ``numbered(wid, word, n, nodes, back)`` that another word may share."""
    return map_arrow(numbered, "prefix long, suffix long, kind byte, wid long, n long", _pairs)


def nearest(pairs: DataFrame) -> DataFrame:
    """``wid, n_near, best(n, order)``: for each word with neighbours their
    number and the one of largest ``n`` (ties: smallest wid = -order).

    Two words that differ by a replaced character share one skip pair; a word
    without one of a run of equal characters is met at the run's first."""
    same = Window.partitionBy("prefix", "suffix")
    me = F.struct(F.col("n"), (-F.col("wid")).alias("order"))
    is_gap = F.col("kind") == _GAP
    skipped, first_of_run, gap = F.when(~is_gap, me), F.when(F.col("kind") == _SKIP, me), F.when(is_gap, me)
    ranked = same.orderBy(is_gap, F.col("n").desc(), "wid")
    rows = pairs.select(
        "wid", "kind", me.alias("me"), F.count(skipped).over(same).alias("n_skipped"), F.max(skipped).over(same).alias("top"),
        F.lead(skipped).over(ranked).alias("second"), F.count(first_of_run).over(same).alias("n_longer"),
        F.max(first_of_run).over(same).alias("longer"), F.max(gap).over(same).alias("shorter"))
    shorter = F.when(F.col("kind") == _SKIP, F.col("shorter"))
    replaced = F.when(F.col("me") == F.col("top"), F.col("second")).otherwise(F.col("top"))
    is_gap = F.col("kind") == _GAP
    near = F.when(is_gap, F.col("n_longer")).otherwise(F.col("n_skipped") - 1 + shorter.isNotNull().cast("long"))
    best = F.when(is_gap, F.col("longer")).otherwise(F.greatest(replaced, shorter))
    found = rows.select("wid", near.alias("near"), best.alias("best")).where("near > 0")
    return found.groupBy("wid").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def followed(forms: DataFrame) -> DataFrame:
    """``wid, root`` for ``forms(wid, form)``: the last word that forms lead
    to.  Every round doubles the steps; a form occurs at least twice as often
    as its word, so there are no circles and few rounds."""
    tops = stored(forms.select("wid", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = tops.select(F.col("wid").alias("root"), F.col("root").alias("higher"))
        step = stored(tops.join(up, "root", "left").select("wid", F.coalesce("higher", "root").alias("root"),
                                                           F.col("higher").isNotNull().alias("moved")), "spelling-roots")
        if step.where("moved").limit(1).count() == 0:
            return step.select("wid", "root")
        tops = step.select("wid", "root")


def group_variants(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """Spelling groups of ``words(word, n)``, words distinct.

    Returns ``word, form, root, n, n_near, form_n``: a word's form is its
    neighbour of largest ``n`` (ties: smallest in code-point order) if that is
    at least ``ratio`` times the word's, else null; ``root`` is the last word
    that forms lead to.  ``n_near`` counts the neighbours.  An empty table
    gives no rows; other columns are ignored.
    """
    words = words.select("word", "n")
    ahead = stored(trie_nodes(words, "spelling-ahead"), "spelling-words")
    back = trie_nodes(ahead.select(F.reverse("word").alias("word"), "wid", "n"), "spelling-back")
    numbered = ahead.join(back.select("wid", F.col("nodes").alias("back")), "wid")
    near = nearest(node_pairs(numbered))
    rows = ahead.select("wid", "word", "n").join(near, "wid", "left")
    is_form = F.col("best.n") >= ratio * F.col("n")
    rows = stored(rows.select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                              F.when(is_form, -F.col("best.order")).alias("form_id"),
                              F.when(is_form, F.col("best.n")).alias("form_n")), "spelling-near")
    roots = followed(rows.where("form_id is not null").select("wid", F.col("form_id").alias("form")))
    name = rows.select(F.col("wid").alias("id"), F.col("word").alias("name"))
    # only words with a form need the names of other words
    formed = (rows.where("form_id is not null").join(roots, "wid")
              .join(name.select(F.col("id").alias("form_id"), F.col("name").alias("form")), "form_id")
              .join(name.select(F.col("id").alias("root"), F.col("name").alias("root_name")), "root"))
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    alone = rows.where("form_id is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"),
                                                 "n", "n_near", "form_n")
    return formed.select("word", "form", F.col("root_name").alias("root"), "n", "n_near", "form_n").unionByName(alone).select(columns)


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``group_variants`` of the words of ``docs(doc_id, text)``."""
    return group_variants(stored(word_counts(docs), "spelling-counts"))
