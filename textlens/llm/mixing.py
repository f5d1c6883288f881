"""Mixing sources to target weights with a low-discrepancy schedule.

The training stream is a sequence of slots.  Slot j belongs to the source in
whose share of the cumulative weights the golden-ratio point frac((j+1) * phi)
falls, so every stretch of the stream holds each source nearly in proportion.
The slots of a source are ranked, and its r-th slot takes the r-th block of
the source: the documents of the source in shuffled order, one epoch after
the other, cut into blocks of an equal number of words.  The last block of a
source is cut at its target.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, word_count

#: Weights of the sources in code-point order, repeating; null comes last.
WEIGHTS = (3, 1, 2)
#: What the mix takes of all words, and the most it takes of one source.
BUDGET_SHARE = (3, 2)
MAX_EPOCHS = 2
#: Words of a block, and about how many documents one running sum goes over.
BLOCK_WORDS = 512
BUCKET_ROWS = 4_000
#: frac(j * phi) in units of 2**-40: j * GOLDEN mod 2**40 (exact below 2**43 slots).
POINT_BITS = 40
GOLDEN = round((5 ** 0.5 - 1) / 2 * 2 ** POINT_BITS) | 1
#: Points and shares meet in cells of so many high bits.
CELL_BITS = 10
#: Slots that one rank goes over.
SLOT_BUCKET = 200_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=BUDGET_SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, weight, target)`` from ``(source, size)`` rows.

    The share of all words is dealt by weight; a source stops at ``epochs``
    times its size and what it leaves is dealt anew among the others, until
    none is above.  Each round is one aggregate over the table of sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = stored(_code_point_rank(stored(totals, "mix-totals")), "mix-sources")
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % n + 1).cast("int"))
    table = ranked.select("source", "source_size", weight.cast("long").alias("weight"))
    everything = table.agg(F.sum("source_size")).first()[0] or 0
    budget = everything * share[0] / share[1]
    cap = F.col("source_size") * epochs
    level, weight_left, left = 0.0, 0, budget  # words for one unit of weight
    full = F.lit(False)
    while True:
        taken, weight_left = table.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0)),
                                       F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        left = budget - taken
        above = full | (F.col("weight") * F.lit(left) / F.lit(max(weight_left, 1)) > cap)
        if weight_left == 0 or table.where(above & ~full).limit(1).count() == 0:
            break
        full = above
    level = F.col("weight") * F.lit(float(left)) / F.lit(max(weight_left, 1))
    return table.withColumn("target", F.when(full, cap.cast("double")).otherwise(level))


def _code_point_rank(totals: DataFrame) -> DataFrame:
    """Rank from 0 of each source by code point, null last, without one task
    that sorts them all: the sorted table is ranked in each partition and the
    counts of the partitions before it are added."""
    ordered = stored(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()),
                     "mix-ordered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").count().select(  # one row per partition
        "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ordered.withColumn("inside", inside).join(F.broadcast(parts), "part").select(
        "source", "source_size", (F.col("offset") + F.col("inside") - 1).alias("rank"))


def _stream_positions(rows: DataFrame, n_rows: int, epochs: int) -> DataFrame:
    """``(row_id, source, size, epoch, start)``: where each document of each
    epoch begins in its source's shuffled stream.

    The order is the md5 of id, row copy and epoch.  Running sums go over
    (source, prefix of that md5); the prefixes grow with the table, so a hot
    source is spread over as many tasks as it needs.
    """
    digits = max(1, math.ceil(math.log(max(2, n_rows / BUCKET_ROWS), 16)))
    shuffled = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("epoch").cast("string")))
    shuffled = shuffled.withColumn("key", key).withColumn("bucket", F.substring("key", 1, digits))
    sums = shuffled.groupBy("source", "epoch", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "epoch", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    inside = (Window.partitionBy("source", "epoch", "bucket").orderBy("key", "doc_id", "row_id")
              .rowsBetween(Window.unboundedPreceding, -1))
    started = shuffled.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    started, offsets = started.alias("a"), offsets.alias("b")
    on = (F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.epoch") == F.col("b.epoch"))
          & (F.col("a.bucket") == F.col("b.bucket")))
    return started.join(offsets, on).select("row_id", "a.source", "size", "a.epoch",
                                            (F.col("offset") + F.col("inside")).alias("start"))


def golden_point(j) -> F.Column:
    """j * GOLDEN mod 2**40, without leaving 64 bits."""
    half = POINT_BITS // 2
    low, high = j % (1 << half), F.shiftright(j, half)
    return (low * GOLDEN + F.shiftleft((high * GOLDEN) % (1 << half), half)) % (1 << POINT_BITS)


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(slot, source, block, words)``: the slots of the stream.

    A source needs ceil(target / block_words) slots.  It gets those of its
    golden-ratio points that rank below that number; the few that the points
    leave out (their discrepancy) follow after the last point, where sources
    share slot numbers.
    """
    spark = targets.sparkSession
    wanted = stored(
        targets.select("source", F.round("target").cast("long").alias("whole"))
        .withColumn("need", F.ceil(F.col("whole") / block_words).cast("long")).where("need > 0")
        .orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-need")
    total = wanted.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    # cumulative shares: running sums in each partition plus the sums before it
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = wanted.groupBy("part").agg(F.sum("need").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = (Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
              .rowsBetween(Window.unboundedPreceding, -1))
    shares = wanted.withColumn("inside", F.coalesce(F.sum("need").over(inside), F.lit(0))).join(
        F.broadcast(parts), "part").withColumn("first", F.col("offset") + F.col("inside"))
    scale = F.lit(float(1 << POINT_BITS)) / F.lit(max(total, 1))
    shares = shares.select("source", "whole", "need", F.floor(F.col("first") * scale).alias("lo"),
                           F.floor((F.col("first") + F.col("need")) * scale).alias("hi"))
    cell = POINT_BITS - CELL_BITS
    cells = shares.withColumn("cell", F.explode(F.sequence(F.shiftright("lo", cell),
                                                           F.shiftright(F.greatest("lo", F.col("hi") - 1), cell))))
    points = spark.range(total).select(F.col("id").alias("slot"), golden_point(F.col("id") + 1).alias("point"))
    points = points.withColumn("cell", F.shiftright("point", cell))
    dealt = points.join(cells, "cell").where("point >= lo and point < hi").select(
        "slot", "source", "whole", "need", F.floor(F.col("slot") / SLOT_BUCKET).alias("bucket"))
    # rank of a slot among those of its source: counts of earlier buckets plus the rank inside
    counts = dealt.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("source").alias("s"), F.col("bucket").alias("b"),
                            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("slot"))
    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))
    ranked = (dealt.withColumn("inside", rank).join(offsets, on)
              .withColumn("block", F.col("offset") + F.col("inside") - 1).where("block < need"))
    got = counts.groupBy(F.col("source").alias("s")).agg(F.sum("n").alias("got"))
    late = (shares.join(got, F.col("source").eqNullSafe(F.col("s")), "left")
            .withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
            .withColumn("block", F.explode(F.sequence("got", F.col("need") - 1)))
            .withColumn("slot", F.lit(total) + F.col("block") - F.col("got")))
    slots = ranked.select("slot", "source", "block", "whole").unionByName(late.select("slot", "source", "block", "whole"))
    return slots.select("slot", "source", "block",
                        F.least(F.lit(block_words), F.col("whole") - F.col("block") * block_words).alias("words"))


def mix(docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS, row_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The sized rows of ``docs(doc_id, source, text)`` and the pieces of the mix.

    Rows: ``row_id, doc_id, source, size, source_size, target``.  Pieces, one
    per document, epoch and block: ``row_id, slot, block, epoch, first_word,
    words`` (a run of the document's words).  Size is the number of words;
    documents without words (null or empty texts) are in no piece.  A null
    source is a source of its own.  Repeated rows are documents of their own.
    An empty table gives no rows; other columns are ignored.  Rows are numbered
    here unless ``row_key`` names a column of unique longs.
    """
    row_id = F.col(row_key) if row_key else F.monotonically_increasing_id()
    sized = stored(docs.select(row_id.alias("row_id"), "doc_id", "source", word_count("text").alias("size")), "mix-sizes")
    targets = stored(source_targets(sized, weights), "mix-targets")
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    rows = sized.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = _stream_positions(sized.where("size > 0"), sized.count(), MAX_EPOCHS)
    end = F.col("start") + F.col("size")
    blocks = F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))
    parts = placed.withColumn("block", F.explode(blocks)).alias("p")
    slots = schedule(targets, block_words).alias("q")
    on = F.col("p.source").eqNullSafe(F.col("q.source")) & (F.col("p.block") == F.col("q.block"))
    lo = F.greatest(F.col("start"), F.col("p.block") * block_words)
    hi = F.least(end, F.col("p.block") * block_words + F.col("words"))
    pieces = (parts.join(slots, on).where(hi > lo)
              .select("row_id", "slot", "p.block", "epoch", (lo - F.col("start")).alias("first_word"),
                      (hi - lo).alias("words")))
    return rows, pieces


def mix_counts(docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``row_id, doc_id, source, size, source_size, target, taken``: words the
    mix takes of each row, repeats counted (see ``mix``)."""
    rows, pieces = mix(docs, weights, block_words)
    taken = pieces.groupBy("row_id").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "row_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` as the mix holds them, with the columns of ``docs``.

    One row per epoch that takes words of a document.  A document of which an
    epoch takes a part (the last of its source) keeps those first words,
    joined by single spaces, and ``n_chars`` (if there) follows the text.
    """
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    held = stored(docs.select(row, F.monotonically_increasing_id().alias("row_id")), "mix-docs")
    rows, pieces = mix(held.select("row_id", "row.doc_id", "row.source", "row.text"), weights, block_words, "row_id")
    epochs = pieces.groupBy("row_id", "epoch").agg(F.sum("words").alias("words"))
    epochs = epochs.join(rows.select("row_id", "size"), "row_id")
    out = held.join(epochs, "row_id")
    split = F.array_remove(F.split(F.translate("row.text", "\t\n\x0b\x0c\r", " " * 5), " ", -1), "")
    text = F.when(F.col("words") < F.col("size"), F.concat_ws(" ", F.slice(split, F.lit(1), F.col("words").cast("int"))))
    text = text.otherwise(F.col("row.text"))
    fields = [F.col(f"row.`{c}`").alias(c) for c in columns]
    out = out.select(*[text.alias("text") if c == "text" else f for c, f in zip(columns, fields)])
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out
