"""Sharding by extendible hashing.

A row's address is the bits of the md5 of its key.  The directory starts with
one bucket; a bucket whose rows exceed the byte limit splits on the next bit,
the others stay.  All depths are summed in one pass: each row's cell (a
prefix as long as the table may need) adds up its bytes, cells add up to all
their prefixes, and a bucket is a prefix that fits whose parent does not fit.
Cells that are still too large go another round with longer prefixes.

Rows that no bit parts (equal keys) form overflow shards: they are put one
after the other and cut below the limit.  A row larger than the limit is a
shard of its own and takes no part in the splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bytes of text that a shard holds at most.
SHARD_BYTES = 1 << 20
#: Address bits; rows equal in all of them overflow.
ADDRESS_BITS = 60
#: Bits by which a round goes beyond what an even spread needs.
SPARE_BITS = 6


def address(key) -> F.Column:
    """The first 60 bits of the md5 of a key; null has an address of its own."""
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, ADDRESS_BITS // 4), 16, 10).cast("long")


def _prefix(addr, depth) -> F.Column:
    """The ``depth`` high bits of an address."""
    return F.call_function("shiftright", addr, (F.lit(ADDRESS_BITS) - depth).cast("int"))


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """``(depth, prefix, shard_bytes, shard_rows, cell_bits)``: the buckets of
    ``sized(addr, n_bytes)``; a bucket of all bits may exceed the limit."""
    total = sized.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    bits = min(ADDRESS_BITS, max(0, int(total // limit).bit_length()) + SPARE_BITS)
    done, todo, from_depth = None, sized, 0
    while True:
        cells = todo.groupBy(_prefix(F.col("addr"), F.lit(bits)).alias("cell")).agg(
            F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        cells = cells.withColumn("depth", F.explode(F.sequence(F.lit(from_depth), F.lit(bits))))
        prefix = F.call_function("shiftright", F.col("cell"), (F.lit(bits) - F.col("depth")).cast("int"))
        sums = cells.groupBy("depth", prefix.alias("prefix")).agg(
            F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == ADDRESS_BITS)
        sums = stored(sums.withColumn("fits", fits).withColumn("cell_bits", F.lit(bits)), "shard-sums")
        parents = sums.where(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        leaves = sums.where("fits").withColumn("up", F.shiftright("prefix", 1))
        first = F.col("depth") == from_depth
        top = leaves.where(first if from_depth == 0 else first & F.lit(False))
        below = leaves.where(F.col("depth") > from_depth).join(parents, ["depth", "up"], "left_semi")
        found = top.unionByName(below).select("depth", "prefix", "shard_bytes", "shard_rows", "cell_bits")
        done = found if done is None else done.unionByName(found)
        large = sums.where((F.col("depth") == bits) & ~F.col("fits")).select(F.col("prefix").alias("cell"))
        if bits == ADDRESS_BITS or large.limit(1).count() == 0:
            return done
        todo = todo.withColumn("cell", _prefix(F.col("addr"), F.lit(bits))).join(large, "cell", "left_semi").drop("cell")
        from_depth, bits = bits, min(ADDRESS_BITS, bits + 2 * SPARE_BITS)


def assign_shards(rows: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """``row_id, depth, prefix, page, shard_bytes`` for ``rows(row_id, key, n_bytes)``.

    (depth, prefix, page) names the shard: the prefix's bits as a string, and
    a page above 0 where rows overflow.  Rows larger than the limit have depth
    -1 and their row_id as page.  A null size counts as 0.  Shards never
    exceed the limit but for those.  An empty table gives no rows.
    """
    sized = stored(rows.select("row_id", F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"),
                               address(F.col("key")).alias("addr")), "shard-rows")
    jumbo = sized.where(F.col("n_bytes") > limit)
    sized = sized.where(F.col("n_bytes") <= limit)
    leaves = stored(directory(sized.select("addr", "n_bytes"), limit), "shard-directory")
    # the directory's slots: every cell that a bucket covers, for each cell length in use
    span = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("cell_bits") - F.col("depth")).cast("int"))
    slots = leaves.withColumn("cell", F.explode(F.sequence(F.col("prefix") * span, (F.col("prefix") + 1) * span - 1)))
    lengths = [r[0] for r in leaves.select("cell_bits").distinct().orderBy("cell_bits").collect()]  # one per round
    wide = sized.withColumn("cell_bits", F.explode(F.array(*[F.lit(n) for n in lengths or [0]])))
    wide = wide.withColumn("cell", _prefix(F.col("addr"), F.col("cell_bits")))
    placed = wide.join(slots, ["cell_bits", "cell"])
    fit = placed.where(F.col("shard_bytes") <= limit).select(
        "row_id", "depth", "prefix", F.lit(0).cast("long").alias("page"), "shard_bytes")
    over = _pages(placed.where(F.col("shard_bytes") > limit), limit)
    alone = jumbo.select("row_id", F.lit(-1).alias("depth"), F.lit(0).cast("long").alias("prefix"),
                         F.col("row_id").alias("page"), F.col("n_bytes").alias("shard_bytes"))
    named = F.when(F.col("depth") > 0, F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), "0"))
    return fit.unionByName(over).unionByName(alone).withColumn("prefix", named.otherwise(F.lit("")))


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow shards of rows whose addresses agree in all bits.

    The rows of an address may be any number, so running sums go over (address,
    slice of row_id) and slices are added up; a page starts where the
    sum passes a multiple of the limit less the largest row.
    """
    held = stored(rows.select("row_id", "n_bytes", "depth", "prefix", "addr",
                              F.pmod(F.xxhash64("row_id"), F.lit(256)).alias("slice")), "shard-overflow")
    sums = held.groupBy("addr", "slice").agg(F.sum("n_bytes").alias("b"), F.max("n_bytes").alias("top"))
    earlier = Window.partitionBy("addr").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("addr")
    sums = sums.select("addr", "slice", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("offset"),
                       (F.lit(limit + 1) - F.max("top").over(whole)).alias("step"))
    inside = Window.partitionBy("addr", "slice").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    started = held.withColumn("inside", F.coalesce(F.sum("n_bytes").over(inside), F.lit(0))).join(sums, ["addr", "slice"])
    paged = started.withColumn("page", F.floor((F.col("offset") + F.col("inside")) / F.col("step")).cast("long") + 1)
    totals = paged.groupBy("addr", "page").agg(F.sum("n_bytes").alias("shard_bytes"))
    return paged.join(totals, ["addr", "page"]).select("row_id", "depth", "prefix", "page", "shard_bytes")


def shard_documents(docs: DataFrame, limit: int = SHARD_BYTES, row_key: str | None = None) -> DataFrame:
    """Shard of each row of ``docs(doc_id, text)`` by document id; the size is
    the text's UTF-8 bytes (null: 0).  Returns ``row_id, doc_id, n_bytes,
    depth, prefix, page, shard_bytes``; other columns are ignored.  Rows are
    numbered here unless ``row_key`` names a column of unique longs."""
    row_id = F.col(row_key) if row_key else F.monotonically_increasing_id()
    rows = stored(docs.select(row_id.alias("row_id"), "doc_id",
                              F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "shard-docs")
    shards = assign_shards(rows.select("row_id", F.col("doc_id").alias("key"), "n_bytes"), limit)
    return rows.join(shards, "row_id")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """Writes ``docs``, all columns kept, with one folder ``shard=<name>`` for
    each shard; each shard is one task's file.  Where ``docs`` has a column
    named shard, underscores are added to the folders' key."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    held = stored(docs.select(row, F.monotonically_increasing_id().alias("row_id")), "shard-input")
    shards = shard_documents(held.select("row_id", "row.doc_id", "row.text"), limit, "row_id")
    key = "shard"
    while key in docs.columns:
        key += "_"
    name = F.concat_ws("-", F.col("depth"), F.col("prefix"), F.col("page")).alias(key)
    out = held.join(shards.select("row_id", name), "row_id").select("row.*", key)
    out.repartition(key).write.partitionBy(key).parquet(path)
