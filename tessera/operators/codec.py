"""Variable-byte and d-gap coding of integer lists, as column expressions.

A number is cut into groups of seven bits, highest first; the last byte of a
number has its high bit set.  Posting lists are coded in blocks of documents,
so the list of a term that every document holds never gathers in one task;
the blocks' streams in order are the stream of the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents of a block of a posting list.
BLOCK_DOCS = 1 << 16


def byte_width(value: Column) -> Column:
    """Bytes that a number takes; an error for a negative one."""
    ladder = F.when(value < 0, F.raise_error(F.lit("a negative number has no variable-byte code")).cast("int"))
    for width in range(1, 9):
        ladder = ladder.when(value < (1 << (7 * width)), width)
    return ladder.otherwise(9)


def encode_number(value: Column) -> Column:
    """Array of the bytes (0 to 255) of one number."""
    value = value.cast("bigint")

    def byte(j: Column) -> Column:
        group = F.pmod(F.call_function("shiftright", value, (j * 7).cast("int")), F.lit(128)).cast("int")
        return F.when(j == 0, group + 128).otherwise(group)

    return F.transform(F.sequence(byte_width(value) - 1, F.lit(0), F.lit(-1)), byte)


def encode(values: Column) -> Column:
    """Bytes of an array of numbers, one after the other."""
    return F.flatten(F.transform(values, encode_number))


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def decode(data: Column) -> Column:
    """Numbers of an array of bytes; an incomplete one at the end is dropped."""

    def numbers(held: Column, ends: Column) -> Column:
        def number(end: Column, i: Column) -> Column:
            begin = F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0))
            return F.aggregate(F.slice(held, begin + 1, end - begin), F.lit(0).cast("bigint"), lambda total, b: total * 128 + F.pmod(b, F.lit(128)))

        return F.transform(ends, number)

    def places(held: Column) -> Column:
        flagged = F.transform(held, lambda b, i: F.when(b >= 128, i + 1))
        return F.filter(flagged, lambda i: i.isNotNull())

    return _with(data, lambda held: _with(places(held), lambda ends: numbers(held, ends)))


def gaps(postings: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``(term, ord, tf, gap, block)``: the distance to the term's document before, the first one's ``ord`` itself."""
    block = F.floor(F.col("ord") / block_docs)
    rows = postings.select("term", "ord", "tf", block.alias("block"))
    last = rows.groupBy("term", "block").agg(F.max("ord").alias("last"))
    last = last.select("term", "block", F.coalesce(F.lag("last").over(Window.partitionBy("term").orderBy("block")), F.lit(0)).alias("base"))
    within = F.lag("ord").over(Window.partitionBy("term", "block").orderBy("ord"))
    joined = rows.withColumn("before", within).join(last, ["term", "block"])
    return joined.select("term", "ord", "tf", (F.col("ord") - F.coalesce("before", "base")).alias("gap"), "block")


def _lists(postings: DataFrame, block_docs: int) -> DataFrame:
    rows = gaps(postings, block_docs).groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("ord", "gap", "tf"))).alias("rows"))
    return rows.select("term", "block", F.col("rows.gap").alias("gaps"), F.col("rows.tf").alias("tfs"))


def encode_interleaved(postings: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``(term, block, data)``: gap and frequency of every posting in turn."""
    pairs = F.flatten(F.zip_with("gaps", "tfs", lambda g, t: F.array(g.cast("bigint"), t.cast("bigint"))))
    return _lists(postings, block_docs).select("term", "block", encode(pairs).alias("data"))


def encode_streams(postings: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``(term, block, gap_stream, tf_stream)``.

    The gap stream has gap x 2, plus 1 where the frequency is above 1; the other
    stream has those frequencies less 2.
    """
    flagged = F.zip_with("gaps", "tfs", lambda g, t: g * 2 + F.when(t > 1, 1).otherwise(0))
    more = F.transform(F.filter("tfs", lambda t: t > 1), lambda t: t - 2)
    return _lists(postings, block_docs).select("term", "block", encode(flagged).alias("gap_stream"), encode(more).alias("tf_stream"))


def _with_bases(blocks: DataFrame) -> DataFrame:
    """Adds ``base``, the document before each block, from the gaps of the earlier blocks."""
    total = F.aggregate("gaps", F.lit(0).cast("bigint"), lambda a, g: a + g)
    earlier = Window.partitionBy("term").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("base", F.coalesce(F.sum(total).over(earlier), F.lit(0)))


def _postings(blocks: DataFrame) -> DataFrame:
    """``(term, ord, tf)`` from ``(term, block, gaps, tfs)``."""
    rows = _with_bases(blocks).select("term", "block", "base", F.posexplode(F.arrays_zip("gaps", "tfs")).alias("at", "p"))
    upto = Window.partitionBy("term", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("term", (F.col("base") + F.sum("p.gaps").over(upto)).alias("ord"), F.col("p.tfs").alias("tf"))


def _decoded(blocks: DataFrame, **streams: str) -> DataFrame:
    """``term``, ``block`` and the numbers of each stream, decoded once.

    A plain select would be merged into what follows and decode again at every mention.
    """
    numbers = F.struct(*(decode(F.col(data)).alias(name) for name, data in streams.items()))
    return blocks.select("term", "block", F.explode(F.array(numbers)).alias("all")).select("term", "block", "all.*")


def decode_interleaved(blocks: DataFrame) -> DataFrame:
    """``(term, ord, tf)`` of ``encode_interleaved``."""
    numbers = _decoded(blocks, n="data")
    pick = lambda odd: F.filter("n", lambda _, i: i % 2 == odd)
    return _postings(numbers.select("term", "block", pick(0).alias("gaps"), pick(1).alias("tfs")))


def decode_streams(blocks: DataFrame) -> DataFrame:
    """``(term, ord, tf)`` of ``encode_streams``; an error if the streams don't fit each other.

    The number of flags up to a posting is the place of its frequency in the
    other stream, so the streams are joined by that place.
    """
    numbers = _decoded(blocks, flagged="gap_stream", more="tf_stream")
    keys = ["term", "block"]
    rows = numbers.select(*keys, F.posexplode("flagged").alias("at", "x"))
    upto = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("place", F.sum(F.col("x") % 2).over(upto)).withColumn("place", F.when(F.col("x") % 2 == 1, F.col("place")))
    others = numbers.select(*keys, F.posexplode("more").alias("place", "more")).withColumn("place", F.col("place").cast("bigint") + 1)
    joined = rows.join(others, [*keys, "place"], "full")
    fits = F.col("x").isNotNull() & (F.col("place").isNull() | F.col("more").isNotNull())
    tf = F.when(~fits, F.raise_error(F.lit("the frequency stream has another length than the flags say")).cast("bigint")).otherwise(F.coalesce(F.col("more") + 2, F.lit(1)))
    joined = joined.select(*keys, "at", F.floor(F.col("x") / 2).alias("gap"), tf.alias("tf"))
    sums = joined.groupBy(*keys).agg(F.sum("gap").alias("gaps"))
    earlier = Window.partitionBy("term").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*keys, F.coalesce(F.sum("gaps").over(earlier), F.lit(0)).alias("base"))
    return joined.join(bases, keys).select("term", (F.col("base") + F.sum("gap").over(upto)).alias("ord"), "tf")
