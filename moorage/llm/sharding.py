"""Op 1, sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get gapless global numbers in an order that depends on their content
alone. A keyed permutation of 0..n-1 then gives each row its place in a
reproducible shuffle; shard and slot are the remainder and the quotient of that
place by the number of shards, so counts differ by at most one (law ``rows``),
slots are gapless, and shard and slot of any row number are computable without
touching other rows.

Only DataFrame expressions. The text never leaves the scan: what is shuffled is
one row of four numbers per distinct (id, size, checksum), summed before the
shuffle, so repeated rows however many stay small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

ROUNDS = 6
#: Rows per numbering bucket that one task orders.
BUCKET_ROWS = 100_000
#: Copies of a row that are written out at once; a larger heap is dealt to all tasks in blocks of so many.
HEAP = 10_000
#: Steps of the walk. At most a + 1 of a * b places lie outside 0..n-1, so longer walks have odds below 1e-100; they raise an error.
WALK = 64


def sides(n: int) -> tuple[int, int]:
    """The smallest near-square a * b >= n on which the network works."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _quotient(x: Column, by: int) -> Column:
    return ((x - F.pmod(x, F.lit(by))) / F.lit(by)).cast("long")


def permuted(place: Column, n: int, seed: int) -> Column:
    """The place of row number ``place`` in the shuffle: one pass of the network, then again while it lies at n or above."""
    a, b = sides(n)

    def once(x: Column) -> Column:
        # A fold, because rounds written as nested expressions would repeat each half 2^rounds times.
        pair = F.struct(_quotient(x, b).alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
        steps = F.sequence(F.lit(0), F.lit(ROUNDS - 1))

        def step(acc: Column, i: Column) -> Column:
            code = F.lit(seed * 64) + i
            left = F.pmod(acc["l"] + F.pmod(F.xxhash64(acc["r"], code), F.lit(a)), F.lit(a)).cast("long")
            right = F.pmod(acc["r"] + F.pmod(F.xxhash64(acc["l"], code), F.lit(b)), F.lit(b)).cast("long")
            even = F.pmod(i, F.lit(2)) == 0
            return F.struct(F.when(even, left).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(right).alias("r"))

        return F.aggregate(steps, pair, step, lambda acc: acc["l"] * F.lit(b) + acc["r"])

    first = once(place)
    excess = a * b - n
    if excess == 0:
        return first
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(min(excess, WALK))), first, lambda acc, _: F.when(acc < n, acc).otherwise(once(acc)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("sharding: the walk did not end")).cast("long")) if excess > WALK else walked


def written_out(ranged: DataFrame) -> DataFrame:
    """A row for each copy, with its number in the range."""
    return ranged.select("doc_id", "size", "text_crc32", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))


def shard_rows(rows: DataFrame, shards: int, seed: int = 7, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each row's shard and slot.

    ``rows`` has doc_id and text; other columns are ignored here, so they may
    have any name. Null text counts as empty (size 16, checksum 0); a null
    doc_id is an id like any other; repeated rows each get a place of their own,
    and no task holds more than HEAP of one row's copies at once; texts of any
    length count whole; an empty table gives an empty result. Equal rows are interchangeable, so the
    result as a whole is the same in every run and for every partitioning.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number.
    """
    body = F.coalesce("text", F.lit(""))
    slim = rows.select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    counted = cut_lineage(slim.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")))
    n = counted.agg(F.sum("copies")).first()[0] or 0
    buckets = max(1, -(-n // bucket_rows))
    dealt = counted.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int"))
    # One row a bucket: n / bucket_rows of them.
    starts = dealt.groupBy("bucket").agg(F.sum("copies").alias("held")).withColumn("start", F.sum("held").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    order = Window.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.withColumn("before", F.coalesce(F.sum("copies").over(order), F.lit(0))).join(starts.select("bucket", F.coalesce("start", F.lit(0)).alias("start")), "bucket")
    # Copies come as a range per row, so that repeated rows are written out, not gathered.
    ranged = numbered.select("doc_id", "size", "text_crc32", (F.col("start") + F.col("before")).alias("first"), "copies")
    each = written_out(ranged.where(F.col("copies") <= HEAP))
    if not counted.where(F.col("copies") > HEAP).isEmpty():
        blocks = ranged.where(F.col("copies") > HEAP).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), _quotient(F.col("copies") - 1, HEAP))))
        own = blocks.select("doc_id", "size", "text_crc32", (F.col("first") + F.col("block") * HEAP).alias("first"), F.least(F.col("copies") - F.col("block") * HEAP, F.lit(HEAP)).alias("copies"))
        each = each.unionByName(written_out(own.repartition(min(10_000, -(-n // HEAP)))))
    placed = each.withColumn("row_number", (F.col("first") + F.col("copy")).cast("long")).withColumn("place", permuted(F.col("row_number"), n, seed))
    return placed.select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        _quotient(F.col("place"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
