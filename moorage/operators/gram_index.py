"""A stored source index: which sources have a gram, and their folded texts.

Texts are folded once, when they are added, and numbered. Sources that follow one
another make a segment; a posting is a gram with all sources of a segment that
have it, as steps from one number to the next, so its rows are those of a
segment's distinct grams, not of its letters. Postings are written by batches, in
these by buckets of their grams, and a batch of more than ``ROWS`` sources is
dealt out by a salt of the segment, so neither building nor a join has all of a
frequent gram in one task. Further sources are further batches: nothing that is
there is touched.

A look-up joins the quotes' grams with the postings of their buckets: how many
of a quote's rarer grams a source has bounds its score. Only sources that can
reach the wanted score are read, and scored on their folded texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalize import fold, gram_numbers, grams
from ..session import cut_lineage, forget
from .grounding import CELLS, CONTAINED, GRAM, score_quotes

#: Sources of a batch whose postings stay together.
ROWS = 200_000
BUCKETS = 32
#: Sources of a segment, as many as two bytes number, and letters of one, unless a single text has more.
SOURCES, LETTERS = 16_383, 2_000_000
#: Share of a quote's grams that are counted beyond those that it may miss.
SPARE = 0.15
#: Grams of quotes that are counted at once in a segment, unless a single quote has more.
COUNTED = 20_000
POSTINGS = "gram string, first long, n long, docs binary, batch int, bucket int"
KNOWN = "gram string, n long, salts long, bucket int, batch int"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _posted(first: int, texts: list[str]) -> pa.RecordBatch | None:
    """The postings of a segment: for each gram how many sources have it, and these by steps of their numbers from ``first``, one byte or two each."""
    long = [i for i, t in enumerate(texts) if len(t) >= GRAM]
    if not long:
        return None
    numbers, written = gram_numbers([np.frombuffer(texts[i].encode("utf-32-le"), dtype=np.uint32) for i in long])
    each = [np.unique(x) for x in numbers]
    held, at = np.concatenate(each), np.repeat(long, [len(x) for x in each])
    order = np.argsort(held, kind="stable")
    held, at = held[order], at[order]
    begins = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
    n = np.diff(np.append(begins, len(held)))
    steps = np.diff(at, prepend=0)
    steps[begins] = at[begins]
    high = steps >= 128
    ends = np.cumsum(1 + high)
    data = np.empty(int(ends[-1]), dtype=np.uint8)
    data[ends - 1] = steps & 127
    data[ends[high] - 2] = 128 | (steps[high] >> 7)
    offsets = np.append(0, ends[begins + n - 1]).astype(np.int32)
    docs = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), first)), pa.array(written(held[begins]), pa.string()), pa.array(n), docs], names=["first", "gram", "n", "docs"])


def _segments(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            begin = letters = 0
            for end in range(1, len(texts) + 1):
                letters += len(texts[end - 1])
                if end == len(texts) or end - begin == most or ids[end] != ids[end - 1] + 1 or letters + len(texts[end]) > LETTERS:
                    if (out := _posted(ids[begin], texts[begin:end])) is not None:
                        yield out
                    begin, letters = end, 0

    return post


def _numbers(data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sources' numbers of postings, n of each, from their bytes one behind another."""
    last = data < 128
    ends = np.flatnonzero(last)
    steps = data[ends].astype(np.int64)
    high = np.append(False, ~last[:-1])[ends]
    steps[high] += (data[ends[high] - 1].astype(np.int64) - 128) << 7
    total, begins = np.cumsum(steps), np.cumsum(n) - n
    return total - np.repeat(total[begins] - steps[begins], n)


def _reaching(rows: pa.Table) -> pa.Table:
    """The sources of a segment that have enough of some quote's counted grams."""
    n, needs, times = (rows[c].to_numpy() for c in ("n", "needed", "times"))
    at = _numbers(np.frombuffer(b"".join(rows["docs"].to_pylist()), dtype=np.uint8), n)
    quotes, own = np.unique(rows["q"].to_numpy(), return_inverse=True)
    needed = np.empty(len(quotes))
    needed[own] = needs
    width = int(at.max()) + 1
    reach, own, times = np.zeros(width, dtype=bool), np.repeat(own, n), np.repeat(times, n)
    for first in range(0, len(quotes), group := max(1, CELLS // width)):
        k = min(group, len(quotes) - first)
        mine = slice(None) if k == len(quotes) else (own >= first) & (own < first + k)
        most = np.bincount((own[mine] - first) * width + at[mine], times[mine], minlength=k * width).reshape(k, width)
        reach |= (most >= needed[first : first + k, None] - 1e-9).any(axis=0)
    ids = rows["first"][0].as_py() + np.flatnonzero(reach)
    return pa.table({"batch": pa.array(np.full(len(ids), rows["batch"][0].as_py(), dtype=np.int32)), "id": pa.array(ids)})


def add_sources(docs: DataFrame, key: str, path: str, text: str = "text", normal: bool = False, rows: int = ROWS, buckets: int = BUCKETS) -> int:
    """Adds sources (one row a key, none of which is there yet) to the index at ``path``; the number of its batch.

    A null text counts as empty and has no grams. A key that is there already,
    or twice in ``docs``, raises a ValueError before anything is written.
    """
    spark, batch = docs.sparkSession, 0
    folded = cut_lineage(docs.select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), fold(F.col(text), normal).alias("folded")))
    twice = folded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    if _exists(spark, f"{path}/sources"):
        there = spark.read.parquet(f"{path}/sources")
        batch = (there.agg(F.max("batch")).first()[0] or 0) + 1
        twice = twice.unionByName(folded.join(there.select("key"), "key", "left_semi").select("key"))
    if (row := twice.first()) is not None:
        forget(folded)
        raise ValueError(f"source {row.key} is in the index already or given twice")
    # A segment's grams are gathered where its texts are, so only whole postings are shuffled.
    salts = max(1, math.ceil(folded.count() / rows))
    posted = folded.select("id", "folded").mapInArrow(_segments(min(rows, SOURCES)), "first long, gram string, n long, docs binary")
    bucket = F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int").alias("bucket")
    dealt = posted.select("gram", "first", "n", "docs", F.lit(batch).alias("batch"), bucket).repartition("bucket", F.pmod(F.xxhash64("first"), F.lit(salts)))
    dealt.sortWithinPartitions("batch", "bucket", "gram", "first").write.mode("append").partitionBy("batch", "bucket").parquet(f"{path}/postings")
    known = spark.read.schema(POSTINGS).parquet(f"{path}/postings").where(F.col("batch") == batch).groupBy("gram").agg(F.sum("n").alias("n"))
    known.select("gram", "n", F.lit(salts).cast("long").alias("salts"), bucket, F.lit(batch).alias("batch")).write.mode("append").partitionBy("batch").parquet(f"{path}/grams")
    # Last: a batch counts once its sources are there.
    folded.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(f"{path}/sources")
    forget(folded)
    return batch


def score_indexed(spark: SparkSession, path: str, quotes: DataFrame, key: str, least: float) -> DataFrame:
    """key, quote, score, where of all pairs that reach ``least`` (over 0), as ``grounding.score_quotes`` has them; ``quotes``: quote_table."""
    sources = spark.read.parquet(f"{path}/sources")
    asked = cut_lineage(quotes.where(F.col("length") >= GRAM).select("folded_quote", "n_grams").distinct().withColumn("q", F.monotonically_increasing_id()))
    many = asked.select("q", "n_grams", F.explode(grams(F.col("folded_quote"))).alias("gram")).groupBy("q", "n_grams", "gram").agg(F.count("*").alias("times"))
    # In each batch that is complete, the grams that are asked for.
    batches = sources.select("batch").distinct()
    known = spark.read.schema(KNOWN).parquet(f"{path}/grams").join(batches, "batch", "left_semi").join(many.select("gram").distinct(), "gram")
    known = cut_lineage(known.select("batch", "bucket", "gram", "n"))
    # Of a quote's rarest grams, a little more than it may miss, a source that reaches the score has some; frequent ones are not counted.
    sized = many.join(known.groupBy("gram").agg(F.sum("n").alias("n")), "gram", "left")
    upto = F.sum("times").over(Window.partitionBy("q").orderBy(F.coalesce("n", F.lit(0)), "gram").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rare = sized.withColumn("_before", upto - F.col("times")).where(F.col("_before") < (1 - least + SPARE) * F.col("n_grams"))
    held = F.sum("times").over(Window.partitionBy("q"))
    needed = F.when(F.col("n_grams") <= CONTAINED, F.col("n_grams")).otherwise(least * F.col("n_grams")) - (F.col("n_grams") - held)
    counted = cut_lineage(rare.select("q", "gram", "times", needed.cast("double").alias("needed")))
    places = known.select("batch", "bucket", "gram").join(counted, "gram")
    parts = max(1, math.ceil(counted.count() / COUNTED))
    met = spark.read.schema(POSTINGS).parquet(f"{path}/postings").join(places, ["batch", "bucket", "gram"])
    met = met.select("batch", "first", "q", "times", "needed", "n", "docs", F.pmod(F.xxhash64("q"), F.lit(parts)).alias("part"))
    reaching = cut_lineage(met.groupBy("batch", "first", "part").applyInArrow(_reaching, "batch int, id long").distinct())
    left = sources.join(reaching, ["batch", "id"], "left_semi").select("key", "folded")
    return score_quotes(left, quotes, "key", least=least).withColumnRenamed("key", key)
