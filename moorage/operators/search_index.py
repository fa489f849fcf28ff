"""A stored inverted index for BM25, ordered by impact.

Texts are read once, when the index is built. A posting's impact is its share of
a score but for the term's weight. A term's postings lie in blocks of falling
impact, each with its largest impact; long lists are dealt into parts by the
documents' batches first, so about ``PART`` postings are ordered at once, and
blocks are written by buckets of their terms. Postings are gathered by term in
each batch of documents before they are shuffled, once.

A search needs few of them. The first blocks give each query a threshold that
its ``top`` best documents reach at least. A block whose impact, with the most
that all other terms can add, stays below it holds no document that is wanted
(block maxima); terms that cannot reach it together bring no document of their
own (MaxScore). What is left is joined and summed; the rows are those of a
search through all postings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, forget
from . import retrieval
from .retrieval import K1, B

#: Postings of a block and, about, of a part.
BLOCK, PART = 128, 65_536
BUCKETS = 32
#: Tasks that a bucket is dealt to while it is written.
SLICES = 4
#: Scores are compared to nine places; bounds are loosened by more than sums may be off.
SLACK = 1e-7


def build_index(docs: DataFrame, key: str, tokens: Column, path: str, k1: float = K1, b: float = B, block: int = BLOCK, part: int = PART, buckets: int = BUCKETS) -> None:
    """Writes the index of ``docs`` (one row a key) to ``path``: terms, blocks and totals. Documents without terms count as of length 1."""
    kind = docs.schema[key].dataType
    rows = T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), *(T.StructField(x, T.ArrayType(y)) for x, y in (("keys", kind), ("tfs", T.IntegerType()), ("dls", T.LongType())))])
    held = cut_lineage(docs.select(key, tokens.alias("_tokens")).mapInArrow(_postings, rows))
    n, total = held.where("term IS NULL").agg(F.sum("n"), F.sum(F.element_at("dls", 1))).first()
    frequency = cut_lineage(held.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df")))
    # At most one term for each ``part`` postings.
    parts = F.broadcast(frequency.where(F.col("df") > part).select("term", F.ceil(F.col("df") / part).alias("parts")))
    nth = F.coalesce(F.pmod(F.xxhash64(F.element_at("keys", 1)), "parts"), F.lit(0)).cast("long").alias("part")
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
    dealt = held.where("term IS NOT NULL").join(parts, "term", "left").select("term", nth, bucket, "keys", "tfs", "dls")
    ordered = dealt.repartition("bucket", F.pmod(F.xxhash64("term", "part"), F.lit(SLICES))).sortWithinPartitions("bucket", "term", "part")
    item = T.StructType([T.StructField("impact", T.DoubleType()), T.StructField("key", kind)])
    made = T.StructType([T.StructField("term", T.StringType()), *(T.StructField(x, T.LongType()) for x in ("part", "block")), T.StructField("bucket", T.IntegerType()), T.StructField("block_top", T.DoubleType()), T.StructField("items", T.ArrayType(item))])
    ordered.mapInArrow(_blocks(k1, b, total / n if total else 1.0, block), made).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    tops = docs.sparkSession.read.schema(made).parquet(f"{path}/blocks").groupBy("term").agg(F.max("block_top").alias("top"))
    weight = F.log(1 + (F.lit(n or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    frequency.join(tops, "term").select("term", "df", "top", weight.alias("weight"), F.ceil(F.col("df") / part).alias("parts"), bucket).write.mode("overwrite").parquet(f"{path}/terms")
    forget(held, frequency)


def _lists(begins: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), values)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, n, keys, tfs, dls: each term of a batch with its documents, how often they have it and their lengths; without a term the number and total length of all."""
    for batch in batches:
        keys, tokens, size = batch.column(0), batch.column(1), batch.num_rows
        if not size:
            continue
        many = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        dl = np.maximum(many, 1)
        words = tokens.flatten().cast(pa.string()).dictionary_encode()
        known = words.dictionary
        code = pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if (blank := pc.index(known, "").as_py()) >= 0:
            code = np.where(code == blank, -1, code)
        pair, tf = np.unique((code * size + np.repeat(np.arange(size), many))[code >= 0], return_counts=True)
        term, row = np.divmod(pair, size)
        names, begins = np.unique(term, return_index=True)
        begins = np.append(begins, len(term))
        terms = pa.concat_arrays([known.take(pa.array(names)), pa.array([None], pa.string())])
        held = np.append(begins, len(term))
        lengths = np.append(begins, len(term) + 1)
        columns = [terms, pa.array(np.append(np.diff(begins), size)), _lists(held, keys.take(pa.array(row))), _lists(held, pa.array(tf.astype(np.int32))), _lists(lengths, pa.array(np.append(dl[row], dl.sum())))]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "n", "keys", "tfs", "dls"])


def _blocks(k1: float, b: float, avg: float, block: int):
    """Blocks of lists that come by term and part; those of the last one wait for the next batch."""

    def cut(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        term, part, bucket, keys, tfs, dls = (rows.column(x).combine_chunks() for x in ("term", "part", "bucket", "keys", "tfs", "dls"))
        group = np.cumsum(_begun(term, part)) - 1
        n = pc.list_value_length(keys).to_numpy(zero_copy_only=False)
        tf, dl = tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64), dls.flatten().to_numpy(zero_copy_only=False)
        impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg))
        each, key = np.repeat(group, n), keys.flatten()
        order = pc.sort_indices(pa.table({"g": each, "impact": impact, "key": key}), sort_keys=[("g", "ascending"), ("impact", "descending"), ("key", "ascending")])
        sizes = np.bincount(each, minlength=group[-1] + 1)
        nth = (np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // block
        begins = np.flatnonzero(np.diff(each, prepend=-1) | np.diff(nth, prepend=-1))
        impact = impact[order.to_numpy()]
        items = pa.StructArray.from_arrays([pa.array(impact), key.take(order)], names=["impact", "key"])
        first = pa.array(np.flatnonzero(np.diff(group, prepend=-1))[each[begins]])
        columns = [term.take(first), part.take(first), pa.array(nth[begins]), bucket.take(first), pa.array(impact[begins]), _lists(np.append(begins, len(each)), items)]
        return pa.RecordBatch.from_arrays(columns, names=["term", "part", "block", "bucket", "block_top", "items"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if waiting:
                a, b = waiting[-1].slice(waiting[-1].num_rows - 1), batch.slice(0, 1)
                if any(a.column(x)[0] != b.column(x)[0] for x in ("term", "part")):
                    yield cut(pa.Table.from_batches(waiting))
                    waiting = []
            last = int(np.flatnonzero(_begun(batch.column("term"), batch.column("part")))[-1])
            if last:
                yield cut(pa.Table.from_batches([*waiting, batch.slice(0, last)]))
                waiting = []
            waiting.append(batch.slice(last))
        if waiting:
            yield cut(pa.Table.from_batches(waiting))

    return blocks


def _begun(term: pa.Array, part: pa.Array) -> np.ndarray:
    """Whether a row is the first of its term and part, for rows that come by them."""
    same = pc.and_(pc.equal(term[1:], term[:-1]), pc.equal(part[1:], part[:-1])).to_numpy(zero_copy_only=False)
    return np.append(True, ~same)


def bounds_of(spark: SparkSession, path: str, queries: DataFrame, top: int) -> DataFrame:
    """query, term, bucket, weight, least, others, essential: what a query's best documents score at least, and what its other terms can add; cut from the lineage."""
    terms = spark.read.parquet(f"{path}/terms")
    asked = cut_lineage(queries.select("query", "term").distinct().join(terms.drop("df", "parts"), "term").withColumn("most", F.col("weight") * F.col("top")))
    blocks = spark.read.parquet(f"{path}/blocks")
    met = blocks.join(asked.select("query", "term", "weight", "most", "bucket"), ["bucket", "term"])
    # Lower bounds of scores, from the first block of every list.
    heads = met.where("block = 0").select("query", "weight", F.explode("items").alias("x"))
    partial = heads.groupBy("query", F.col("x.key").alias("key")).agg(F.sum(F.col("weight") * F.col("x.impact")).alias("s"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s")))
    least = partial.withColumn("nth", nth).where(F.col("nth") == top).select("query", F.col("s").alias("least"))
    below = Window.partitionBy("query").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = asked.join(least, "query", "left").withColumns({"least": F.coalesce("least", F.lit(0.0)) - SLACK, "upto": F.sum("most").over(below), "all": F.sum("most").over(Window.partitionBy("query"))})
    told = cut_lineage(bounds.select("query", "term", "bucket", "weight", "least", (F.col("all") - F.col("most")).alias("others"), (F.col("upto") >= F.col("least")).alias("essential")))
    forget(asked)
    return told


def needed_blocks(spark: SparkSession, path: str, queries: DataFrame, top: int) -> DataFrame:
    """query, term, weight, essential, block_top, items of the blocks that can hold one of a query's best documents; cut from the lineage."""
    told = bounds_of(spark, path, queries, top)
    return _needed(spark.read.parquet(f"{path}/blocks"), told)


def _needed(blocks: DataFrame, told: DataFrame) -> DataFrame:
    found = blocks.join(told, ["bucket", "term"]).where(F.col("weight") * F.col("block_top") + F.col("others") >= F.col("least"))
    out = cut_lineage(found.select("query", "term", "weight", "essential", "block_top", "items"))
    forget(told)
    return out


def search_index(spark: SparkSession, path: str, queries: DataFrame, key: str, top: int = 5) -> DataFrame:
    """query, key, score, rank: for each query (query, term) its best documents, as ``retrieval.bm25_search`` has them; ties go by key.

    Up to ``retrieval.SENT_PAIRS`` pairs of query and term go to the workers: each
    block that some query needs is read once, a document's postings are gathered
    and scored for all queries, and only the best of each batch are shuffled. What
    a block brings to a query that can do without it is part of a true score, and
    still below the bound. Beyond, each query's postings are joined.
    """
    told, blocks = bounds_of(spark, path, queries, top), spark.read.parquet(f"{path}/blocks")
    pairs = told.select("query", "term", "weight").limit(retrieval.SENT_PAIRS + 1).collect()
    if len(pairs) <= retrieval.SENT_PAIRS:
        weights = {r.term: r.weight for r in pairs}
        floors = told.groupBy("bucket", "term").agg(F.min((F.col("least") - F.col("others")) / F.col("weight")).alias("floor"))
        terms = sorted(weights)
        numbers = F.broadcast(spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, no int"))
        each = blocks.join(F.broadcast(floors), ["bucket", "term"]).where("block_top >= floor").join(numbers, "term").select("no", F.explode("items").alias("x"))
        rows = each.groupBy(F.col("x.key").alias(key)).agg(F.collect_list(F.struct("no", "x.impact")).alias("x")).select(key, F.size("x").cast("long").alias("n"), F.col("x.no").alias("terms"), F.col("x.impact").alias("impacts"))
        found = retrieval.best_rows(rows, key, queries, pairs, terms, np.array([weights[t] for t in terms]), top, lambda w, x, row, n: w * x)
        return retrieval._ranked(found, key, top).select("query", key, "score", "rank")
    needed = _needed(blocks, told)
    each = needed.select("query", "essential", "weight", F.explode("items").alias("x")).select("query", "essential", F.col("x.key").alias("key"), (F.col("weight") * F.col("x.impact")).alias("share"))
    candidates = each.where("essential").select("query", "key").distinct()
    shares = each.where("essential").unionByName(each.where("NOT essential").join(candidates, ["query", "key"], "left_semi"))
    scored = shares.groupBy("query", "key").agg(F.sum("share").alias("score")).where("score > 0")
    best = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "key")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("query", F.col("key").alias(key), "score", "rank")
