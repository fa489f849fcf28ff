"""Queries that search stored indexes of the driver's documents, with SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import gram_index, grounding, lexicon, retrieval, search_index
from ..session import cut_lineage, shared_folder, table
from . import document_queries as D

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def index_path(spark: SparkSession, kind: str) -> str:
    """A new folder beside the other intermediate tables; a user gives a lasting one."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


@query(D.SQL["bm25_topk"])
def bm25_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L13, L14, J03, T01 from a stored index: the five best documents for each benchmark text."""
    path = index_path(spark, "bm25")
    search_index.build_index(D._documents(spark, sf_dir), "doc_id", N.tokenize(F.col("text")), path)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(N.tokenize(F.col("text"))).alias("term")).distinct()
    best = search_index.search_index(spark, path, asked, "doc_id")
    return best.select("query", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(D.SQL["quote_best"])
def quote_index_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G01-G03, J01 from a stored index that was built in two batches: quote_best's rows."""
    path, docs = index_path(spark, "grams"), D._documents(spark, sf_dir)
    first = F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0
    gram_index.add_sources(docs.where(first), "doc_id", path)
    gram_index.add_sources(docs.where(~first), "doc_id", path)
    asked = table(spark, sf_dir, "benchmark").select("item_id", "text").unionByName(spark.createDataFrame(D.SHORT_QUOTES, "item_id long, text string"))
    scores = gram_index.score_indexed(spark, path, grounding.quote_table(asked, "item_id", "text"), "doc_id", grounding.WEAK)
    return grounding.verify_quotes(scores).select("doc_id", "quote", "score", "verdict")


#: Words of the look-up's lexicon: the most frequent tokens.
FREQUENT = 2_000


@query(f"""WITH {D._TOKENS}, n AS (SELECT term, count(*) AS n FROM kept GROUP BY term),
lex AS (SELECT term AS surface, length(term) AS len FROM n ORDER BY n DESC, term LIMIT {FREQUENT}),
rest AS (SELECT term, length(term) AS len FROM n WHERE term NOT IN (SELECT surface FROM lex)),
near AS (SELECT term, surface, lex.len AS slen, 1 - levenshtein(term, surface) / CAST(greatest(rest.len, lex.len) AS DOUBLE) AS s FROM rest JOIN lex ON lex.len BETWEEN rest.len - 1 AND rest.len + 1),
best AS (SELECT term, first(surface ORDER BY s DESC, slen, surface) AS surface, max(s) AS s FROM near WHERE s >= 0.86 GROUP BY term)
SELECT term AS token, coalesce(surface, term) AS canon, round(coalesce(s, 0.0), 6) AS score FROM rest LEFT JOIN best USING (term)""")
def token_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L10, J05 over the documents' tokens: those that aren't among the most frequent, with the frequent one that they are a slip of, if any. Letters of Latin words cost 1 each."""
    counts = retrieval.term_counts(D._documents(spark, sf_dir), "doc_id", N.tokenize(F.col("text"))).groupBy("term").agg(F.sum("tf").alias("n"))
    held = cut_lineage(counts)
    frequent = cut_lineage(held.orderBy(F.desc("n"), "term").limit(FREQUENT).select(F.col("term").alias("surface"), F.col("term").alias("canon")))
    asked = held.select(F.col("term").alias("token")).join(frequent.select(F.col("surface").alias("token")), "token", "left_anti")
    return lexicon.fuzzy_canon(asked, frequent).select("token", "canon", F.round("score", 6).alias("score"))
