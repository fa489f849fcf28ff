"""Queries of the SQL functions, of deep leaves, of all numbers and of progress, over the driver's tables, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import grounding, schema
from ..session import table
from . import document_queries as D
from . import sql_functions
from .progress import Progress

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"""WITH {D._TOKENS}, n AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id)
SELECT doc_id, length(f) AS folded_chars, md5(f) AS folded_md5, coalesce(n, 0) AS n_tokens FROM (SELECT doc_id, {D.FOLD_SQL} AS f FROM documents) LEFT JOIN n USING (doc_id)""")
def sql_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.14: folded text and tokens by name, in a query of spark.sql."""
    sql_functions.register(spark)
    # Cleaned in a step of its own: within the arguments of both it would be done for each.
    told = "SELECT doc_id, fold_cleaned(c) AS f, size(tokenize_cleaned(c)) AS n FROM (SELECT doc_id, clean_text(text) AS c FROM {docs})"
    return spark.sql(f"SELECT doc_id, CAST(length(f) AS BIGINT) AS folded_chars, md5(f) AS folded_md5, CAST(n AS BIGINT) AS n_tokens FROM ({told})", docs=D._documents(spark, sf_dir))


#: Two pieces of a text as one quote, which stand further or less far from each other.
_TWO = "concat(substr(text, 31, 80), ' ', substr(text, CAST(120 + doc_id % 700 AS INT), 80))"


@query(f"""WITH d AS (SELECT doc_id, {D.FOLD_SQL} AS f FROM documents), said AS (SELECT doc_id, {D.FOLD_SQL} AS f FROM (SELECT doc_id, {_TWO} AS text FROM documents)),
q AS (SELECT doc_id, f, length(f) AS len, length(f) - 3 AS n, (length(f) * 18) // 10 + 40 AS w FROM said),
qg AS (SELECT doc_id, n, w, unnest(range(0, n)) AS i, unnest(list_transform(range(1, n + 1), lambda i: substr(f, i, 4))) AS gram FROM q WHERE n > 2),
dg AS (SELECT doc_id, unnest(range(0, length(f) - 3)) AS pos, unnest(list_transform(range(1, length(f) - 2), lambda i: substr(f, i, 4))) AS gram FROM d WHERE length(f) >= 4),
hits AS (SELECT doc_id, pos, i, n, w FROM dg JOIN qg USING (doc_id, gram)),
win AS (SELECT doc_id, n, count(DISTINCT i) OVER (PARTITION BY doc_id ORDER BY pos RANGE BETWEEN w PRECEDING AND CURRENT ROW) AS c FROM hits),
best AS (SELECT doc_id, max(c) / CAST(n AS DOUBLE) AS s FROM win GROUP BY doc_id, n UNION ALL SELECT doc_id, 1.0 FROM q JOIN d USING (doc_id) WHERE n BETWEEN 1 AND 2 AND contains(d.f, q.f))
SELECT doc_id, round(s, 3) AS score, CASE WHEN s >= 0.85 THEN 'grounded' ELSE 'weak' END AS verdict FROM best WHERE s >= 0.55 UNION ALL SELECT doc_id, 0.0, 'weak' FROM q WHERE n < 1""")
def sql_verify_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.14: each document with two of its own pieces as a quote; ungrounded ones are left out."""
    sql_functions.register(spark)
    # A list of none or one, not a filter, which would be pushed down and verify again.
    told = f"SELECT doc_id, verify_quote(text, {_TWO}) AS v FROM {{docs}}"
    return spark.sql(f"SELECT doc_id, inline(filter(array(v), x -> x.verdict <> 'ungrounded')) FROM ({told})", docs=D._documents(spark, sf_dir))


@query("""WITH k AS (SELECT event_type, unnest(json_keys(props)) AS k, props FROM events)
SELECT event_type, k AS path, count(*) AS n, count(DISTINCT json_extract_string(props, '$.' || k)) AS n_values FROM k WHERE json_extract_string(props, '$.' || k) IS NOT NULL GROUP BY ALL""")
def sql_event_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.14, P05: the leaves of JSON texts by a table function."""
    sql_functions.register(spark)
    return spark.sql("SELECT event_type, l.path, count(*) AS n, count(DISTINCT l.value) AS n_values FROM {events}, LATERAL json_leaves(props) l GROUP BY ALL", events=table(spark, sf_dir, "events"))


@query("""WITH k AS (SELECT event_id, event_type, unnest(json_keys(props)) AS k, props FROM events),
l AS (SELECT 'meta.kind' AS path, event_type AS value FROM events
 UNION ALL SELECT 'meta.trail[0].step.raw.' || k, json_extract_string(props, '$.' || k) FROM k
 UNION ALL SELECT 'meta.trail[1][0][2].id', CAST(event_id AS VARCHAR) FROM events)
SELECT path, count(*) AS n, count(DISTINCT value) AS n_values, min(value) AS first_value FROM l WHERE value IS NOT NULL GROUP BY path""")
def deep_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaves of records of six steps made of the events."""
    parts = ['{"meta": {"kind": "', F.col("event_type"), '", "empty": [], "none": null, "trail": [{"step": {"raw": ', F.col("props"), '}}, [[null, {}, {"id": ', F.col("event_id").cast("string"), "}]]]}}"]
    record = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    found = schema.leaves(table(spark, sf_dir, "events").select("event_id", record.alias("values")), "event_id")
    return found.groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"), F.min("value").alias("first_value"))


@query(D.SQL["number_classify"].replace("WHERE nth <= 200", ""))
def number_classify_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same claims against all numbers of every document, without a bound."""
    numbers = D.doc_numbers(spark, sf_dir)
    claims = numbers.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.lit(c) for c in D.CLAIMS])).alias("raw"))
    return grounding.classify_numbers(claims, numbers, "doc_id", most=None).select("doc_id", "raw", "kind")


@query(f"""WITH {D._TOKENS}, f AS (SELECT length({D.FOLD_SQL}) AS n FROM documents), t AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id)
SELECT 0 AS ord, 'documents' AS stage, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS amount FROM documents
UNION ALL SELECT 1, 'folded', count(*), CAST(sum(n) AS BIGINT) FROM f
UNION ALL SELECT 2, 'tokens', (SELECT count(*) FROM documents), CAST(sum(n) AS BIGINT) FROM t
UNION ALL SELECT 3, 'terms', count(*), CAST(max(n) AS BIGINT) FROM (SELECT term, count(*) AS n FROM kept GROUP BY term)""")
def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and amounts of the stages that lead from documents to terms, as they were counted while written."""
    progress, docs = Progress(), D._documents(spark, sf_dir)
    held = progress.cut("documents", docs.select("doc_id", "text"), amount=F.sum(F.length("text")))
    folded = progress.cut("folded", held.select("doc_id", N.clean(F.col("text")).alias("c")).withColumn("f", N.fold_clean(F.col("c"))), amount=F.sum(F.length("f")))
    tokens = progress.cut("tokens", folded.select("doc_id", N.tokenize_clean(F.col("c")).alias("t")), amount=F.sum(F.size("t")))
    progress.cut("terms", N.counted(tokens, F.col("t"), "doc_id").groupBy("value").agg(F.sum("n").alias("n")), amount=F.max("n"))
    return progress.table(spark).select("ord", "stage", "n_rows", F.col("metrics")["amount"].alias("amount"))
