"""Incremental forms of the same operators. The reference has no streams; these show that its operators run in one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import normalize as N


def document_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """Documents as their Parquet files arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def token_counts(docs: DataFrame) -> DataFrame:
    """Per document, without state: the same expressions as in a batch."""
    return docs.select("doc_id", F.size(N.tokenize(F.col("text"))).cast("long").alias("n_tokens"), F.md5(N.fold(F.col("text"))).alias("folded_md5"))


def new_documents(docs: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """The first of the documents of equal text within the watermark; state is dropped behind it."""
    return docs.withColumn("_text", F.sha2("text", 256)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["_text"]).drop("_text")


def usage_windows(calls: DataFrame, time: str, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Calls and their value by stage in windows of time; works on streams and tables."""
    marked = calls.withWatermark(time, delay) if calls.isStreaming else calls
    window = marked.groupBy(F.window(time, size).alias("w"), "event_type").agg(F.count("*").alias("calls"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return window.select(F.col("w.start").alias("window_start"), "event_type", "calls", "cents")
