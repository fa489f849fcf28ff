"""Evidence for a reader with a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
BUNDLE_CHARS, SPAN_CHARS = 180_000, 9_000
LEAST_SHARE, HEAD_SHARE, CUT_MARK = 2_000, 0.62, 60
DIGEST_CHARS = 6_000
GAP = 120
#: Characters around a quote and around a value; the most values of a form that are looked for, and the length a value must exceed.
QUOTE_PAD, VALUE_PAD, LEAVES, LEAST_VALUE = 260, 180, 120, 12


def bundle_shares(docs: DataFrame, group: str, budget: int = BUNDLE_CHARS) -> DataFrame:
    """``docs`` with length, share, head and tail: what each document of a group may keep, and where it is cut.

    A group within the budget is kept whole. Totals are summed before they are
    joined back, so a large group isn't gathered anywhere. Null text is empty.
    """
    sized = docs.withColumn("length", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    totals = sized.groupBy(F.col(group).alias("_group")).agg(F.sum("length").alias("_total"))
    joined = sized.join(totals, F.col(group).eqNullSafe(F.col("_group")))
    share = F.when(F.col("_total") <= budget, F.col("length")).otherwise(F.greatest(F.lit(LEAST_SHARE), F.floor(F.col("length") / F.col("_total") * budget)))
    cut = joined.withColumn("share", share.cast("long"))
    head = F.floor(F.col("share") * HEAD_SHARE).cast("long")
    over = F.col("length") > F.col("share")
    return cut.withColumn("head", F.when(over, head)).withColumn("tail", F.when(over, F.col("share") - head - CUT_MARK)).drop("_group", "_total")


def clipped(shared: DataFrame) -> DataFrame:
    """bundle_shares with ``body``: head and tail of what is over its share, with a note on what is left out."""
    left = F.col("length") - F.col("head") - F.col("tail")
    note = F.concat(F.lit("\n\n…(중략: "), F.format_number(left, 0), F.lit("자 생략)…\n\n"))
    cut = F.concat(F.substring("text", F.lit(1), F.col("head").cast("int")), note, F.substring("text", (F.col("length") - F.col("tail") + 1).cast("int"), F.col("tail").cast("int")))
    return shared.withColumn("body", F.when(F.col("head").isNull(), F.coalesce("text", F.lit(""))).otherwise(cut))


def quality_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.6, "fair").otherwise("low")


def evidence_bundle(docs: DataFrame, group: str, budget: int = BUNDLE_CHARS) -> DataFrame:
    """group, bundle: the documents of a group (source_id, name, kind, confidence, text) between marks that name them."""
    body = clipped(bundle_shares(docs, group, budget))
    head = F.concat(F.lit("<<<파일 sourceId="), F.col("source_id"), F.lit(' 이름="'), F.col("name"), F.lit('" 형식='), F.col("kind"), F.lit(" 텍스트품질="), quality_band(F.col("confidence")), F.lit(">>>"))
    shown = F.when(F.col("body") == "", F.lit("(텍스트 없음)")).otherwise(F.col("body"))
    part = F.concat_ws("\n", head, shown, F.concat(F.lit("<<<파일 끝 sourceId="), F.col("source_id"), F.lit(">>>")))
    lines = F.sort_array(F.collect_list(F.struct("source_id", part.alias("part"))))
    return body.groupBy(group).agg(F.array_join(F.transform(lines, lambda x: x["part"]), "\n\n").alias("bundle"))


def classification_digest(docs: DataFrame, group: str) -> DataFrame:
    """group, digest: the list of files and the beginning of each."""
    length = F.length(F.coalesce("text", F.lit("")))
    line = F.concat(F.lit("- "), F.col("name"), F.lit(" ("), F.col("kind"), F.lit(", "), F.format_number(length, 0), F.lit("자, 품질 "), F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%)"))
    shown = F.concat(F.lit("["), F.col("source_id"), F.lit(" "), F.col("name"), F.lit("]\n"), F.substring(F.coalesce("text", F.lit("")), 1, DIGEST_CHARS))
    rows = F.sort_array(F.collect_list(F.struct("source_id", line.alias("line"), shown.alias("shown"))))
    text = F.concat(F.lit("[업로드된 파일 목록]\n"), F.array_join(F.transform(rows, lambda x: x["line"]), "\n"), F.lit("\n\n[본문 발췌]\n"), F.array_join(F.transform(rows, lambda x: x["shown"]), "\n\n"))
    return docs.groupBy(group).agg(text.alias("digest"))


def merged_spans(spans: DataFrame, key: str, gap: int = GAP) -> DataFrame:
    """key, start, end of ``spans`` (key, start, end), joined where at most ``gap`` lies between."""
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("end").over(before)
    opens = F.when(F.col("start") <= reached + gap, 0).otherwise(1)
    numbered = spans.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def budgeted_spans(spans: DataFrame, key: str, budget: int = SPAN_CHARS) -> DataFrame:
    """``spans`` in order until ``budget`` characters are full; the last one is cut."""
    length = F.col("end") - F.col("start")
    used = F.coalesce(F.sum(length).over(Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    filled = spans.withColumn("_used", used).where(F.col("_used") < budget)
    return filled.withColumn("end", F.least("end", F.col("start") + budget - F.col("_used"))).drop("_used").where("end > start")


def located(needles: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """key, start, end in the raw text around each needle.

    ``needles``: key, needle, pad; ``sources``: key, raw, folded. A needle is
    found by its first 60 folded characters, else by the first of its twelve
    first grams that occurs; places are carried over by the ratio of lengths.
    Needles of fewer than six folded characters mark nothing.
    """
    from ..functions.normalize import fold, grams

    asked = needles.withColumn("_f", fold(F.col("needle"))).where(F.length("_f") >= 6).join(sources, key)
    whole = F.instr(F.col("folded"), F.substring("_f", 1, 60))
    first = F.filter(F.transform(F.slice(grams(F.col("_f")), 1, 12), lambda g: F.instr(F.col("folded"), g)), lambda p: p > 0)
    pos = F.when(whole > 0, whole - 1).otherwise(F.get(first, F.lit(0)) - 1)
    at = F.floor(pos * F.length("raw") / F.greatest(F.length("folded"), F.lit(1))).cast("long")
    hit = asked.withColumn("_at", at).where("_at IS NOT NULL")
    return hit.select(key, F.greatest(F.lit(0).cast("long"), F.col("_at") - F.col("pad")).alias("start"), F.least(F.length("raw").cast("long"), F.col("_at") + F.length("needle") + F.col("pad")).alias("end"))


def needles(leaves: DataFrame, provenance: DataFrame, key: str = "draft_id") -> DataFrame:
    """Key, needle, pad: a form's quotes (key, path, quotes), and the longer ones of its first LEAVES values (key, path, value) in order of path."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("path"))
    first = leaves.withColumn("_nth", nth).where((F.col("_nth") <= LEAVES) & (F.length("value") > LEAST_VALUE))
    values = first.select(key, F.col("value").alias("needle"), F.lit(VALUE_PAD).alias("pad"))
    return provenance.select(key, F.explode("quotes").alias("needle"), F.lit(QUOTE_PAD).alias("pad")).unionByName(values).distinct()


def evidence_spans(needles: DataFrame, sources: DataFrame, key: str, budget: int = SPAN_CHARS) -> DataFrame:
    """key, evidence: the merged, budgeted stretches around the needles; the beginning of the text where none is found."""
    spans = budgeted_spans(merged_spans(located(needles, sources, key), key), key, budget)
    cut = spans.join(sources.select(key, "raw"), key).select(key, "start", F.substring("raw", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("chunk"))
    lines = F.sort_array(F.collect_list(F.struct("start", "chunk")))
    joined = cut.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["chunk"]), "…\n").alias("evidence"))
    return sources.select(key, "raw").join(joined, key, "left").select(key, F.coalesce("evidence", F.substring("raw", 1, budget)).alias("evidence"))
