"""The deterministic parts around model calls (A07-A22): evidence of drafts, gaps, issues, patches, models, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
LEAST_CONFIDENCE, SURE_OF_TYPE = 0.4, 0.55
REQUIRED_WEIGHT = 3


def normalized_extraction(evidence: DataFrame, fields: DataFrame) -> DataFrame:
    """draft_id, path, value, confidence, quotes, reason.

    ``evidence``: draft_id, ord, path, value, confidence, quote. For a path the
    first value counts, the highest confidence and all quotes in order. Below
    the least confidence the value is null with a reason; fields without any
    evidence are added as null.
    """
    rows = F.sort_array(F.collect_list(F.struct("ord", "value", "quote")))
    per = evidence.groupBy("draft_id", "path").agg(F.max("confidence").alias("confidence"), rows.alias("rows"))
    weak = F.col("confidence") < LEAST_CONFIDENCE
    value = F.get(F.filter(F.transform("rows", lambda r: r["value"]), lambda v: v.isNotNull()), F.lit(0))
    quotes = F.filter(F.transform("rows", lambda r: r["quote"]), lambda q: q.isNotNull())
    told = per.select("draft_id", "path", F.when(~weak, value).alias("value"), "confidence", quotes.alias("quotes"), F.when(weak, F.lit("low confidence")).alias("reason"))
    every = evidence.select("draft_id").distinct().crossJoin(F.broadcast(fields.select("path")))  # fields: the constants of a type
    missing = every.join(told, ["draft_id", "path"], "left_anti")
    return told.unionByName(missing.select("draft_id", "path", F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("confidence"), F.array().cast("array<string>").alias("quotes"), F.lit("not found").alias("reason")))


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows with equal keys the one that comes first."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def merge_issues(issues: DataFrame) -> DataFrame:
    """Issues of a draft by path, type and detail, the first of each; what a patch has settled stays."""
    return first_wins(issues, ["draft_id", "path", "type", "detail"], "ord")


def empty_paths(fields: DataFrame, leaves: DataFrame) -> DataFrame:
    """draft_id, path of what a form lacks.

    ``fields``: key, parent_key (null at the top), kind, ord; ``leaves``:
    draft_id, path, value of all leaves. An empty repeater is one gap; in a
    filled one the empty cells of its rows are.
    """
    filled = leaves.where(F.length(F.trim(F.coalesce("value", F.lit("")))) > 0)
    drafts = leaves.select("draft_id").distinct()
    top = fields.where("parent_key IS NULL").select("key", "kind")
    root = F.regexp_extract("path", r"^([^.\[]+)", 1)
    held = filled.select("draft_id", root.alias("key")).distinct()
    gaps = drafts.crossJoin(F.broadcast(top)).join(held, ["draft_id", "key"], "left_anti").select("draft_id", F.col("key").alias("path"))
    cells = fields.where("parent_key IS NOT NULL").select(F.col("parent_key").alias("parent"), F.col("key").alias("sub"))
    rows = filled.select("draft_id", F.regexp_extract("path", r"^([^.\[]+)\[[0-9]+\]", 1).alias("parent"), F.regexp_extract("path", r"^([^.\[]+\[[0-9]+\])", 1).alias("row")).where("parent <> ''").distinct()
    asked = rows.join(F.broadcast(cells), "parent").select("draft_id", F.concat("row", F.lit("."), "sub").alias("path"))
    have = filled.select("draft_id", F.regexp_extract("path", r"^([^.\[]+\[[0-9]+\]\.[^.\[]+)", 1).alias("path")).distinct()
    return gaps.unionByName(asked.join(have, ["draft_id", "path"], "left_anti"))


def completeness(fields: DataFrame, leaves: DataFrame) -> DataFrame:
    """draft_id, completeness: the weighted share of top fields that are filled, in percent; required ones weigh three."""
    filled = leaves.where(F.length(F.trim(F.coalesce("value", F.lit("")))) > 0).select("draft_id", F.regexp_extract("path", r"^([^.\[]+)", 1).alias("key")).distinct().withColumn("_filled", F.lit(1))
    top = fields.where("parent_key IS NULL").select("key", F.when(F.col("required"), REQUIRED_WEIGHT).otherwise(1).alias("weight"))
    both = leaves.select("draft_id").distinct().crossJoin(F.broadcast(top)).join(filled, ["draft_id", "key"], "left")
    return both.groupBy("draft_id").agg(F.round(100 * F.sum(F.col("weight") * F.coalesce("_filled", F.lit(0))) / F.sum("weight")).cast("long").alias("completeness"))


def ranked_gaps(gaps: DataFrame, most: int = 5) -> DataFrame:
    """Each draft's gaps with rank, by priority (high, medium, low), then order; questions are the first ``most``."""
    level = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    ranked = gaps.withColumn("rank", F.row_number().over(Window.partitionBy("draft_id").orderBy(level, "ord")))
    return ranked.withColumn("asked", F.col("rank") <= most)


def apply_patch(leaves: DataFrame, patch: DataFrame, valid: DataFrame) -> DataFrame:
    """Leaves after the patch: an upsert by path; paths whose root is no field are ignored."""
    known = patch.withColumn("_root", F.regexp_extract("path", r"^([^.\[]+)", 1)).join(F.broadcast(valid.select(F.col("key").alias("_root"))), "_root", "left_semi").drop("_root")
    kept = leaves.join(known.select("draft_id", "path"), ["draft_id", "path"], "left_anti")
    return kept.unionByName(known.where(F.col("value").isNotNull() & (F.col("value") != "")).select("draft_id", "path", "value"))


def patched_provenance(provenance: DataFrame, patch: DataFrame) -> DataFrame:
    """Provenance without that of paths a patch has emptied."""
    emptied = patch.where(F.col("value").isNull() | (F.col("value") == "")).select("draft_id", "path")
    return provenance.join(emptied, ["draft_id", "path"], "left_anti")


def usage_by_stage(calls: DataFrame, price: float) -> DataFrame:
    """Calls, tokens and cost of each stage at a price for a million tokens."""
    summed = calls.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("in_tokens").alias("in_tokens"), F.count_distinct("user_id").alias("users"))
    return summed.withColumn("cost", F.round(F.col("in_tokens") * price / 1_000_000, 6))


def cost_by_tier(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Tier, calls, tokens and cost; ``prices``: tier, in_price, out_price for a million tokens."""
    priced = calls.join(F.broadcast(prices), "tier")
    cost = (F.col("in_tokens") * F.col("in_price") + F.col("out_tokens") * F.col("out_price")) / 1_000_000
    return priced.groupBy("tier").agg(F.count("*").alias("calls"), F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"), F.round(F.sum(cost), 6).alias("cost"))


#: Fixed value: characters of a token, in tenths.
TOKEN_CHARS = 17


def simulated_cost(stages: DataFrame, prices: DataFrame) -> DataFrame:
    """C11: plan, tier, calls, tokens and cost of planned calls: ``stages`` has plan, stage, tier, chars of a call, calls, out_tokens of a call."""
    tokens = F.floor(F.col("chars") * 10 / F.lit(TOKEN_CHARS)).cast("long")
    summed = stages.groupBy("plan", "tier").agg(F.sum("calls").alias("calls"), F.sum(F.col("calls") * tokens).alias("in_tokens"), F.sum(F.col("calls") * F.col("out_tokens")).alias("out_tokens"))
    cost = (F.col("in_tokens") * F.col("in_price") + F.col("out_tokens") * F.col("out_price")) / 1_000_000
    return summed.join(F.broadcast(prices), "tier").select("plan", "tier", "calls", "in_tokens", "out_tokens", F.round(cost, 6).alias("cost"))


def ranked_models(models: DataFrame, tier: str | None = None) -> DataFrame:
    """Models with rank: the newest generation first, pro before flash, stable before preview, then the shorter name."""
    name = F.col("model")
    version = F.regexp_extract(name, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    kind = F.when(name.contains("pro"), 0).when(name.contains("flash"), 1).otherwise(2)
    preview = F.when(name.rlike("preview|exp"), 1).otherwise(0)
    asked = models if tier is None else models.where(name.contains(tier))
    order = [F.desc(F.coalesce(version, F.lit(0.0))), kind, preview, F.length(name), name]
    return asked.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # a model list: a few dozen rows


def retry_waits(tries: int = 4) -> list[int]:
    """Seconds to wait before each further try."""
    return [2**k for k in range(tries - 1)]
