"""Several drafts of a form as one (A08-A11, R04, W02). Tables hold the drafts of many forms, by form_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import fold

# The weights of a field's score.
UNQUOTED, NUMBER_GAIN, NUMBER_MOST, NUMBER_LOSS = 0.8, 0.2, 0.8, 1.2
ROW_GAIN, ROW_MOST, LONG_GAIN, LONG_LEAST, LONG_MOST, LONG_SHORT = 0.25, 1.0, 0.4, 30, 800, 15
CLOSE_SCORES, MOST_CONFLICTS = 0.25, 12


def field_scores(values: DataFrame) -> DataFrame:
    """``values`` with score.

    ``values``: one row for each form, draft and field, with kind, value (text or
    JSON; null or blank: empty), quote_scores (array), n_numbers, n_good (those
    that are literal or derived), filled_rows (of a repeater). An empty value
    scores -1.
    """
    quoted = F.coalesce(F.size("quote_scores"), F.lit(0)) > 0
    mean = F.aggregate("quote_scores", F.lit(0.0), lambda a, x: a + x) / F.size("quote_scores")
    numbers = F.least(F.lit(NUMBER_MOST), F.lit(NUMBER_GAIN) * F.col("n_good")) - F.lit(NUMBER_LOSS) * (F.col("n_numbers") - F.col("n_good"))
    n = F.length(F.trim("value"))
    shape = (
        F.when(F.col("kind") == "repeater", F.least(F.lit(ROW_MOST), F.lit(ROW_GAIN) * F.col("filled_rows")))
        .when((F.col("kind") == "longtext") & n.between(LONG_LEAST, LONG_MOST), LONG_GAIN)
        .when((F.col("kind") == "longtext") & (n < LONG_SHORT), -LONG_GAIN)
        .otherwise(0.0)
    )
    empty = F.length(F.trim(F.coalesce("value", F.lit("")))) == 0
    return values.withColumn("score", F.when(empty, -1.0).otherwise(F.when(quoted, 2 * mean).otherwise(UNQUOTED) + numbers + shape))


def best_values(scored: DataFrame) -> DataFrame:
    """form_id, key, kind, value, draft_id, score of the best draft of each field of a form; the earlier draft wins a tie; empty fields are null."""
    nth = F.row_number().over(Window.partitionBy("form_id", "key").orderBy(F.desc("score"), "draft_id"))
    best = scored.withColumn("_nth", nth).where("_nth = 1")
    return best.select("form_id", "key", "kind", F.when(F.col("score") >= 0, F.col("value")).when(F.length(F.trim(F.coalesce("value", F.lit("")))) > 0, F.col("value")).alias("value"), "draft_id", "score")


def merge_conflicts(scored: DataFrame) -> DataFrame:
    """form_id, key, a, b: fields whose best draft meets another value of nearly its score. Repeaters are merged and don't conflict."""
    full = scored.where((F.length(F.trim(F.coalesce("value", F.lit("")))) > 0) & (F.col("kind") != "repeater"))
    best = best_values(full).select("form_id", "key", F.col("value").alias("a"), F.col("score").alias("_best"))
    others = full.join(best, ["form_id", "key"]).where(F.col("value") != F.col("a"))
    second = others.groupBy("form_id", "key", "a", "_best").agg(F.min_by(F.struct("value", "score"), F.struct(-F.col("score"), "draft_id")).alias("m"))
    return second.where(F.abs(F.col("m.score") - F.col("_best")) < CLOSE_SCORES).select("form_id", "key", "a", F.col("m.value").alias("b"))


def arbitrated(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """form_id, key, value after decisions (form_id, key, choice, merged) on each form's first conflicts: A, B, merged or neither (null).

    Conflicts without a decision, and those beyond the first, keep the best draft's value.
    """
    nth = F.row_number().over(Window.partitionBy("form_id").orderBy("key"))
    told = conflicts.withColumn("_nth", nth).join(decisions, ["form_id", "key"], "left")
    choice = F.when(F.col("_nth") <= MOST_CONFLICTS, F.col("choice"))
    value = F.when(choice == "B", F.col("b")).when(choice == "merged", F.col("merged")).when(choice == "neither", F.lit(None).cast("string")).otherwise(F.col("a"))
    return told.select("form_id", "key", value.alias("value"))


def decided_by_rule(conflicts: DataFrame, sources: DataFrame) -> DataFrame:
    """A11 without a model: form_id, key, choice, merged: the value that the form's source (form_id, folded) holds, A if both or neither do."""
    inside = lambda v: (F.length(fold(F.col(v))) > 0) & F.col("folded").contains(fold(F.col(v)))
    told = conflicts.join(sources.select("form_id", "folded"), "form_id", "left")
    choice = F.when(inside("b") & ~F.coalesce(inside("a"), F.lit(False)), F.lit("B")).otherwise(F.lit("A"))
    return told.select("form_id", "key", choice.alias("choice"), F.lit(None).cast("string").alias("merged"))


def merged_rows(cells: DataFrame) -> DataFrame:
    """A10: form_id, field, row_key, column, value of the rows of repeaters, merged over a form's drafts.

    ``cells``: form_id, field, rank (of the draft, best first), row, row_key (the text of
    the row's key column), column, value. Rows of an equal folded key are one;
    rows without a key are dropped. A row with more filled cells replaces the
    ones before it, what they had is lost; other rows fill what is empty.

    In order, the last replacing row is the first of those with the most
    filled cells; only it and the rows after it give values, each cell its first.
    """
    # A list of none or one, not a filter, which would be pushed down and fold again.
    key = F.explode(F.filter(F.array(fold(F.col("row_key"))), lambda k: k != "")).alias("_k")
    named = F.col("form_id").isNotNull() & F.col("field").isNotNull()
    full = cells.where(named & (F.length(F.trim(F.coalesce("value", F.lit("")))) > 0)).select("form_id", "field", key, "rank", "row", "column", "value")
    # The second window and the last aggregate are dealt and ordered alike; cells dealt by row already are not dealt for the first.
    rows = Window.partitionBy("form_id", "field", "_k")
    filled = full.withColumn("_n", F.count("*").over(Window.partitionBy("form_id", "field", "_k", "rank", "row")))
    led = filled.withColumn("_lead", F.min(F.struct((-F.col("_n")).alias("n"), "rank", "row")).over(rows))
    at = F.struct("rank", "row")
    late = led.where(at >= F.struct(F.col("_lead.rank").alias("rank"), F.col("_lead.row").alias("row")))
    return late.groupBy("form_id", "field", F.col("_k").alias("row_key"), "column").agg(F.min_by("value", at).alias("value"))


def unfilled(gaps: DataFrame, merged: DataFrame) -> DataFrame:
    """Reasons (form_id, path, label, reason, ord) of fields that are empty after the merge, the first of each path of a form."""
    nth = F.row_number().over(Window.partitionBy("form_id", "path").orderBy("ord"))
    root = F.regexp_extract("path", r"^([^.\[]+)", 1)
    first = gaps.withColumn("_nth", nth).where("_nth = 1").drop("_nth").withColumn("_root", root)
    held = merged.where(F.length(F.trim(F.coalesce("value", F.lit("")))) > 0).select("form_id", F.col("key").alias("_root"))
    return first.join(held, ["form_id", "_root"], "left_anti").drop("_root")


def numbers_of(value: Column) -> Column:
    """The numbers in a value, as they stand."""
    return F.regexp_extract_all(value, F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1))
