"""Structural rules over the leaves of a form (V01-V11) and grounding rules (G07), as unions of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import trim

# Fixed values.
DATE = r"^(?:19|20)[0-9]{2}(?:-(?:0[1-9]|1[0-2])(?:-(?:0[1-9]|[12][0-9]|3[01]))?)?$"
URL = r"(?i)^(?:https?://|www\.)[^\s]+$"
MOST_TAGS, MOST_SUMMARY, LEAST_LONG, LEAST_UNPROVEN = 20, 120, 5, 25
FILE_KEYS = r"(?i)evidence|certificate|file|transcript|screenshots?|submission|artifacts|attachment"
COMMON_WORDS = "and the for with from team project data web app api ui ux pm qa ai ml it hr ceo cto kpi roi pdf png jpg url http https www com net org".split()
ISSUE = ["draft_id", "severity", "type", "path", "rule"]


def _issue(rows: DataFrame, when: Column, severity: str, rule: str, kind: str = "format", path: str = "path") -> DataFrame:
    return rows.where(when).select("draft_id", F.lit(severity).alias("severity"), F.lit(kind).alias("type"), F.col(path).alias("path"), F.lit(rule).alias("rule"))


def structural_issues(cells: DataFrame) -> DataFrame:
    """draft_id, severity, type, path, rule of each violation.

    ``cells``: one row for each field of each draft and, in repeaters, of each
    row: draft_id, path, key, kind, required, options, free_options, and the
    value as text, or items (array), or start, end, ongoing for date ranges;
    ``malformed`` is true where a list was wanted and something else is there.
    A required field that is empty breaks no other rule.
    """
    text = F.coalesce(F.col("value"), F.lit(""))
    empty = (F.length(trim(text)) == 0) & (F.coalesce(F.size("items"), F.lit(0)) <= 0) & F.col("start").isNull() & F.col("end").isNull() & F.col("ongoing").isNull() & ~F.col("malformed")
    rows = cells.withColumn("_empty", empty)
    full = rows.where(~F.col("_empty"))
    is_kind = lambda *k: F.col("kind").isin(*k)
    bad_date = lambda c: F.col(c).isNotNull() & (F.col(c) != "") & ~trim(F.col(c)).rlike(DATE)
    unknown = F.size(F.filter("items", lambda x: ~F.array_contains(F.col("options"), x))) > 0
    parts = [
        _issue(rows, F.col("required") & F.col("_empty"), "blocker", "V01", "missing_required"),
        _issue(full, is_kind("date") & ~trim(text).rlike(DATE), "major", "V02"),
        _issue(full.withColumn("path", F.concat("path", F.lit(".start"))), is_kind("daterange") & bad_date("start"), "major", "V03"),
        _issue(full.withColumn("path", F.concat("path", F.lit(".end"))), is_kind("daterange") & bad_date("end"), "major", "V03"),
        _issue(full, is_kind("daterange") & (F.length("start") > 0) & (F.length("end") > 0) & (F.col("start") > F.col("end")), "major", "V03 order"),
        _issue(full, is_kind("daterange") & F.coalesce("ongoing", F.lit(False)) & (F.length("end") > 0), "minor", "V03 ongoing"),
        _issue(full, is_kind("select") & F.col("options").isNotNull() & ~F.array_contains("options", F.col("value")), "major", "V04"),
        _issue(full, is_kind("checklist") & (F.col("malformed") | (F.col("options").isNotNull() & ~F.col("free_options") & unknown)), "major", "V05"),
        _issue(full, is_kind("tags") & F.col("malformed"), "major", "V06"),
        _issue(full, is_kind("tags") & (F.size("items") > MOST_TAGS), "minor", "V06 many"),
        _issue(full, is_kind("link") & ~trim(text).rlike(URL), "minor", "V07"),
        _issue(full, is_kind("text") & F.col("value").contains("\n"), "minor", "V08"),
        _issue(full, is_kind("text") & F.col("key").isin("summary", "oneLiner") & (F.length("value") > MOST_SUMMARY), "minor", "V08 long"),
        _issue(full, is_kind("repeater") & F.col("malformed"), "major", "V09"),
        _issue(full, is_kind("longtext") & (F.length(trim(text)) < LEAST_LONG) & F.col("value").isNotNull(), "minor", "V10"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def file_issues(leaves: DataFrame, names: DataFrame) -> DataFrame:
    """G07.2, J11: file values that no upload's name contains or is contained in. ``names``: draft_id, name."""
    held = names.groupBy("draft_id").agg(F.collect_set("name").alias("names"))
    v = F.col("value")
    asked = leaves.where(F.regexp_extract("path", r"([^.\[]+)(?:\[[0-9]+\])?$", 1).rlike(FILE_KEYS)).join(held, "draft_id", "left")
    known = F.exists(F.coalesce("names", F.array().cast("array<string>")), lambda n: n.contains(trim(v)) | v.contains(n))
    return _issue(asked, ~known, "major", "G07 file", "hallucination")


def number_claims(leaves: DataFrame) -> DataFrame:
    """G07.3: draft_id, path, raw: the numbers of two digits or more in values that aren't files."""
    told = leaves.where(~F.regexp_extract("path", r"([^.\[]+)(?:\[[0-9]+\])?$", 1).rlike(FILE_KEYS))
    raw = told.select("draft_id", "path", F.explode(F.regexp_extract_all("value", F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1))).alias("raw"))
    return raw.where(F.length(F.regexp_replace("raw", ",", "")) >= 2).distinct()


def term_claims(leaves: DataFrame) -> DataFrame:
    """G07.4, J09: draft_id, path, term: names and terms in values that aren't files, without common words."""
    told = leaves.where(~F.regexp_extract("path", r"([^.\[]+)(?:\[[0-9]+\])?$", 1).rlike(FILE_KEYS))
    terms = told.select("draft_id", "path", F.explode(F.regexp_extract_all("value", F.lit(r"([A-Za-z][A-Za-z0-9+#.]{2,}|[가-힣]{3,})"), F.lit(1))).alias("term"))
    return terms.where(~F.lower("term").isin(COMMON_WORDS)).distinct()


def unproven_issues(leaves: DataFrame, provenance: DataFrame) -> DataFrame:
    """G07.5, J06: long values on whose path, or on a beginning or continuation of it, there is no provenance."""
    told = leaves.where(~F.regexp_extract("path", r"([^.\[]+)(?:\[[0-9]+\])?$", 1).rlike(FILE_KEYS) & (F.length(trim(F.col("value"))) > LEAST_UNPROVEN))
    beginnings = F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring("path", F.lit(1), n)))
    given = provenance.select("draft_id", "path").distinct()
    # Beginnings of paths are joined with whole paths, either way round, so a draft's paths never meet in one row.
    below = told.select("draft_id", "path", beginnings.alias("given")).join(given.withColumnRenamed("path", "given"), ["draft_id", "given"], "left_semi").select("draft_id", "path")
    above = given.select("draft_id", beginnings.alias("path"))
    proven = below.unionByName(above).distinct().withColumn("_held", F.lit(True))
    asked = told.join(proven, ["draft_id", "path"], "left")
    return _issue(asked, F.col("_held").isNull(), "minor", "G07 unproven", "hallucination")


def quote_issues(verified: DataFrame) -> DataFrame:
    """G07.1: from verified quotes (draft_id, path, verdict, where): ungrounded ones block, weak and empty ones are minor."""
    bad = _issue(verified, F.col("verdict") == "ungrounded", "blocker", "G07 quote", "hallucination")
    none = _issue(verified, F.col("where") == "no content", "minor", "G07 no content", "hallucination")
    weak = _issue(verified, (F.col("verdict") == "weak") & (F.col("where") != "no content"), "minor", "G07 weak", "hallucination")
    return bad.unionByName(none).unionByName(weak)


def grounding_issues(leaves: DataFrame, provenance: DataFrame, names: DataFrame, verified: DataFrame, numbers: DataFrame, terms: DataFrame) -> DataFrame:
    """The five rules together, each path and rule once.

    ``verified``: the quotes' verdicts; ``numbers``: number_claims with kind;
    ``terms``: term_claims with found.
    """
    parts = [
        file_issues(leaves, names),
        _issue(numbers, F.col("kind") == "unknown", "major", "G07 number", "hallucination"),
        _issue(terms, ~F.col("found"), "minor", "G07 term", "hallucination"),
        unproven_issues(leaves, provenance),
    ]
    out = quote_issues(verified)
    for part in parts:
        out = out.unionByName(part)
    return out.distinct()
