"""What stands for a model (A02-A04, A11, A12, A20, A21): a protocol, and an offline provider of rules.

A provider maps batches of requests to batches of answers, so calls run in the
partitions of a DataFrame. Errors become values of the row; a paid provider
retries by itself and never relies on Spark's task retries.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.agents import retry_waits

ANSWER = "request_id string, stage string, model string, answer string, in_tokens long, out_tokens long, ms long, error string"


class Provider(Protocol):
    """Answers one request; raises on failure."""

    def resolve_model(self, stage: str) -> str: ...

    def answer(self, stage: str, prompt: str, temperature: float) -> str: ...


class Recorded:
    """Answers from a table of prompts, for tests."""

    def __init__(self, answers: dict[str, str]):
        self.answers = answers

    def resolve_model(self, stage: str) -> str:
        return "recorded"

    def answer(self, stage: str, prompt: str, temperature: float) -> str:
        return self.answers[prompt]


def with_retry(call: Callable[[], str], retryable: Callable[[Exception], bool] = lambda e: True, waits: list[int] | None = None, sleep: Callable[[float], None] = time.sleep) -> str:
    """Tries with growing waits; an error that isn't retryable is tried once more, after the first try only."""
    waits = retry_waits() if waits is None else waits
    for n, wait in enumerate([*waits, None]):
        try:
            return call()
        except Exception as e:
            if wait is None or (not retryable(e) and n > 0):
                raise
            sleep(wait)
    raise AssertionError


def retryable(error: Exception) -> bool:
    """Errors of the way to a model, which may pass; others are those of the request."""
    return isinstance(error, (ConnectionError, TimeoutError))


def ask(requests: DataFrame, provider: Provider, waits: list[int] | None = None) -> DataFrame:
    """The answers to ``requests`` (request_id, stage, prompt, temperature), with usage; exceptions are values. Calls are tried again after ``waits`` seconds, by default 1, 2 and 4."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                began, answer, error = time.time(), None, None
                try:
                    answer = with_retry(lambda r=r: provider.answer(r.stage, r.prompt, r.temperature), retryable, waits)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                rows.append((r.request_id, r.stage, provider.resolve_model(r.stage), answer, len(r.prompt) * 10 // 17, len(answer or "") * 10 // 17, int(1000 * (time.time() - began)), error))
            yield pd.DataFrame(rows, columns=["request_id", "stage", "model", "answer", "in_tokens", "out_tokens", "ms", "error"])

    return requests.select("request_id", "stage", "prompt", "temperature").mapInPandas(run, ANSWER)


#: Words by which the rules know a type of the sample catalogue; a category's words count for all its types.
SIGNALS = {
    "work": "근무 급여 매장", "work.shift": "교대 아르바이트 시간제 계산대", "study": "수업 강의 학습", "study.lecture": "강좌 수강 회차 강사", "trip": "여행 방문", "trip.visit": "숙소 기차 다녀왔다",
}


def classify(docs: DataFrame, key: str = "draft_id", text: str = "text", signals: dict[str, str] = SIGNALS) -> DataFrame:
    """Key, type_id, category, confidence, by the words of a type (weight 2) and of its category (1); a tie goes to the name.

    ``signals``: words by type (``category.type``) and by category, as many rows as a catalogue has types.
    """
    types = [(t, t.split(".")[0], words.split(), signals.get(t.split(".")[0], "").split()) for t, words in signals.items() if "." in t]
    known = docs.sparkSession.createDataFrame(types, "type_id string, category string, own array<string>, wider array<string>")
    body = F.coalesce(F.col(text), F.lit(""))
    hits = lambda c: F.size(F.filter(c, lambda w: body.contains(w)))
    scored = docs.crossJoin(F.broadcast(known)).select(key, "type_id", "category", (2 * hits("own") + hits("wider")).alias("score"))  # known: one row a type
    best = scored.groupBy(key).agg(F.min_by(F.struct("type_id", "category", "score"), F.struct(-F.col("score"), "type_id")).alias("b"), F.sum("score").alias("all"))
    return best.select(key, "b.type_id", "b.category", F.round(F.when(F.col("all") > 0, F.col("b.score") / F.col("all")).otherwise(0.0), 3).alias("confidence"))


def type_by_label(asked: DataFrame, types: DataFrame, default: str, said: str = "said") -> DataFrame:
    """``asked`` with type_id: the type of that id, else the first in order of name whose label holds what was said or is held by it, else ``default``.

    ``types``: type_id, label, as many rows as a catalogue has types. Null and blank say nothing.
    """
    known = F.broadcast(types.select(F.col("type_id").alias("_type"), F.lower("label").alias("_label")))
    words = F.lower(F.trim(F.col(said)))
    fits = (F.col("_type") == F.trim(F.col(said))) | ((F.length(words) > 0) & (F.col("_label").contains(words) | words.contains(F.col("_label"))))
    rows = asked.select(said).distinct().join(known, fits)
    best = rows.groupBy(F.col(said).alias("_said")).agg(F.min(F.struct(F.col("_type") != F.trim(F.col(said)), "_type")).alias("_b"))
    found = asked.join(best, F.col(said) == F.col("_said"), "left")
    return found.withColumn("type_id", F.coalesce("_b._type", F.lit(default))).drop("_said", "_b")


def _lines(docs: DataFrame, typed: DataFrame, key: str, text: str) -> DataFrame:
    return docs.join(typed.select(key, "type_id"), key).select(key, "type_id", F.posexplode(F.split(text, r"\r?\n")).alias("ord", "line"))


def extract(docs: DataFrame, specs: DataFrame, typed: DataFrame, key: str = "draft_id", text: str = "text") -> DataFrame:
    """A07 by rules: lines "label: value" of the documents as evidence for the fields of their type: key, ord, path, value, confidence, quote.

    A row of a repeater is said by its path, as in "duties[0].note: value".
    """
    from ..operators.schema import all_fields

    fields = all_fields(specs)
    top = fields.where("parent_key IS NULL").select("type_id", F.col("key").alias("path"), F.explode(F.array(F.lower("label"), F.lower("key"))).alias("said"), F.lit(None).cast("string").alias("sub")).distinct()
    cells = fields.where("parent_key IS NOT NULL").select("type_id", F.col("parent_key").alias("path"), F.lower(F.concat("parent_key", F.lit("[]."), "key")).alias("said"), F.col("key").alias("sub"))
    pattern = r"^[\s\-*#>|]*+([^:|*]{1,60}?)\**\s*[:|]\s*\**\s*(.+?)\s*\|?\s*$"
    told = _lines(docs, typed, key, text).select(key, "type_id", "ord", F.col("line").alias("quote"), F.lower(F.trim(F.regexp_extract("line", pattern, 1))).alias("_said"), F.regexp_extract("line", pattern, 2).alias("value")).where("_said <> '' AND value <> ''")
    index = F.regexp_extract("_said", r"\[([0-9]+)\]\.", 1)
    asked = told.withColumn("said", F.regexp_replace("_said", r"\[[0-9]+\]", "[]")).withColumn("_i", index)
    found = asked.join(F.broadcast(top.unionByName(cells)), ["type_id", "said"])
    path = F.when(F.col("sub").isNull(), F.col("path")).otherwise(F.concat("path", F.lit("["), "_i", F.lit("]."), "sub"))
    return found.select(key, "ord", path.alias("path"), "value", F.lit(0.9).alias("confidence"), "quote")


def extract_loosely(docs: DataFrame, specs: DataFrame, typed: DataFrame, key: str = "draft_id", text: str = "text") -> DataFrame:
    """A second reading: lines that begin with a field's label, whatever follows it, at less confidence. Lines meet the fields of their type, a bounded table."""
    from ..operators.schema import all_fields

    fields = all_fields(specs).where("parent_key IS NULL").select("type_id", F.col("key").alias("path"), F.lower("label").alias("label"))
    bare = F.regexp_replace("line", r"^[\s\-*#>|]+", "")
    lines = _lines(docs, typed, key, text).withColumn("_bare", bare).join(F.broadcast(fields), "type_id").where(F.lower("_bare").startswith(F.col("label")))
    value = F.regexp_replace(F.substring("_bare", F.length("label") + 1, F.length("_bare")), r"^(?:은|는|이|가)?[\s:|=\-–—→>*]+", "")
    return lines.select(key, "ord", "path", F.trim(value).alias("value"), F.lit(0.6).alias("confidence"), F.col("line").alias("quote")).where("value <> ''")


def drafts(docs: DataFrame, specs: DataFrame, typed: DataFrame, key: str = "draft_id") -> DataFrame:
    """The evidence of all readings, numbered by ``draft``; a model's provider gives one for each temperature."""
    ways = [extract, extract_loosely]
    out = None
    for n, way in enumerate(ways):
        told = way(docs, specs, typed, key).withColumn("draft", F.lit(n))
        out = told if out is None else out.unionByName(told)
    return out


def review(issues: DataFrame) -> DataFrame:
    """A12 without a model: draft_id, answer in JSON: values whose quotes, numbers or files the source lacks are taken out; ``issues``: draft_id, severity, path, rule."""
    cut = F.col("rule").isin("G07 quote", "G07 number", "G07 file")
    patch = F.sort_array(F.collect_set(F.when(cut, F.struct(F.col("path"), F.lit("null").alias("valueJson")))))
    return issues.groupBy("draft_id").agg(patch.alias("patch"), F.max(F.col("severity") != "minor").alias("_bad")).select("draft_id", F.to_json(F.struct(F.when(F.col("_bad"), "revise").otherwise("pass").alias("verdict"), F.lit("by rule").alias("comment"), F.col("patch"))).alias("answer"))
