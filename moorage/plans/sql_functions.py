"""The engine's functions by name, for spark.sql (§2.14).

``register`` makes temporary functions of a session: ``fold_text(text)``,
``clean_text(text)``, ``tokenize_ko(text)``, ``normalize_number(text)``,
``normal_token(text)`` and, of what ``clean_text`` gave, ``fold_cleaned(text)`` and
``tokenize_cleaned(text)`` are SQL functions, which Spark puts into the plan as the
expressions that they stand for; ``verify_quote(source, quote)`` and the table
function ``json_leaves(json)`` run on Arrow batches in Python.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize as N
from ..operators import grounding
from ..session import ship


def _text(x: str) -> str:
    escaped = x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t")
    return f"'{escaped}'"


def _steps(column: str, steps: list[tuple[str, str]]) -> str:
    for pattern, by in steps:
        column = f"regexp_replace({column}, {_text(pattern)}, {_text(by)})"
    return column


def _blank_trimmed(column: str) -> str:
    return f"btrim({column}, {_text(N.BLANKS)})"


def _whole_number(s: str) -> str:
    """A plain decimal as the engine prints it."""
    decimal = f"CAST(TRY_CAST({s} AS DECIMAL(38, 15)) AS STRING)"
    return f"CASE WHEN contains({decimal}, '.') THEN regexp_replace({decimal}, {_text(r'\.?0+$')}, '') ELSE {decimal} END"


def _shortest(v: str) -> str:
    """``normalize._shortest`` of a double by name."""
    text = f"CAST({v} AS STRING)"
    high = f"CAST(floor({v} / 4294967296D) AS BIGINT)"
    whole = f"CAST({high} AS DECIMAL(20, 0)) * CAST(4294967296 AS DECIMAL(10, 0)) + CAST(CAST({v} - {high} * 4294967296D AS BIGINT) AS DECIMAL(10, 0))"
    ten = "CAST(pow(10D, greatest(length(CAST(w AS STRING)) - n, 0)) AS DECIMAL(10, 0))"
    rounded = f"CAST(CAST((w + CAST(floor({ten} / 2) AS DECIMAL(10, 0))) div {ten} AS DECIMAL(20, 0)) * {ten} AS STRING)"
    tries = f"CASE WHEN {v} < 1e23D AND {v} = rint({v}) THEN flatten(transform(array({whole}), w -> transform(array(15, 16, 17), n -> {rounded}))) ELSE transform(array(15, 16, 17), n -> format_string(concat('%.', n - 1, 'e'), {v})) END"
    return f"CASE WHEN length({text}) < 17 THEN {text} ELSE coalesce(get(filter({tries}, c -> TRY_CAST(c AS DOUBLE) = {v}), 0), {text}) END"


def _functions() -> dict[str, tuple[str, str]]:
    """name -> (type, body) over the argument t."""
    clean = _blank_trimmed(_steps("nfkc_text(coalesce(t, ''))", N.CLEAN_STEPS))
    folded = lambda c: f"lower(regexp_replace({c}, {_text(N.LEFT_OUT)}, ''))"
    units = " ".join(f"WHEN {_text(u)} THEN {v!r}D" for u, v in N.UNITS.items())
    shape = r"^([0-9]+(?:\.[0-9]+)?)([천만억조])?$"
    without = lambda x, ends: f"regexp_replace({x}, {_text(f'^(.{{2,}}?)(?:{chr(124).join(ends)})$')}, '$1')"

    def number(x: str) -> str:
        bare = f"regexp_replace({x}, {_text(f',|{N.WS}')}, '')"
        value = f"CAST(regexp_extract({bare}, {_text(shape)}, 1) AS DOUBLE) * CASE regexp_extract({bare}, {_text(shape)}, 2) {units} ELSE 1.0D END"
        return f"CASE WHEN rlike({bare}, {_text(shape)}) THEN get(transform(array({value}), v -> {_whole_number(_shortest('v'))}), 0) ELSE {bare} END"

    def token(x: str) -> str:
        particle = f"CASE WHEN length({x}) <= 2 THEN {x} ELSE {without(x, N.PARTICLES)} END"
        return f"CASE WHEN {x} >= 'a' AND {x} < '{{' THEN trim(TRAILING '.' FROM {x}) WHEN rlike({x}, '^[0-9][0-9,.]*$') THEN {number(x)} WHEN rlike({x}, '^[가-힣]+$') THEN {without(without(f'({particle})', N.ENDINGS), N.ENDINGS)} ELSE trim(TRAILING '.' FROM {x}) END"

    stops = ", ".join(map(_text, N.STOPWORDS))
    # A lambda takes no function of the session, so a token's form is written out in it.
    tokens = lambda c: f"filter(transform(transform(regexp_extract_all({c}, {_text(f'({N.TOKEN})')}, 1), x -> lower(x)), x -> {token('x')}), x -> x <> '' AND (x < '가' OR NOT rlike(x, '^[가-힣]$') AND x NOT IN ({stops})))"
    return {"clean_text": ("STRING", clean), "fold_text": ("STRING", folded("clean_text(t)")), "fold_cleaned": ("STRING", folded("t")), "normalize_number": ("STRING", number("t")), "normal_token": ("STRING", token("t")), "tokenize_ko": ("ARRAY<STRING>", tokens("clean_text(t)")), "tokenize_cleaned": ("ARRAY<STRING>", tokens("t"))}


def scored(source: str, quote: str) -> tuple[float, str]:
    """A folded quote in a folded source: score and where, by the rules of ``grounding.score_quotes``."""
    n = len(quote) - grounding.GRAM + 1
    if n < 1:
        return 0.0, "no content"
    if n <= grounding.CONTAINED:
        return (1.0, "contained") if quote in source else (0.0, "absent")
    found = grounding.QuoteGrams([(quote, len(quote) * 18 // 10 + 40)], 0.0).best(source)
    if not found:
        return 0.0, "no hit"
    score = found[0][1] / n
    return score, "local" if score >= grounding.GROUNDED else "partial" if score >= grounding.WEAK else "scattered"


def _verify(source: pd.Series, quote: pd.Series) -> pd.DataFrame:
    rows = []
    for s, q in zip(source, quote):
        score, where = scored(s or "", q or "")
        verdict = "weak" if where == "no content" else "grounded" if score >= grounding.GROUNDED else "weak" if score >= grounding.WEAK else "ungrounded"
        rows.append((float(Decimal(repr(float(score))).quantize(Decimal("0.001"), ROUND_HALF_UP)), verdict))
    return pd.DataFrame(rows, columns=["score", "verdict"])


class JsonLeaves:
    """path, value of every scalar of a JSON text, however deep; broken texts and nulls have none."""

    def eval(self, text: str) -> Iterator[tuple[str, str]]:
        try:
            held = [("", json.loads(text))] if text else []
        except ValueError:
            return
        while held:
            path, x = held.pop()
            if isinstance(x, dict):
                held += [(f"{path}.{k}" if path else k, v) for k, v in x.items()]
            elif isinstance(x, list):
                held += [(f"{path}[{i}]", v) for i, v in enumerate(x)]
            elif x is not None and path:
                yield path, x if isinstance(x, str) else json.dumps(x)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; their names."""
    ship(spark)
    spark.udf.register("nfkc_text", F.pandas_udf(N._normal, T.StringType()))
    made = _functions()
    for name, (kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN ({body})")
    spark.udf.register("verify_folded", F.pandas_udf(_verify, "score double, verdict string"))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION verify_quote(source STRING, quote STRING) RETURNS STRUCT<score: DOUBLE, verdict: STRING> RETURN verify_folded(fold_text(source), fold_text(quote))")
    spark.udtf.register("json_leaves", F.udtf(JsonLeaves, returnType="path string, value string"))
    return [*made, "verify_quote", "json_leaves"]
