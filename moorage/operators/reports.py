"""What readers and models get to see, and what comes back from them: fact sheets, outlines, reviews, guides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import match_enum, trim
from .agents import SURE_OF_TYPE, ranked_gaps
from .schema import BLANK, TRUE, all_fields, layout

# A fact sheet's parts with their labels and the most entries shown of each.
FACTS = (
    "docType string, register string, title string, outline array<struct<heading:string,summary:string>>, entities struct<orgs:array<string>,people:array<string>,products:array<string>,tools:array<string>>, "
    "dates array<struct<value:string,context:string>>, numbers array<struct<value:string,unit:string,context:string,before:string,after:string>>, myActions array<string>, teamActions array<string>, "
    "achievements array<string>, problems array<string>, learnings array<string>, unclear array<string>, links array<string>, normalized array<struct<as_written:string,meaning:string>>"
)
ENTITIES = [("orgs", "조직"), ("people", "사람"), ("products", "제품"), ("tools", "도구")]
LISTS = [("myActions", "내가 한 일"), ("teamActions", "팀이 한 일"), ("achievements", "성과"), ("problems", "문제·한계"), ("learnings", "배운 점"), ("unclear", "주어 불명")]
MOST = {"outline": 20, "entities": 15, "dates": 15, "numbers": 40, "lists": 15, "links": 10, "normalized": 20}
CANDIDATES, QUESTIONS = 3, 5


def factsheet_text(facts: Column) -> Column:
    """A fact sheet in JSON as lines for a reader; parts that are empty have no line. Null, or not JSON, gives an empty text."""
    x = F.from_json(facts, FACTS)

    def line(label: str, items: Column, show, most: int, by: str) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.transform(F.slice(items, 1, most), show), by)))

    same = lambda v: v
    change = lambda n: F.when((F.coalesce(n["before"], F.lit("")) != "") | (F.coalesce(n["after"], F.lit("")) != ""), F.concat(F.lit(" ["), F.coalesce(n["before"], F.lit("?")), F.lit(" → "), F.coalesce(n["after"], F.lit("?")), F.lit("]"))).otherwise("")
    number = lambda n: F.concat(F.lit("  · "), F.coalesce(n["value"], F.lit("")), F.coalesce(n["unit"], F.lit("")), F.lit(" — "), F.coalesce(n["context"], F.lit("")), change(n))
    lines = [
        F.concat(F.lit("문서 성격: "), F.coalesce(x["docType"], F.lit("?")), F.lit(" / 문체: "), F.coalesce(x["register"], F.lit("?"))),
        F.when(F.coalesce(x["title"], F.lit("")) != "", F.concat(F.lit("활동명 후보: "), x["title"])),
        line("구성", x["outline"], lambda o: F.concat(o["heading"], F.lit("="), o["summary"]), MOST["outline"], " | "),
        *[line(label, x["entities"][k], same, MOST["entities"], ", ") for k, label in ENTITIES],
        line("날짜", x["dates"], lambda d: F.concat(d["value"], F.lit("("), d["context"], F.lit(")")), MOST["dates"], " / "),
        F.when(F.size(x["numbers"]) > 0, F.concat(F.lit("수치(원문 근거 있음):\n"), F.array_join(F.transform(F.slice(x["numbers"], 1, MOST["numbers"]), number), "\n"))),
        *[line(label, x[k], same, MOST["lists"], " / ") for k, label in LISTS],
        line("링크", x["links"], same, MOST["links"], ", "),
        line("표기 정규화", x["normalized"], lambda n: F.concat(n["as_written"], F.lit("→"), n["meaning"]), MOST["normalized"], ", "),
    ]
    known = F.coalesce(F.schema_of_variant(F.try_parse_json(facts)).startswith("OBJECT"), F.lit(False))
    return F.when(known, F.array_join(F.array(*lines), "\n")).otherwise("")


def field_outline(specs: DataFrame) -> DataFrame:
    """type_id, outline: each type's sections, in order, with a line for each field and its inner fields."""
    fields = all_fields(specs)
    options = F.when(F.size("options") > 0, F.concat(F.lit(" 〔"), F.array_join("options", "·"), F.lit("〕"))).otherwise("")
    line = F.concat(F.lit("- "), F.col("key"), F.lit(" | "), F.col("label"), F.lit(" — "), F.col("kind"), options, F.when(F.col("required"), " (필수)").otherwise(""))
    told = fields.select("type_id", "parent_key", "key", "at", line.alias("line"))
    inner = told.where("parent_key IS NOT NULL").groupBy("type_id", F.col("parent_key").alias("key")).agg(F.sort_array(F.collect_list(F.struct("at", F.concat(F.lit("    "), "line").alias("line")))).alias("inner"))
    whole = F.concat_ws("\n", "line", F.array_join(F.transform("inner", lambda x: x["line"]), "\n"))
    top = told.where("parent_key IS NULL").join(inner, ["type_id", "key"], "left").select("type_id", "key", F.when(F.col("inner").isNull(), F.col("line")).otherwise(whole).alias("text"))
    placed = layout(specs).select("type_id", "section", "title", "collapsed", F.posexplode("keys").alias("nth", "key")).join(top, ["type_id", "key"])
    sections = placed.groupBy("type_id", "section", "title", "collapsed").agg(F.sort_array(F.collect_list(F.struct("nth", "text"))).alias("lines"))
    body = F.concat(F.lit("### "), F.col("title"), F.when(F.col("collapsed"), " (접힘)").otherwise(""), F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["text"]), "\n"))
    return sections.select("type_id", F.struct("section", body.alias("text")).alias("s")).groupBy("type_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["text"]), "\n\n").alias("outline"))


def reviewed(reviews: DataFrame, validator_issues: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What reviews (draft_id, answer in JSON) say: verdicts, issues and patches.

    verdicts: draft_id, verdict, reclassify_to, comment. issues: draft_id, ord,
    path, type, detail, severity, found_by: the validator's (draft_id, path,
    type, rule, severity) first, then the reviewer's. patches: draft_id, path,
    value: a value in JSON is read, any other text stands as it is, null is
    empty. An answer that isn't JSON says nothing.
    """
    shape = "verdict string, reclassifyTo string, comment string, issues array<struct<path:string,type:string,detail:string,severity:string>>, patch array<struct<path:string,valueJson:string>>"
    told = reviews.select("draft_id", F.from_json("answer", shape).alias("r")).where("r IS NOT NULL")
    verdicts = told.select("draft_id", F.col("r.verdict").alias("verdict"), F.col("r.reclassifyTo").alias("reclassify_to"), F.col("r.comment").alias("comment")).where("verdict IS NOT NULL")
    own = told.select("draft_id", F.posexplode("r.issues").alias("ord", "i")).select("draft_id", (F.col("ord") + 1_000_000).alias("ord"), "i.path", "i.type", "i.detail", "i.severity", F.lit("supervisor").alias("found_by"))
    first = validator_issues.select("draft_id", F.lit(0).alias("ord"), "path", "type", F.col("rule").alias("detail"), "severity", F.lit("validator").alias("found_by"))
    each = told.select("draft_id", F.explode("r.patch").alias("p")).select("draft_id", "p.path", F.col("p.valueJson").alias("raw"))
    parsed = F.try_parse_json("raw")
    kind = F.schema_of_variant(parsed)
    value = F.when(parsed.isNull(), F.col("raw")).when(kind == "VOID", F.lit(None).cast("string")).otherwise(F.coalesce(F.try_variant_get(parsed, "$", "string"), F.to_json(parsed)))
    return verdicts, first.unionByName(own), each.select("draft_id", "path", value.alias("value"))


def guides(gaps: DataFrame, types: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A15 without a model: what to ask about gaps, and which types to confirm.

    ``gaps``: draft_id, path, label, required, ord. The first table has draft_id,
    rank, path, label, priority, asked: required gaps first, questions for the
    first QUESTIONS. ``types``: draft_id, type_id, confidence, alternatives
    (array of type ids, best first); ``labels``: type_id, label. The second has
    draft_id, candidates (labels), question, for types below the least confidence.
    """
    ranked = ranked_gaps(gaps.withColumn("priority", F.when(F.col("required"), "high").otherwise("low")), QUESTIONS)
    unsure = types.where(F.col("confidence") < SURE_OF_TYPE)
    ids = F.slice(F.concat(F.array("type_id"), F.coalesce("alternatives", F.array().cast("array<string>"))), 1, CANDIDATES)
    named = unsure.select("draft_id", F.posexplode(ids).alias("nth", "type_id")).join(F.broadcast(labels), "type_id", "left").select("draft_id", "nth", F.coalesce("label", "type_id").alias("label"))
    listed = named.groupBy("draft_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "label"))), lambda x: x["label"]).alias("candidates"))
    question = F.concat(F.lit("이 활동이 '"), F.get("candidates", F.lit(0)), F.lit("'이 맞나요? 아니라면 아래에서 골라주세요."))
    return ranked.select("draft_id", "rank", "path", "label", "priority", "asked"), listed.withColumn("question", question)


def _blank(value: Column) -> Column:
    """Null, a word for nothing, or an empty list or object."""
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    return value.isNull() | (kind == "VOID") | ((kind == "STRING") & F.lower(trim(text)).isin(BLANK)) | kind.isin("ARRAY<VOID>", "OBJECT<>")


def coerced_value(value: Column, node: dict) -> Column:
    """A variant brought to a JSON schema's type, as a column of that type; rules as in ``coerced_record``."""
    kinds = node.get("type") or "string"
    kinds = kinds if isinstance(kinds, list) else [kinds]
    kind, nullable = next((k for k in kinds if k != "null"), "string"), "null" in kinds
    text = F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))
    if kind == "object":
        parts = [coerced_value(F.try_variant_get(value, f"$['{k}']", "variant"), p).alias(k) for k, p in (node.get("properties") or {}).items()]
        whole = F.struct(*parts)
        return F.when(~_blank(value), whole) if nullable else whole
    if kind == "array":
        listed = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))
        made = F.filter(F.transform(F.filter(listed, lambda v: ~_blank(v)), lambda v: coerced_value(v, node.get("items") or {"type": "string"})), lambda v: v.isNotNull())
        full = ~_blank(value) & (F.size(made) > 0)
        return F.when(full, made) if nullable else F.when(full, made).otherwise(F.filter(made, lambda v: F.lit(False)))
    options = [o for o in node.get("enum") or [] if isinstance(o, str)]
    if options:
        hit = match_enum(text, F.array(*[F.lit(o) for o in options]))
        return F.when(~_blank(value), hit if nullable else F.coalesce(hit, F.lit(options[0])))
    if kind == "boolean":
        truth = F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).otherwise(F.lower(text).isin(TRUE))
        return F.when(~_blank(value), truth)
    if kind in ("number", "integer"):
        digits = F.regexp_replace(text, r"[^0-9.\-]", "")
        number = F.when(digits == "", F.lit(0.0)).otherwise(digits.try_cast("double"))
        return F.when(~_blank(value), number if nullable else F.coalesce(number, F.lit(0.0)))
    return F.when(~_blank(value), trim(text))


def coerced_record(raw: Column, node: dict) -> Column:
    """A JSON text as a struct of a JSON schema (nested as deep as the schema).

    A word for nothing becomes null; keys that are missing are null; a value
    that should be a list is one of itself, blanks are left out of lists, and an
    empty list is null where null is allowed; an option is matched by name, else
    null, or the first option where null isn't allowed; truth words become true
    and others false; numbers are read without their units, what is none gives
    null, or 0 where null isn't allowed. Text that isn't JSON gives nulls.
    """
    return coerced_value(F.try_parse_json(raw), node)
