"""The whole flow: files to filled, verified forms (the reference's main entry), as one plan of DataFrames.

Stages: ingest, classify, several drafts, normalise, merge, arbitrate, validate,
verify, evidence spans, review, rework, complete, form. Model steps go through
the provider module; its default are rules, so the flow runs without a network.
A review's patch is applied and all is validated once more: two passes, written
out, not looped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import agents, evidence, grounding, lexicon, merge, reports, schema, validation
from ..session import cut_lineage, ship
from . import provider


@dataclass
class Organized:
    """The tables of a result, by draft_id."""

    documents: DataFrame
    types: DataFrame
    leaves: DataFrame
    provenance: DataFrame
    issues: DataFrame
    completeness: DataFrame
    gaps: DataFrame
    conflicts: DataFrame
    evidence: DataFrame
    verdicts: DataFrame


@dataclass
class Grounds:
    """What values are checked against, each written once: plans stay small however often they are used."""

    fields: DataFrame
    typed: DataFrame
    sources: DataFrame
    numbers: DataFrame
    tokens: DataFrame
    names: DataFrame
    words: DataFrame
    clusters: DataFrame


def grounds(spark: SparkSession, docs: DataFrame, specs: DataFrame, typed: DataFrame) -> Grounds:
    typed = cut_lineage(typed)
    if (unknown := typed.join(specs.select("type_id").distinct(), "type_id", "left_anti").first()) is not None:
        raise ValueError(f"draft {unknown.draft_id} is of type {unknown.type_id}, which the catalogue lacks")
    return Grounds(
        cut_lineage(schema.all_fields(specs)), typed, cut_lineage(grounding.folded_sources(docs, "draft_id", order="source_id")), cut_lineage(docs.select("draft_id", F.explode(N.numbers_in(F.col("text"))).alias("num")).distinct()),
        cut_lineage(docs.select("draft_id", F.explode(N.tokenize(F.col("text"))).alias("token")).distinct()), cut_lineage(docs.select("draft_id", "name")), cut_lineage(lexicon.build_lexicon(spark)), cut_lineage(lexicon.seed_tables(spark)["clusters"]),
    )


def validators(leaves: DataFrame, provenance: DataFrame, held_by: Grounds) -> DataFrame:
    """Structural and grounding issues of all drafts together; ``leaves`` and ``provenance`` are cut from their lineage."""
    typed, sources, numbers = held_by.typed, held_by.sources, held_by.numbers
    fields = held_by.fields.select("type_id", "parent_key", "key", "kind", "required", "options", "free_options")
    types = typed.select("draft_id", "type_id")
    top = types.join(F.broadcast(fields.where("parent_key IS NULL")), "type_id").withColumn("path", F.col("key"))
    # The cells of each row of a repeater that has any.
    rows = leaves.select("draft_id", schema.root_key(F.col("path")).alias("parent_key"), F.regexp_extract("path", r"^([^.\[]+\[[0-9]+\])", 1).alias("row")).where("row <> ''").distinct()
    inner = types.join(F.broadcast(fields.where("parent_key IS NOT NULL")), "type_id").join(rows, ["draft_id", "parent_key"]).withColumn("path", F.concat("row", F.lit("."), "key")).drop("row")
    held = leaves.select("draft_id", "path", "value")
    filled = rows.select("draft_id", F.col("parent_key").alias("path"), F.lit("rows").alias("rows")).distinct()
    wanted = top.unionByName(inner).drop("parent_key")
    text = F.col("value")
    span = F.col("kind") == "daterange"
    dates = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([0-9]{4}(?:[-./][0-9]{1,2}){0,2})"), F.lit(1))
    day = lambda i: F.when(span, F.regexp_replace(F.get(dates, F.lit(i)), r"[./]", "-"))
    cells = wanted.join(held, ["draft_id", "path"], "left").join(filled, ["draft_id", "path"], "left").select(
        "draft_id", "path", "key", "kind", "required",
        F.when(span, F.lit(None).cast("string")).otherwise(F.coalesce(text, "rows")).alias("value"),
        F.when(F.col("kind").isin("tags", "checklist") & text.isNotNull(), F.split(text, r"\s*,\s*")).alias("items"),
        day(0).alias("start"), day(1).alias("end"), F.lit(None).cast("boolean").alias("ongoing"), "options", "free_options", ((F.col("kind") == "repeater") & text.isNotNull()).alias("malformed"),
    )
    structural = validation.structural_issues(cells)
    quotes = provenance.select("draft_id", "path", F.explode("quotes").alias("text")).withColumn("quote", F.xxhash64("draft_id", "path", "text"))
    table = grounding.quote_table(quotes.select("quote", "text").distinct(), "quote", "text")
    verified = grounding.verify_quotes(grounding.score_quotes(sources, table, "draft_id", pairs=quotes.select("draft_id", "quote").distinct()))
    told = verified.join(quotes.select("draft_id", "quote", "path"), ["draft_id", "quote"])
    claims = grounding.classify_numbers(validation.number_claims(leaves), numbers, "draft_id")
    terms = lexicon.checked_terms(cut_lineage(validation.term_claims(leaves)), sources, held_by.tokens, held_by.words, held_by.clusters, "draft_id")
    return structural.unionByName(validation.grounding_issues(leaves, provenance, held_by.names, cut_lineage(told), claims, cut_lineage(terms)))


def scored_drafts(normal: DataFrame, held_by: Grounds) -> DataFrame:
    """form_id, draft_id (its number), key, kind, value, score of each draft's fields; ``normal``: draft_id, draft, path, value, quotes."""
    sources, numbers, typed = held_by.sources, held_by.numbers, held_by.typed
    fields = held_by.fields.where("parent_key IS NULL").select("type_id", "key", "kind")
    rooted = normal.where("value IS NOT NULL").withColumn("key", schema.root_key(F.col("path")))
    quotes = rooted.select("draft_id", "draft", "key", F.explode("quotes").alias("text")).withColumn("quote", F.xxhash64("draft_id", "text"))
    table = grounding.quote_table(quotes.select("quote", "text").distinct(), "quote", "text")
    scores = grounding.score_quotes(sources, table, "draft_id", pairs=quotes.select("draft_id", "quote").distinct())
    by_quote = quotes.join(scores, ["draft_id", "quote"]).groupBy("draft_id", "draft", "key").agg(F.sort_array(F.collect_list("score")).alias("quote_scores"))
    told = rooted.select("draft_id", "draft", "key", F.explode(merge.numbers_of(F.col("value"))).alias("raw"))
    counted = grounding.classify_numbers(told, numbers, "draft_id").groupBy("draft_id", "draft", "key").agg(F.count("*").cast("int").alias("n_numbers"), F.count_if(F.col("kind") != "unknown").cast("int").alias("n_good"))
    cells = rooted.groupBy("draft_id", "draft", "key").agg(F.max(F.when(F.col("path") == F.col("key"), F.col("value"))).alias("value"), F.count_distinct(F.regexp_extract("path", r"(\[[0-9]+\])", 1)).cast("int").alias("filled_rows"))
    every = typed.select("draft_id", "type_id").join(F.broadcast(fields), "type_id").drop("type_id").join(cells, ["draft_id", "key"])
    whole = every.join(by_quote, ["draft_id", "draft", "key"], "left").join(counted, ["draft_id", "draft", "key"], "left").fillna(0, ["n_numbers", "n_good"])
    shown = whole.withColumn("value", F.coalesce("value", F.when(F.col("kind") == "repeater", F.concat(F.col("filled_rows").cast("string"), F.lit(" rows")))))
    return merge.field_scores(shown.withColumnRenamed("draft_id", "form_id").withColumnRenamed("draft", "draft_id"))


def merged_rows(normal: DataFrame, scored: DataFrame, fields: DataFrame) -> DataFrame:
    """A10: draft_id, path, value of the rows of repeaters over all drafts, those of the better draft first; a row's key is its repeater's first inner field."""
    inner = fields.where("parent_key IS NOT NULL")
    first = inner.groupBy(F.col("parent_key").alias("field")).agg(F.min_by("key", "ord").alias("first"))
    part = lambda i: F.regexp_extract("path", r"^([^.\[]+)\[([0-9]+)\]\.(.+)$", i)
    cells = normal.where(F.col("value").isNotNull() & F.col("path").contains("[")).select(F.col("draft_id").alias("form_id"), F.col("draft").alias("draft_id"), part(1).alias("field"), part(2).cast("int").alias("row"), part(3).alias("column"), "value")
    ranks = scored.select("form_id", F.col("key").alias("field"), "draft_id", F.row_number().over(Window.partitionBy("form_id", "key").orderBy(F.desc("score"), "draft_id")).alias("rank"))
    ranked = cells.join(ranks, ["form_id", "field", "draft_id"]).join(F.broadcast(first), "field")
    keys = ranked.where(F.col("column") == F.col("first")).select("form_id", "field", "draft_id", "row", F.col("value").alias("row_key"))
    keyed = ranked.join(keys, ["form_id", "field", "draft_id", "row"]).select("form_id", "field", "rank", "row", "row_key", "column", "value")
    merged = merge.merged_rows(keyed)
    order = keyed.groupBy("form_id", "field", N.fold(F.col("row_key")).alias("row_key")).agg(F.min(F.struct("rank", "row")).alias("at"))
    seat = order.withColumn("i", F.row_number().over(Window.partitionBy("form_id", "field").orderBy("at")) - 1)
    return merged.join(seat, ["form_id", "field", "row_key"]).select(F.col("form_id").alias("draft_id"), F.concat("field", F.lit("["), F.col("i").cast("string"), F.lit("]."), "column").alias("path"), "value")


def organize(spark: SparkSession, docs: DataFrame, catalogue: dict | None = None, patch: DataFrame | None = None, signals: dict[str, str] = provider.SIGNALS, drafts: DataFrame | None = None) -> Organized:
    """``docs``: draft_id, source_id, name, kind, text; documents of one draft_id make one form.

    ``drafts``: a model's evidence (draft_id, draft, ord, path, value,
    confidence, quote) in place of the rules'. The best draft of each field
    counts, close ones are decided by the source, rows of repeaters are merged;
    the review's patch, then ``patch``, is applied, and all is validated again.
    """
    ship(spark)
    specs = schema.field_rows(spark, catalogue)
    whole = docs.groupBy("draft_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source_id", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    held_by = grounds(spark, docs, specs, provider.classify(whole, signals=signals))
    typed, own, sources = held_by.typed, held_by.fields, held_by.sources
    told = drafts if drafts is not None else provider.drafts(whole, specs, typed)
    fields = own.where("parent_key IS NULL").select(F.col("key").alias("path")).distinct()
    pair = told.withColumn("draft_id", F.struct("draft_id", "draft"))
    normal = agents.normalized_extraction(pair.drop("draft"), fields).where("value IS NOT NULL")
    normal = cut_lineage(normal.select("draft_id.draft_id", "draft_id.draft", "path", "value", "confidence", "quotes"))
    scored = cut_lineage(scored_drafts(normal, held_by))
    best = merge.best_values(scored)
    conflicts = cut_lineage(merge.merge_conflicts(scored))
    decided = merge.arbitrated(conflicts, merge.decided_by_rule(conflicts, sources.withColumnRenamed("draft_id", "form_id")))
    chosen = best.where("kind <> 'repeater' AND value IS NOT NULL").join(decided.withColumnRenamed("value", "by_rule").withColumn("told", F.lit(True)), ["form_id", "key"], "left")
    flat = chosen.select(F.col("form_id").alias("draft_id"), F.col("key").alias("path"), F.when(F.col("told"), F.col("by_rule")).otherwise(F.col("value")).alias("value")).where("value IS NOT NULL")
    leaves = cut_lineage(flat.unionByName(merged_rows(normal, scored, own)))
    # The proof of a value: the quotes of the drafts that say it.
    said = normal.withColumn("root", schema.root_key(F.col("path"))).join(leaves.select("draft_id", F.col("path").alias("root"), F.col("value").alias("final")), ["draft_id", "root"], "left")
    proof = said.where((F.col("value") == F.col("final")) | F.col("path").contains("[")).groupBy("draft_id", F.col("root").alias("path")).agg(F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("quotes")))).alias("quotes"))
    provenance = cut_lineage(proof.where(F.size("quotes") > 0))
    valid = fields.select(F.col("path").alias("key"))
    first = cut_lineage(validators(leaves, provenance, held_by))
    needles = evidence.needles(leaves, provenance)
    spans = evidence.evidence_spans(needles, sources, "draft_id")
    verdicts, _, rework = reports.reviewed(provider.review(first), first)
    leaves, provenance = agents.apply_patch(leaves, rework, valid), agents.patched_provenance(provenance, rework)
    if patch is not None:
        leaves, provenance = agents.apply_patch(leaves, patch, valid), agents.patched_provenance(provenance, patch)
    leaves, provenance = cut_lineage(leaves), cut_lineage(provenance)
    issues = cut_lineage(validators(leaves, provenance, held_by))
    per_type = typed.select("draft_id", "type_id").join(F.broadcast(own.where("parent_key IS NULL").select("type_id", "key", F.when(F.col("required"), agents.REQUIRED_WEIGHT).otherwise(1).alias("w"))), "type_id")
    held = leaves.select("draft_id", schema.root_key(F.col("path")).alias("key")).distinct().withColumn("held", F.lit(1))
    both = per_type.join(held, ["draft_id", "key"], "left")
    done = both.groupBy("draft_id").agg(F.round(100 * F.sum(F.col("w") * F.coalesce("held", F.lit(0))) / F.sum("w")).cast("long").alias("completeness"))
    gaps = both.where("held IS NULL").select("draft_id", F.col("key").alias("path"), (F.col("w") > 1).alias("required"))
    return Organized(docs, typed, leaves, provenance, issues, done, gaps, conflicts.withColumnRenamed("form_id", "draft_id"), spans, verdicts)


def form_state(spark: SparkSession, result: Organized, catalogue: dict | None = None) -> DataFrame:
    """One row for each field of each form, in the order of its layout, with value, confidence, evidence, guide and attention.

    Below a repeater stand the fields of its rows (path "key[i].sub"), or, where
    it has none, those of an empty row to fill in (path "key[].sub", template).
    """
    specs = schema.field_rows(spark, catalogue)
    every = schema.all_fields(specs)
    fields = every.where("parent_key IS NULL").select("type_id", "key", "label", "kind", "required", "at")
    sections = schema.layout(specs).select("type_id", "section", "zone", "title", "collapsed", F.explode("keys").alias("key"))
    types = result.types.select("draft_id", "type_id")
    shown = types.join(F.broadcast(fields.join(sections, ["type_id", "key"])), "type_id").withColumns({"path": F.col("key"), "row": F.lit(-1), "inner": F.lit(-1), "template": F.lit(False)})
    rows = result.leaves.select("draft_id", schema.root_key(F.col("path")).alias("key"), F.regexp_extract("path", r"^[^.\[]+\[([0-9]+)\]", 1).alias("i")).where("i <> ''").distinct()
    inner = every.where("parent_key IS NOT NULL").select("type_id", F.col("parent_key").alias("key"), F.col("key").alias("sub"), F.col("label").alias("sub_label"), F.col("kind").alias("sub_kind"), F.col("required").alias("sub_required"), F.col("ord").alias("inner"))
    below = shown.where("kind = 'repeater'").drop("inner", "template", "row").join(F.broadcast(inner), ["type_id", "key"]).join(rows, ["draft_id", "key"], "left")
    below = below.select(
        "draft_id", "type_id", "key", F.col("sub_label").alias("label"), F.col("sub_kind").alias("kind"), F.col("sub_required").alias("required"), "at", "section", "zone", "title", "collapsed",
        F.concat("key", F.lit("["), F.coalesce("i", F.lit("")), F.lit("]."), "sub").alias("path"), F.coalesce(F.col("i").cast("int"), F.lit(0)).alias("row"), "inner", F.col("i").isNull().alias("template"),
    )
    values = result.leaves.select("draft_id", "path", "value")
    proof = result.provenance.select("draft_id", "path", "confidence", "quotes")
    gaps = result.gaps.select("draft_id", "path", F.when(F.col("required"), "high").otherwise("low").alias("guide"))
    attention = result.issues.where("severity <> 'minor'").select("draft_id", schema.root_key(F.col("path")).alias("key"), "rule").groupBy("draft_id", "key").agg(F.sort_array(F.collect_set("rule")).alias("attention"))
    out = shown.unionByName(below)
    for part in (values, proof, gaps):
        out = out.join(part, ["draft_id", "path"], "left")
    out = out.join(attention, ["draft_id", "key"], "left").withColumn("attention", F.when(F.col("row") < 0, F.col("attention")))
    return out.withColumn("filled", F.col("value").isNotNull())
