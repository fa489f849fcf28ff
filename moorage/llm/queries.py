"""The operators' queries over the driver's tables, and their SQL where there is any."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, table
from . import chat, decontaminate, fill_middle, license_scan, near_dedup, ngram_join, oracles, packing, pii, quality, sharding, spelling, toxicity, url_rules

SHARDS = 40


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    told = chat.canonical_turns(chat.records_of_turns(rows))
    return chat.digest_formatted(chat.format_turns(told), also=("fingerprint", "layout"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    return rows.withColumns({"base_failed": ~quality.verdict("base"), "kept": quality.verdict("v2")})


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of policy v2: what each rule fails, and what it alone rejects, from op8's ledger."""
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents")), "v2")


def quality_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All policies tried on one stored ledger."""
    return quality.trials(quality.store(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    form, output = F.col("fim.form"), F.col("fim.output")
    back = fill_middle.restored(output, form)
    lengths = {"prefix_chars": F.length("fim.prefix").cast("long"), "middle_chars": F.length("fim.middle").cast("long")}
    return made.select("doc_id", F.col("fim.n").alias("n"), form.alias("form"), *[c.alias(k) for k, c in lengths.items()], F.sha2(output, 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_licenses, op3_pii, op4_toxicity, op5_chat, op6_packing, op7_near_dedup, op8_quality, quality_ablations, quality_policies, op9_decontaminate, op10_url_rules, op11_spelling, op12_ngram_join, op13_fill_middle)
}

SQL = {
    "op2_licenses": oracles.licenses(),
    "op7_near_dedup": oracles.near_groups(),
    "op8_quality": oracles.ledger(),
    "quality_ablations": oracles.ablations("v2"),
    "quality_policies": oracles.trials(),
    "op11_spelling": oracles.spelling_groups(),
    "op12_ngram_join": oracles.ngram_groups(),
    "op13_fill_middle": oracles.fill_in_middle(),
    "op5_chat": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, substr(sha256('OBJECT<turns: ARRAY<OBJECT<role, text>>>'), 1, 16) AS fingerprint, 'turns' AS layout, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(15 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id""",
    "op10_url_rules": r"""
WITH after AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM after),
rules(rule_host, rule_path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hits AS (
  SELECT s.page_id, s.host, s.path, r.rule_host || r.rule_path AS rule, r.verdict,
    row_number() OVER (PARTITION BY s.page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS nth
  FROM split s LEFT JOIN rules r ON ('.' || s.host) LIKE ('%.' || r.rule_host) AND starts_with(s.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hits WHERE nth = 1""",
}
