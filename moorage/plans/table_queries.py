"""The operators of the flow over the driver's tables: conversations as drafts, orders as forms, parts as words, events as spans.

Inputs are derived by SELECTs that are written once and said in both dialects;
each operator and its SQL are those of the queries over literals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, hangul
from ..functions import normalize as N
from ..operators import agents, evidence, lexicon, merge, ocr, schema, validation
from ..session import table
from ..sources import kinds
from . import fixture_queries as X

QUERIES, SQL = {}, {}


class Dialect:
    """What the two engines say in other words."""

    def __init__(self, duck: bool):
        self.duck = duck

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]" if self.duck else f"array({', '.join(items)})"

    def words(self, items: list[str]) -> str:
        return self.array(*[f"'{x}'" for x in items])

    def at(self, items: list[str], index: str) -> str:
        """The item of a number from 0 on, whatever its size."""
        place = f"CAST(1 + ({index}) % {len(items)} AS INTEGER)"
        return f"({self.words(items)})[{place}]" if self.duck else f"element_at({self.words(items)}, {place})"

    def bytes_of(self, text: str) -> str:
        return f"encode({text})" if self.duck else f"encode({text}, 'UTF-8')"

    def seconds(self, time: str) -> str:
        return f"CAST(floor(epoch({time})) AS BIGINT)" if self.duck else f"CAST(floor(unix_micros(CAST({time} AS TIMESTAMP)) / 1000000) AS BIGINT)"

    def day(self, time: str) -> str:
        return f"strftime({time}, '%Y-%m-%d')" if self.duck else f"date_format({time}, 'yyyy-MM-dd')"

    def line(self) -> str:
        return "chr(10)"


DUCK, SPARK = Dialect(True), Dialect(False)


class Derived:
    """A SELECT over the driver's tables, in place of a table of literals."""

    def __init__(self, tables: str, select: Callable[[Dialect], str]):
        self.tables, self.select = tables.split(), select

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        held = {t: table(spark, sf_dir, t) for t in self.tables}
        text = self.select(SPARK)
        for t in self.tables:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
        return spark.sql(text, **held)


def _swapped(sql: str, literals: X.Fixture, by: Derived) -> str:
    found = False
    for alias in "abcdefghijklmnopqrstuvw":
        whole = literals.sql(alias)
        for renamed in (whole, whole.replace("start, end)", '"start", "end")'), whole.replace("start, end,", "s, e,"), whole.replace("row,", '"row",').replace("column,", '"column",')):
            if renamed in sql:
                found, sql = True, sql.replace(renamed, f"({by.select(DUCK)}) {alias}")
    if not found:
        raise ValueError("the SQL has no such literals")
    return sql


def query(base: str, *swaps: tuple[X.Fixture, Derived]):
    def add(f):
        sql = X.SQL[base]
        for literals, by in swaps:
            sql = _swapped(sql, literals, by)
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


#: Turns of a conversation as the values of a form: its title, its summary, then rows of a repeater.
_PATH = "CASE WHEN turn = 0 THEN 'title' WHEN turn = 1 THEN 'summary' WHEN turn % 2 = 0 THEN concat('tasks[', turn, '].name') ELSE concat('tasks[', turn, '].detail') END"
FORMS = Derived("conversations", lambda d: f"SELECT conv_id AS draft_id, {_PATH} AS path, text AS value FROM conversations")
PROOF = Derived("conversations", lambda d: "SELECT conv_id AS draft_id, CASE WHEN turn = 1 THEN 'summary' ELSE concat('tasks[', turn, ']') END AS path FROM conversations WHERE role = 'assistant' AND length(text) > 500")
PATCHES = Derived("conversations", lambda d: "SELECT conv_id AS draft_id, CASE WHEN turn = 0 THEN 'title' WHEN turn = 1 THEN 'bogus.x' ELSE concat('tasks[', turn, '].name') END AS path, CASE WHEN length(text) % 4 = 2 THEN NULL ELSE concat('patched ', turn) END AS value FROM conversations")


@query("completeness", (X.LEAVES, FORMS))
def conversation_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14, R07."""
    return agents.completeness(X.FIELDS.df(spark), FORMS.df(spark, sf_dir))


@query("empty_paths", (X.LEAVES, FORMS))
def conversation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, U03."""
    return agents.empty_paths(X.FIELDS.df(spark), FORMS.df(spark, sf_dir))


TEXTS = Derived("documents", lambda d: "SELECT doc_id AS draft_id, 'summary' AS path, text AS value FROM documents")


@query("number_claims", (X.LEAVES, TEXTS))
def document_number_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G07.3."""
    return validation.number_claims(TEXTS.df(spark, sf_dir))


@query("term_claims", (X.LEAVES, FORMS))
def conversation_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G07.4, J09."""
    return validation.term_claims(FORMS.df(spark, sf_dir))


@query("unproven_issues", (X.LEAVES, FORMS), (X.PROVENANCE, PROOF))
def conversation_unproven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G07.5, J06."""
    return validation.unproven_issues(FORMS.df(spark, sf_dir), PROOF.df(spark, sf_dir))


@query("patch_apply", (X.LEAVES, FORMS), (X.PATCH, PATCHES))
def conversation_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16, P03."""
    return agents.apply_patch(FORMS.df(spark, sf_dir), PATCHES.df(spark, sf_dir), X.FIELDS.df(spark).where("parent_key IS NULL"))


FILE_VALUES = Derived("pages", lambda d: "SELECT page_id AS draft_id, 'evidence' AS path, substr(url, 1 + CAST(page_id % 20 AS INTEGER)) AS value FROM pages")
FILE_NAMES = Derived("pages", lambda d: "SELECT page_id AS draft_id, substr(url, 9, 30) AS name FROM pages")


@query("file_issues", (X.LEAVES, FILE_VALUES), (X.UPLOADS, FILE_NAMES))
def page_file_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G07.2, J11."""
    return validation.file_issues(FILE_VALUES.df(spark, sf_dir), FILE_NAMES.df(spark, sf_dir))


def _cells(d: Dialect) -> str:
    """Orders as forms: a date, a span of time, a choice, a text, tags, a link and a long text of each."""
    start, end = ("s", "e") if d.duck else ("start", "end")
    none = "CAST(NULL AS STRING)"
    lists = f"CAST(NULL AS {'VARCHAR[]' if d.duck else 'ARRAY<STRING>'})"
    held = [
        ("orderDate", "date", "true", f"CASE WHEN o_orderkey % 3 = 0 THEN concat('on ', {d.day('o_orderdate')}) ELSE {d.day('o_orderdate')} END", lists, none, none, "NULL", lists),
        ("term", "daterange", "true", none, lists, d.day("o_orderdate"), "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE '1996-01' END", "CASE WHEN o_orderstatus = 'O' THEN true END", lists),
        ("status", "select", "false", "o_orderstatus", lists, none, none, "NULL", d.words(["O", "F"])),
        ("summary", "text", "false", "CASE WHEN o_custkey % 5 = 0 THEN concat(o_orderpriority, chr(10), 'x') WHEN o_custkey % 5 = 1 THEN repeat(o_orderpriority, 20) ELSE o_orderpriority END", lists, none, none, "NULL", lists),
        ("parts", "checklist", "false", none, d.array("o_orderstatus", "o_orderpriority"), none, none, "NULL", d.words(["O", "F", "1-URGENT", "5-LOW"])),
        ("url", "link", "false", "CASE WHEN o_custkey % 2 = 0 THEN concat('https://x.example/', o_orderkey) ELSE o_orderpriority END", lists, none, none, "NULL", lists),
        ("memo", "longtext", "true", "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE substr(o_orderpriority, 1, 5) END", lists, none, none, "NULL", lists),
    ]
    rows = [
        f"SELECT o_orderkey AS draft_id, '{key}' AS path, '{key}' AS key, '{kind}' AS kind, {need} AS required, {value} AS value, {items} AS items, {a} AS {start}, {b} AS {end}, CAST({ongoing} AS BOOLEAN) AS ongoing, {options} AS options, false AS free_options, o_orderkey % 11 = 0 AND '{kind}' = 'checklist' AS malformed FROM orders"
        for key, kind, need, value, items, a, b, ongoing, options in held
    ]
    return " UNION ALL ".join(rows)


CELLS = Derived("orders", _cells)


@query("structural_issues", (X.CELLS, CELLS))
def order_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V01-V08, V10."""
    return validation.structural_issues(CELLS.df(spark, sf_dir))


#: Turns of one role as drafts of a field; the scores of their quotes come from their lengths.
DRAFTS = Derived("conversations", lambda d: f"SELECT conv_id AS form_id, role AS key, CAST(turn AS INTEGER) AS draft_id, CASE WHEN role = 'user' THEN 'text' ELSE 'longtext' END AS kind, text AS value, {d.array('(length(text) % 997) / CAST(997 AS DOUBLE)')} AS quote_scores, CAST(turn % 3 AS INTEGER) AS n_numbers, CAST(turn % 2 AS INTEGER) AS n_good, 0 AS filled_rows FROM conversations")
HELD = Derived("conversations", lambda d: "SELECT conv_id AS form_id, lower(replace(text, '-', '')) AS folded FROM conversations WHERE turn = 0")
MISSING = Derived("conversations", lambda d: "SELECT conv_id AS form_id, CASE WHEN turn < 2 THEN role ELSE concat('none ', length(text) % 3) END AS path, role AS label, concat('turn ', turn) AS reason, CAST(turn AS INTEGER) AS ord FROM conversations")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.field_scores(DRAFTS.df(spark, sf_dir))


@query("merge_best", (X.DRAFTS, DRAFTS))
def conversation_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A08, A09, R04, W02."""
    return merge.best_values(_scored(spark, sf_dir)).select("form_id", "key", "value", "draft_id", F.round("score", 6).alias("score"))


@query("merge_conflicts", (X.DRAFTS, DRAFTS))
def conversation_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A09."""
    return merge.merge_conflicts(_scored(spark, sf_dir))


@query("merge_unfilled", (X.DRAFTS, DRAFTS), (X.MISSING, MISSING))
def conversation_unfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A09, W06."""
    return merge.unfilled(MISSING.df(spark, sf_dir), merge.best_values(_scored(spark, sf_dir)))


#: Lines of an order as rows of a repeater, said by several drafts; a row's key is its part's number.
_ROW = "CAST(l_linenumber % 3 AS INTEGER) AS rank, l_linenumber AS {q}row{q}, concat('part ', min(l_partkey) % 4) AS row_key, concat('c', min(l_suppkey) % 3) AS {q}column{q}, concat(min(l_returnflag), ' ', min(l_partkey)) AS value"
ROWS = Derived("lineitem", lambda d: f"SELECT l_orderkey AS form_id, 'items' AS field, {_ROW.format(q=chr(34) if d.duck else '')} FROM lineitem GROUP BY l_orderkey, l_linenumber")


@query("merge_rows", (X.ROWS, ROWS))
def lineitem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return merge.merged_rows(ROWS.df(spark, sf_dir))


EVIDENCE = Derived("conversations", lambda d: f"SELECT conv_id AS draft_id, CAST(turn AS INTEGER) AS ord, {d.at(['title', 'summary', 'period', 'tasks'], 'turn')} AS path, text AS value, (length(text) % 100) / CAST(100 AS DOUBLE) AS confidence, CASE WHEN length(text) % 3 > 0 THEN substr(text, 1, 30) END AS quote FROM conversations")


@query("extract_normalize", (X.EVIDENCE, EVIDENCE))
def conversation_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A07, R03, W06."""
    fields = X.FIELDS.df(spark).where("parent_key IS NULL").select(F.col("key").alias("path"))
    return agents.normalized_extraction(EVIDENCE.df(spark, sf_dir), fields).withColumn("quotes", F.array_join("quotes", "|"))


ISSUES = Derived("events", lambda d: "SELECT user_id AS draft_id, event_id AS ord, event_type AS path, 'format' AS type, props AS detail, CASE WHEN value > 50 THEN 'major' ELSE 'minor' END AS severity FROM events")
GAPS = Derived("orders", lambda d: "SELECT o_custkey AS draft_id, concat('order ', o_orderkey) AS path, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority, o_orderkey AS ord FROM orders")
CALLS = Derived("events", lambda d: "SELECT event_type AS tier, event_id % 5000 AS in_tokens, user_id % 700 AS out_tokens FROM events")
PRICES = Derived("events", lambda d: "SELECT DISTINCT event_type AS tier, CAST(length(event_type) AS DOUBLE) AS in_price, CAST(length(event_type) * 3 AS DOUBLE) AS out_price FROM events")
MODELS = Derived("part", lambda d: "SELECT DISTINCT concat('gen-', p_size, '.', p_partkey % 10, CASE WHEN p_partkey % 3 = 0 THEN '-pro' WHEN p_partkey % 3 = 1 THEN '-flash' ELSE '' END, CASE WHEN p_size % 5 = 0 THEN '-preview' ELSE '' END) AS model FROM part")


@query("issue_dedupe", (X.ISSUES, ISSUES))
def event_first_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17, W06, U01."""
    return agents.merge_issues(ISSUES.df(spark, sf_dir))


@query("gap_ranking", (X.GAPS, GAPS))
def order_gap_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15, T03."""
    return agents.ranked_gaps(GAPS.df(spark, sf_dir)).select("draft_id", "path", "rank", "asked")


@query("cost_by_tier", (X.CALLS, CALLS), (X.PRICES, PRICES))
def event_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22, R10."""
    return agents.cost_by_tier(CALLS.df(spark, sf_dir), PRICES.df(spark, sf_dir))


@query("model_pick", (X.MODELS, MODELS))
def part_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19, T02."""
    return agents.ranked_models(MODELS.df(spark, sf_dir))


#: What users do, as spans of text places: some meet, some lie near each other.
SPANS = Derived("events", lambda d: f"SELECT user_id AS doc, (event_id * 7919) % 20000 AS {'"start"' if d.duck else 'start'}, (event_id * 7919) % 20000 + event_id % 300 + 1 AS {'"end"' if d.duck else 'end'} FROM events")


@query("span_merge", (X.SPANS, SPANS))
def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A06, W03."""
    return evidence.merged_spans(SPANS.df(spark, sf_dir), "doc")


@query("span_budget", (X.SPANS, SPANS))
def event_span_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A06, W04."""
    return evidence.budgeted_spans(evidence.merged_spans(SPANS.df(spark, sf_dir), "doc"), "doc", 400)


SENTENCES = Derived("documents", lambda d: "SELECT doc_id AS id, text FROM documents")


@query("sentence_split", (X.TEXTS, SENTENCES))
def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N09."""
    return SENTENCES.df(spark, sf_dir).select("id", F.explode(N.sentences(F.col("text"))).alias("sentence"))


_STEMS = "개선 프로젝트 구현 향상 한글 서비스 데이터 분석 컨텐츠 주도 캐리 첫걸음 끝내기 조깅 산책 회고 자전거 과일 플젝 없는말 값 가".split()
_TAILS = ["", *"했습니다 에서 하였으며 로 를 이라고는 으로서 한다 됐음 시켰다 의 은 하기 스럽게".split()]
#: Words of parts: a stem and what follows it, by the part's number and size.
WORDS = Derived("part", lambda d: f"SELECT DISTINCT concat({d.at(_STEMS, 'p_partkey')}, {d.at(_TAILS, 'p_size')}) AS w FROM part")
PAIRS = Derived("part", lambda d: f"SELECT DISTINCT {d.at(_STEMS, 'p_partkey')} AS a, {d.at([*_STEMS[5:], '게선', '프로젝드', '컨텐스', '자전가', '서비쓰'], 'p_size')} AS b FROM part")
TOKENS = Derived("part", lambda d: f"SELECT DISTINCT concat({d.at(_STEMS, 'p_partkey')}, {d.at(_TAILS, 'p_size')}) AS token FROM part")


@query("particle_stem", (X.WORDS, WORDS))
def part_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N03, N04."""
    w = F.col("w")
    return WORDS.df(spark, sf_dir).select("w", N.strip_particle(w).alias("bare"), N.stem(w).alias("stem"), N.stem(N.strip_particle(w)).alias("both"))


@query("jamo_decompose", (X.WORDS, WORDS))
def part_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N11."""
    return WORDS.df(spark, sf_dir).select("w", hangul.decompose(F.col("w")).alias("letters"))


@query("jamo_similarity", (X.PAIRS, PAIRS))
def part_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N12, N14."""
    return PAIRS.df(spark, sf_dir).select("a", "b", F.round(hangul.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


# The SQL's distance has no cap.
SQL["part_similarity"] = f"SELECT a, b, similarity FROM ({SQL['part_similarity']})"


@query("typo_variants", (X.WORDS, WORDS))
def part_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N15."""
    return WORDS.df(spark, sf_dir).select("w", F.posexplode(hangul.typo_variants(F.col("w"))).alias("n", "variant"))


@query("canonical_tokens", (X.TOKENS, TOKENS))
def part_canons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L09, J02."""
    return lexicon.with_canon(TOKENS.df(spark, sf_dir), lexicon.build_lexicon(spark))


@query("expand_tokens", (X.TOKENS, TOKENS))
def part_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L08, L11, U02."""
    return lexicon.expanded(TOKENS.df(spark, sf_dir), lexicon.build_lexicon(spark), lexicon.seed_tables(spark)["clusters"])


FILES = Derived("pages", lambda d: f"SELECT url AS name, CASE WHEN page_id % 3 = 0 THEN 'text/html; charset=utf-8' END AS mime, {d.bytes_of('html')} AS content FROM pages")


@query("kind_detect", (X.FILES, FILES))
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S05-S07, S09, S10."""
    return FILES.df(spark, sf_dir).select("name", F.hex("content").alias("content_hex"), kinds.detect_kind(F.col("name"), F.col("mime"), F.col("content")).alias("kind"))


READS = Derived("conversations", lambda d: "SELECT conv_id * 1000 + turn AS id, text AS a, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), substr(text, 3)) AS b FROM conversations")
HEIGHTS = Derived("part", lambda d: "SELECT p_partkey AS image, CAST(p_size * 300 + p_partkey % 100 AS INTEGER) AS height FROM part")


@query("dice_consensus", (X.READS, READS))
def turn_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O01, O02, U04."""
    return ocr.dice(READS.df(spark, sf_dir), "id", "a", "b").select("id", F.round("dice", 9).alias("dice"))


@query("image_tiles", (X.HEIGHTS, HEIGHTS))
def part_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O06."""
    return ocr.tiles(HEIGHTS.df(spark, sf_dir))


_BY = "CASE WHEN c_custkey % 2 = 0 THEN ',' ELSE chr(9) END"
SHEETS = Derived("customer", lambda d: f"SELECT concat('c', c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '.csv' ELSE '.tsv' END) AS name, concat('name', {_BY}, 'segment', CASE WHEN c_custkey % 3 = 0 THEN chr(10) ELSE '' END, chr(10), c_name, {_BY}, c_mktsegment, chr(10), {_BY}, c_nationkey) AS text FROM customer")


@query("csv_pairs", (X.TABLES, SHEETS))
def customer_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13."""
    return SHEETS.df(spark, sf_dir).select("name", formats.delimited_to_text(F.col("text"), F.col("name")).alias("out"))


FENCED = Derived("events", lambda d: "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN concat('```json', chr(10), props, chr(10), '```') WHEN event_id % 3 = 1 THEN concat('```', props, '``` ') ELSE props END AS text FROM events")


@query("code_fence", (X.FENCED, FENCED))
def event_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13."""
    return FENCED.df(spark, sf_dir).select("id", schema.without_fence(F.col("text")).alias("body"))
