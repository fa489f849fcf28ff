"""Queries of what is shown to readers and read back from them, over small literals and the conversations, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import agents, evidence, lexicon, reports, schema
from ..session import table
from ..sources import ingest, kinds
from . import provider
from .document_queries import CLEAN_SQL, FOLD_SQL, _quoted
from .fixture_queries import _ALL, _LEXICON, Fixture, _lit
from .rule_sql import token_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_FULL = {
    "docType": "메모", "register": "구어체", "title": "텃밭", "outline": [{"heading": f"절{i}", "summary": f"요약{i}"} for i in range(22)], "entities": {"orgs": ["가게"], "people": [], "products": [f"p{i}" for i in range(17)], "tools": ["삽"]},
    "numbers": [{"value": str(i), "unit": "개" if i % 2 else None, "context": f"c{i}", "before": "1" if i % 3 == 0 else None, "after": None} for i in range(42)], "dates": [{"value": "5월", "context": "심은 날"}], "myActions": ["심기", "물 주기"], "teamActions": [], "unclear": ["누가"], "achievements": ["수확"], "problems": [], "learnings": ["기다림"],
    "links": [f"u{i}" for i in range(12)], "normalized": [{"as_written": "ㅇㅋ", "meaning": "좋다"}],
}
SHEETS = Fixture("id int, facts string", [(1, json.dumps(_FULL, ensure_ascii=False)), (2, '{"docType": "일기"}'), (3, None), (4, "not json"), (5, "{}")])
_ITEMS = lambda path, most, by, show: f"CASE WHEN json_array_length(j, '{path}') > 0 THEN array_to_string(list_transform(from_json(json_extract(j, '{path}'), '[\"JSON\"]')[1:{most}], lambda o: {show}), '{by}') END"
_LABELLED = lambda label, x: f"'{label}: ' || {x}"
_SHEET_LINES = [
    "'문서 성격: ' || coalesce(j ->> '$.docType', '?') || ' / 문체: ' || coalesce(j ->> '$.register', '?')", "'활동명 후보: ' || nullif(j ->> '$.title', '')",
    _LABELLED("구성", _ITEMS("$.outline", 20, " | ", "(o ->> '$.heading') || '=' || (o ->> '$.summary')")),
    *[_LABELLED(label, _ITEMS(f"$.entities.{k}", 15, ", ", "o ->> '$'")) for k, label in reports.ENTITIES],
    _LABELLED("날짜", _ITEMS("$.dates", 15, " / ", "(o ->> '$.value') || '(' || (o ->> '$.context') || ')'")),
    "'수치(원문 근거 있음):' || chr(10) || " + _ITEMS("$.numbers", 40, "\n", "'  · ' || (o ->> '$.value') || coalesce(o ->> '$.unit', '') || ' — ' || (o ->> '$.context') || CASE WHEN (o ->> '$.before') IS NOT NULL OR (o ->> '$.after') IS NOT NULL THEN ' [' || coalesce(o ->> '$.before', '?') || ' → ' || coalesce(o ->> '$.after', '?') || ']' ELSE '' END"),
    *[_LABELLED(label, _ITEMS(f"$.{k}", 15, " / ", "o ->> '$'")) for k, label in reports.LISTS], _LABELLED("링크", _ITEMS("$.links", 10, ", ", "o ->> '$'")), _LABELLED("표기 정규화", _ITEMS("$.normalized", 20, ", ", "(o ->> '$.as_written') || '→' || (o ->> '$.meaning')")),
]


@query(f"WITH s AS (SELECT id, coalesce(json_valid(facts), false) AS ok, CASE WHEN json_valid(facts) THEN CAST(facts AS JSON) END AS j FROM {SHEETS.sql('t')}) SELECT id, CASE WHEN ok THEN concat_ws(chr(10), {', '.join(_SHEET_LINES)}) ELSE '' END AS body FROM s")
def factsheet_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A04."""
    return SHEETS.df(spark).select("id", reports.factsheet_text(F.col("facts")).alias("body"))


_OPTIONS = {(t, f["key"]): f["options"] for t, fields in {"*": schema.common_fields(), **schema.SAMPLE}.items() for f in fields if f.get("options")}


@query(f"""WITH {_ALL}, o(type_id, key, options) AS (VALUES {', '.join(f"({_lit(t)}, {_lit(k)}, {_lit('·'.join(v))})" for (t, k), v in _OPTIONS.items())}),
l AS (SELECT f.*, row_number() OVER (PARTITION BY f.type_id ORDER BY own, ord) AS seat, '- ' || f.key || ' | ' || label || ' — ' || kind || coalesce(' 〔' || options || '〕', '') || CASE WHEN required THEN ' (필수)' ELSE '' END AS line FROM fields f LEFT JOIN o ON o.key = f.key AND f.parent_key IS NULL AND o.type_id = CASE WHEN own THEN f.type_id ELSE '*' END),
i AS (SELECT type_id, parent_key AS key, string_agg('    ' || line, chr(10) ORDER BY seat) AS inner_lines FROM l WHERE parent_key IS NOT NULL GROUP BY ALL),
t AS (SELECT l.type_id, l.seat, l.line || coalesce(chr(10) || inner_lines, '') AS text, CASE WHEN own THEN 1 WHEN l.key IN ('title', 'summary') THEN 0 WHEN l.key = 'evidence' THEN 3 ELSE 2 END AS zone, CASE WHEN own THEN coalesce(grp, l.type_id) WHEN l.key IN ('title', 'summary') THEN '제목/요약' WHEN l.key = 'evidence' THEN '증빙 자료' ELSE '확장 입력 (선택)' END AS title FROM l LEFT JOIN i USING (type_id, key) WHERE parent_key IS NULL),
s AS (SELECT type_id, zone, min(seat) AS first, '### ' || title || CASE WHEN zone = 2 THEN ' (접힘)' ELSE '' END || chr(10) || string_agg(text, chr(10) ORDER BY seat) AS body FROM t GROUP BY type_id, zone, title)
SELECT type_id, string_agg(body, chr(10) || chr(10) ORDER BY zone, first) AS outline FROM s GROUP BY type_id""")
def field_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15."""
    return reports.field_outline(schema.field_rows(spark))


REVIEWS = Fixture("draft_id int, answer string", [
    (1, json.dumps({"verdict": "revise", "reclassifyTo": None, "comment": "c", "issues": [{"path": "title", "type": "tone", "detail": "d", "severity": "minor"}, {"path": "x", "type": "t", "detail": None, "severity": "major"}], "patch": [{"path": "title", "valueJson": '"새 제목"'}, {"path": "n", "valueJson": "3"}, {"path": "gone", "valueJson": "null"}, {"path": "raw", "valueJson": "그냥 글"}, {"path": "list", "valueJson": '["a","b"]'}, {"path": "flag", "valueJson": "true"}]}, ensure_ascii=False)),
    (2, '{"verdict": "pass"}'), (3, "no json at all"), (4, None),
])
FOUND = Fixture("draft_id int, severity string, type string, path string, rule string", [(1, "blocker", "missing_required", "title", "V01"), (2, "minor", "format", "url", "V07")])
_REVIEWS = f"r AS (SELECT draft_id, CAST(answer AS JSON) AS j FROM {REVIEWS.sql('t')} WHERE json_valid(answer))"


@query(f"WITH {_REVIEWS}, i AS (SELECT draft_id, k, json_extract(j, '$.issues[' || k || ']') AS i FROM (SELECT draft_id, j, unnest(range(CAST(coalesce(json_array_length(j, '$.issues'), 0) AS BIGINT))) AS k FROM r)) SELECT draft_id, 0 AS ord, path, type, rule AS detail, severity, 'validator' AS found_by FROM {FOUND.sql('f')} UNION ALL SELECT draft_id, CAST(1000000 + k AS INTEGER), i ->> '$.path', i ->> '$.type', i ->> '$.detail', i ->> '$.severity', 'supervisor' FROM i")
def review_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validator's issues and the reviewer's."""
    return reports.reviewed(REVIEWS.df(spark), FOUND.df(spark))[1]


@query(f"WITH {_REVIEWS}, p AS (SELECT draft_id, json_extract(j, '$.patch[' || k || ']') AS p FROM (SELECT draft_id, j, unnest(range(CAST(coalesce(json_array_length(j, '$.patch'), 0) AS BIGINT))) AS k FROM r)), v AS (SELECT draft_id, p ->> '$.path' AS path, p ->> '$.valueJson' AS raw FROM p) SELECT draft_id, path, CASE WHEN NOT json_valid(raw) THEN raw WHEN json_type(raw) = 'NULL' THEN NULL ELSE CAST(raw AS JSON) ->> '$' END AS value FROM v")
def review_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches, values read from JSON where they are."""
    return reports.reviewed(REVIEWS.df(spark), FOUND.df(spark))[2]


@query(f"WITH {_REVIEWS} SELECT draft_id, j ->> '$.verdict' AS verdict, j ->> '$.reclassifyTo' AS reclassify_to, j ->> '$.comment' AS comment FROM r")
def review_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    return reports.reviewed(REVIEWS.df(spark), FOUND.df(spark))[0]


LACKING = Fixture("draft_id int, path string, label string, required boolean, ord int", [(1, f"f{k}", f"항목{k}", k in (3, 6), k) for k in range(7)] + [(2, "title", "제목", True, 0)])
JUDGED = Fixture("draft_id int, type_id string, confidence double, alternatives array<string>", [(1, "work.shift", 0.54, ["trip.visit", "study.lecture", "other"]), (2, "trip.visit", 0.55, ["work.shift"]), (3, "unknown.type", 0.1, None), (4, "study.lecture", 0.0, [])])
LABELS = Fixture("type_id string, label string", [("work.shift", "가게 일"), ("study.lecture", "강좌"), ("trip.visit", "나들이")])


@query(f"SELECT draft_id, row_number() OVER (PARTITION BY draft_id ORDER BY required DESC, ord) AS rank, path, label, CASE WHEN required THEN 'high' ELSE 'low' END AS priority, row_number() OVER (PARTITION BY draft_id ORDER BY required DESC, ord) <= 5 AS asked FROM {LACKING.sql('t')}")
def guide_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked about gaps."""
    return reports.guides(LACKING.df(spark), JUDGED.df(spark), LABELS.df(spark))[0]


@query(f"""WITH u AS (SELECT draft_id, list_concat([type_id], coalesce(CAST(alternatives AS VARCHAR[]), [])) AS ids FROM {JUDGED.sql('t')} WHERE confidence < 0.55), e AS (SELECT draft_id, unnest(range(1, least(len(ids), 3) + 1)) AS n, unnest(ids[1:3]) AS id FROM u),
c AS (SELECT draft_id, string_agg(coalesce(label, id), '|' ORDER BY n) AS candidates, arg_min(coalesce(label, id), n) AS best FROM e LEFT JOIN {LABELS.sql('l')} ON l.type_id = e.id GROUP BY draft_id)
SELECT draft_id, candidates, '이 활동이 ''' || best || '''이 맞나요? 아니라면 아래에서 골라주세요.' AS question FROM c""")
def type_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which types to confirm."""
    return reports.guides(LACKING.df(spark), JUDGED.df(spark), LABELS.df(spark))[1].withColumn("candidates", F.array_join("candidates", "|"))


SAID = Fixture("id int, said string", [(1, "work.shift"), (2, "강좌"), (3, " 동네 나들이 기록 "), (4, "가게"), (5, "전혀 다른 것"), (6, ""), (7, None), (8, "나")])


@query(f"""WITH s AS (SELECT id, said, trim(said) AS s FROM {SAID.sql('t')}), h AS (SELECT s.id, l.type_id, row_number() OVER (PARTITION BY s.id ORDER BY l.type_id <> s.s, l.type_id) AS nth FROM s JOIN {LABELS.sql('l')} ON l.type_id = s.s OR (length(s.s) > 0 AND (contains(lower(l.label), lower(s.s)) OR contains(lower(s.s), lower(l.label)))))
SELECT s.id, s.said, coalesce(h.type_id, 'work.shift') AS type_id FROM s LEFT JOIN h ON h.id = s.id AND nth = 1""")
def type_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C06."""
    return provider.type_by_label(SAID.df(spark), LABELS.df(spark), "work.shift")


NODE = {
    "type": "object",
    "properties": {
        "name": {"type": ["string", "null"]}, "level": {"type": ["string", "null"], "enum": ["상", "중", "하"]}, "must": {"type": "string", "enum": ["공개", "비공개"]}, "count": {"type": ["number", "null"]}, "least": {"type": "number"}, "done": {"type": ["boolean", "null"]},
        "tags": {"type": ["array", "null"], "items": {"type": "string"}}, "list": {"type": "array", "items": {"type": "string"}}, "span": {"type": ["object", "null"], "properties": {"start": {"type": ["string", "null"]}, "ongoing": {"type": ["boolean", "null"]}}},
    },
}
ANSWERS = Fixture("id int, raw string", [
    (1, '{"name": " 이름 ", "level": "중간", "must": "비 공개", "count": "약 1,234.5개", "least": 7, "done": "예", "tags": ["a", "없음", "b"], "list": "one", "span": {"start": "2024-01", "ongoing": true}}'),
    (2, '{"name": "미상", "level": "최고", "must": "모름", "count": "여럿", "least": "-", "done": "아니오", "tags": ["-"], "list": [], "span": {}}'), (3, "{}"), (4, "not json"), (5, '{"name": 5, "level": "하", "must": "공개", "count": -2, "least": "3점", "done": false, "tags": "x", "list": ["", "y"], "span": "none"}'),
])
_BLANKS = ", ".join(map(_lit, schema.BLANK))
_NONE = lambda x: f"(x.{x} IS NULL OR json_type(x.{x}) = 'NULL' OR (json_type(x.{x}) = 'VARCHAR' AND lower(trim(x.{x} ->> '$')) IN ({_BLANKS})) OR (json_type(x.{x}) = 'ARRAY' AND json_array_length(x.{x}) = 0) OR (json_type(x.{x}) = 'OBJECT' AND len(json_keys(x.{x})) = 0))"
_OPTION = lambda x, options: f"CASE WHEN NOT {_NONE(x)} THEN coalesce(list_filter({_lit(options)}, lambda o: o = replace(x.{x} ->> '$', ' ', ''))[1], list_filter({_lit(options)}, lambda o: contains(replace(x.{x} ->> '$', ' ', ''), o) OR contains(o, replace(x.{x} ->> '$', ' ', '')))[1]) END"
_NUMBER = lambda x: f"CASE WHEN regexp_replace(x.{x} ->> '$', '[^0-9.\\-]', '', 'g') = '' THEN 0.0 ELSE TRY_CAST(regexp_replace(x.{x} ->> '$', '[^0-9.\\-]', '', 'g') AS DOUBLE) END"
_ITEM_LIST = lambda x: f"list_filter(CASE WHEN json_type(x.{x}) = 'ARRAY' THEN from_json(x.{x}, '[\"VARCHAR\"]') ELSE [x.{x} ->> '$'] END, lambda v: lower(trim(v)) NOT IN ({_BLANKS}))"
_TRUE = lambda x: f"CASE WHEN NOT {_NONE(x)} THEN lower(x.{x} ->> '$') IN ('true', '예', 'yes', 'y', '1') END"


@query(f"""WITH a AS (SELECT id, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM {ANSWERS.sql('t')}),
x AS (SELECT id, {', '.join(f"json_extract(j, '$.{k}') AS {'many' if k == 'count' else 'few' if k == 'least' else 'items' if k == 'list' else k}" for k in NODE['properties'])}, json_extract(j, '$.span.start') AS start, json_extract(j, '$.span.ongoing') AS ongoing FROM a)
SELECT id, CASE WHEN NOT {_NONE('name')} THEN trim(x.name ->> '$') END AS name, {_OPTION('level', ['상', '중', '하'])} AS level, CASE WHEN NOT {_NONE('must')} THEN coalesce({_OPTION('must', ['공개', '비공개'])}, '공개') END AS must,
 CAST(CASE WHEN NOT {_NONE('many')} THEN {_NUMBER('many')} END AS DOUBLE) AS n_count, CAST(CASE WHEN NOT {_NONE('few')} THEN coalesce({_NUMBER('few')}, 0) END AS DOUBLE) AS n_least, {_TRUE('done')} AS done,
 CASE WHEN NOT {_NONE('tags')} AND len({_ITEM_LIST('tags')}) > 0 THEN array_to_string({_ITEM_LIST('tags')}, '|') END AS tags, CASE WHEN NOT {_NONE('items')} THEN array_to_string({_ITEM_LIST('items')}, '|') ELSE '' END AS list,
 CASE WHEN NOT {_NONE('start')} THEN x.start ->> '$' END AS span_start, {_TRUE('ongoing')} AS span_ongoing FROM x""")
def coerce_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole answers brought to a schema: numbers, booleans, nested objects, options."""
    r = reports.coerced_record(F.col("raw"), NODE)
    told = ANSWERS.df(spark).select("id", r.alias("r"))
    return told.select("id", "r.name", "r.level", "r.must", F.col("r.count").alias("n_count"), F.col("r.least").alias("n_least"), "r.done", F.array_join("r.tags", "|").alias("tags"), F.array_join("r.list", "|").alias("list"), F.col("r.span.start").alias("span_start"), F.col("r.span.ongoing").alias("span_ongoing"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", F.format_string("src%03d", "turn").alias("source_id"), F.col("role").alias("name"), F.lit("text").alias("kind"), F.when(F.col("role") == "user", 0.9).otherwise(0.7).alias("confidence"), "text")


_TURNS = "d AS (SELECT conv_id, printf('src%03d', turn) AS source_id, role AS name, CASE WHEN role = 'user' THEN 'high' ELSE 'fair' END AS band, CASE WHEN role = 'user' THEN 90 ELSE 70 END AS share, coalesce(text, '') AS text FROM conversations)"


@query(f"""WITH {_TURNS}, p AS (SELECT *, '<<<파일 sourceId=' || source_id || ' 이름="' || name || '" 형식=text 텍스트품질=' || band || '>>>' || chr(10) || CASE WHEN text = '' THEN '(텍스트 없음)' ELSE text END || chr(10) || '<<<파일 끝 sourceId=' || source_id || '>>>' AS part FROM d)
SELECT conv_id, md5(string_agg(part, chr(10) || chr(10) ORDER BY source_id, part)) AS bundle_md5 FROM p GROUP BY conv_id""")
def evidence_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation between marks that name them (all within the budget)."""
    return evidence.evidence_bundle(_turns(spark, sf_dir), "conv_id").select("conv_id", F.md5("bundle").alias("bundle_md5"))


@query(f"""WITH {_TURNS}, l AS (SELECT *, '- ' || name || ' (text, ' || regexp_replace(format('{{:,}}', length(text)), ',', ',', 'g') || '자, 품질 ' || share || '%)' AS line, '[' || source_id || ' ' || name || ']' || chr(10) || substr(text, 1, {evidence.DIGEST_CHARS}) AS shown FROM d)
SELECT conv_id, md5('[업로드된 파일 목록]' || chr(10) || string_agg(line, chr(10) ORDER BY source_id, line, shown) || chr(10) || chr(10) || '[본문 발췌]' || chr(10) || string_agg(shown, chr(10) || chr(10) ORDER BY source_id, line, shown)) AS digest_md5 FROM l GROUP BY conv_id""")
def classification_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A01."""
    return evidence.classification_digest(_turns(spark, sf_dir), "conv_id").select("conv_id", F.md5("digest").alias("digest_md5"))


_LONG = " ".join(f"문장 {i} 은 다른 이야기를 한다." for i in range(60))
PLACES = Fixture("doc int, raw string", [(1, f"{_LONG} 응답이 820ms 에서 210ms 로 줄었다. {_LONG} 결제 실패는 84건에서 21건이 되었다. {_LONG}"), (2, "짧은 글이다."), (3, _LONG)])
NEEDLES = Fixture("doc int, needle string, pad int", [(1, "응답이 820ms에서 210ms로 줄었다", 50), (1, "결제 실패는 84건에서 21건", 200), (1, "짧다", 10), (1, "결제 실패는 없었다고 한다", 30), (2, "없는 말을 찾는다", 20), (3, "문장 7 은 다른", 40), (3, "문장 8 은 다른", 40)])


@query(f"""WITH s AS (SELECT doc, raw, {FOLD_SQL} AS f FROM (SELECT doc, raw, raw AS text FROM {PLACES.sql('t')})), n AS (SELECT doc, needle, pad, {FOLD_SQL} AS nf FROM (SELECT doc, needle, pad, needle AS text FROM {NEEDLES.sql('t')})),
p AS (SELECT n.doc, needle, pad, raw, f, strpos(f, substr(nf, 1, 60)) AS whole, list_filter(list_transform(range(1, least(length(nf) - 3, 12) + 1), lambda i: strpos(f, substr(nf, i, 4))), lambda x: x > 0)[1] AS part FROM n JOIN s ON s.doc = n.doc WHERE length(nf) >= 6),
a AS (SELECT *, CAST(floor((CASE WHEN whole > 0 THEN whole ELSE part END - 1) * length(raw) / CAST(greatest(length(f), 1) AS DOUBLE)) AS BIGINT) AS place FROM p WHERE whole > 0 OR part IS NOT NULL),
h AS (SELECT doc, greatest(0, place - pad) AS x, least(length(raw), place + length(needle) + pad) AS y FROM a), o AS (SELECT *, CASE WHEN x <= max(y) OVER (PARTITION BY doc ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 120 THEN 0 ELSE 1 END AS o FROM h),
g AS (SELECT doc, min(x) AS x, max(y) AS y FROM (SELECT *, sum(o) OVER (PARTITION BY doc ORDER BY x, y) AS g FROM o) GROUP BY doc, g), u AS (SELECT doc, x, y, coalesce(sum(y - x) OVER (PARTITION BY doc ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM g),
c AS (SELECT u.doc, x, substr(raw, x + 1, CAST(least(y, x + 300 - used) - x AS BIGINT)) AS chunk FROM u JOIN s ON s.doc = u.doc WHERE used < 300), e AS (SELECT doc, string_agg(chunk, '…' || chr(10) ORDER BY x) AS e FROM c GROUP BY doc)
SELECT s.doc, coalesce(e, substr(raw, 1, 300)) AS evidence FROM s LEFT JOIN e ON e.doc = s.doc""")
def evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of a source around what is asked, within a budget."""
    sources = PLACES.df(spark).select("doc", "raw", N.fold(F.col("raw")).alias("folded"))
    return evidence.evidence_spans(NEEDLES.df(spark), sources, "doc", 300)


VALUES_OF = Fixture("draft_id int, path string, value string", [(1, f"f{k:03}", f"값 {k} 은 열두 글자보다 길다") for k in range(125)] + [(1, "a", "짧다"), (2, "title", "열두 글자보다 긴 제목이다"), (2, "none", None)])
PROOF = Fixture("draft_id int, path string, quotes array<string>", [(1, "a", ["인용 하나", "인용 둘"]), (2, "b", ["인용 하나", "인용 하나"]), (2, "c", [])])


@query(f"SELECT DISTINCT draft_id, unnest(quotes) AS needle, 260 AS pad FROM {PROOF.sql('p')} UNION SELECT draft_id, value, 180 FROM (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY path) AS nth FROM {VALUES_OF.sql('v')}) WHERE nth <= 120 AND length(value) > 12")
def evidence_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is looked for in a source."""
    return evidence.needles(VALUES_OF.df(spark), PROOF.df(spark))


TALK = Fixture("doc int, text string", [(1, "첫걸음을 내디뎠습니다 그리고 자전거에서 바이크로 바꿨다"), (2, "컨텐츠 API와 프로젝트 리더쉽 조깅 조깅"), (3, ""), (4, "및 등")])


@query(f"""WITH {_LEXICON}, k AS (SELECT doc, list_filter(list_transform(regexp_extract_all({CLEAN_SQL}, {_quoted(N.TOKEN)}), lambda x: {token_sql('x')}), lambda x: x <> '' AND NOT regexp_full_match(x, '[가-힣]') AND NOT list_contains({_lit(N.STOPWORDS)}, x)) AS w FROM {TALK.sql('t')}),
e AS (SELECT doc, CAST(unnest(range(0, len(w))) AS INTEGER) AS pos, unnest(w) AS token FROM k)
SELECT doc, pos, coalesce(a.canon, b.canon, {token_sql('token')}) AS term FROM e LEFT JOIN words a ON a.surface = {token_sql('token')} LEFT JOIN words b ON b.surface = lower(trim(token))""")
def analyzed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L12."""
    return lexicon.analyzed(TALK.df(spark), lexicon.build_lexicon(spark), "doc")


UPLOAD = Fixture("upload_id int, source_id string, content binary, given string", [(1, "src1", bytearray(b"12345"), None), (1, "src2", bytearray(b"123"), None), (1, "src3", None, "12"), (1, "src4", bytearray(b"1"), None), (2, "src1", bytearray(b"12345678901"), None), (2, "src2", None, None), (3, "src1", None, "1234567890")])


@query(f"SELECT upload_id, source_id FROM (SELECT *, sum(coalesce(octet_length(CAST(content AS BLOB)), length(CAST(given AS VARCHAR)), 0)) OVER (PARTITION BY upload_id ORDER BY source_id) AS used FROM {UPLOAD.sql('t')}) WHERE used <= 10")
def upload_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S02, W08."""
    return ingest.within_upload_cap(UPLOAD.df(spark), cap=10).select("upload_id", "source_id")


PHOTOS = Fixture("id int, content binary", [(1, bytearray(b"\xff\xd8\xff\xe1Exif\x002021:05:06 07:08:09\x00")), (2, bytearray(b"\xff\xd8none")), (3, bytearray(b"1899:01:01 00:00:00 2020:12:31 23:59:59")), (4, bytearray(b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR\x00\x00\x01\x40\x00\x00\x00\xf0\x08")), (5, None), (6, bytearray(b"GIF89a\x40\x01\xf0\x00")), (7, bytearray(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\xf0\x01\x40\x03"))])


@query(f"""WITH p AS (SELECT id, hex(CAST(content AS BLOB)) AS h FROM {PHOTOS.sql('t')}), d AS (SELECT id, h, regexp_extract(h, '^(?:..)*?((?:3139|3230)3[0-9]3[0-9]3A3[01]3[0-9]3A3[0-3]3[0-9]203[0-2]3[0-9]3A3[0-5]3[0-9]3A3[0-5]3[0-9])', 1) AS x FROM p),
s AS (SELECT id, x, CASE WHEN h LIKE '89504E47%' THEN substr(h, 33, 8) WHEN h LIKE '4749463839%' THEN substr(h, 15, 2) || substr(h, 13, 2) WHEN h LIKE 'FFD8%' THEN nullif(regexp_extract(h, '^(?:..)*?FFC0......(....)....', 1), '') || '' END AS w, CASE WHEN h LIKE '89504E47%' THEN substr(h, 41, 8) WHEN h LIKE '4749463839%' THEN substr(h, 19, 2) || substr(h, 17, 2) END AS y, CASE WHEN h LIKE 'FFD8%' THEN regexp_extract(h, '^(?:..)*?FFC0......(....)(....)', 2) END AS jw, CASE WHEN h LIKE 'FFD8%' THEN regexp_extract(h, '^(?:..)*?FFC0......(....)(....)', 1) END AS jh FROM d)
SELECT id, CASE WHEN x <> '' THEN regexp_replace(decode(unhex(substr(x, 1, 20))), ':', '-', 'g') || decode(unhex(substr(x, 21))) END AS taken, TRY_CAST('0x' || coalesce(nullif(jw, ''), CASE WHEN jw IS NULL THEN w END) AS INTEGER) AS width, TRY_CAST('0x' || coalesce(nullif(jh, ''), CASE WHEN jh IS NULL THEN y END) AS INTEGER) AS height FROM s""")
def photo_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date and size of pictures."""
    size = kinds.image_size(F.col("content"))
    return PHOTOS.df(spark).select("id", kinds.exif_date(F.col("content")).alias("taken"), size["width"].alias("width"), size["height"].alias("height"))


STAGES = Fixture("plan string, stage string, tier string, chars long, calls int, out_tokens long", [
    ("all to the reviewer", "classify", "pro", 7000, 1, 700), ("all to the reviewer", "extract", "pro", 36000, 3, 2500), ("all to the reviewer", "supervise", "pro", 34000, 3, 2500), ("all to the reviewer", "guide", "flash", 2000, 1, 700),
    ("evidence only", "factsheet", "flash", 33000, 1, 2500), ("evidence only", "classify", "flash", 7000, 1, 700), ("evidence only", "extract", "flash", 36000, 2, 2500), ("evidence only", "supervise", "pro", 2746, 1, 2500), ("evidence only", "guide", "flash", 2000, 1, 700),
])
TIERS = Fixture("tier string, in_price double, out_price double", [("pro", 1.25, 10.0), ("flash", 0.3, 2.5)])


@query(f"""WITH c AS (SELECT plan, tier, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(calls * CAST(floor(chars * 10 / 17.0) AS BIGINT)) AS BIGINT) AS in_tokens, CAST(sum(calls * out_tokens) AS BIGINT) AS out_tokens FROM {STAGES.sql('s')} GROUP BY ALL)
SELECT plan, c.tier, calls, in_tokens, out_tokens, round((in_tokens * in_price + out_tokens * out_price) / CAST(1000000 AS DOUBLE), 6) AS cost FROM c JOIN {TIERS.sql('p')} ON p.tier = c.tier""")
def cost_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: what two ways to ask cost, by payload; a token is 1.7 characters."""
    return agents.simulated_cost(STAGES.df(spark), TIERS.df(spark))

