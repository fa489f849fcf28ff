"""Queries over small tables of literals, the same on both sides, for operators that the driver's tables have no input for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, hangul
from ..functions import normalize as N
from ..operators import agents, evidence, lexicon, merge, ocr, schema, validation
from ..sources import kinds
from . import rule_sql
from .document_queries import CLEAN_SQL

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _lit(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return str(x)
    if isinstance(x, list):
        return "[" + ", ".join(map(_lit, x)) + "]"
    if isinstance(x, (bytes, bytearray)):
        return f"unhex('{x.hex()}')"
    return "'" + x.replace("'", "''") + "'"


class Fixture:
    """Rows and columns with types, as a DataFrame and as SQL."""

    def __init__(self, columns: str, rows: list[tuple]):
        self.columns, self.rows = columns, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.columns)

    def sql(self, name: str) -> str:
        names = [c.split()[0] for c in self.columns.split(", ")]
        return f"(VALUES {', '.join('(' + ', '.join(map(_lit, r)) + ')' for r in self.rows)}) {name}({', '.join(names)})"


WORDS = Fixture("w string", [(w,) for w in ["개선했습니다", "프로젝트에서", "구현하였으며", "향상", "a가b", "한글", "서비스로", "데이터를", "이라고는", "Node.js", "18,799", "1만", "06", "3.10천", "API."]])
_PARTICLE = f"CASE WHEN length(w) <= 2 THEN w ELSE regexp_replace(w, '^(.{{2,}}?)(?:{'|'.join(N.PARTICLES)})$', '\\1') END"


def _ending(x: str) -> str:
    one = f"regexp_replace({x}, '^(.{{2,}}?)(?:{'|'.join(N.ENDINGS)})$', '\\1')"
    return f"regexp_replace({one}, '^(.{{2,}}?)(?:{'|'.join(N.ENDINGS)})$', '\\1')"


@query(f"SELECT w, {_PARTICLE} AS bare, {_ending('w')} AS stem, {_ending(_PARTICLE)} AS both FROM {WORDS.sql('t')}")
def particle_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N03, N04."""
    w = F.col("w")
    return WORDS.df(spark).select("w", N.strip_particle(w).alias("bare"), N.stem(w).alias("stem"), N.stem(N.strip_particle(w)).alias("both"))


@query(f"""WITH c AS (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM {WORDS.sql('t')}), u AS (SELECT w, i, substr(w, i, 1) AS c, unicode(substr(w, i, 1)) - 44032 AS x FROM c)
SELECT w, string_agg(CASE WHEN x BETWEEN 0 AND 11171 THEN substr({_lit(hangul.CHO)}, x // 588 + 1, 1) || substr({_lit(hangul.JUNG)}, (x % 588) // 28 + 1, 1) || {_lit(hangul.JONG)}[x % 28 + 1] ELSE c END, '' ORDER BY i) AS letters FROM u GROUP BY w""")
def jamo_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N11."""
    return WORDS.df(spark).select("w", hangul.decompose(F.col("w")).alias("letters"))


PAIRS = Fixture("a string, b string", [("개선", "게선"), ("개선", "향상"), ("프로젝트", "프로젝드"), ("", ""), ("가", ""), ("했다", "하다"), ("abc", "abd"), ("콘텐츠", "컨텐츠")])


@query(f"""WITH RECURSIVE pairs AS (SELECT * FROM {PAIRS.sql('t')}), {rule_sql.distances('pairs', 'far')}
SELECT a, b, CASE WHEN longest = 0 THEN 1.0 ELSE round(greatest(0, 1 - d / longest), 6) END AS similarity, CAST(round(d, 6) AS DOUBLE) AS distance FROM far""")
def jamo_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N12-N14."""
    p = PAIRS.df(spark)
    return p.select("a", "b", F.round(hangul.similarity(F.col("a"), F.col("b")), 6).alias("similarity"), F.round(hangul.weighted_distance(F.col("a"), F.col("b")), 6).alias("distance"))


@query(f"WITH src AS (SELECT w AS word FROM {WORDS.sql('t')}), {rule_sql.typos('src', 'wrong', 6)} SELECT word AS w, CAST(t AS INTEGER) AS n, variant FROM wrong")
def typo_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N15."""
    return WORDS.df(spark).select("w", F.posexplode(hangul.typo_variants(F.col("w"))).alias("n", "variant"))


NUMBERS = Fixture("raw string", [(x,) for x in ["18,799", "1만", "06", "1.5억", "3 천", "12345678901234567890", "0.5", "2024.06.24", "약 3", "", "7조", "100.0"]])


@query(f"""WITH s AS (SELECT raw, regexp_replace(raw, '[, ]', '', 'g') AS s FROM {NUMBERS.sql('t')}), m AS (SELECT raw, s, regexp_extract(s, '^([0-9]+(?:\\.[0-9]+)?)([천만억조])?$', 1) AS d, regexp_extract(s, '^([0-9]+(?:\\.[0-9]+)?)([천만억조])?$', 2) AS u FROM s)
SELECT raw, CASE WHEN d = '' THEN s ELSE regexp_replace(CAST(CAST(CAST(CAST(d AS DOUBLE) * CASE u WHEN '천' THEN 1e3 WHEN '만' THEN 1e4 WHEN '억' THEN 1e8 WHEN '조' THEN 1e12 ELSE 1 END AS VARCHAR) AS DECIMAL(38,15)) AS VARCHAR), '\\.?0+$', '') END AS num FROM m""")
def number_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N05."""
    return NUMBERS.df(spark).select("raw", N.normalize_number(F.col("raw")).alias("num"))


TEXTS = Fixture("id int, text string", [
    (1, "첫 문장이다. 둘째 문장! 3.5점을 받았다? 끝"), (2, "- 항목 하나\n1) 항목 둘\n12\n| --- | --- |\n----\n표 | 값"), (3, "page 3 / 10 본문 «불명» 계속\n\n\n\n다음"), (4, "Team built API v2.0.\nUsed Node.js and C++."), (5, ""), (6, "  가. 나머지  "),
])


@query(f"""WITH c AS (SELECT id, {CLEAN_SQL} AS c FROM {TEXTS.sql('t')}), p AS (SELECT id, unnest(string_split_regex(regexp_replace(c, '([.!?。])\\s+', '\\1' || chr(1), 'g'), '[\\x01]|\\n+')) AS s FROM c)
SELECT id, trim(s, ' ' || chr(10) || chr(9)) AS sentence FROM p WHERE length(trim(s, ' ' || chr(10) || chr(9))) >= 2""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N09."""
    return TEXTS.df(spark).select("id", F.explode(N.sentences(F.col("text"))).alias("sentence"))


FILES = Fixture("name string, mime string, content binary", [
    ("a.PDF", None, bytearray(b"%PDF-1.7 x")), ("b.txt", None, bytearray(b"\x89PNG\r\n\x1a\n1")), ("c.docx", None, bytearray(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")), ("d.ppt", None, bytearray(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")),
    ("e.webp", None, bytearray(b"RIFF1234WEBP")), ("f.zip", None, bytearray(b"PK\x03\x04abcd")), ("g.xlsx", None, bytearray(b"PK\x03\x04abcd")), ("notes", None, bytearray(b"plain text here")), ("notes", None, None), ("h", "text/html; charset=utf-8", bytearray(b"<a>")),
    ("i", "application/vnd.ms-excel", None), ("j", None, bytearray(b"\x00\x01\x02\x03")), ("k.tar.gz", None, bytearray(b"\x1f\x8b\x08\x00\x00\x00\x00\x00")), ("l.unknownext", None, bytearray(b"\x01\x02\x03")), (" m.Md ", None, None),
])
_EXT = "lower(regexp_extract(trim(name), '\\.([A-Za-z0-9]+)$', 1))"
_BY_EXT = "CASE " + " ".join(f"WHEN {_EXT} IN ({', '.join(map(_lit, names.split()))}) THEN {_lit(kind)}" for kind, names in kinds.EXTENSIONS.items()) + " END"
_BY_SIG = "CASE WHEN octet_length(content) < 8 THEN NULL " + " ".join(f"WHEN starts_with(hex(content), {_lit(s)}) THEN {_lit(kind)}" for s, kind in kinds.SIGNATURES) + " END"
_BY_MIME = "CASE " + " ".join(f"WHEN regexp_matches(mime, {_lit(p)}) THEN {_lit(kind)}" for p, kind in kinds.MIME) + " END"


@query(f"""WITH f AS (SELECT name, mime, hex(content) AS h, {_BY_EXT} AS e, {_BY_SIG} AS s, {_BY_MIME} AS m FROM (SELECT name, CAST(mime AS VARCHAR) AS mime, CAST(content AS BLOB) AS content FROM {FILES.sql('t')}))
SELECT name, h AS content_hex, CASE WHEN s <> 'archive' AND e <> s AND s = 'hwp' AND e IN ('docx', 'xlsx') THEN e WHEN s <> 'archive' AND e <> s THEN s
 ELSE coalesce(e, s, m, CASE WHEN length(h) > 0 AND NOT regexp_matches(h, '^(..)*00') AND len(regexp_extract_all(h, '..')) * 0.02 > len(list_filter(regexp_extract_all(h, '..'), lambda b: regexp_full_match(b, '0[1-8EF]|1.'))) THEN 'text' END, 'unknown') END AS kind FROM f""")
def kind_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S05-S07, S09, S10."""
    return FILES.df(spark).select("name", F.hex("content").alias("content_hex"), kinds.detect_kind(F.col("name"), F.col("mime"), F.col("content")).alias("kind"))


ENTRIES = Fixture("id int, names array<string>", [(1, ["word/document.xml"]), (2, ["ppt/slides/slide1.xml", "xl/a"]), (3, ["xl/workbook.xml"]), (4, ["Contents/section0.xml"]), (5, ["version.xml"]), (6, ["mimetype"]), (7, ["a.txt", "META-INF/x"]), (8, ["a.txt"])])


@query(f"""SELECT id, CASE WHEN len(list_filter(names, lambda n: starts_with(n, 'word/'))) > 0 THEN 'docx' WHEN len(list_filter(names, lambda n: starts_with(n, 'ppt/'))) > 0 THEN 'pptx' WHEN len(list_filter(names, lambda n: starts_with(n, 'xl/'))) > 0 THEN 'xlsx'
 WHEN len(list_filter(names, lambda n: contains(n, 'Contents/section') OR n = 'version.xml')) > 0 THEN 'hwp' WHEN len(list_filter(names, lambda n: n = 'mimetype' OR starts_with(n, 'META-INF/'))) > 0 THEN 'docx' ELSE 'archive' END AS kind FROM {ENTRIES.sql('t')}""")
def zip_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S08."""
    return ENTRIES.df(spark).select("id", kinds.refine_zip(F.col("names")).alias("kind"))


TABLES = Fixture("name string, text string", [("a.csv", "항목,수치\n전환율,12%\n빈칸,\n\n짧음"), ("b.tsv", "h1\th2\nx\ty,z"), ("c.csv", "one line")])


@query(f"""WITH l AS (SELECT name, text, list_filter(string_split_regex(text, '\\r?\\n'), lambda x: trim(x) <> '') AS lines, CASE WHEN ends_with(name, '.tsv') THEN chr(9) ELSE ',' END AS d FROM {TABLES.sql('t')}),
s AS (SELECT name, text, len(lines) AS n, list_transform(lines, lambda x: string_split(x, d)) AS cells FROM l),
r AS (SELECT name, text, n, cells[1] AS h, list_transform(cells[2:], lambda r: array_to_string(list_filter(list_transform(range(1, len(cells[1]) + 1), lambda i: trim(cells[1][i]) || ': ' || trim(coalesce(r[i], ''))), lambda p: NOT ends_with(p, ': ')), ' | ')) AS b FROM s)
SELECT name, CASE WHEN n < 2 THEN text ELSE '[표: ' || name || ']' || chr(10) || '열: ' || array_to_string(h, ' | ') || chr(10) || array_to_string(b, chr(10)) END AS out FROM r""")
def csv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13."""
    return TABLES.df(spark).select("name", formats.delimited_to_text(F.col("text"), F.col("name")).alias("out"))


SUBTITLES = Fixture("id int, raw string", [(1, "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\n안녕하세요\n\n2\n00:00:03.000 --> 00:00:04.000\n둘째 줄"), (2, "12\r\ntext 12\r\n"), (3, "")])


@query(f"SELECT id, trim(regexp_replace(array_to_string(list_filter(string_split_regex(raw, '\\r?\\n'), lambda l: NOT regexp_full_match(trim(l), '[0-9]+') AND NOT contains(l, '-->') AND NOT starts_with(trim(l), 'WEBVTT')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS out FROM {SUBTITLES.sql('t')}")
def subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S17."""
    return SUBTITLES.df(spark).select("id", formats.subtitles_to_text(F.col("raw")).alias("out"))


MAILS = Fixture("id int, raw string", [(1, "From: a@x.example\nSubject:  Hello there \nDate: Mon\n\n<p>Body</p> text"), (2, "no header at all"), (3, "Subject: crlf\r\nTo: b\r\n\r\nbody")])


@query(f"""WITH m AS (SELECT id, raw, strpos(raw, chr(10) || chr(10)) AS e FROM {MAILS.sql('t')}), h AS (SELECT id, CASE WHEN e > 0 THEN substr(raw, 1, e - 1) ELSE '' END AS head FROM m)
SELECT id, nullif(trim(regexp_extract(head, '(?im)^Subject:\\s*(.+)$', 1)), '') AS subject, nullif(trim(regexp_extract(head, '(?im)^From:\\s*(.+)$', 1)), '') AS sender, nullif(trim(regexp_extract(head, '(?im)^To:\\s*(.+)$', 1)), '') AS recipient FROM h""")
def email_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S19."""
    parts = MAILS.df(spark).select("id", formats.email_parts(F.col("raw")).alias("p"))
    return parts.select("id", "p.subject", "p.sender", "p.recipient")


RTF = Fixture("id int, raw string", [(1, "{\\rtf1\\ansi Hello \\b bold\\b0  text}"), (2, "plain")])


@query(f"SELECT id, trim(regexp_replace(regexp_replace(raw, '\\\\[a-z]+-?[0-9]*\\s?', '', 'g'), '[{{}}]', '', 'g')) AS out FROM {RTF.sql('t')}")
def rtf_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S18."""
    return RTF.df(spark).select("id", formats.rtf_to_text(F.col("raw")).alias("out"))


XML = Fixture("id int, xml string", [(1, "<w:p><w:t>A &amp; B</w:t><w:tab/></w:p><w:tr><w:tc>1</w:tc><w:tc>2</w:tc></w:tr>"), (2, "<a:p>slide &lt;1&gt;</a:p>\n\n\n\n<a:p>&quot;q&apos;</a:p>")])


def _chain(x: str, steps: list[tuple[str, str]]) -> str:
    for p, by in steps:
        x = f"regexp_replace({x}, {_lit(p)}, {_lit(by)}, 'g')"
    return x


@query(f"SELECT id, trim({_chain('xml', formats.OOXML_STEPS)}, chr(10) || chr(9) || ' ') AS office, trim({_chain('xml', formats.HWPX_STEPS)}, chr(10) || chr(9) || ' ') AS hwpx FROM {XML.sql('t')}")
def office_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S27."""
    return XML.df(spark).select("id", formats.ooxml_to_text(F.col("xml")).alias("office"), formats.hwpx_to_text(F.col("xml")).alias("hwpx"))


NOTEBOOKS = Fixture("id int, raw string", [
    (1, '{"cells": [{"cell_type": "markdown", "source": ["# T\\n", "x"]}, {"cell_type": "code", "source": "1+1", "outputs": [{"text": ["2"]}, {"data": {"text/plain": "two"}}]}]}'), (2, "not json"), (3, '{"cells": []}'),
    (4, '{"cells": [{"cell_type": "raw", "source": "left out"}, {"cell_type": "code", "source": ["a\\n", "b"], "outputs": [{"text": ""}, {"data": {"image/png": "x"}}]}, {"cell_type": "markdown", "source": "last"}]}'),
])
_JOINED = lambda x: f"CASE WHEN json_type({x}) = 'ARRAY' THEN array_to_string(from_json({x}, '[\"VARCHAR\"]'), '') ELSE coalesce({x} ->> '$', '') END"


@query(f"""WITH n AS (SELECT id, raw, json_valid(raw) AS ok FROM {NOTEBOOKS.sql('t')}), c AS (SELECT id, k, json_extract(raw, '$.cells[' || k || ']') AS c FROM (SELECT id, raw, unnest(range(CAST(json_array_length(raw, '$.cells') AS BIGINT))) AS k FROM n WHERE ok)),
o AS (SELECT id, k, j, json_extract(c, '$.outputs[' || j || ']') AS o FROM (SELECT id, k, c, unnest(range(CAST(coalesce(json_array_length(c, '$.outputs'), 0) AS BIGINT))) AS j FROM c WHERE c ->> '$.cell_type' = 'code')),
said AS (SELECT id, k, j, coalesce(json_extract(o, '$.text'), json_extract(o, '$.data."text/plain"')) AS x FROM o), shown AS (SELECT id, k, j + 1 AS j, {_JOINED('x')} AS t FROM said),
parts AS (SELECT id, k, 0 AS j, CASE WHEN c ->> '$.cell_type' = 'code' THEN '```' || chr(10) || {_JOINED("json_extract(c, '$.source')")} || chr(10) || '```' ELSE {_JOINED("json_extract(c, '$.source')")} END AS part FROM c WHERE c ->> '$.cell_type' IN ('code', 'markdown')
 UNION ALL SELECT id, k, j, '출력: ' || substr(t, 1, {formats.OUTPUT_CHARS}) FROM shown WHERE t <> '')
SELECT n.id, CASE WHEN ok THEN coalesce((SELECT string_agg(part, chr(10) || chr(10) ORDER BY k, j) FROM parts p WHERE p.id = n.id), '') ELSE raw END AS out FROM n""")
def notebook_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14."""
    return NOTEBOOKS.df(spark).select("id", formats.notebook_to_text(F.col("raw")).alias("out"))


READS = Fixture("id int, a string, b string", [(1, "안녕하세요 반갑습니다", "안녕하세요, 반갑습니다!"), (2, "abcd", "abce"), (3, "", "x"), (4, "aaaa", "aa"), (5, "«불명» 하나", "하나"), (6, "a", "b")])
_NORM = lambda c: f"lower(regexp_replace(regexp_replace(replace({c}, '«불명»', ''), '\\s+', '', 'g'), {_lit(ocr.PUNCTUATION)}, '', 'g'))"


@query(f"""WITH n AS (SELECT id, {_NORM('a')} AS x, {_NORM('b')} AS y FROM {READS.sql('t')}),
gx AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest(list_transform(range(1, length(x)), lambda i: substr(x, i, 2))) AS g FROM n) GROUP BY ALL),
gy AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest(list_transform(range(1, length(y)), lambda i: substr(y, i, 2))) AS g FROM n) GROUP BY ALL),
c AS (SELECT id, sum(least(gx.n, gy.n)) AS c FROM gx JOIN gy USING (id, g) GROUP BY id)
SELECT id, CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y THEN 1.0 WHEN length(x) + length(y) > 2 THEN round(2 * coalesce(c, 0) / CAST(length(x) + length(y) - 2 AS DOUBLE), 9) ELSE 0.0 END AS dice FROM n LEFT JOIN c USING (id)""")
def dice_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O01, O02, U04."""
    return ocr.dice(READS.df(spark), "id", "a", "b").select("id", F.round("dice", 9).alias("dice"))


ENGINES = Fixture("image int, engine string, is_primary boolean, text string, reported double, height int", [
    (1, "vision", True, "안녕하세요 여러분 반갑습니다 오늘도 좋은 하루", None, 1000), (1, "clova", False, "안녕하세요 여러분 반갑습니다 오늘도 좋은 하루", 0.9, None), (2, "vision", True, "", None, 3000), (2, "tess", False, "this is a long enough reading", 0.5, None),
    (3, "vision", True, "«불명» 글", None, 500), (4, "vision", True, "[[NO_TEXT]]", None, 500),
])


@query(f"""WITH e AS (SELECT image, engine, is_primary, coalesce(CAST(text AS VARCHAR), '') AS text, CAST(reported AS DOUBLE) AS reported, CAST(height AS INTEGER) AS height FROM {ENGINES.sql('t')}),
u AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY length(text) DESC, engine) AS nth, count(*) OVER (PARTITION BY image) AS n, max(reported) OVER (PARTITION BY image) AS told FROM e WHERE NOT is_primary AND length(text) > {ocr.USABLE} AND text <> {_lit(ocr.NO_TEXT)}),
m AS (SELECT e.image, e.height, coalesce(u.n, 0) AS n, u.told, e.text IN ('', {_lit(ocr.NO_TEXT)}) AND u.image IS NOT NULL AS other, CASE WHEN other THEN u.engine ELSE e.engine END AS engine, CASE WHEN other THEN u.text ELSE e.text END AS best, CASE WHEN other THEN u.reported ELSE e.reported END AS own FROM e LEFT JOIN u ON u.image = e.image AND u.nth = 1 WHERE e.is_primary),
p AS (SELECT u.image, u.engine, {_NORM('m.best')} AS x, {_NORM('u.text')} AS y FROM u JOIN m USING (image)),
gx AS (SELECT image, engine, g, count(*) AS n FROM (SELECT image, engine, unnest(list_transform(range(1, length(x)), lambda i: substr(x, i, 2))) AS g FROM p) GROUP BY ALL),
gy AS (SELECT image, engine, g, count(*) AS n FROM (SELECT image, engine, unnest(list_transform(range(1, length(y)), lambda i: substr(y, i, 2))) AS g FROM p) GROUP BY ALL),
c AS (SELECT image, engine, sum(least(gx.n, gy.n)) AS c FROM gx JOIN gy USING (image, engine, g) GROUP BY ALL),
d AS (SELECT image, max(CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y THEN 1.0 WHEN length(x) + length(y) > 2 THEN 2 * coalesce(c, 0) / CAST(length(x) + length(y) - 2 AS DOUBLE) ELSE 0.0 END) AS a FROM p LEFT JOIN c USING (image, engine) GROUP BY image),
s AS (SELECT m.image, m.engine, height, n, CASE WHEN best = {_lit(ocr.NO_TEXT)} THEN '' ELSE best END AS text, coalesce(a, 0) AS a, CASE WHEN n > 0 THEN 0.55 + 0.4 * coalesce(a, 0) ELSE 0.62 END AS base, greatest(own, told) AS told FROM m LEFT JOIN d USING (image))
SELECT image, engine, text, CAST(round(a, 6) AS DOUBLE) AS agreement, CASE WHEN text = '' THEN 0.0 ELSE CAST(round(greatest(0, least(1, CASE WHEN told IS NULL THEN base ELSE (base + told) / 2 END - 0.5 * least(1, len(regexp_extract_all(text, {_lit(ocr.UNKNOWN)})) / greatest(1, length(regexp_replace(text, '\\s+', '', 'g')) / 4.0)))), 6) AS DOUBLE) END AS confidence,
 coalesce(height > {ocr.TILE}, false) OR (n > 0 AND a < {ocr.AGREED}) AS reread_wanted FROM s""")
def ocr_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O03, O04, R05."""
    out = ocr.consensus(ENGINES.df(spark))
    return out.select("image", "engine", "text", F.round("agreement", 6).alias("agreement"), F.round("confidence", 6).alias("confidence"), "reread_wanted")


HEIGHTS = Fixture("image int, height int", [(1, 1000), (2, 2200), (3, 5000), (4, 2120)])


@query(f"SELECT image, CAST(k AS INT) AS tile, CAST(k * 2040 AS INT) AS top, CAST(least(2200, height - k * 2040) AS INT) AS height FROM {HEIGHTS.sql('t')}, range(0, 10) r(k) WHERE k * 2040 < height AND (height - k * 2040 >= 80 OR k = 0)")
def image_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O06."""
    return ocr.tiles(HEIGHTS.df(spark))


SPANS = Fixture("doc int, start long, end long", [(1, 0, 100), (1, 150, 300), (1, 500, 600), (1, 90, 95), (2, 10, 20), (2, 141, 9000), (2, 9500, 9900)])
_ISLANDS = f"""s AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY doc ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 120 THEN 0 ELSE 1 END AS o FROM {SPANS.sql('t').replace('start, end)', '"start", "end")')}),
i AS (SELECT *, sum(o) OVER (PARTITION BY doc ORDER BY "start", "end") AS g FROM s), m AS (SELECT doc, min("start") AS a, max("end") AS b FROM i GROUP BY doc, g)"""


@query(f'WITH {_ISLANDS} SELECT doc, a AS "start", b AS "end" FROM m')
def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A06, W03."""
    return evidence.merged_spans(SPANS.df(spark), "doc")


@query(f'WITH {_ISLANDS}, u AS (SELECT doc, a, b, coalesce(sum(b - a) OVER (PARTITION BY doc ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM m) SELECT doc, a AS "start", CAST(least(b, a + 400 - used) AS BIGINT) AS "end" FROM u WHERE used < 400')
def span_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A06, W04."""
    return evidence.budgeted_spans(evidence.merged_spans(SPANS.df(spark), "doc"), "doc", 400)


_LEXICON = rule_sql.lexicon_ctes()


@query(f"WITH {_LEXICON} SELECT surface, canon, origin, len FROM words")
def lexicon_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L01-L05, W06, W07."""
    return lexicon.build_lexicon(spark)


@query(f"WITH {_LEXICON} SELECT origin, count(*) AS entries FROM words GROUP BY origin")
def lexicon_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L07, R10."""
    return lexicon.stats(lexicon.build_lexicon(spark))


@query(f"WITH {_LEXICON} SELECT surface, string_agg(DISTINCT canon, '|' ORDER BY canon) AS canons FROM made GROUP BY surface HAVING count(DISTINCT canon) > 1")
def lexicon_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L06."""
    return lexicon.conflicts(spark).withColumn("canons", F.array_join("canons", "|"))


TOKENS = Fixture("token string", [(t,) for t in ["첫걸음", "끝내기했습니다", "컨텐츠", "프로젝드", "없는단어임다", "API", "게선", "조깅", "효율화"]])


_NAMED = f"{_LEXICON}, tokens AS (SELECT * FROM {TOKENS.sql('t')}), {rule_sql.canon_ctes('tokens')}"


@query(f"WITH {_NAMED} SELECT token, canon FROM named")
def canonical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L09, J02."""
    return lexicon.with_canon(TOKENS.df(spark), lexicon.build_lexicon(spark))


@query(f"WITH {_NAMED}, e AS (SELECT token, canon AS word FROM named UNION SELECT token, t FROM named UNION SELECT token, surface FROM named JOIN words USING (canon) UNION SELECT token, member FROM named JOIN clusters ON head = canon) SELECT * FROM e WHERE word <> ''")
def expand_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L08, L11, U02."""
    return lexicon.expanded(TOKENS.df(spark), lexicon.build_lexicon(spark), lexicon.seed_tables(spark)["clusters"])


@query(f"""WITH RECURSIVE {_NAMED}, asked AS (SELECT token, t, w.canon FROM named n LEFT JOIN words w ON w.surface = n.t),
pairs AS (SELECT DISTINCT t AS a, w.surface AS b FROM asked JOIN words w ON w.len BETWEEN length(t) - 1 AND length(t) + 1 WHERE asked.canon IS NULL), {rule_sql.distances('pairs', 'far')},
best AS (SELECT a AS t, canon, s FROM (SELECT a, w.canon, greatest(0, 1 - d / longest) AS s, row_number() OVER (PARTITION BY a ORDER BY 1 - d / longest DESC, w.len, w.surface) AS nth FROM far JOIN words w ON w.surface = far.b) WHERE nth = 1)
SELECT token, CASE WHEN q.canon IS NOT NULL THEN q.canon WHEN s >= {lexicon.FUZZY} THEN best.canon ELSE t END AS canon, CASE WHEN q.canon IS NOT NULL THEN 1.0 WHEN s >= {lexicon.FUZZY} THEN round(s, 6) ELSE 0.0 END AS score FROM asked q LEFT JOIN best USING (t)""")
def fuzzy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L10, J05."""
    out = lexicon.fuzzy_canon(TOKENS.df(spark), lexicon.build_lexicon(spark))
    return out.select("token", "canon", F.round("score", 6).alias("score"))


CELLS = Fixture("draft_id int, path string, key string, kind string, required boolean, value string, items array<string>, start string, end string, ongoing boolean, options array<string>, free_options boolean, malformed boolean", [
    (1, "companyName", "companyName", "text", True, None, None, None, None, None, None, False, False), (1, "employmentPeriod", "employmentPeriod", "daterange", True, None, None, "2024-09", "2024-03", True, None, False, False),
    (1, "employmentType", "employmentType", "select", False, "정직원", None, None, None, None, ["정규직", "인턴"], False, False), (1, "day", "day", "date", False, "2024/06", None, None, None, None, None, False, False), (1, "ok", "ok", "date", False, "2024-06", None, None, None, None, None, False, False),
    (1, "skills", "skills", "tags", False, None, [str(i) for i in range(21)], None, None, None, None, False, False), (1, "url", "url", "link", False, "example", None, None, None, None, None, False, False), (1, "memo", "memo", "longtext", False, "짧다", None, None, None, None, None, False, False),
    (1, "summary", "summary", "text", False, "가" * 121, None, None, None, None, None, False, False), (1, "line", "line", "text", False, "a\nb", None, None, None, None, None, False, False), (1, "tasks", "tasks", "repeater", False, "x", None, None, None, None, None, False, True),
    (1, "areas", "areas", "checklist", False, None, ["a", "z"], None, None, None, ["a", "b"], False, False), (2, "period", "period", "daterange", True, None, None, "24-01", None, None, None, False, False), (2, "title", "title", "text", True, "제목", None, None, None, None, None, False, False),
])
_DATE = _lit(validation.DATE)


@query(f"""WITH c AS (SELECT draft_id, path, key, kind, required, CAST(value AS VARCHAR) AS value, CAST(items AS VARCHAR[]) AS items, CAST(s AS VARCHAR) AS s, CAST(e AS VARCHAR) AS e, CAST(ongoing AS BOOLEAN) AS ongoing, CAST(options AS VARCHAR[]) AS options, free_options, malformed FROM {CELLS.sql('t').replace('start, end,', 's, e,')}),
f AS (SELECT *, coalesce(trim(value), '') = '' AND coalesce(len(items), 0) = 0 AND s IS NULL AND e IS NULL AND ongoing IS NULL AND NOT malformed AS empty FROM c)
SELECT draft_id, 'blocker' AS severity, 'missing_required' AS type, path, 'V01' AS rule FROM f WHERE required AND empty
UNION ALL SELECT draft_id, 'major', 'format', path, 'V02' FROM f WHERE NOT empty AND kind = 'date' AND NOT regexp_matches(trim(value), {_DATE})
UNION ALL SELECT draft_id, 'major', 'format', path || '.start', 'V03' FROM f WHERE kind = 'daterange' AND s <> '' AND NOT regexp_matches(s, {_DATE})
UNION ALL SELECT draft_id, 'major', 'format', path || '.end', 'V03' FROM f WHERE kind = 'daterange' AND e <> '' AND NOT regexp_matches(e, {_DATE})
UNION ALL SELECT draft_id, 'major', 'format', path, 'V03 order' FROM f WHERE kind = 'daterange' AND s > e
UNION ALL SELECT draft_id, 'minor', 'format', path, 'V03 ongoing' FROM f WHERE kind = 'daterange' AND ongoing AND e <> ''
UNION ALL SELECT draft_id, 'major', 'format', path, 'V04' FROM f WHERE NOT empty AND kind = 'select' AND NOT list_contains(options, value)
UNION ALL SELECT draft_id, 'major', 'format', path, 'V05' FROM f WHERE NOT empty AND kind = 'checklist' AND (malformed OR (NOT free_options AND len(list_filter(items, lambda x: NOT list_contains(options, x))) > 0))
UNION ALL SELECT draft_id, 'major', 'format', path, 'V06' FROM f WHERE kind = 'tags' AND malformed
UNION ALL SELECT draft_id, 'minor', 'format', path, 'V06 many' FROM f WHERE kind = 'tags' AND len(items) > 20
UNION ALL SELECT draft_id, 'minor', 'format', path, 'V07' FROM f WHERE NOT empty AND kind = 'link' AND NOT regexp_matches(value, '(?i)^(https?://|www\\.)')
UNION ALL SELECT draft_id, 'minor', 'format', path, 'V08' FROM f WHERE kind = 'text' AND contains(value, chr(10))
UNION ALL SELECT draft_id, 'minor', 'format', path, 'V08 long' FROM f WHERE kind = 'text' AND key IN ('summary', 'oneLiner') AND length(value) > 120
UNION ALL SELECT draft_id, 'major', 'format', path, 'V09' FROM f WHERE kind = 'repeater' AND malformed
UNION ALL SELECT draft_id, 'minor', 'format', path, 'V10' FROM f WHERE NOT empty AND kind = 'longtext' AND length(trim(value)) < 5""")
def structural_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V01-V11."""
    return validation.structural_issues(CELLS.df(spark))


LEAVES = Fixture("draft_id int, path string, value string", [
    (1, "title", "지도 앱 개발"), (1, "tasks[0].name", "로그인 개선"), (1, "tasks[0].detail", "응답 820ms 를 210ms 로 줄였다. 250팀이 참여한 대회였다."), (1, "evidence", "report.pdf"), (1, "period.start", "2024-06"), (2, "evidence", "other.pdf"), (2, "summary", ""), (2, "title", "x"),
])
FIELDS = Fixture("key string, parent_key string, kind string, required boolean, ord int", [("title", None, "text", True, 0), ("period", None, "daterange", True, 1), ("summary", None, "text", False, 2), ("evidence", None, "file", False, 3), ("tasks", None, "repeater", False, 4), ("name", "tasks", "text", True, 5), ("detail", "tasks", "longtext", False, 6), ("role", "tasks", "text", True, 7)])


@query(f"""WITH l AS (SELECT DISTINCT draft_id, regexp_extract(path, '^([^.\\[]+)', 1) AS key FROM {LEAVES.sql('t')} WHERE trim(value) <> ''), f AS (SELECT key, CASE WHEN required THEN 3 ELSE 1 END AS w FROM {FIELDS.sql('t')} WHERE parent_key IS NULL), d AS (SELECT DISTINCT draft_id FROM {LEAVES.sql('t')})
SELECT d.draft_id, CAST(round(100.0 * sum(CASE WHEN l.key IS NULL THEN 0 ELSE w END) / sum(w)) AS BIGINT) AS completeness FROM d CROSS JOIN f LEFT JOIN l ON l.draft_id = d.draft_id AND l.key = f.key GROUP BY d.draft_id""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14, R07."""
    return agents.completeness(FIELDS.df(spark), LEAVES.df(spark))


@query(f"""WITH l AS (SELECT draft_id, path FROM {LEAVES.sql('t')} WHERE trim(value) <> ''), f AS (SELECT * FROM {FIELDS.sql('t')}), d AS (SELECT DISTINCT draft_id FROM {LEAVES.sql('t')})
SELECT d.draft_id, f.key AS path FROM d CROSS JOIN f WHERE f.parent_key IS NULL AND NOT EXISTS (SELECT 1 FROM l WHERE l.draft_id = d.draft_id AND regexp_extract(l.path, '^([^.\\[]+)', 1) = f.key)
UNION ALL SELECT r.draft_id, r.row || '.' || f.key FROM (SELECT DISTINCT draft_id, regexp_extract(path, '^([^.\\[]+)\\[', 1) AS parent, regexp_extract(path, '^([^.\\[]+\\[[0-9]+\\])', 1) AS row FROM l) r JOIN f ON f.parent_key = r.parent WHERE r.row <> '' AND NOT EXISTS (SELECT 1 FROM l WHERE l.draft_id = r.draft_id AND l.path = r.row || '.' || f.key)""")
def empty_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, U03."""
    return agents.empty_paths(FIELDS.df(spark), LEAVES.df(spark))


UPLOADS = Fixture("draft_id int, name string", [(1, "2024_report.pdf"), (2, "report.pdf")])


@query(f"SELECT l.draft_id, 'major' AS severity, 'hallucination' AS type, path, 'G07 file' AS rule FROM {LEAVES.sql('l')} WHERE path = 'evidence' AND NOT EXISTS (SELECT 1 FROM {UPLOADS.sql('u')} WHERE u.draft_id = l.draft_id AND (contains(name, trim(value)) OR contains(value, name)))")
def file_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G07.2, J11."""
    return validation.file_issues(LEAVES.df(spark), UPLOADS.df(spark))


PROVENANCE = Fixture("draft_id int, path string", [(1, "tasks"), (2, "summary")])


@query(f"SELECT l.draft_id, 'minor' AS severity, 'hallucination' AS type, l.path, 'G07 unproven' AS rule FROM {LEAVES.sql('l')} WHERE l.path <> 'evidence' AND length(trim(value)) > 25 AND NOT EXISTS (SELECT 1 FROM {PROVENANCE.sql('p')} WHERE p.draft_id = l.draft_id AND (starts_with(l.path, p.path) OR starts_with(p.path, l.path)))")
def unproven_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G07.5, J06."""
    return validation.unproven_issues(LEAVES.df(spark), PROVENANCE.df(spark))


@query(f"SELECT DISTINCT draft_id, path, raw FROM (SELECT draft_id, path, unnest(regexp_extract_all(value, '[0-9][0-9,]*(?:\\.[0-9]+)?')) AS raw FROM {LEAVES.sql('t')} WHERE path <> 'evidence') WHERE length(replace(raw, ',', '')) >= 2")
def number_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G07.3: what is asked of the source's numbers."""
    return validation.number_claims(LEAVES.df(spark))


@query(f"SELECT DISTINCT draft_id, path, term FROM (SELECT draft_id, path, unnest(regexp_extract_all(value, '[A-Za-z][A-Za-z0-9+#.]{{2,}}|[가-힣]{{3,}}')) AS term FROM {LEAVES.sql('t')} WHERE path <> 'evidence') WHERE lower(term) NOT IN ({', '.join(map(_lit, validation.COMMON_WORDS))})")
def term_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G07.4, J09: what is asked of the source's terms."""
    return validation.term_claims(LEAVES.df(spark))


_DRAFTS = [
    ("title", 0, "text", "가", [1.0], 0, 0, 0), ("title", 1, "text", "나", [0.9], 0, 0, 0), ("role", 0, "longtext", "a" * 40, None, 0, 0, 0), ("role", 1, "longtext", "b" * 40, None, 1, 0, 0),
    ("team", 0, "text", None, None, 0, 0, 0), ("team", 1, "text", "팀", None, 0, 0, 0), ("tasks", 0, "repeater", "[1]", None, 0, 0, 3), ("tasks", 1, "repeater", "[2]", [0.5, 0.7], 6, 6, 9), ("memo", 0, "longtext", "짧음", None, 0, 0, 0), ("memo", 1, "longtext", "짧음", None, 0, 0, 0), ("none", 0, "text", None, None, 0, 0, 0), ("none", 1, "text", "", None, 0, 0, 0),
]
#: Three forms of the same fields: as they are, with the drafts' values the other way round, and with a third draft and many close fields.
DRAFTS = Fixture("form_id int, key string, draft_id int, kind string, value string, quote_scores array<double>, n_numbers int, n_good int, filled_rows int", [
    *[(1, *r) for r in _DRAFTS], *[(2, r[0], 1 - r[1], *r[2:]) for r in _DRAFTS], *[(3, f"field{k:02}", d, "text", f"v{k}-{d}", [0.9 + d / 100], 0, 0, 0) for k in range(14) for d in range(3)],
])
_SCORED = f"""s AS (SELECT *, CASE WHEN coalesce(trim(value), '') = '' THEN -1 ELSE CASE WHEN len(quote_scores) > 0 THEN 2 * list_avg(quote_scores) ELSE 0.8 END + least(0.8, 0.2 * n_good) - 1.2 * (n_numbers - n_good)
 + CASE WHEN kind = 'repeater' THEN least(1, 0.25 * filled_rows) WHEN kind = 'longtext' AND length(trim(value)) BETWEEN 30 AND 800 THEN 0.4 WHEN kind = 'longtext' AND length(trim(value)) < 15 THEN -0.4 ELSE 0 END END AS score FROM {DRAFTS.sql('t')}),
b AS (SELECT *, row_number() OVER (PARTITION BY form_id, key ORDER BY score DESC, draft_id) AS nth FROM s)"""
_CONFLICTS = f"""{_SCORED}, f AS (SELECT * FROM b WHERE coalesce(trim(value), '') <> '' AND kind <> 'repeater'), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY form_id, key ORDER BY score DESC, draft_id) AS n1 FROM f) WHERE n1 = 1),
o AS (SELECT f.form_id, f.key, t.value AS a, f.value AS b, abs(f.score - t.score) AS gap, row_number() OVER (PARTITION BY f.form_id, f.key ORDER BY f.score DESC, f.draft_id) AS n2 FROM f JOIN t USING (form_id, key) WHERE f.value <> t.value), conflicts AS (SELECT form_id, key, a, b FROM o WHERE n2 = 1 AND gap < 0.25)"""


@query(f"WITH {_SCORED} SELECT form_id, key, nullif(value, '') AS value, draft_id, CAST(round(score, 6) AS DOUBLE) AS score FROM b WHERE nth = 1")
def merge_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A08, A09, R04, W02."""
    return merge.best_values(merge.field_scores(DRAFTS.df(spark))).select("form_id", "key", "value", "draft_id", F.round("score", 6).alias("score"))


@query(f"WITH {_CONFLICTS} SELECT * FROM conflicts")
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A09."""
    return merge.merge_conflicts(merge.field_scores(DRAFTS.df(spark)))


DECISIONS = Fixture("form_id int, key string, choice string, merged string", [(1, "title", "B", None), (2, "title", "neither", None), (3, "field00", "merged", "both"), (3, "field01", "A", None), (3, "field02", "B", None), (3, "field13", "B", None), (9, "field00", "B", None)])


@query(f"WITH {_CONFLICTS}, n AS (SELECT *, row_number() OVER (PARTITION BY form_id ORDER BY key) AS nth FROM conflicts) SELECT n.form_id, n.key, CASE WHEN nth > 12 OR choice IS NULL OR choice = 'A' THEN a WHEN choice = 'B' THEN b WHEN choice = 'merged' THEN merged END AS value FROM n LEFT JOIN {DECISIONS.sql('d')} ON d.form_id = n.form_id AND d.key = n.key")
def merge_arbitrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on each form's first twelve conflicts."""
    return merge.arbitrated(merge_conflicts(spark, sf_dir), DECISIONS.df(spark))


HELD = Fixture("form_id int, folded string", [(1, "가나다"), (2, "나라"), (3, "v00v11v22v132")])


@query(f"WITH {_CONFLICTS} SELECT c.form_id, c.key, CASE WHEN contains(folded, lower(replace(b, '-', ''))) AND NOT contains(folded, lower(replace(a, '-', ''))) THEN 'B' ELSE 'A' END AS choice, CAST(NULL AS VARCHAR) AS merged FROM conflicts c LEFT JOIN {HELD.sql('h')} USING (form_id)")
def merge_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 without a model: what the source holds wins."""
    return merge.decided_by_rule(merge_conflicts(spark, sf_dir), HELD.df(spark))


MISSING = Fixture("form_id int, path string, label string, reason string, ord int", [(1, "title", "제목", "x", 0), (1, "none", "빈칸", "first", 1), (1, "none", "빈칸", "second", 2), (2, "none", "빈칸", "other", 0), (3, "none", "빈칸", "third", 0), (2, "tasks[0].name", "일", "row", 1)])


@query(f"WITH {_SCORED}, h AS (SELECT form_id, key FROM b WHERE nth = 1 AND coalesce(trim(value), '') <> '') SELECT form_id, path, label, reason, ord FROM (SELECT *, row_number() OVER (PARTITION BY form_id, path ORDER BY ord) AS nth FROM {MISSING.sql('t')}) m WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM h WHERE h.form_id = m.form_id AND h.key = regexp_extract(m.path, '^([^.\\[]+)', 1))")
def merge_unfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of what is empty after the merge."""
    return merge.unfilled(MISSING.df(spark), merge.best_values(merge.field_scores(DRAFTS.df(spark))))


_ROWS = [
    ("tasks", 0, 0, "로그인", "name", "로그인"), ("tasks", 0, 0, "로그인", "role", "개발"), ("tasks", 0, 1, "지도", "name", "지도"), ("tasks", 1, 0, "로 그인", "name", "로 그인"), ("tasks", 1, 0, "로 그인", "detail", "상세"), ("tasks", 1, 0, "로 그인", "tools", "React"),
    ("tasks", 1, 1, "지도", "name", "지도"), ("tasks", 1, 1, "지도", "role", ""), ("tasks", 1, 2, "", "role", "x"), ("tasks", 2, 0, "로그인", "role", "리드"),
]
ROWS = Fixture("form_id int, field string, rank int, row int, row_key string, column string, value string", [*[(1, *r) for r in _ROWS], *[(2, r[0], 2 - r[1], *r[2:]) for r in _ROWS], *[(3, "logs", 0, k, "지도", f"c{k}", f"v{k}") for k in range(3)]])


@query(f"""WITH c AS (SELECT *, lower(replace(row_key, ' ', '')) AS k FROM {ROWS.sql('t').replace('row,', '"row",').replace('column,', '"column",')} WHERE row_key <> '' AND value <> ''),
n AS (SELECT form_id, field, k, rank, "row", count(*) AS n FROM c GROUP BY ALL), l AS (SELECT form_id, field, k, rank AS r0, "row" AS w0 FROM (SELECT *, row_number() OVER (PARTITION BY form_id, field, k ORDER BY n DESC, rank, "row") AS nth FROM n) WHERE nth = 1)
SELECT form_id, field, k AS row_key, "column", value FROM (SELECT c.*, row_number() OVER (PARTITION BY c.form_id, c.field, c.k, c."column" ORDER BY rank, "row") AS nth FROM c JOIN l ON l.form_id = c.form_id AND l.field = c.field AND l.k = c.k WHERE (rank, "row") >= (r0, w0)) WHERE nth = 1""")
def merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return merge.merged_rows(ROWS.df(spark))


EVIDENCE = Fixture("draft_id int, ord int, path string, value string, confidence double, quote string", [(1, 0, "title", "A", 0.9, "q1"), (1, 1, "title", "B", 0.95, "q2"), (1, 2, "role", "weak", 0.3, "q3"), (2, 0, "role", "R", 0.8, None)])


@query(f"""WITH e AS (SELECT draft_id, path, max(confidence) AS c, first(value ORDER BY ord) AS v, coalesce(list(quote ORDER BY ord) FILTER (quote IS NOT NULL), []) AS q FROM {EVIDENCE.sql('t')} GROUP BY ALL)
SELECT draft_id, path, CASE WHEN c >= 0.4 THEN v END AS value, CAST(c AS DOUBLE) AS confidence, array_to_string(q, '|') AS quotes, CASE WHEN c < 0.4 THEN 'low confidence' END AS reason FROM e
UNION ALL SELECT d.draft_id, f.key, NULL, NULL, '', 'not found' FROM (SELECT DISTINCT draft_id FROM e) d, (SELECT key FROM {FIELDS.sql('t')} WHERE parent_key IS NULL) f WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.draft_id = d.draft_id AND e.path = f.key)""")
def extract_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A07, R03, W06."""
    fields = FIELDS.df(spark).where("parent_key IS NULL").select(F.col("key").alias("path"))
    return agents.normalized_extraction(EVIDENCE.df(spark), fields).withColumn("quotes", F.array_join("quotes", "|"))


ISSUES = Fixture("draft_id int, ord int, path string, type string, detail string, severity string", [(1, 0, "a", "format", "x", "major"), (1, 1, "a", "format", "x", "minor"), (1, 2, "a", "format", "y", "minor"), (1, 3, "b", "format", "x", "blocker"), (2, 0, "a", "format", "x", "minor"), (2, 1, "a", "format", "x", "major"), (3, 0, "b", "format", "x", "blocker")])


@query(f"SELECT draft_id, ord, path, type, detail, severity FROM (SELECT *, row_number() OVER (PARTITION BY draft_id, path, type, detail ORDER BY ord) AS nth FROM {ISSUES.sql('t')}) WHERE nth = 1")
def issue_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17, A18, W06, U01."""
    return agents.merge_issues(ISSUES.df(spark))


PATCH = Fixture("draft_id int, path string, value string", [(1, "title", "새 제목"), (1, "tasks[0].name", None), (1, "bogus.x", "y"), (2, "period.end", "2025")])


@query(f"""WITH p AS (SELECT * FROM {PATCH.sql('t')} WHERE regexp_extract(path, '^([^.\\[]+)', 1) IN (SELECT key FROM {FIELDS.sql('f')} WHERE parent_key IS NULL))
SELECT draft_id, path, value FROM {LEAVES.sql('l')} WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.draft_id = l.draft_id AND p.path = l.path) UNION ALL SELECT draft_id, path, value FROM p WHERE value <> ''""")
def patch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16, P03."""
    return agents.apply_patch(LEAVES.df(spark), PATCH.df(spark), FIELDS.df(spark).where("parent_key IS NULL"))


MODELS = Fixture("model string", [(m,) for m in ["gen-2.5-pro", "gen-3.8-flash", "gen-3.8-flash-preview", "gen-2.5-flash", "gen-3.8-pro-preview", "gen-3.8-pro-exp-long", "embed-1"]])


@query(f"SELECT model, row_number() OVER (ORDER BY coalesce(TRY_CAST(regexp_extract(model, '([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE), 0) DESC, CASE WHEN contains(model, 'pro') THEN 0 WHEN contains(model, 'flash') THEN 1 ELSE 2 END, CASE WHEN regexp_matches(model, 'preview|exp') THEN 1 ELSE 0 END, length(model), model) AS rank FROM {MODELS.sql('t')}")
def model_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19, T02."""
    return agents.ranked_models(MODELS.df(spark))


GAPS = Fixture("draft_id int, path string, priority string, ord int", [(1, "a", "low", 0), (1, "b", "high", 1), (1, "c", "medium", 2), (1, "d", "high", 3), (1, "e", "low", 4), (1, "f", "low", 5), (2, "a", "medium", 0)])


@query(f"SELECT draft_id, path, rank, rank <= 5 AS asked FROM (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, ord) AS rank FROM {GAPS.sql('t')})")
def gap_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15, T03."""
    return agents.ranked_gaps(GAPS.df(spark)).select("draft_id", "path", "rank", "asked")


CALLS = Fixture("tier string, in_tokens long, out_tokens long", [("pro", 1000, 500), ("pro", 615, 100), ("flash", 66023, 2500)])
PRICES = Fixture("tier string, in_price double, out_price double", [("pro", 1.25, 10.0), ("flash", 0.3, 2.5)])


@query(f"SELECT tier, count(*) AS calls, CAST(sum(in_tokens) AS BIGINT) AS in_tokens, CAST(sum(out_tokens) AS BIGINT) AS out_tokens, round(CAST(sum(in_tokens * in_price + out_tokens * out_price) AS DOUBLE) / 1000000, 6) AS cost FROM {CALLS.sql('c')} JOIN {PRICES.sql('p')} USING (tier) GROUP BY tier")
def cost_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22, C11."""
    return agents.cost_by_tier(CALLS.df(spark), PRICES.df(spark))


def _spec_sql() -> str:
    rows = []
    for type_id, fields in {"*": schema.common_fields(), **schema.SAMPLE}.items():
        n = 0
        for f in fields:
            for parent, x in [(None, f), *((f["key"], s) for s in f.get("fields") or [])]:
                rows.append((type_id, n, parent, x["key"], x["label"], x["kind"], bool(x.get("required")), x.get("supersedes") or None, x.get("group")))
                n += 1
    return f"specs AS (SELECT type_id, ord, CAST(parent_key AS VARCHAR) AS parent_key, key, label, kind, required, CAST(supersedes AS VARCHAR[]) AS supersedes, CAST(grp AS VARCHAR) AS grp FROM (VALUES {', '.join('(' + ', '.join(map(_lit, r)) + ')' for r in rows)}) t(type_id, ord, parent_key, key, label, kind, required, supersedes, grp))"


_SPECS = _spec_sql()
_ALL = f"""{_SPECS}, sup AS (SELECT DISTINCT type_id, unnest(supersedes) AS key FROM specs WHERE type_id <> '*'), types AS (SELECT DISTINCT type_id FROM specs WHERE type_id <> '*'),
fields AS (SELECT t.type_id, s.ord, s.parent_key, s.key, s.label, s.kind, s.required, s.grp, false AS own FROM specs s, types t WHERE s.type_id = '*' AND NOT EXISTS (SELECT 1 FROM sup WHERE sup.type_id = t.type_id AND sup.key = s.key)
 UNION ALL SELECT type_id, ord, parent_key, key, label, kind, required, grp, true FROM specs WHERE type_id <> '*')"""


@query(f"WITH {_ALL} SELECT type_id, key FROM sup")
def superseded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P06."""
    return schema.superseded(schema.field_rows(spark))


@query(f"WITH {_ALL} SELECT type_id, parent_key, key, kind, required, row_number() OVER (PARTITION BY type_id ORDER BY own, ord) - 1 AS at FROM fields")
def all_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P07, J08."""
    return schema.all_fields(schema.field_rows(spark)).select("type_id", "parent_key", "key", "kind", "required", "at")


@query(f"""WITH {_ALL}, z AS (SELECT *, CASE WHEN own THEN 'specialized' WHEN key IN ('title', 'summary') THEN 'header' WHEN key = 'evidence' THEN 'evidence' ELSE 'extended' END AS zone, CASE WHEN own THEN coalesce(grp, type_id) ELSE '' END AS title FROM fields WHERE parent_key IS NULL)
SELECT type_id, zone, string_agg(key, ',' ORDER BY ord) AS keys, zone = 'extended' AS collapsed FROM z GROUP BY type_id, zone, title""")
def form_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P08, W09."""
    return schema.layout(schema.field_rows(spark)).select("type_id", "zone", F.array_join("keys", ",").alias("keys"), "collapsed")


PATHS = Fixture("type_id string, path string", [("work.shift", "duties[0].result"), ("work.shift", "title"), ("work.shift", "nothing"), ("work.shift", "duties[1].nothing"), ("trip.visit", "period"), ("study.lecture", "summary"), ("study.lecture", "sessions[12].topic"), ("work.shift", "duties[0].duty.more")])


@query(f"""WITH {_ALL}, p AS (SELECT type_id, path, string_split(regexp_replace(path, '\\[[0-9]+\\]', '', 'g'), '.') AS k FROM {PATHS.sql('t')})
SELECT p.type_id, p.path, CASE WHEN len(k) = 1 AND a.label IS NOT NULL THEN a.label WHEN len(k) = 2 AND b.label IS NOT NULL THEN a.label || ' > ' || b.label ELSE p.path END AS label
FROM p LEFT JOIN fields a ON a.type_id = p.type_id AND a.parent_key IS NULL AND a.key = k[1] LEFT JOIN fields b ON b.type_id = p.type_id AND b.parent_key = k[1] AND b.key = k[2]""")
def label_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P01, P09."""
    return schema.labelled(PATHS.df(spark), schema.field_rows(spark)).select("type_id", "path", "label")


@query(f"WITH {_SPECS} SELECT split_part(type_id, '.', 1) AS category, type_id, count(*) AS fields, count(*) FILTER (required) AS required, count(*) FILTER (kind = 'repeater') AS repeaters FROM specs WHERE type_id <> '*' GROUP BY ROLLUP (split_part(type_id, '.', 1), type_id)")
def spec_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16, R12."""
    return schema.spec_counts(schema.field_rows(spark))


FORMS = Fixture("draft_id int, values string", [(1, '{"title": "T", "period": {"start": "2024", "end": null}, "tasks": [{"name": "a", "n": 3}, {"name": "b"}], "skills": ["x", "y"], "empty": null}'), (2, "{}")])


@query(f"""WITH t AS (SELECT draft_id, CAST(j AS JSON) AS j FROM {FORMS.sql('t').replace('values)', 'j)')}),
a AS (SELECT draft_id, k AS path, json_extract(j, '$."' || k || '"') AS x FROM (SELECT draft_id, j, unnest(json_keys(j)) AS k FROM t)),
b AS (SELECT draft_id, path, x FROM a WHERE json_type(x) NOT IN ('ARRAY', 'OBJECT', 'NULL')
 UNION ALL SELECT draft_id, path || '[' || i || ']', json_extract(x, '$[' || i || ']') FROM (SELECT draft_id, path, x, unnest(range(CAST(json_array_length(x) AS BIGINT))) AS i FROM a WHERE json_type(x) = 'ARRAY')
 UNION ALL SELECT draft_id, path || '.' || k, json_extract(x, '$."' || k || '"') FROM (SELECT draft_id, path, x, unnest(json_keys(x)) AS k FROM a WHERE json_type(x) = 'OBJECT')),
c AS (SELECT draft_id, path, x FROM b WHERE json_type(x) <> 'OBJECT' UNION ALL SELECT draft_id, path || '.' || k, json_extract(x, '$."' || k || '"') FROM (SELECT draft_id, path, x, unnest(json_keys(x)) AS k FROM b WHERE json_type(x) = 'OBJECT'))
SELECT draft_id, path, x ->> '$' AS value FROM c WHERE json_type(x) <> 'NULL'""")
def leaf_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P02, P04, P05."""
    return schema.leaves(FORMS.df(spark))


VALUES = Fixture("type_id string, key string, value string", [("work.shift", k, v) for k, v in [("contract", "시간제 계약"), ("contract", "정 규 직"), ("contract", "unrelated"), ("contract", "-"), ("storeName", "해당 없음"), ("storeName", " 가게 "), ("storeName", None), ("tools", '["a", "-", "b"]'), ("tools", "one"), ("tools", "없음"), ("days", '["평일"]')]])
_BLANK = ", ".join(map(_lit, schema.BLANK))
_FOLDED = lambda x: f"lower(regexp_replace({x}, '[\\s·.\\-_/]', '', 'g'))"


@query(f"""WITH {_SPECS}, o(type_id, key, options) AS (VALUES ('work.shift', 'contract', {_lit(["정규직", "시간제", "인턴"])})),
v AS (SELECT t.key, s.kind, trim(t.value) AS v, coalesce(lower(trim(t.value)) IN ({_BLANK}), true) AS blank, o.options FROM {VALUES.sql('t')} JOIN specs s ON s.type_id = t.type_id AND s.key = t.key AND s.parent_key IS NULL LEFT JOIN o ON o.type_id = t.type_id AND o.key = t.key),
l AS (SELECT *, list_filter(CASE WHEN v LIKE '[%' THEN from_json(v, '["VARCHAR"]') ELSE [v] END, lambda x: lower(trim(x)) NOT IN ({_BLANK})) AS items, list_filter(options, lambda x: {_FOLDED('x')} = {_FOLDED('v')}) AS same, list_filter(options, lambda x: contains({_FOLDED('v')}, {_FOLDED('x')}) OR contains({_FOLDED('x')}, {_FOLDED('v')})) AS near FROM v)
SELECT key, CASE WHEN blank OR kind IN ('tags', 'checklist') THEN NULL WHEN kind = 'select' THEN coalesce(same[1], near[1]) ELSE v END AS value, CASE WHEN NOT blank AND kind IN ('tags', 'checklist') AND len(items) > 0 THEN array_to_string(items, ',') END AS items FROM l""")
def coerce_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N17, P12, C01."""
    return schema.coerced(VALUES.df(spark), schema.field_rows(spark)).select("key", "value", F.array_join("items", ",").alias("items"))


FENCED = Fixture("id int, text string", [(1, "```json\n{\"a\": 1}\n```"), (2, "plain"), (3, " ```\nx\n``` ")])


@query(f"SELECT id, CASE WHEN regexp_matches(text, '(?s)^\\s*```(?:json)?\\s*(.*?)\\s*```\\s*$') THEN regexp_extract(text, '(?s)^\\s*```(?:json)?\\s*(.*?)\\s*```\\s*$', 1) ELSE text END AS body FROM {FENCED.sql('t')}")
def code_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13."""
    return FENCED.df(spark).select("id", schema.without_fence(F.col("text")).alias("body"))
