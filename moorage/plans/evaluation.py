"""Evaluation of the rules on documents of our own (C07-C10, R08): what they accept, and what they miss.

Every sentence of a document is quoted in six ways that a writer changes
quotes; sentences of other documents, invented ones and words picked from all
over a document must not pass. The old check, an exact substring, stands beside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.hangul import typo_variants
from ..operators import grounding, lexicon
from .document_queries import FOLD_SQL, _number_sql, _quoted

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


DOCS = {
    "보고": "가게 주문 화면 점검 보고\n첫 화면이 뜨기까지 3,400ms 가 걸려 손님이 기다리다 나가는 일이 잦았다.\n그림 크기를 줄이고 목록을 나누어 받게 해서 1,150ms 까지 낮췄다.\n결제 실패는 하루 84건에서 21건으로 줄었고, 문의 전화도 절반이 되었다.\n| :--- | :--- |\n남은 일은 늦은 밤 시간대의 느린 조회를 찾아 고치는 것이다.",
    "일지": "5월 3일 텃밭 일지\n상추 모종 40포기를 옮겨 심고, 물은 아침저녁으로 두 번 주었다.\n지난주에 뿌린 무씨가 싹을 틔웠는데 달팽이가 잎을 먹어 그물을 쳤다.\n거름은 나무 상자 두 개 분량을 썼고 다음 달에 한 번 더 준다.\n이웃 할머니께서 고추 지지대 세우는 법을 알려 주셨다.",
    "후기": "동네 합창단 봄 공연 후기\n나는 두 번째 성부를 맡아 열두 번의 연습에 모두 나갔다.\n공연 당일 마이크 한 대가 꺼졌지만 지휘자의 눈짓에 맞춰 끝까지 불렀다.\n객석 180자리가 다 찼고 앙코르로 두 곡을 더 불렀다.\n다음에는 악보를 외워서 관객을 보며 부르고 싶다.",
}
INVENTED = ["시장님께 표창장을 받고 지역 신문 첫 쪽에 실렸다", "회원 수가 다섯 배로 늘어 새 건물로 옮기게 되었다", "해외 초청을 받아 세 나라를 돌며 발표를 이어 갔다", "연간 예산 이억 원을 아껴 모두에게 나누어 주었다"]
#: Words picked from all over a document: how many, how far apart, in how many ways.
PICKED, STRIDE, PICKS = 9, 11, 4
#: A sentence has so many characters, and so many folded ones; the old check lets shorter quotes pass.
SENTENCE, SKELETON = 15, 8
OLD_MARKS = r"[.,·:;'\"“”‘’()\[\]{}\-—_/\\|\s\x{200b}]"


def mutations(sentence: Column) -> dict[str, Column]:
    """Six ways in which a quote differs from its sentence. The lengths that are cut."""
    n = F.length(sentence)
    return {
        "as it is": sentence,
        "cut short": F.concat(F.substring(sentence, F.lit(1), F.greatest(F.lit(12), F.floor(n * 7 / 10).cast("int"))), F.lit("…")),
        "one line": F.replace(sentence, F.lit("\n"), F.lit(" ")),
        "other marks": F.replace(F.replace(sentence, F.lit("."), F.lit(" ·")), F.lit(","), F.lit(" ")),
        "no blanks": F.regexp_replace(sentence, r"\s+", ""),
        "trimmed": F.when(n > 12, F.substring(sentence, F.lit(4), n - 6)).otherwise(sentence),
    }


def sentences_of(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """key, sentence: the lines of texts that say something."""
    lines = docs.select(key, F.explode(F.split(text, "\n")).alias("line")).select(key, N.trim(F.col("line")).alias("sentence"))
    return lines.where((F.length("sentence") >= SENTENCE) & (F.length(N.fold(F.col("sentence"))) >= SKELETON))


def cases(docs: DataFrame, invented: DataFrame) -> DataFrame:
    """Doc, kind, truth, quote. ``docs``: doc, text, a handful; ``invented``: quote, a handful."""
    lines = sentences_of(docs)
    ways = F.array(*[F.struct(F.lit(k).alias("kind"), q.alias("quote")) for k, q in mutations(F.col("sentence")).items()])
    true = lines.select("doc", F.explode(ways).alias("w")).select("doc", "w.kind", F.lit(True).alias("truth"), "w.quote")
    other = docs.select("doc").join(F.broadcast(lines.withColumnRenamed("doc", "of")), F.col("doc") != F.col("of"))  # an evaluation set of a few dozen lines
    wrong = other.select("doc", F.lit("other document").alias("kind"), F.lit(False).alias("truth"), F.col("sentence").alias("quote"))
    made = docs.select("doc").join(F.broadcast(invented), F.lit(True)).select("doc", F.lit("invented").alias("kind"), F.lit(False).alias("truth"), "quote")
    words = docs.select("doc", F.filter(F.split("text", r"\s+"), lambda w: F.length(w) > 0).alias("words")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(PICKS - 1))))
    pick = F.transform(F.sequence(F.lit(0), F.lit(PICKED - 1)), lambda i: F.element_at("words", (F.pmod(F.col("k") * 3 + i * STRIDE, F.size("words")) + 1).cast("int")))
    scraps = words.select("doc", F.lit("scraps").alias("kind"), F.lit(False).alias("truth"), F.array_join(pick, " ").alias("quote"))
    return true.unionByName(wrong).unionByName(made).unionByName(scraps)


def old_check(quote: Column, source: Column) -> Column:
    """An exact substring, without marks and blanks; a short quote always passes."""
    q, s = F.lower(F.regexp_replace(quote, OLD_MARKS, "")), F.lower(F.regexp_replace(source, OLD_MARKS, ""))
    return (F.length(q) < SKELETON) | s.contains(q)


def judged(docs: DataFrame, invented: DataFrame) -> DataFrame:
    """``cases`` with old and new: whether the old check and the grounding rules accept them."""
    asked = cases(docs, invented).withColumn("id", F.xxhash64("doc", "kind", "quote"))
    sources = grounding.folded_sources(docs, "doc")
    table = grounding.quote_table(asked.select("id", "quote").distinct(), "id", "quote")
    scored = grounding.verify_quotes(grounding.score_quotes(sources, table, "doc", pairs=asked.select("doc", F.col("id").alias("quote")).distinct()))
    told = scored.select("doc", F.col("quote").alias("id"), (F.col("verdict") != "ungrounded").alias("new"))
    return asked.join(docs, "doc").withColumn("old", old_check(F.col("quote"), F.col("text"))).join(told, ["doc", "id"]).select("doc", "kind", "truth", "quote", "old", "new")


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(list(DOCS.items()), "doc string, text string"), spark.createDataFrame([(q,) for q in INVENTED], "quote string")


def _sql_text(x: str) -> str:
    return "(" + " || chr(10) || ".join(map(_quoted, x.split("\n"))) + ")"


_OLD = lambda x: f"lower(regexp_replace({x}, {_quoted(OLD_MARKS)}, '', 'g'))"
_FOLD = lambda rows, x: f"(SELECT *, {FOLD_SQL} AS f FROM (SELECT *, {x} AS text FROM ({rows})))"
_JUDGED = rf"""docs(doc, body) AS (VALUES {', '.join(f"({_quoted(k)}, {_sql_text(v)})" for k, v in DOCS.items())}), invented(quote) AS (VALUES {', '.join(f"({_quoted(q)})" for q in INVENTED)}),
l AS (SELECT doc, trim(unnest(string_split(body, chr(10)))) AS s FROM docs), lines AS (SELECT doc, s FROM {_FOLD('SELECT * FROM l', 's')} WHERE length(s) >= {SENTENCE} AND length(f) >= {SKELETON}),
w AS (SELECT doc, list_filter(string_split_regex(body, '\s+'), lambda x: x <> '') AS words, unnest(range(0, {PICKS})) AS k FROM docs),
cases AS (
 SELECT doc, 'as it is' AS kind, true AS truth, s AS quote FROM lines UNION ALL SELECT doc, 'cut short', true, substr(s, 1, greatest(12, length(s) * 7 // 10)) || '…' FROM lines UNION ALL SELECT doc, 'one line', true, replace(s, chr(10), ' ') FROM lines
 UNION ALL SELECT doc, 'other marks', true, replace(replace(s, '.', ' ·'), ',', ' ') FROM lines UNION ALL SELECT doc, 'no blanks', true, regexp_replace(s, '\s+', '', 'g') FROM lines UNION ALL SELECT doc, 'trimmed', true, CASE WHEN length(s) > 12 THEN substr(s, 4, length(s) - 6) ELSE s END FROM lines
 UNION ALL SELECT d.doc, 'other document', false, s FROM docs d JOIN lines l ON l.doc <> d.doc UNION ALL SELECT doc, 'invented', false, quote FROM docs, invented
 UNION ALL SELECT doc, 'scraps', false, array_to_string(list_transform(range(0, {PICKED}), lambda i: words[(k * 3 + i * {STRIDE}) % len(words) + 1]), ' ') FROM w),
q AS (SELECT row_number() OVER () AS id, doc, kind, truth, quote, f, length(f) - 3 AS n, (length(f) * 18) // 10 + 40 AS w FROM {_FOLD('SELECT * FROM cases', 'quote')}),
d AS (SELECT doc, body, f FROM {_FOLD('SELECT * FROM docs', 'body')}),
qg AS (SELECT id, doc, n, w, unnest(range(0, n)) AS i, unnest(list_transform(range(1, n + 1), lambda i: substr(f, i, 4))) AS gram FROM q WHERE n > 2),
dg AS (SELECT doc, unnest(range(0, length(f) - 3)) AS pos, unnest(list_transform(range(1, length(f) - 2), lambda i: substr(f, i, 4))) AS gram FROM d),
win AS (SELECT id, n, count(DISTINCT i) OVER (PARTITION BY id ORDER BY pos RANGE BETWEEN w PRECEDING AND CURRENT ROW) AS c FROM qg JOIN dg ON dg.doc = qg.doc AND dg.gram = qg.gram),
best AS (SELECT id, max(c) / CAST(n AS DOUBLE) AS s FROM win GROUP BY id, n),
judged AS (SELECT q.*, length({_OLD('quote')}) < {SKELETON} OR contains({_OLD('body')}, {_OLD('quote')}) AS old, CASE WHEN n > 2 THEN coalesce(s, 0) >= {grounding.WEAK} WHEN n > 0 THEN contains(d.f, q.f) ELSE true END AS new FROM q JOIN d ON d.doc = q.doc LEFT JOIN best b ON b.id = q.id)"""


@query(f"WITH {_JUDGED} SELECT kind, truth, count(*) AS n, count(*) FILTER (old = truth) AS old_right, count(*) FILTER (new = truth) AS new_right FROM judged GROUP BY kind, truth")
def grounding_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases and right verdicts of each kind."""
    rows = judged(*_tables(spark))
    return rows.groupBy("kind", "truth").agg(F.count("*").alias("n"), F.count_if(F.col("old") == F.col("truth")).alias("old_right"), F.count_if(F.col("new") == F.col("truth")).alias("new_right"))


def prf(rows: DataFrame, said: str, truth: str = "truth") -> DataFrame:
    """Checker, tp, fp, fn, precision, recall, f1 of a column of verdicts; a rate of nothing is 0."""
    counts = rows.agg(*[F.count_if(c).alias(n) for n, c in (("tp", F.col(said) & F.col(truth)), ("fp", F.col(said) & ~F.col(truth)), ("fn", ~F.col(said) & F.col(truth)))])
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(F.lit(said).alias("checker"), "tp", "fp", "fn", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


_PRF = lambda c: f"SELECT '{c}' AS checker, tp, fp, fn, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1 FROM (SELECT count(*) FILTER ({c} AND truth) AS tp, count(*) FILTER ({c} AND NOT truth) AS fp, count(*) FILTER (NOT {c} AND truth) AS fn FROM judged)"


@query(f"WITH {_JUDGED} {_PRF('old')} UNION ALL {_PRF('new')}")
def grounding_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of both checks."""
    rows = judged(*_tables(spark))
    return prf(rows, "old").unionByName(prf(rows, "new"))


#: Number, and what it is to the document "보고".
NUMBERS = [("3,400", "literal"), ("3400", "literal"), ("1150", "literal"), ("84", "literal"), ("2250", "derived"), ("63", "derived"), ("25", "derived"), ("105", "derived"), ("999", "unknown"), ("5000", "unknown"), ("7777.5", "unknown")]


@query(rf"""WITH f AS (SELECT unnest(regexp_extract_all({_sql_text(DOCS['보고'])}, {_quoted(N.NUMBER)}, 1)) AS raw), v AS (SELECT DISTINCT CAST({_number_sql("replace(raw, ',', '')")} AS DOUBLE) AS v FROM f),
c(raw, expected) AS (VALUES {', '.join(f"({_quoted(a)}, {_quoted(b)})" for a, b in NUMBERS)}), x AS (SELECT *, CAST(replace(raw, ',', '') AS DOUBLE) AS x FROM c)
SELECT raw, expected, CASE WHEN EXISTS (SELECT 1 FROM v WHERE abs(v - x) < 1e-9) THEN 'literal' WHEN EXISTS (SELECT 1 FROM v p JOIN v q ON p.v < q.v WHERE abs(q.v - p.v - x) < greatest(0.05, x * 1e-6) OR abs(p.v + q.v - x) < greatest(0.05, x * 1e-6)
 OR abs(p.v / q.v * 100 - x) < 0.05 OR (p.v <> 0 AND (abs(q.v / p.v * 100 - x) < 0.05 OR abs((q.v - p.v) / p.v * 100 - x) < 0.05))) THEN 'derived' ELSE 'unknown' END AS kind FROM x""")
def number_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that the source has, that follow from it, and others."""
    docs = spark.createDataFrame([("보고", DOCS["보고"])], "doc string, text string")
    claims = spark.createDataFrame([("보고", *x) for x in NUMBERS], "doc string, raw string, expected string")
    numbers = docs.select("doc", F.explode(N.numbers_in(F.col("text"))).alias("num"))
    return grounding.classify_numbers(claims, numbers, "doc").select("raw", "expected", "kind")


#: Words, and words that mean the same by the built-in seeds.
SYNONYMS = [("시작", "첫걸음"), ("봉사", "일손돕기"), ("자전거", "바이크"), ("산책", "나들이"), ("도서관", "열람실"), ("컨텐츠", "콘텐츠"), ("메세지", "메시지"), ("리더쉽", "리더십"), ("플젝", "팀과업"), ("캐리했다", "주도했다"), ("끝내기", "종료"), ("걷기", "소풍")]
DIFFERENT = [("산책", "청소"), ("바다", "은행"), ("시작", "종료")]


@query()
def synonym_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A, b, wanted, same: whether two words meet, by canon or by expansion. Its numbers are asserted in the tests."""
    words, clusters = lexicon.build_lexicon(spark), lexicon.seed_tables(spark)["clusters"]
    rows = spark.createDataFrame([(a, b, True) for a, b in SYNONYMS] + [(a, b, False) for a, b in DIFFERENT], "a string, b string, wanted boolean")
    canon = lexicon.with_canon(rows.select(F.explode(F.array("a", "b")).alias("token")).distinct(), words).select("token", "canon")
    wide = lexicon.expanded(canon.select("token"), words, clusters)
    named = rows.join(canon.select(F.col("token").alias("a"), F.col("canon").alias("ca")), "a").join(canon.select(F.col("token").alias("b"), F.col("canon").alias("cb")), "b")
    a_has = wide.select(F.col("token").alias("a"), F.col("word").alias("cb"), F.lit(True).alias("in_a"))
    b_has = wide.select(F.col("token").alias("b"), F.col("word").alias("ca"), F.lit(True).alias("in_b"))
    both = named.join(a_has, ["a", "cb"], "left").join(b_has, ["b", "ca"], "left")
    return both.select("a", "b", "wanted", ((F.col("ca") == F.col("cb")) | F.coalesce("in_a", F.lit(False)) | F.coalesce("in_b", F.lit(False))).alias("same"))


TYPED = "프로젝트 콘텐츠 자전거 도서관 박물관 고양이 강아지 인물사진 일기예보 음식점 우체국 애플리케이션 포트폴리오 모니터링 체크리스트 회계감사 장학금 동아리회장 시나리오 클라우드".split()


@query()
def typo_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed, known (typing errors that the lexicon has), held_out (others), recovered (of these, brought back to the word's canon by similarity)."""
    words = lexicon.build_lexicon(spark)
    typed = spark.createDataFrame([(w,) for w in TYPED], "token string")
    target = lexicon.with_canon(typed, words).select(F.col("token").alias("typed"), F.col("canon").alias("target"))
    errors = target.select("typed", "target", F.explode(typo_variants(F.col("typed"), 30)).alias("token"))
    known = errors.join(F.broadcast(words.select(F.col("surface").alias("token"), F.lit(True).alias("known"))), "token", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    found = lexicon.fuzzy_canon(known.where(~F.col("known")).select("token"), words).select("token", "canon")
    rows = known.join(found, "token", "left")
    return rows.groupBy("typed").agg(F.count_if("known").alias("known"), F.count_if(~F.col("known")).alias("held_out"), F.count_if(~F.col("known") & (F.col("canon") == F.col("target"))).alias("recovered"))
