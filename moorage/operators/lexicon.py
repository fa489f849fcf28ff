"""The lexicon: rules that generate it, and look-ups against it.

Seeds are data by parameter (a table of clusters, spellings, abbreviations);
everything else is generated by rules with DataFrame expressions. A surface
that several rules give belongs to the first in the order of generation; rules
are then filled in the order of their budget until the target is reached.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hangul import letter_classes, may_reach, similarity, typo_variants
from ..functions.letter_trie import LetterTrie
from ..functions.normalize import normalize_token, tokenize
from ..session import cut_lineage

# Endings, heads, affixes and budgets of the rules.
INFLECTIONS = "하다 했다 하는 하여 하고 함 하기 한 했음 했습니다 하였다 해왔다 하려 하도록 하며 해야 되다 됐다 되는 되어 된 됨 되었다 됐음 되었습니다 시키다 시킴 시켰다".split()
HEADS = "개선 감소 증가 달성 해결 기여 수상 인정 담당 주도 참여 보조 협업 소통 조율 기획 개발 운영 분석 발표 교육 검증 리뷰 대응 예방 학습 회고 성장 배포 자동화 봉사 주최 실패 시작 종료 마감 계획 목표 동기".split()
SUFFIXES, PREFIXES = "화 성 적 력 도 율 량 치".split(), "재 고 저 초 신 구 최 비 미".split()
STEMS = "효율 안정 확장 생산 정확 신뢰 가독 재사용 유지보수 일관 완성 차별 지속 접근 호환 최적 자동 표준 통합 분산 병렬 실시간 동시 독립".split()
#: Rules in the order in which they are filled, with the most surfaces of each.
BUDGET = [("seed", None), ("variant", None), ("collo", None), ("abbr", None), ("affix-stem", None), ("affix", None), ("typo", 4200), ("infl", 4200), ("affix+infl", 900), ("collo+infl", 600)]
#: The order in which rules generate.
GENERATION = ["seed", "variant", "collo", "abbr", "affix-stem", "affix", "infl", "affix+infl", "collo+infl", "typo"]
TARGET, TYPOS = 10_000, 14
FUZZY, FUZZY_TERM = 0.86, 0.88

#: Small seeds of our own, for a start and for tests; ``load_seeds`` reads larger ones from a file. Heads with their members; every head of the rules stands for itself.
CLUSTERS = {h: "" for h in HEADS} | {
    "시작": "첫걸음 첫발", "종료": "끝내기", "소통": "대화나눔", "봉사": "일손돕기 이웃돕기", "회고": "돌아봄", "계획": "짜임새", "프로젝트": "팀과업", "콘텐츠": "읽을거리 볼거리",
    "요리": "조리 밥짓기 음식준비", "식당": "음식점 밥집 한식집", "날씨": "기상 일기예보", "자전거": "두바퀴 바이크", "기차": "열차 급행열차", "버스": "시내버스 마을버스", "산책": "걷기 나들이 소풍",
    "청소": "정돈 쓸기 닦기", "빨래": "세탁 손빨래", "장보기": "마트방문 식료품구매", "정원": "화단 텃밭", "책장": "서가 책꽂이", "의자": "걸상 좌석", "이웃": "옆집 동네사람", "아침": "새벽녘 오전", "저녁": "해질녘 초저녁",
    "병원": "의원 보건소", "약국": "조제실", "우체국": "우편취급국", "은행": "금융창구", "도서관": "열람실 책마루", "박물관": "전시관 기념관", "바다": "해변 바닷가", "산": "봉우리 산등성이", "강": "하천 물줄기",
    "고양이": "길냥이 반려묘", "강아지": "반려견 멍멍이", "사진": "스냅 인물사진", "노래": "가창 합창", "그림": "회화 스케치", "춤": "무용 안무", "축구": "풋살", "수영": "물놀이 자유형", "달리기": "조깅 마라톤",
    "봄": "새봄 초봄", "여름": "한여름 초여름", "가을": "늦가을", "겨울": "한겨울", "커피": "원두커피 라테", "차": "녹차 홍차", "우유": "저지방우유", "과일": "사과 복숭아", "채소": "상추 시금치",
}
SPELLINGS = {"컨텐츠": "콘텐츠", "메세지": "메시지", "어플리케이션": "애플리케이션", "리더쉽": "리더십", "프리젠테이션": "프레젠테이션", "워크샵": "워크숍", "스케쥴": "스케줄"}
SLANG = {"캐리하다": "주도", "캐리": "주도", "갈아넣다": "집중투입", "빌드업": "준비", "떡상": "증가", "떡락": "감소", "존버": "지속"}
SHORT = {"플젝": "프로젝트", "알바": "아르바이트", "공모": "공모전", "컨퍼": "컨퍼런스", "디비": "데이터베이스"}


#: Words that are often mistyped and in no cluster.
OFTEN_MISTYPED = (
    "알고리즘 데이터베이스 네트워크 서버개발 클라우드 컨테이너 파이프라인 인공지능 머신러닝 딥러닝 시각화 대시보드 통계분석 회귀분석 설문조사 인터뷰 벤치마킹 사용성평가 프로토타입 와이어프레임 "
    "브랜딩 캠페인 콘텐츠기획 영상편집 촬영감독 연출가 시나리오 포트폴리오 전시회 공연기획 동아리회장 총무부장 학생회 장학금 졸업논문 학술대회 연구실 실험설계 교환학생 어학연수 "
    "자격증시험 합격수기 모의고사 문제풀이 스터디그룹 멘토링 튜터링 봉사시간 후원금 기부행사 환경보호 지역사회 취약계층 청소년 다문화가정 독거노인 재능나눔 해외봉사 국제교류 통역사 번역가 "
    "매장관리 재고관리 고객상담 판매전략 영업실적 거래처 계약서 견적서 세금계산서 회계감사 재무제표 투자유치 사업계획서 창업경진대회 스타트업 액셀러레이터 특허출원 기술이전 품질관리 공정개선 "
    "안전점검 설비보전 생산계획 물류창고 유통채널 구매담당자 인사평가 채용공고 조직문화 복리후생 워크플로 체크리스트 마일스톤 스프린트 백로그 코드리뷰 단위테스트 통합테스트 배포자동화 모니터링"
).split()


SEEDS: dict = {"clusters": CLUSTERS, "spellings": SPELLINGS, "slang": SLANG, "short": SHORT, "mistyped": OFTEN_MISTYPED}


def load_seeds(path: str) -> dict:
    """Seeds from a JSON file in the form of SEEDS: clusters {head: "member member"}, spellings, slang, short {surface: stands for}, mistyped [word]. What is missing is empty."""
    with open(path, encoding="utf-8") as f:
        return {"clusters": {}, "spellings": {}, "slang": {}, "short": {}, "mistyped": []} | json.load(f)


def seed_tables(spark: SparkSession, seeds: dict = SEEDS) -> dict[str, DataFrame]:
    """The seeds as tables with their order: clusters (head, member), spellings, slang and short (surface, stands)."""
    members = [(n, head, m) for n, (head, m) in enumerate((h, m) for h, ms in seeds["clusters"].items() for m in [h, *ms.split()])]
    tables = {"clusters": spark.createDataFrame(members, "n int, head string, member string"), "mistyped": spark.createDataFrame(list(enumerate(seeds["mistyped"])), "n int, word string")}
    for name in ("spellings", "slang", "short"):
        tables[name] = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(seeds[name].items())], "n int, surface string, stands string")
    return tables


def _words(spark: SparkSession, words: list[str], name: str) -> DataFrame:
    return spark.createDataFrame([(i, w) for i, w in enumerate(words)], f"{name}_n int, {name} string")


def inflectable(word: Column) -> Column:
    """Words that an ending may follow: two or more syllables, no verb form yet."""
    return (F.length(word) >= 2) & word.rlike("^[가-힣]+$") & ~word.rlike("(?:하다|되다|다|음|함|기)$")


def candidates(spark: SparkSession, seeds: dict[str, DataFrame]) -> DataFrame:
    """rule, a, b, c, surface, canon: all that the rules give; a, b, c order them within a rule."""
    cluster = seeds["clusters"]
    first = F.row_number().over(Window.partitionBy("member").orderBy("n"))
    canon_of = cluster.withColumn("k", first).where("k = 1").select(F.col("member").alias("word"), F.col("head").alias("base"))

    def based(name: str) -> DataFrame:
        rows = seeds[name].join(F.broadcast(canon_of), F.col("stands") == F.col("word"), "left")
        return rows.select("n", "surface", "stands", F.coalesce("base", "stands").alias("base"))

    def rule(rows: DataFrame, name: str, surface: str, canon: str, a: str, b: int | str = 0, c: int | str = 0) -> DataFrame:
        col = lambda x: F.col(x).cast("int") if isinstance(x, str) else F.lit(x)
        return rows.select(F.lit(name).alias("rule"), col(a).alias("a"), col(b).alias("b"), col(c).alias("c"), F.col(surface).alias("surface"), F.col(canon).alias("canon"))

    spelled, slang, short = based("spellings"), based("slang"), based("short")
    stems, endings = _words(spark, STEMS, "stem"), F.broadcast(_words(spark, INFLECTIONS, "ending"))
    forms = spark.createDataFrame([(i, "", s) for i, s in enumerate(SUFFIXES)] + [(len(SUFFIXES) + i, p, "") for i, p in enumerate(PREFIXES)], "form_n int, pre string, post string")
    affixed = stems.crossJoin(F.broadcast(forms)).withColumn("word", F.concat("pre", "stem", "post"))  # 24 stems, 17 affixes
    # Words that may be inflected, in the order in which they were met.
    met = canon_of.join(cluster.groupBy("member").agg(F.min("n").alias("a")), F.col("word") == F.col("member")).select(F.lit(0).alias("g"), "a", "word", F.col("base").alias("canon"))
    for g, (rows, w) in enumerate(((spelled, "surface"), (slang, "surface"), (short, "surface")), 1):
        met = met.unionByName(rows.select(F.lit(g).alias("g"), F.col("n").alias("a"), F.col(w).alias("word"), F.col("base").alias("canon")))
    headed = met.where(F.col("canon").isin(HEADS) & inflectable(F.col("word"))).withColumn("place", F.col("g") * 100_000 + F.col("a"))
    inflected = headed.crossJoin(endings).withColumn("form", F.concat("word", "ending"))  # seeds times 28 endings
    made = affixed.where(F.col("word").rlike("[화성]$") & inflectable(F.col("word"))).crossJoin(endings).withColumn("form", F.concat("word", "ending"))
    spoken = slang.where(inflectable(F.col("surface"))).crossJoin(endings).withColumn("form", F.concat("surface", "ending"))
    targets = met.where("g = 0").select(F.lit(0).alias("g"), "a", "word", "canon").unionByName(seeds["mistyped"].select(F.lit(-1).alias("g"), F.col("n").alias("a"), "word", F.col("word").alias("canon")))
    for g, rows in enumerate((spelled, short), 1):
        targets = targets.unionByName(rows.select(F.lit(g).alias("g"), F.col("n").alias("a"), F.col("stands").alias("word"), F.col("base").alias("canon")))
    once = targets.withColumn("k", F.row_number().over(Window.partitionBy("word").orderBy("g", "a"))).where("k = 1").withColumn("place", F.col("g") * 100_000 + F.col("a"))
    typos = once.select("place", "canon", F.posexplode(typo_variants(F.col("word"), TYPOS)).alias("t", "form"))
    parts = [
        rule(cluster, "seed", "member", "head", "n"),
        rule(spelled, "variant", "stands", "base", "n", 0),
        rule(spelled, "variant", "surface", "base", "n", 1),
        rule(slang, "collo", "surface", "base", "n"),
        rule(short, "abbr", "stands", "base", "n", 0),
        rule(short, "abbr", "surface", "base", "n", 1),
        rule(stems, "affix-stem", "stem", "stem", "stem_n"),
        rule(affixed, "affix", "word", "stem", "stem_n", "form_n"),
        rule(inflected, "infl", "form", "canon", "place", "ending_n"),
        rule(made, "affix+infl", "form", "stem", "stem_n", "form_n", "ending_n"),
        rule(spoken, "collo+infl", "form", "base", "n", "ending_n"),
        rule(typos, "typo", "form", "canon", "place", "t"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.col("surface") != "")


def _order(names: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col("rule"))


def build_lexicon(spark: SparkSession, seeds: dict[str, DataFrame] | None = None, target: int = TARGET) -> DataFrame:
    """surface, canon, origin, len."""
    made = candidates(spark, seeds or seed_tables(spark))
    first = Window.partitionBy("surface").orderBy(_order(GENERATION), "a", "b", "c")
    own = made.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    nth = F.row_number().over(Window.partitionBy("rule").orderBy("a", "b", "c", "surface"))
    cap = F.coalesce(*[F.when(F.col("rule") == r, F.lit(c)) for r, c in BUDGET if c is not None], F.lit(1 << 30))
    within = own.withColumn("_nth", nth).where(F.col("_nth") <= cap)
    # At most the sum of the rules' output, some ten thousand rows, for any corpus.
    filled = within.withColumn("_at", F.row_number().over(Window.orderBy(_order([r for r, _ in BUDGET]), "_nth"))).where(F.col("_at") <= target)
    return filled.select("surface", "canon", F.col("rule").alias("origin"), F.length("surface").alias("len"))


def conflicts(spark: SparkSession, seeds: dict[str, DataFrame] | None = None) -> DataFrame:
    """Surfaces that rules give to different canons, before the first wins."""
    made = candidates(spark, seeds or seed_tables(spark))
    return made.groupBy("surface").agg(F.sort_array(F.collect_set("canon")).alias("canons")).where(F.size("canons") > 1)


def stats(lexicon: DataFrame) -> DataFrame:
    """Entries of each rule."""
    return lexicon.groupBy("origin").agg(F.count("*").alias("entries"))


def members(lexicon: DataFrame, clusters: DataFrame) -> DataFrame:
    """Canon, member: the surfaces of a canon and its cluster's members."""
    own = lexicon.select("canon", F.col("surface").alias("member"))
    return own.union(clusters.select("head", "member")).distinct()


def with_canon(tokens: DataFrame, lexicon: DataFrame, token: str = "token") -> DataFrame:
    """``tokens`` with canon: of the normalised token, else of the plain one, else the normalised token.

    Spark broadcasts the lexicon by its size: at most TARGET rows.
    """
    a = lexicon.select(F.col("surface").alias("_a"), F.col("canon").alias("_ca"))
    b = lexicon.select(F.col("surface").alias("_b"), F.col("canon").alias("_cb"))
    asked = tokens.withColumn("_t", normalize_token(F.col(token))).withColumn("_p", F.lower(F.trim(F.col(token))))
    found = asked.join(F.broadcast(a), F.col("_t") == F.col("_a"), "left").join(F.broadcast(b), F.col("_p") == F.col("_b"), "left")
    return found.withColumn("canon", F.coalesce("_ca", "_cb", "_t")).drop("_t", "_p", "_a", "_b", "_ca", "_cb")


#: Surfaces of a trie, and tokens that are looked up in it by one task, about.
TRIE, ASKED = 50_000, 5_000


def _look_up(threshold: float):
    """Each token with the best of the surfaces that its group has, if there is any."""

    def look_up(asked: pd.DataFrame, surfaces: pd.DataFrame) -> pd.DataFrame:
        # One for each length, so that a walk is bounded by words of that length.
        tries = {n: LetterTrie(part) for n, part in surfaces["surface"].groupby(surfaces["surface"].str.len())}
        rows = []
        for t in asked["_t"]:
            hits = [(-hit[1], n, hit[0]) for n in (len(t) - 1, len(t), len(t) + 1) if n in tries and (hit := tries[n].best(t, threshold, (n,)))]
            if hits:
                score, _, surface = min(hits)
                rows.append((t, surface, -score))
        return pd.DataFrame(rows, columns=["_t", "surface", "score"]).astype({"_t": object, "surface": object, "score": float})

    return look_up


def fuzzy_canon(tokens: DataFrame, lexicon: DataFrame, token: str = "token", threshold: float = FUZZY, trie: int = TRIE, asked_at_once: int = ASKED) -> DataFrame:
    """Token, canon, score: the most similar surface of a length one off at most.

    Tokens that the lexicon lacks go down a trie of its surfaces with a weighted
    automaton (``LetterTrie``), each distinct one once. A lexicon of more than
    ``trie`` surfaces is several tries, and tokens are dealt out, so a task has a
    bounded part of both. Of equally similar ones the shorter, then the earlier
    surface in order of name. Below the threshold, and for a null token, the
    normalised token with score 0.
    """
    named = cut_lineage(tokens.select(token).distinct().withColumn("_t", normalize_token(F.col(token))))
    rest = cut_lineage(named.where("_t IS NOT NULL").select("_t").distinct().join(lexicon.select(F.col("surface").alias("_t")), "_t", "left_anti"))
    parts, deals = (max(1, -(-n // most)) for n, most in ((lexicon.count(), trie), (rest.count(), asked_at_once)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rest.select("_t", F.pmod(F.xxhash64("_t"), F.lit(deals)).cast("int").alias("_deal"), every(parts).alias("_part"))
    held = lexicon.select("surface", F.pmod(F.xxhash64("surface"), F.lit(parts)).cast("int").alias("_part"), every(deals).alias("_deal"))
    found = asked.groupBy("_part", "_deal").cogroup(held.groupBy("_part", "_deal")).applyInPandas(_look_up(threshold), "_t string, surface string, score double")
    best = found.groupBy("_t").agg(F.min(F.struct((-F.col("score")).alias("s"), F.length("surface").alias("len"), "surface")).alias("m"))
    near = best.select("_t", F.col("m.surface").alias("surface"), (-F.col("m.s")).alias("score")).join(lexicon.select("surface", "canon"), "surface")
    exact = named.join(lexicon.select(F.col("surface").alias("_t"), "canon"), "_t").select("_t", "canon", F.lit(1.0).alias("score")).distinct()
    told = named.join(exact.unionByName(near.select("_t", "canon", "score")), "_t", "left")
    return told.select(token, F.coalesce("canon", "_t").alias("canon"), F.coalesce("score", F.lit(0.0)).alias("score"))


def expanded(tokens: DataFrame, lexicon: DataFrame, clusters: DataFrame, token: str = "token") -> DataFrame:
    """Token, word: the canon, the normalised token and all members of the canon."""
    named = with_canon(tokens.select(token).distinct(), lexicon, token)
    own = named.select(token, F.explode(F.array("canon", normalize_token(F.col(token)))).alias("word"))
    more = named.join(members(lexicon, clusters), "canon").select(token, F.col("member").alias("word"))
    return own.unionByName(more).where("word <> ''").distinct()


def analyzed(docs: DataFrame, lexicon: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Key, pos, term: the text's tokens as canons, in order."""
    tokens = docs.select(key, F.posexplode(tokenize(F.col(text))).alias("pos", "token"))
    return with_canon(tokens, lexicon).select(key, "pos", F.col("canon").alias("term"))


def checked_terms(claims: DataFrame, sources: DataFrame, tokens: DataFrame, lexicon: DataFrame, clusters: DataFrame, key: str, threshold: float = FUZZY_TERM) -> DataFrame:
    """``claims`` (key, term) with found: stop words and blanks are; else a term is found in its source as token, as part of the folded text, by canon, by an expansion, or but for typing errors.

    Each step takes what the ones before have left. ``sources``: key, folded;
    ``tokens``: key, token, each once.
    """
    from ..functions.normalize import STOPWORDS, fold

    t = F.trim("term")
    asked = claims.select(key, "term").distinct()
    trivial = asked.where((t == "") | F.lower(t).isin(STOPWORDS)).select(key, "term")
    rest = asked.join(trivial, [key, "term"], "left_anti")
    as_token = rest.withColumn("token", F.explode(F.array(t, F.lower(t)))).join(tokens, [key, "token"], "left_semi").select(key, "term").distinct()
    rest1 = rest.join(as_token, [key, "term"], "left_anti")
    inside = rest1.withColumn("_f", fold(F.col("term"))).join(sources.select(key, "folded"), key).where((F.col("_f") != "") & F.col("folded").contains(F.col("_f"))).select(key, "term")
    rest2 = rest1.join(inside, [key, "term"], "left_anti")
    canons = with_canon(tokens, lexicon).select(key, F.col("canon").alias("word")).union(tokens.select(key, "token")).distinct()
    words = expanded(rest2, lexicon, clusters, "term")
    meant = rest2.join(words, "term").join(canons, [key, "word"], "left_semi").select(key, "term").distinct()
    rest3 = rest2.join(meant, [key, "term"], "left_anti")
    offsets = rest3.withColumn("_l", letter_classes(t)).withColumn("len", F.explode(F.array(*[F.length(t) + d for d in range(-2, 3)])))
    lettered = offsets.join(tokens.withColumns({"len": F.length("token"), "_m": letter_classes(F.col("token"))}), [key, "len"]).where(may_reach(F.col("_l"), F.col("_m"), threshold))
    near = lettered.where(similarity(t, F.col("token")) >= threshold).select(key, "term").distinct()
    found = trivial.union(as_token).union(inside).union(meant).union(near).distinct().withColumn("found", F.lit(True))
    return claims.join(found, [key, "term"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
