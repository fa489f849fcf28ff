import random

import pytest
from pyspark.sql import functions as F

from moorage.functions import normalize as N
from moorage.operators import grounding, lexicon, ocr, retrieval, schema
from moorage.plans import fixture_queries


def plain_score(folded, quote):
    """The sliding window over sorted hits, as defined."""
    grams = [quote[i : i + 4] for i in range(len(quote) - 3)]
    hits = sorted((p, i) for i, g in enumerate(grams) for p in range(len(folded) - 3) if folded[p : p + 4] == g)
    width, best = len(quote) * 18 // 10 + 40, 0
    for end, _ in hits:
        best = max(best, len({i for p, i in hits if end - width <= p <= end}))
    return best / len(grams)


def test_quote_scores_are_the_densest_windows(spark):
    rng = random.Random(8)
    docs = [(i, "".join(rng.choices("abcd", k=rng.randint(0, 260)))) for i in range(25)]
    quotes = [(j, "".join(rng.choices("abcd", k=rng.randint(6, 30)))) for j in range(6)] + [(90, "ab"), (91, "abcd"), (92, "abcde")]
    sources = grounding.folded_sources(spark.createDataFrame(docs, "d int, text string"), "d")
    table = grounding.quote_table(spark.createDataFrame(quotes, "q int, text string"), "q", "text")
    pairs = spark.createDataFrame([(d, q) for d, _ in docs for q, _ in quotes], "d int, quote int")
    got = {(r.d, r.quote): (r.score, r.where) for r in grounding.score_quotes(sources, table, "d", pairs=pairs).collect()}
    assert len(got) == len(docs) * len(quotes)
    for d, text in docs:
        for q, quote in quotes:
            want = 0.0 if len(quote) < 4 else float(quote in text) if len(quote) < 6 else plain_score(text, quote)
            assert got[d, q][0] == pytest.approx(want)
    assert got[0, 90][1] == "no content"
    for most in (10**6, 0):  # quotes sent to the workers, and joined
        least = {(r.d, r.quote): (r.score, r.where) for r in grounding.score_quotes(sources, table, "d", least=0.4, most_bytes=most).collect()}
        assert least == {k: v for k, v in got.items() if v[0] >= 0.4} and any(q > 90 for _, q in least)


def test_numbers_literal_derived_unknown(spark):
    docs = spark.createDataFrame([(1, "달성률 32.9% 에서 55.7% 로, 18,799 건")], "d int, text string")
    numbers = docs.select("d", F.explode(N.numbers_in(F.col("text"))).alias("num"))
    claims = spark.createDataFrame([(1, r) for r in ("22.8", "18,799", "777", "88.6", "x")], "d int, raw string")
    got = {r.raw: r.kind for r in grounding.classify_numbers(claims, numbers, "d").collect()}
    assert got == {"22.8": "derived", "18,799": "literal", "777": "unknown", "88.6": "derived", "x": "unknown"}


def test_lexicon(spark):
    words = lexicon.build_lexicon(spark).persist()
    rows = words.collect()
    assert 5_000 < len({r.surface for r in rows}) == len(rows) <= lexicon.TARGET
    assert lexicon.build_lexicon(spark, target=700).count() == 700
    canon = {r.surface: r.canon for r in rows}
    assert canon["첫걸음"] == "시작" and canon["컨텐츠"] == "콘텐츠" and canon["효율화"] == "효율"
    assert not any(s.startswith(("식당하", "날씨하", "기차하", "의자하", "이웃하")) for s in canon)
    caps = {r: c for r, c in lexicon.BUDGET if c}
    counts = {r.origin: r.entries for r in lexicon.stats(words).collect()}
    assert all(counts.get(r, 0) <= c for r, c in caps.items())
    tokens = spark.createDataFrame([("캐리했다",), ("프로젝드",), ("컨텐츠를",)], "token string")
    assert {r.token: r.canon for r in lexicon.with_canon(tokens, words).collect()}["캐리했다"] == "주도"
    assert {r.token: r.canon for r in lexicon.fuzzy_canon(tokens, words).collect()}["프로젝드"] == "프로젝트"


def test_terms(spark):
    words, clusters = lexicon.build_lexicon(spark), lexicon.seed_tables(spark)["clusters"]
    docs = spark.createDataFrame([(1, "주문 처리를 시작했습니다. Redis 도입")], "d int, text string")
    tokens = docs.select("d", F.explode(N.tokenize(F.col("text"))).alias("token")).distinct()
    claims = spark.createDataFrame([(1, t) for t in ("시작", "첫걸음", "프로젝트", "redis", "그리고", "", "시직")], "d int, term string")
    got = {r.term: r.found for r in lexicon.checked_terms(claims, grounding.folded_sources(docs, "d"), tokens, words, clusters, "d").collect()}
    assert got == {"시작": True, "첫걸음": True, "프로젝트": False, "redis": True, "그리고": True, "": True, "시직": True}


def test_bm25_prefers_the_document_with_the_words(spark):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "apple apple kiwi"), (3, "none"), (4, None)], "d int, text string")
    queries = spark.createDataFrame([("q", "apple"), ("q", "kiwi")], "query string, term string")
    got = retrieval.bm25_search(docs, "d", N.tokenize(F.col("text")), queries, top=2).orderBy("rank").collect()
    assert [r.d for r in got] == [2, 1]


def test_recognition_consensus(spark):
    got = {r.image: r for r in fixture_queries.ocr_score(spark, "").collect()}
    assert got[1].agreement == 1.0 and got[1].confidence == pytest.approx((0.95 + 0.9) / 2) and not got[1].reread_wanted
    assert got[2].engine == "tess" and got[2].confidence == pytest.approx((0.95 + 0.5) / 2) and got[2].reread_wanted
    assert got[3].confidence == pytest.approx(0.62 - 0.5 * min(1, 1 / max(1, 5 / 4)))
    assert got[4].text == "" and got[4].confidence == 0


def test_dice_of_equal_and_empty(spark):
    rows = spark.createDataFrame([(1, "가 나", "가나"), (2, "", "a"), (3, "ab", "cd")], "i int, a string, b string")
    assert {r.i: r.dice for r in ocr.dice(rows, "i", "a", "b").collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_seeds_from_a_file(spark, tmp_path):
    path = tmp_path / "seeds.json"
    path.write_text('{"clusters": {"개선": "다듬기"}, "short": {"앱": "애플리케이션"}}', encoding="utf-8")
    canon = {r.surface: r.canon for r in lexicon.build_lexicon(spark, lexicon.seed_tables(spark, lexicon.load_seeds(str(path)))).collect()}
    assert canon["다듬기"] == "개선" and canon["앱"] == "애플리케이션" and canon["개선했다"] == "개선" and "첫걸음" not in canon


def test_schemas():
    form = schema.json_schema(schema.SAMPLE["work.shift"])
    assert form["required"] == list(form["properties"]) and not form["additionalProperties"]
    assert all("null" in p["type"] for p in form["properties"].values())
    told = schema.provider_schema(form)
    assert told["type"] == "OBJECT" and told["propertyOrdering"] == form["required"] and "required" not in told
    assert schema.struct_type(schema.SAMPLE["work.shift"])["duties"].dataType.elementType["duty"].dataType.simpleString() == "string"


def test_superseded_fields(spark):
    fields = schema.all_fields(schema.field_rows(spark))
    keys = {r.key for r in fields.where("type_id = 'trip.visit' AND parent_key IS NULL").collect()}
    assert "period" not in keys and "visitPeriod" in keys and "background" not in keys
