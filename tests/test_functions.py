import random

import pytest
from pyspark.sql import functions as F

from moorage.functions import formats, hangul
from moorage.functions import normalize as N


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize(("word", "bare"), [("프로젝트에서", "프로젝트"), ("개선했습니다", "개선"), ("구현하였으며", "구현")])
def test_tokens_lose_particles_and_endings(spark, word, bare):
    assert one(spark, word, N.normalize_token) == bare


def test_numbers(spark):
    assert one(spark, "18,799", N.normalize_number) == "18799"
    assert one(spark, "1만", N.normalize_number) == "10000"
    assert set(one(spark, "1만8799 그리고 2024.06.24, 3.5%", N.numbers_in)) == {"10000", "1", "8799", "2024.06", "24", "3.5"}
    assert one(spark, None, N.numbers_in) == []


def test_tokenize(spark):
    got = one(spark, "주문 API를 개선했습니다", N.tokenize)
    assert {"주문", "api", "개선"} <= set(got)
    assert one(spark, None, N.tokenize) == []


def test_clean_drops_page_numbers_and_marks(spark):
    assert one(spark, "본문\n- 12 -\n① 항목 … 끝", N.clean) == "본문\n\n1 항목 ... 끝"
    assert one(spark, "A B​C-d", N.fold) == "abcd"


def test_grams(spark):
    assert one(spark, "가나다라마", N.ngrams) == ["가나다라", "나다라마"]
    assert one(spark, "가나", N.ngrams) == ["가나"]
    assert one(spark, "", N.ngrams) == []


def test_letters(spark):
    assert one(spark, "개선했습니다", hangul.decompose) == "ㄱㅐㅅㅓㄴㅎㅐㅆㅅㅡㅂㄴㅣㄷㅏ"
    assert one(spark, "개선", hangul.typo_variants) == ["게선", "깨선", "대선", "래선", "새선", "개션"]
    assert round(one(spark, "개선", lambda c: hangul.similarity(c, F.lit("게선"))), 2) == 0.95
    assert round(one(spark, "개선", lambda c: hangul.similarity(c, F.lit("향상"))), 2) == 0.47


def plain_distance(x, y):
    d = [[i + j if not i * j else 0.0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + hangul.jamo_cost(x[i - 1], y[j - 1]))
    return d[-1][-1]


def test_distance_is_the_whole_table():
    rng = random.Random(4)
    for _ in range(500):
        x, y = ("".join(rng.choices(hangul.LETTERS[:12] + ["a"], k=rng.randint(0, 9))) for _ in range(2))
        assert hangul.distance(x, y, 99) == pytest.approx(plain_distance(x, y))
        assert hangul.distance(x, y, 99) == pytest.approx(hangul.distance(y, x, 99))
        capped = hangul.distance(x, y, 2)
        assert capped == (pytest.approx(plain_distance(x, y)) if plain_distance(x, y) <= 2 else pytest.approx(capped)) and (plain_distance(x, y) <= 2 or capped > 2)


def test_formats(spark):
    assert one(spark, "<p>A&amp;lt;B</p><script>x()</script><br/>c", formats.html_to_text) == "A<B\n\nc"
    assert one(spark, "항목,수치\n전환율,12%", lambda c: formats.delimited_to_text(c, F.lit("a.csv"))) == "[표: a.csv]\n열: 항목 | 수치\n항목: 전환율 | 수치: 12%"
    raw = '{"cells": [{"cell_type": "markdown", "source": ["# T\\n", "x"]}, {"cell_type": "code", "source": "1+1", "outputs": [{"text": ["2"]}, {"data": {"text/plain": "two"}}]}]}'
    assert one(spark, raw, formats.notebook_to_text) == "# T\nx\n\n```\n1+1\n```\n\n출력: 2\n\n출력: two"
    assert one(spark, "[not json", formats.notebook_to_text) == "[not json"
    assert one(spark, '<a href="/x">label</a> <a href="/y"><b></b></a>', formats.html_links) == ["label → /x"]
