"""Texts with a million of one mark: no pattern recurses on its repeats or reads a run again and again."""

import pytest
from pyspark.sql import functions as F

from moorage.functions import formats
from moorage.functions import normalize as N
from moorage.plans import provider

MARKS = [".", "-", "|", " ", "\t", "\n", " \n", "*", "=", "_", "#", ">", ",", ":", "'", "(", "　", "—", "1", "1,", "1 ", "a", "A.", "가", "페이지 ", "page", "é", "·", "[", "]", "-\n", "| ", "|-"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, f"begin {m * (1_000_000 // len(m))} end. 12 가나다에서") for i, m in enumerate(MARKS)]
    rows += [(1000 + i, m * (1_000_000 // len(m))) for i, m in enumerate(MARKS)]
    return spark.createDataFrame(rows, "id int, text string").repartition(8)


@pytest.mark.parametrize("name", ["clean", "fold", "tokenize", "numbers", "sentences", "grams", "trim", "rtf", "subtitles", "pages", "digits", "stem"])
def test_functions(texts, name):
    t = F.col("text")
    made = {
        "clean": lambda: N.clean(t), "fold": lambda: N.fold(t), "tokenize": lambda: F.array_join(N.tokenize(t), " "), "numbers": lambda: F.array_join(N.numbers_in(t), " "), "sentences": lambda: F.array_join(N.sentences(t), " "),
        "grams": lambda: F.size(N.ngrams(t)).cast("string"), "trim": lambda: N.trim(t), "rtf": lambda: formats.rtf_to_text(t), "subtitles": lambda: formats.subtitles_to_text(t), "pages": lambda: formats.join_pages(F.array(t, t)), "digits": lambda: N.normalize_number(t), "stem": lambda: N.normalize_token(t),
    }[name]()
    got = {r.id: r.n for r in texts.select("id", F.length(made).alias("n")).collect()}
    assert len(got) == 2 * len(MARKS)


def test_trim_is_that_of_the_pattern(spark):
    rows = [("　﻿ a  b\n ",), ("​a​",), ("",), (" \t ",)]
    df = spark.createDataFrame(rows, "t string")
    same = df.select(N.trim(F.col("t")).alias("a"), F.regexp_replace("t", f"^{N.WS}+|{N.WS}+$", "").alias("b")).collect()
    assert all(r.a == r.b for r in same) and same[0].a == "a  b"


def test_lines_of_drafts(spark):
    from moorage.operators import schema

    specs = schema.field_rows(spark)
    lines = "\n".join(["-" * 200_000, "- " * 100_000, "#" * 200_000 + " 매장 이름: 가게", "**매장 이름**: 다른 가게"])
    docs = spark.createDataFrame([("d", lines)], "draft_id string, text string")
    typed = spark.createDataFrame([("d", "work.shift")], "draft_id string, type_id string")
    told = {(r.path, r.value) for r in provider.extract(docs, specs, typed).collect()}
    assert ("storeName", "가게") in told
