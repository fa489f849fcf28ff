"""What larger tables showed: numbers of many digits, classes of marks, work that has to grow with the input."""

import random
from collections import Counter
from decimal import Decimal

import duckdb
from pyspark.sql import functions as F

from moorage.functions import normalize as N
from moorage.operators import gram_index, grounding
from moorage.plans import registry, sql_functions


def test_numbers_of_many_digits_are_printed_by_their_shortest_form(spark):
    rng = random.Random(3)
    raw = ["90819894045335504", "36798284236820096", "626238320783947639.3", "236487160908248851", "100000000000000000000000"]
    for _ in range(2000):
        digits = "".join(rng.choices("0123456789", k=rng.randint(1, 23)))
        at = rng.randint(1, len(digits))
        raw.append(digits[:at] + ("." + digits[at:] if digits[at:] else ""))
    rows = spark.createDataFrame([(x,) for x in raw], "s string")
    for got, x in ((r.p, r.s) for r in rows.select("s", N._shortest(F.col("s").cast("double")).alias("p")).collect()):
        assert Decimal(got) == Decimal(repr(float(x)))
    assert rows.limit(2).select(N.normalize_number(F.col("s"))).collect() == [("90819894045335500",), ("36798284236820100",)]
    sql_functions.register(spark)
    assert rows.where(N.normalize_number(F.col("s")) != F.expr("normalize_number(s)")).count() == 0


def test_skeletons_lack_what_the_three_classes_name(spark):
    rows = spark.createDataFrame([(f"a{chr(i)}b",) for i in range(1, 65536) if not 0xD800 <= i <= 0xDFFF], "t string")
    named = f"[{N.MARKS}{N.PUNCTUATION}{N.SPACES.removesuffix('+')}]+"
    assert rows.where(F.regexp_replace("t", named, "") != F.regexp_replace("t", N.LEFT_OUT, "")).count() == 0


def agrees(spark, folder, name):
    """Whether a query gives the rows of its SQL on the tables in the folder."""
    got = registry.queries()[name](spark, str(folder))
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    cols = ", ".join(f'"{c}"' for c in got.columns)
    return Counter(map(tuple, got.collect())) == Counter(con.execute(f"SELECT {cols} FROM ({registry.oracle_sql()[name]})").fetchall())


def test_numbers_beyond_the_decimal_are_as_in_the_sql(spark, tmp_path):
    long = "123456789012345678901234567890"
    texts = [f"code {long} and 42 of 603", f"{long} {long}1", "x 90819894045335504 y 12", "plain words here plains wordz"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("doc_numbers", "doc_tokens", "number_classify", "number_classify_all", "token_fuzzy", "stage_progress", "sql_text_stats"):
        assert agrees(spark, tmp_path, name), name


def test_index_finds_quotes_by_their_rare_grams(spark, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(5, 80))) for _ in range(80)] + [None, "", "abc"]
    quotes = [t[a : a + 50] + rng.choice(["", " xyzzy" * 3]) for t in texts[:40] for a in (0, 13)] + ["abcd", "abcde", "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = grounding.quote_table(spark.createDataFrame(list(enumerate(quotes)), "id long, text string"), "id", "text")
    gram_index.add_sources(docs.where("doc_id % 3 > 0"), "doc_id", f"{tmp_path}/grams", rows=5)
    gram_index.add_sources(docs.where("doc_id % 3 = 0"), "doc_id", f"{tmp_path}/grams", rows=5)
    for least in (0.55, 0.9):
        joined = grounding.score_quotes(grounding.folded_sources(docs, "doc_id"), asked, "doc_id", least=least, most_bytes=0)
        want = sorted(map(tuple, joined.collect()))
        assert want and sorted(map(tuple, gram_index.score_indexed(spark, f"{tmp_path}/grams", asked, "doc_id", least).collect())) == want
        assert sorted(map(tuple, grounding.score_quotes(grounding.folded_sources(docs, "doc_id"), asked, "doc_id", least=least).collect())) == want
