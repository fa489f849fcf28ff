"""Steps that grew too fast or broke off: the same results on larger inputs, within a time."""

import random
import time

from pyspark.sql import functions as F

from moorage.operators import grounding


def plain_best(text, quote, width):
    own, n = {}, len(quote) - 3
    for i in range(n):
        own.setdefault(quote[i : i + 4], []).append(i)
    hits = [(p, i) for p in range(len(text) - 3) for i in own.get(text[p : p + 4], ())]
    return max((len({i for p, i in hits if at - width <= p <= at}) for at, _ in hits), default=0) / n


def test_quotes_in_long_texts_of_few_words(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(150)]
    said = lambda n: "".join(rng.choices(words, k=n))
    quotes = [(i, said(rng.randint(2, 40))) for i in range(200)] + [(500, "xy😀z" + said(3)), (501, "abcd"), (502, "zzzz")]
    texts = [(d, said(60_000)) for d in range(10)] + [(20 + d, said(50) + quotes[d][1] + said(50)) for d in range(8)]
    texts += [(40, quotes[3][1][:30] + said(20) + quotes[3][1][30:]), (41, said(30) + quotes[200][1] + said(9)), (42, ""), (43, "zzz")]
    asked = spark.createDataFrame(quotes, "quote string, folded_quote string".replace("quote string,", "quote long,", 1))
    length = F.length("folded_quote")
    asked = asked.select("quote", "folded_quote", length.alias("length"), (length - 3).alias("n_grams"), (F.floor(length * 18 / 10).cast("long") + 40).alias("width"))
    sources = spark.createDataFrame(texts, "d long, folded string").coalesce(1).cache()
    sources.count()
    began = time.time()
    got = {(r.d, r.quote): r.score for r in grounding.score_quotes(sources, asked, "d", least=0.55).collect()}
    assert time.time() - began < 15
    assert got[41, 500] == 1.0
    held = {d: t for d, t in texts}
    for d in (20, 21, 22, 40, 41, 42, 43):
        for q, text in quotes:
            n = len(text) - 3
            want = float(text in held[d]) if n <= grounding.CONTAINED else plain_best(held[d], text, len(text) * 18 // 10 + 40)
            assert got.get((d, q)) == (want if want >= 0.55 else None)


def test_a_quote_is_verified_once(spark, tmp_path):
    from moorage.plans import surface_queries

    spark.createDataFrame([(i, f"text {i} of some words " * 20) for i in range(5)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = surface_queries.sql_verify_quotes(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [verify_folded") == 1


def test_documents_are_scored_in_their_rows(spark, monkeypatch):
    from moorage.operators import retrieval

    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    docs = [(f"d{i:03}" if i else None, rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 30))) for i in range(300)]
    docs += [(f"e{i:02}", ["w1", "w50"]) for i in range(20)] + [("f", None)]
    df = spark.createDataFrame(docs, "k string, words array<string>").repartition(5)
    asked = spark.createDataFrame([(q, w) for q in range(12) for w in {rng.choice(words) for _ in range(4)}] + [(12, "w1"), (12, "w50"), (13, "none"), (14, None)], "query long, term string")
    search = lambda: sorted(map(tuple, retrieval.bm25_search(df, "k", F.col("words"), asked).select("query", "rank", "k", F.round("score", 9)).collect()))
    near = search()
    monkeypatch.setattr(retrieval, "SCORES", 40)
    assert search() == near
    monkeypatch.setattr(retrieval, "SENT_PAIRS", 0)
    assert search() == near and {q for q, *_ in near} == set(range(13))


def test_grams_of_all_letters_are_counted(spark):
    from collections import Counter

    from moorage.functions import normalize as N

    rng = random.Random(6)
    texts = ["".join(rng.choices("ab😀가é", k=rng.randint(0, 40))) for _ in range(300)] + ["aaaaaaa" * 50, None, "", "abc", "abcd"]
    # More letters than a table of pairs holds.
    texts += ["".join(chr(0x4E00 + (i * k) % 9_000) for i in range(9_000)) for k in (1, 7)]
    n, df = Counter(), Counter()
    for t in texts:
        own = Counter(t[i : i + 4] for i in range(len(t or "") - 3))
        n.update(own)
        df.update(own.keys())
    rows = spark.createDataFrame([(t,) for t in texts], "f string")
    for parts in (1, 4):
        got = {r.gram: (r.n, r.df) for r in N.gram_counts(rows.repartition(parts)).collect()}
        assert got == {g: (n[g], df[g]) for g in n}
