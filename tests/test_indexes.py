import random
import uuid

import pytest
from pyspark.sql import functions as F

from moorage.functions import hangul
from moorage.functions.letter_trie import LetterTrie
from moorage.operators import gram_index, grounding, lexicon, retrieval, search_index


def corpus(spark, n=300, seed=2):
    rng = random.Random(seed)
    words = [f"term{i}" for i in range(150)]
    rows = [(i, ["every"] + rng.choices(words, [1 / (k + 1) for k in range(150)], k=rng.choice((0, 3, 20, 60)))) for i in range(n)]
    return spark.createDataFrame(rows + [(n, []), (n + 1, ["every"] * 50)], "d long, tokens array<string>"), words


def test_search_is_that_of_all_postings(spark, tmp_path):
    docs, words = corpus(spark)
    rng = random.Random(4)
    asked = [(q, w) for q in range(25) for w in {"every", "nowhere", *rng.choices(words, k=rng.randint(1, 9))}]
    queries = spark.createDataFrame(asked, "query int, term string")
    want = sorted(map(str, retrieval.bm25_search(docs, "d", F.col("tokens"), queries, 4).select("query", "d", F.round("score", 9), "rank").collect()))
    for k, (block, part) in enumerate([(128, 65_536), (4, 50), (1, 7)]):
        path = f"file://{tmp_path}/{k}"
        search_index.build_index(docs, "d", F.col("tokens"), path, block=block, part=part, buckets=3)
        got = search_index.search_index(spark, path, queries, "d", 4).select("query", "d", F.round("score", 9), "rank").collect()
        assert sorted(map(str, got)) == want


def test_blocks_that_cannot_matter_are_not_read(spark, tmp_path):
    rows = [(i, ["common"] + ["rare"] * (i < 3) + ["pad"] * 30) for i in range(2000)]
    docs = spark.createDataFrame(rows, "d long, tokens array<string>")
    path = f"file://{tmp_path}/x"
    search_index.build_index(docs, "d", F.col("tokens"), path, block=50)
    queries = spark.createDataFrame([(1, "common"), (1, "rare")], "query int, term string")
    needed = search_index.needed_blocks(spark, path, queries, 3)
    read = {r.term: (r.n, r.e) for r in needed.groupBy("term").agg(F.count("*").alias("n"), F.max("essential").alias("e")).collect()}
    assert read["rare"] == (1, True) and not read["common"][1]
    assert [r.d for r in search_index.search_index(spark, path, queries, "d", 3).orderBy("rank").collect()] == [0, 1, 2]


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(9)
    words = ["harbour", "lantern", "meadow", "river", "garden", "작업을", "개선했다", "820ms"]
    rows = [(i, " ".join(["shared beginning of all"] + rng.choices(words, k=rng.randint(0, 60)))) for i in range(80)] + [(100, None), (101, ""), (102, "abc")]
    return rows, spark.createDataFrame(rows, "doc long, text string")


def test_quotes_from_the_index(spark, sources, tmp_path):
    rows, docs = sources
    quotes = [(i, t[: 20 + 7 * (i % 5)]) for i, t in rows if t and i % 3 == 0] + [(200, "shared beginning"), (201, "harb"), (202, "ur"), (203, "river garden " * 5), (204, "nothing of it anywhere at all"), (205, None)]
    table = grounding.quote_table(spark.createDataFrame(quotes, "q long, text string"), "q", "text")
    want = grounding.score_quotes(grounding.folded_sources(docs, "doc"), table, "doc", least=0.3)
    want = sorted(str((r.doc, r.quote, round(r.score, 9), r["where"])) for r in want.collect())
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    # Every gram is hot at three postings; three batches, the last a single source.
    for k, part in enumerate([docs.where("doc < 40"), docs.where("doc >= 40 AND doc <> 77"), docs.where("doc = 77")]):
        assert gram_index.add_sources(part, "doc", path, rows=3, buckets=4) == k
    got = gram_index.score_indexed(spark, path, table, "doc", 0.3)
    assert sorted(str((r.doc, r.quote, round(r.score, 9), r["where"])) for r in got.collect()) == want
    salts = spark.read.parquet(f"{path}/grams").agg(F.max("salts")).first()[0]
    assert salts == 14
    for again in (docs.where("doc = 77"), docs.where("doc = 500").unionByName(spark.createDataFrame([(900, "x"), (900, "y")], "doc long, text string"))):
        with pytest.raises(ValueError, match="already or given twice"):
            gram_index.add_sources(again, "doc", path)


def words_of(rng):
    syllables = "가게개대데래새션선프로젝트드콘컨텐츠향상알고리즘"
    return "".join(rng.choices(syllables, k=rng.randint(1, 5)))


def test_distance_in_the_jvm_is_the_plain_one(spark):
    rng = random.Random(1)
    rows = [(words_of(rng), words_of(rng)) for _ in range(150)]
    rows += [(w, w[:-1] + rng.choice("개게새선a")) for w, _ in rows[:80]] + [("", ""), ("", "가"), ("abc", "abd"), ("가a", "a가"), (None, "가"), ("가", None), ("ㅏㅐ", "ㅐㅏ")]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", hangul.similarity(F.col("a"), F.col("b")).alias("s"), hangul.weighted_distance(F.col("a"), F.col("b"), 3).alias("d")).collect():
        if r.a is None or r.b is None:
            assert r.s is None and r.d is None
        else:
            assert r.s == pytest.approx(hangul.pair_similarity(r.a, r.b), abs=1e-12)
            assert r.d == pytest.approx(hangul.distance(hangul.letters_of(r.a), hangul.letters_of(r.b), 3), abs=1e-12)


def test_fuzzy_look_up_is_that_of_all_pairs(spark):
    rng = random.Random(3)
    surfaces = sorted({words_of(rng) for _ in range(250)} | {"international", "internation", "garden", "gardens"})
    tokens = [words_of(rng) for _ in range(120)] + ["internatiomal", "gardem", "gardn", surfaces[0], "x"]
    def best(word, threshold):
        found = [(-hangul.pair_similarity(word, s), len(s), s) for s in surfaces if abs(len(s) - len(word)) <= 1]
        found = [f for f in found if -f[0] >= threshold]
        return min(found) if found else None

    trie = LetterTrie(surfaces)
    for threshold in (0.6, 0.86):
        for t in tokens:
            want, got = best(t, threshold), trie.best(t, threshold, (len(t) - 1, len(t), len(t) + 1))
            assert (got is None) == (want is None)
            assert want is None or (got[0] == want[2] and got[1] == pytest.approx(-want[0]))
    lex = spark.createDataFrame([(s, f"canon of {s}") for s in surfaces], "surface string, canon string")
    asked = spark.createDataFrame([(t,) for t in tokens] + [(None,)], "token string")
    from moorage.functions.normalize import normalize_token

    normal = {r.token: r.n for r in asked.select("token", normalize_token(F.col("token")).alias("n")).collect()}
    for trie_size, deal in ((50_000, 20_000), (40, 30)):
        got = {r.token: (r.canon, round(r.score, 9)) for r in lexicon.fuzzy_canon(asked, lex, trie=trie_size, asked_at_once=deal).collect()}
        for t in set(tokens):
            n = normal[t]
            hit = (0, 0, n) if n in surfaces else best(n, 0.86)
            assert got[t] == ((f"canon of {hit[2]}", 1.0 if n in surfaces else round(-hit[0], 9)) if hit else (n, 0.0))
        assert got[None] == (None, 0.0)
