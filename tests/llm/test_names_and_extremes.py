"""Clashing column names, long texts, heaps of equal rows, other vocabularies, empty tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from moorage.llm import chat, decontaminate, license_scan, near_dedup, packing, pii, quality, sharding, toxicity, url_rules
from moorage.llm.queries import tokenizer_path

#: Names that operators use inside.
INNER = (
    "tx cls n low high sketch size own often v comp component_id kept kept_id kept_tx again text_hash hit zone block lo hi left same shingles first smallest g x y "
    "text_digest reveal more entity entities term action row e j df found row_number place shard slot law copies bucket before start held copy part rank length "
    "score predicted feature toxic item_id equal_words failed n_words pairs piece known scored best license dice won new host path rule verdict "
    "fingerprint layout turns skeleton lines formatted loss_spans record _tx _nth _won _new _key _reveal _lines _id"
).split()
TEXTS = [
    (1, "a plain text of some words about the river and the bridge over it"), (2, "a plain text of some words about the river and the bridge over it"), (3, "mail me@x.example or call +1 (255) 555-8013 today please"), (4, None), (5, ""), (None, "no id but words enough to be a text of its own here"),
    (6, "Released under the MIT License."), (7, "the quick brown fox jumps over the lazy dog while seven wizards watch"), (7, "the quick brown fox jumps over the lazy dog while seven wizards watch"),
]


def plain(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def crowded(spark):
    return plain(spark).select("*", *[F.lit(f"mine {n}").alias(n) for n in INNER])


def rows(df, names):
    return sorted(map(str, df.select(*names).collect()))


def kept_whole(out, names=("doc_id", "text")):
    """Every column of the input is still there, with its values."""
    assert set(INNER) <= set(out.columns)
    assert all(r[n] == f"mine {n}" for r in out.collect() for n in INNER)


def test_operators_that_make_tables_of_their_own(spark):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog while seven wizards watch us"), (2, None), (1, "quick brown fox jumps over the lazy dog while seven wizards watch us"), (None, "river")], "item_id long, text string")
    clash = bench.select("*", *[F.lit("x").alias(n) for n in INNER if n != "item_id"])
    for make in (
        lambda d: sharding.shard_rows(d, 4), license_scan.scan, pii.scan, near_dedup.near_duplicates, quality.ledger,
        lambda d: packing.pack(d, tokenizer_path()).drop("sequence_id", "offset"), lambda d: decontaminate.find_overlaps(d, clash),
    ):
        a, b = make(plain(spark)), make(crowded(spark))
        assert rows(a, a.columns) == rows(b, a.columns)
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(crowded(spark), clash).collect()}
    assert found == {(7, 1), (1, None), (2, None)}


def test_operators_that_keep_the_columns(spark):
    bench = spark.createDataFrame([(1, TEXTS[-1][1])], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    kept_whole(near_dedup.drop_near_duplicates(crowded(spark)))
    assert rows(near_dedup.drop_near_duplicates(crowded(spark)), ["text"]) == rows(near_dedup.drop_near_duplicates(plain(spark)), ["text"])
    kept_whole(decontaminate.drop_overlapping(crowded(spark), bench))
    for part in (100_000, 0):
        out = pii.sanitise(crowded(spark), part)
        kept_whole(out)
        assert rows(out, ["doc_id", "text"]) == rows(pii.sanitise(plain(spark)), ["doc_id", "text"])
    model = toxicity.fit(crowded(spark), labels)
    kept_whole(toxicity.score(crowded(spark), model, prefix="own_"))
    urls = crowded(spark).withColumn("url", F.lit("https://www.example.com/en/x?y"))
    judged = url_rules.judge_urls(urls, prefix="own_")
    kept_whole(judged)
    assert {r.own_verdict for r in judged.collect()} == {"allow"} and {r.own_rule for r in judged.collect()} == {"www.example.com/en/"}
    records = crowded(spark).drop("record").withColumn("record", F.lit('{"prompt": "p", "completion": "c", "more": 1}'))
    told = chat.canonical_turns(records, prefix="own_")
    assert {r.own_layout for r in told.collect()} == {"prompt_completion"} and {r.layout for r in told.collect()} == {"mine layout"}
    made = chat.format_turns(told.drop("turns", "formatted", "loss_spans").withColumnRenamed("own_turns", "turns"))
    assert {r.formatted for r in made.collect()} == {"### user: p\n</turn>\n### assistant: c\n</turn>\n"} and {r.lines for r in made.collect()} == {"mine lines"}


def test_heaps_of_equal_rows_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HEAP", 7)
    df = spark.createDataFrame([(1, "heap")] * 61 + [(2, "small")] * 7 + [(3, "pile")] * 8 + [(i, "one") for i in range(10, 30)], "doc_id long, text string")
    heaped = sharding.shard_rows(df, 5, bucket_rows=10).collect()
    monkeypatch.setattr(sharding, "HEAP", 10_000)
    assert Counter(heaped) == Counter(sharding.shard_rows(df, 5, bucket_rows=10).collect()) and len(heaped) == 96


def test_long_texts(spark):
    words = [f"w{i}" for i in range(60_000)]
    long, other = " ".join(words), " ".join(words[:59_000] + ["x"] * 1000)
    df = spark.createDataFrame([(1, long), (2, other), (3, long + " end"), (4, "w " * 500_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {d: (n, c) for d, n, c in brute.near_groups([(r.doc_id, r.text) for r in df.collect()])}
    said = "y" * 2_000_000 + "</turn>\\"
    turns = spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", said)], "conv_id int, turn int, role string, text string")
    told = chat.digest_formatted(chat.format_turns(chat.canonical_turns(chat.records_of_turns(turns)))).first()
    assert (told.n_turns, told.loss_chars) == (2, len(said))
    urls = spark.createDataFrame([("http://" + "a." * 100_000 + "com/" + "p/" * 100_000,)], "url string")
    assert url_rules.judge_urls(urls).first().rule == "com/"


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(spark, name):
    path, rng = public_tokenizers.path(name), random.Random(3)
    texts = [(i, "".join(rng.choices(["Hello ", "naïve", " x1", "\n", "日本", "don't ", "  ", "é"], k=40 * i))) for i in range(12)] + [(50, None)]
    out = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), path, 64).collect()
    import zlib

    encode, want = packing.PieceTokenizer(path), Counter()
    for i, t in texts:
        ids = np.append(np.frombuffer(encode(t or ""), dtype="<u4"), np.uint32(packing.END)).astype("<u4")
        want.update((i, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes()), len(ids)) for s in range(0, len(ids), 64))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    assert not packing.WordTokenizer.knows(path) if name.endswith(".json") else True


def slow_terms(texts):
    """For each text the places of terms that disclose an entity in it, from counts of all texts."""
    word = re.compile(r"[^\W_]{3,}")
    spans = [pii.base_spans(t) for t in texts]
    names = [{pii.entity(t, k, a, b) for a, k, b in s} for t, s in zip(texts, spans)]
    outside = [[(m[0].lower(), *m.span()) for m in word.finditer(t or "") if not any(a < m.end() and m.start() < b for a, _, b in s)] for t, s in zip(texts, spans)]
    n, df, e, both = len(texts), Counter(), Counter(), Counter()
    for t, own, terms in zip(texts, names, outside):
        df.update({x.lower() for x in word.findall(t or "")})
        e.update(own)
        both.update((x, w) for x in own for w in {w for w, _, _ in terms})
    bad = {}
    for (x, w), j in both.items():
        if e[x] < n and j >= min(pii.JOINT, e[x]):
            t = df[w] + (pii.SMOOTH if e[x] < pii.JOINT else 0)
            bad[x, w] = math.log(n * j / (e[x] * t)) / math.log(n / e[x])
    return [[(a, b) for w, a, b in terms if any(bad.get((x, w), 0) >= pii.GENERALISE for x in own)] for own, terms in zip(names, outside)]


def test_disclosing_terms_by_plain_counts(spark):
    rng = random.Random(21)
    vocabulary = [f"word{i}" for i in range(40)] + ["acct9931x", "Zorblax", "río"]
    people = [("anna@x.example", "Annabel"), ("bob@y.example", "Bobrowski"), ("+1 (255) 555-8013", "key77AB"), ("10.0.0.7", "serverroom")]
    texts = []
    for i in range(300):
        words = rng.choices(vocabulary, k=rng.randint(3, 25))
        if i % 5 == 0:
            mail, name = rng.choice(people)
            words[1:1] = [mail]
            words += [name] * rng.randint(1, 2)
        texts.append(" ".join(words))
    texts += [None, "", "only once@rare.example Uniqueword with word1"]
    got = {r.doc_id: r.spans for r in pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    want = slow_terms(texts)
    assert sum(map(len, want)) > 60
    for i, terms in enumerate(want):
        assert [(int(a), int(b)) for a, b in re.findall(r"term:(\d+):(\d+)", got[i])] == sorted(terms), texts[i]


def test_generalised_terms_say_their_class():
    reveal = {("email:a@b.c", t): "generalise" for t in ("anna", "k9x2", "garden")}
    assert pii.sanitise_text("Anna a@b.c k9x2 garden", reveal) == "[NAME] [EMAIL] [ID] [TERM]"


def test_pipeline_on_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, "the quick brown fox jumps over the lazy dog while seven wizards watch", "en", "s", 1), (None, None, None, None, None), (2, "", None, "s", 0), (3, "another text that stays where it is, whatever else may go", "en", "s", 1)]
    for name, docs, items in (("empty", [], []), ("odd", odd, [(None, None), (1, ""), (2, odd[0][1]), (2, odd[0][1]), (None, odd[0][1])])):
        folder = tmp_path / name
        spark.createDataFrame(docs, schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        got = defaultdict(int)
        for r in corpus_pipeline.run(spark, str(folder)).collect():
            got[r.doc_id] += r.length
        assert set(got) == ({None, 2, 3} if docs else set())
