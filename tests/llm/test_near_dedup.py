import random

import numpy as np
import pytest

import brute
from moorage.llm import near_dedup

DOCS = "doc_id long, text string, source string, cls string, n string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", "clash", "x") for i, t in rows], DOCS)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(1, 3)))
    base, passage = [word() for _ in range(60)], " ".join(word() for _ in range(30))
    rows = [(None, "a b c"), (1, "A B  c"), (2, ""), (3, None), (4, " \t\n"), (5, "x"), (5, "x"), (6, "one word two three four five six"), (7, "w " * 3000)]
    for i in range(120):  # near copies, some close to one another, some only to the base
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = word()
        rows.append((100 + i, " ".join(words)))
    for i in range(80):  # a common passage in otherwise different documents
        rows.append((300 + i, " ".join([word() for _ in range(rng.randint(2, 40))] + [passage] + [word() for _ in range(rng.randint(0, 20))])))
    chain = [word() for _ in range(50)]
    for i in range(30):  # a chain: each document is like the next one only
        rows.append((500 - i, " ".join(chain)))
        k = rng.randrange(len(chain) - 3)
        chain = [*chain[:k], word(), word(), *chain[k + 2 :]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [None, (0, 5)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, limits):
    if limits:
        monkeypatch.setattr(near_dedup, "SHORT", limits[0])
        monkeypatch.setattr(near_dedup, "BLOCK", limits[1])
        monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    rows = corpus(3)
    got = near_dedup.near_duplicates(docs(spark, rows).repartition(3)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute.near_groups(rows), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_of_each_group_stays(spark):
    rows = corpus(5)
    df = docs(spark, rows)
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    wanted = {c for d, n, c in brute.near_groups(rows) if n and c is not None}
    got = [r.doc_id for r in kept.collect() if brute.shingles(r.text)]
    assert sorted(x for x in got if x is not None) == sorted(wanted)
    assert sum(not brute.shingles(r.text) for r in kept.collect()) == sum(not brute.shingles(t) for _, t in rows)


def test_empty_table(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    assert near_dedup.drop_near_duplicates(docs(spark, [])).count() == 0


def test_shingles():
    hashes = near_dedup._WordHashes()
    a, b = near_dedup.shingle_set("A b\tc\nd e f", hashes), near_dedup.shingle_set("a B c d e", hashes)
    assert len(a) == 2 and len(b) == 1 and len(np.intersect1d(a, b)) == 1
    assert len(near_dedup.shingle_set("a b", hashes)) == 1 and not len(near_dedup.shingle_set("", hashes))
    assert near_dedup.shingle_set("a b", hashes)[0] != near_dedup.shingle_set("b a", hashes)[0]
