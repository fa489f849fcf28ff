import random

import numpy as np
from brute import near_groups

from moorage.llm import ngram_join

SCHEMA = "doc_id long, text string, cls string, n int, head string"


def test_tries_find_what_all_pairs_have():
    rng = random.Random(3)
    for round_ in range(60):
        pool = [rng.getrandbits(62) for _ in range(40)]
        sets = []
        for _ in range(rng.randint(2, 25)):
            base = sets[rng.randrange(len(sets))].tolist() if sets and rng.random() < 0.7 else rng.sample(pool, rng.randint(1, 20))
            for _ in range(rng.randint(0, 4)):
                if base and rng.random() < 0.5:
                    base.pop(rng.randrange(len(base)))
                else:
                    base.append(rng.choice(pool) if rng.random() < 0.5 else rng.getrandbits(62))
            sets.append(np.unique(np.array(base or [1], dtype=np.int64)))
        sizes = [len(x) for x in sets]
        comps = [i if rng.random() < 0.8 else 0 for i in range(len(sets))]
        every = list(range(len(sets)))
        pairs = ngram_join.joined_sets(sets, sizes, comps, every, every)
        like = {(a, b) for a in every for b in every if a != b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
        assert all(p in like for p in pairs)

        def groups(edges):
            parent = {c: c for c in comps}

            def find(c):
                while parent[c] != c:
                    c = parent[c]
                return c

            for a, b in edges:
                parent[find(comps[a])] = find(comps[b])
            return [frozenset(j for j in every if find(comps[j]) == find(comps[i])) for i in every]

        assert groups(pairs) == groups(like)
        assert len(pairs) <= len(set(comps)) - 1


def test_bounds_hold_for_all_sizes():
    for a in range(1, 400):
        for b in range(ngram_join.least(a), a + 1):
            # The smallest overlap with which sets of a and b shingles link.
            both = -(-80 * (a + b) // 180)
            if both > b:
                continue
            # The heads share all common shingles but those that may lie behind both heads.
            shared = min(ngram_join.head(a) - (a - both), ngram_join.head(b) - (b - both))
            assert shared >= max(ngram_join.more(a), 1) or shared >= ngram_join.more(b)
            assert shared >= min(ngram_join.more(a), ngram_join.more(b))
            # The rarest ones of each head but more - 1 still hold one in common.
            assert ngram_join.more(a) <= shared and ngram_join.more(b) <= shared


def corpus(seed=11, copies=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    say = lambda k: [rng.choice(words) for _ in range(k)]
    passage, rows = say(60), []
    for _ in range(25):
        rows.append(say(rng.randint(1, 90)))
    base = say(120)
    for _ in range(copies):  # near copies of one text, with more or fewer changes
        own = base[:]
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = f"x{rng.getrandbits(40)}"
        rows.append(own)
    for k in range(40):  # much in common, not alike
        rows.append(passage + [f"p{k}.{i}" for i in range(10 + k % 20)])
    for k in range(12):  # a chain: each links with the next only
        rows.append(base[k * 6 : k * 6 + 60])
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def test_components_equal_a_plain_version(spark, monkeypatch):
    rows = corpus()
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one two"), (1004, "ONE  two"), (None, "one two"), (None, "alone here"), (1005, rows[30][1]), (1005, rows[30][1]), (None, None)]
    docs = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)
    want = sorted(map(str, near_groups(rows, 80)))
    got = lambda: sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in ngram_join.joined(docs).collect())
    assert got() == want
    # All by zones, in small blocks; and by leaders in small chunks.
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    monkeypatch.setattr("moorage.llm.near_dedup.BLOCK", 7)
    assert got() == want
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    monkeypatch.setattr(ngram_join, "SETS", 5)
    assert got() == want


def test_an_empty_table_and_a_long_text(spark):
    assert ngram_join.joined(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    long = " ".join(str(i * 7919 % 1_000_003) for i in range(300_000))
    rows = [(1, long), (2, long + " more words at the end"), (3, long[: len(long) // 2])]
    got = {r.doc_id: r.component_id for r in ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
