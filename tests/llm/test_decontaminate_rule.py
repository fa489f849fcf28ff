import itertools
import random

from moorage.llm import decontaminate


def plainly_overlaps(words, item):
    """Of some twelve words of the item in a row, or of all of a shorter one, three quarters stand on one diagonal."""
    size = min(12, len(item))
    for shift in range(-len(item), len(words)):
        equal = [0 <= k + shift < len(words) and words[k + shift] == w for k, w in enumerate(item)]
        if any(4 * sum(equal[k : k + size]) >= 3 * size for k in range(len(item) - size + 1)):
            return bool(item)
    return False


def found(words, item):
    return bool(decontaminate.overlaps(" ".join(words), decontaminate.build([(1, " ".join(item))])))


def test_all_placements_of_substitutions_in_a_whole_item():
    for n, subs in [(3, 0), (4, 1), (7, 1), (8, 2), (11, 2), (12, 1), (12, 3), (13, 2), (15, 2), (15, 3), (18, 3)]:
        item = [f"w{k}" for k in range(n)]
        for changed in itertools.combinations(range(n), subs):
            words = ["x", "y", *("z" if k in changed else w for k, w in enumerate(item)), "x"]
            assert found(words, item), (n, changed)


def test_the_rule_on_random_passages():
    rng = random.Random(3)
    seen = set()
    for _ in range(1500):
        item = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 11, 12, 14, 25]))]
        a, b = sorted(rng.sample(range(len(item) + 1), 2))
        share = rng.choice([0, 0.2, 0.3])
        words = ["o"] * rng.randrange(4) + [f"n{k}" if rng.random() < share else w for k, w in enumerate(item[a:b])] + ["o"] * rng.randrange(4)
        want = plainly_overlaps(words, item)
        assert found(words, item) == want, (words, item)
        seen.add((want, len(item)))
    assert len(seen) == 20


def test_a_join_of_hashes_finds_the_same(spark, monkeypatch):
    import random

    rng = random.Random(12)
    words = [f"w{i}" for i in range(500)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    frame, items = say(14), []
    for i in range(40):
        items.append((i, " ".join(frame + say(6) if i % 4 == 0 else say(rng.choice((1, 2, 3, 5, 8, 11, 12, 20, 40))))))
    items += [(100, None), (101, ""), (102, items[3][1]), (3, items[3][1]), (None, items[5][1])]
    rows = []
    for k in range(120):
        own = (items[rng.randrange(40)][1] or "").split()
        for _ in range(rng.randint(0, 1 + len(own) // 3)):
            own[rng.randrange(len(own))] = rng.choice(words + ["new"])
        if k % 5 == 0:
            own = own[rng.randint(0, 4) :]
        rows.append((k, " ".join(say(rng.choice((0, 0, 7))) + own + say(rng.choice((0, 9))))))
    rows += [(200, " ".join(frame)), (201, None), (202, ""), (None, rows[4][1]), (203, rows[4][1]), (203, rows[4][1])]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, text_hash string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, decontaminate.find_overlaps(docs, bench).collect()))
    assert len(want) > 60
    assert sorted(map(str, decontaminate.joined_overlaps(docs, bench).collect())) == want
    kept = sorted(map(str, decontaminate.drop_overlapping(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "JOIN_PARTS", 0)
    assert sorted(map(str, decontaminate.drop_overlapping(docs, bench).collect())) == kept
    assert decontaminate.joined_overlaps(docs, bench.limit(0)).collect() == [] == decontaminate.joined_overlaps(docs.limit(0), bench).collect()
