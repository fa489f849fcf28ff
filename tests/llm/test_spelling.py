import random
import re
import zlib
from collections import Counter

from moorage.llm import spelling

SCHEMA = "doc_id long, text string, word string, key string, n int"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows, odd):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if odd and h % odd == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out, forms = {}, {}
    for w, n in words.items():
        found = sorted((-m, o) for o, m in words.items() if near(w, o))
        form = found[0][1] if found and -found[0][0] >= 5 * n else None
        forms[w] = form
        out[w] = (form, n, len(found), -found[0][0] if form else None)
    for w in out:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


def test_groups_equal_a_plain_version(spark):
    rng = random.Random(5)
    words = ["garden", "gardens", "Garten", "gärten", "école", "écoles", "ecoles", "river-bank", "aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "babababa", "harbour", "harbor", "harbours", "ÀÉÎõüß", "àéîõüß"]
    weights = [rng.choice((1, 1, 6, 40)) for _ in words]
    rows = [(d, " ".join(rng.choices(words, weights, k=120))) for d in range(60)]
    # Chains of forms, each five times as frequent as the one before.
    rows += [(100 + d, "lantern " * 3 + "lanterm " * (d < 25) + "lantfrm " * (d < 5)) for d in range(60)]
    rows += [(None, "garden lantern"), (None, None), (7, ""), (8, "123 … ÷×"), (9, "garden"), (9, "garden")]
    docs = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA)
    for odd in (3, spelling.ODD, None):
        got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(docs, odd=odd).collect()}
        assert got == plain(rows, odd)
    assert got["lantfrm"][:2] == ("lanterm", "lantern")


def test_very_long_runs_and_no_rows(spark):
    long = "ab" * 100_000
    rows = [(i, f"{long} {long}c {long[:-2]}bb") for i in range(5)]
    got = {len(r.word): r.n_near for r in spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string"), odd=None).collect() if r.word.endswith("c")}
    assert got == {200_001: 1}
    assert spelling.group_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_deletion_keys_are_those_of_the_deletions():
    words = ["aabbc", "abbc", "ëaé", "b"]
    owner, keys = spelling.deletion_keys(words)
    of = {}
    for i, k in zip(owner, keys):
        of.setdefault(int(i), []).append(int(k))
    assert [len(of[i]) for i in range(4)] == [1 + 3, 1 + 3, 1 + 3, 1 + 1]
    whole = {w: int(spelling.deletion_keys([w])[1][0]) for w in ("abbc", "aabc", "aabb", "aabbc")}
    assert set(of[0]) == set(whole.values())
