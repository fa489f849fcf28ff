import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from moorage.llm import packing, quality, sharding
from moorage.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, bucket int, copies string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "x") for i, t in rows], DOCS)


ODD = [(1, "a b c"), (1, "a b c"), (None, "x"), (None, None), (3, ""), (4, None), (5, "é" * 50_000), (6, "w " * 9000)]


def hash64(value, code):
    seed = xxhash.xxh64_intdigest(value.to_bytes(8, "little"), 42)
    return xxhash.xxh64_intdigest(code.to_bytes(4, "little"), seed)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def place(x, n, seed):
    a, b = sharding.sides(n)
    while True:
        left, right = divmod(x, b)
        for r in range(sharding.ROUNDS):
            if r % 2 == 0:
                left = (left + signed(hash64(right, seed * 64 + r)) % a) % a
            else:
                right = (right + signed(hash64(left, seed * 64 + r)) % b) % b
        x = left * b + right
        if x < n:
            return x


def test_permutation_is_the_feistel_walk(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 7)).collect()]
        assert sorted(got) == list(range(n))
        assert got == [place(i, n, 7) for i in range(n)]


def test_shards(spark):
    rows = ODD + [(100 + i, f"text {i % 7}") for i in range(300)]
    for parts in (1, 5):
        out = sharding.shard_rows(docs(spark, rows).repartition(parts), 40, bucket_rows=50).collect()
        if parts == 1:
            first = Counter(out)
    assert Counter(out) == first and len(out) == len(rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert all((r.shard, r.slot) == (place(r.row_number, len(rows), 7) % 40, place(r.row_number, len(rows), 7) // 40) for r in out)
    assert sharding.shard_rows(docs(spark, []), 40).count() == 0


def test_fill_is_the_closest_multiset():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 60)
        reach = {0}
        for n, c in counts.items():
            reach = {x + n * k for x in reach for k in range(c + 1)}
        used = packing.fill(counts, room)
        assert all(counts[n] >= c for n, c in used.items())
        assert sum(n * c for n, c in used.items()) == max(x for x in reach if x <= room)


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    rows = ODD + [(10 + i, " ".join(random.Random(i).choices(["Hello", "don't", "naïve", "x1y2", "<|endoftext|>", "a\u0301", "\u3000", "日本", "σΣ", "\x1c", "İ"], k=37 * i))) for i in range(60)]
    out = packing.pack(docs(spark, rows).repartition(3), tokenizer_path()).collect()
    expect = Counter()
    for i, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        expect.update((i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == expect
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= 2048
    tokens = sum(r.length for r in out)
    assert len(held) <= -(-tokens // 2048) + 2
    assert packing.pack(docs(spark, []), tokenizer_path()).count() == 0


def test_word_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    whole, own, rng = Tokenizer.from_file(tokenizer_path()), packing.WordTokenizer(tokenizer_path()), random.Random(11)
    letters = "abzABZ019.,'!<|>-_@#sStTdD\n\t\r \u00a0éÉßÿŸœŁİŉſıǅñÑ¼²ªΣσς日本\u0301\u0308\u200b\u2028\x1c\x85🙂\ufb01"
    texts = ["", " ", "<|endoftext|>x<|startoftext|>", "don't WE'LL I'd o'S x's 'tis 're", "a" * 5000] + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(own(t), dtype="<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def slow_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(line in lines[:k] for k, line in enumerate(lines))
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    hit = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(lines), sum(c in "0123456789" for c in text), sum(c.isalpha() for c in text)


def test_quality_ledger(spark):
    rng = random.Random(3)
    rows = [*ODD[:-2], (5, "é " * 400), (9, "a\nb\n\na\n \nb")] + [(20 + i, " ".join(rng.choices(["ab", "c#", "d\n", "é1", "\u00a0", "f\t"], k=i))) for i in range(80)]
    out = quality.ledger(docs(spark, rows))
    got = Counter((r.doc_id, *(r[m] for m in quality.MEASURES)) for r in out.collect())
    assert got == Counter((i, *slow_measures(t)) for i, t in rows)
    for r in out.withColumns({"kept": quality.verdict("v2"), "base": quality.verdict("base")}).collect():
        assert r.base == (not (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words))
        assert r.base or not r.kept
    alone = {r.rule: (r.fails, r.alone) for r in quality.ablations(out, "base").collect()}
    rows = out.collect()
    assert alone["few_words"] == (sum(r.n_words < 20 for r in rows), sum(r.n_words < 20 and not 100 * r.n_repeat_words > 30 * r.n_words for r in rows))
    assert quality.ledger(docs(spark, [])).count() == 0
