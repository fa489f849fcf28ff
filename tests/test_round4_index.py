import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from moorage.operators import gram_index, grounding


def held_by(rows):
    """gram -> ids of the sources that have it, from rows of postings."""
    out = {}
    for r in rows:
        at = gram_index._numbers(np.frombuffer(bytes(r["docs"]), dtype=np.uint8), np.array([r["n"]]))
        assert len(at) == r["n"]
        out.setdefault(r["gram"], []).extend((r["first"] + at).tolist())
    return out


def test_segments_hold_each_source_of_each_gram(monkeypatch):
    rng = random.Random(5)
    letters = "ab漢𝄞" + "".join(map(chr, range(0x4E00, 0x4E00 + 2_100)))
    texts = ["abab" if i in (0, 127, 128, 400, 16_500) else "".join(rng.choices(letters, k=rng.choice((0, 3, 4, 9)))) for i in range(17_000)] + ["ab漢𝄞" * 300]
    ids = list(range(9_000)) + list(range(1 << 33, (1 << 33) + len(texts) - 9_000))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], names=["id", "folded"])
    want = {}
    for i, t in zip(ids, texts):
        for g in {t[k : k + 4] for k in range(len(t) - 3)}:
            want.setdefault(g, []).append(i)
    for most, size, segments in ((16_383, 2_000_000, 2), (5_000, 2_000_000, 4), (16_383, 5_000, None)):
        monkeypatch.setattr(gram_index, "LETTERS", size)
        out = [r for b in gram_index._segments(most)([batch]) for r in b.to_pylist()]
        assert held_by(out) == want
        firsts = {r["first"] for r in out}
        assert len(firsts) == segments if segments else len(firsts) > 10


def test_quotes_are_counted_apart_in_a_segment(monkeypatch):
    asked = [(1, "abcd", 2, 3.0, [0, 3, 130]), (1, "bcde", 1, 3.0, [3, 129]), (2, "abcd", 1, 1.0, [5]), (3, "xxxx", 1, 2.0, [0, 130])]
    step = lambda at: bytes(x for a, b in zip([0, *at], at) for x in ([b - a] if b - a < 128 else [128 | (b - a) >> 7, (b - a) & 127]))
    rows = pa.table({"batch": pa.array([7] * 4, pa.int32()), "first": [1_000] * 4, "q": [a[0] for a in asked], "times": [a[2] for a in asked], "needed": [a[3] for a in asked], "n": [len(a[4]) for a in asked], "docs": [step(a[4]) for a in asked]})
    for cells in (2_000_000, 1):
        monkeypatch.setattr(gram_index, "CELLS", cells)
        assert gram_index._reaching(rows).to_pylist() == [{"batch": 7, "id": 1_003}, {"batch": 7, "id": 1_005}]


def test_a_gram_has_a_row_for_a_segment_and_not_for_each_source(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    # The first batch has no gram at all.
    assert gram_index.add_sources(spark.createDataFrame([("a", None), ("b", "xy")], "d string, text string"), "d", path) == 0
    quotes = grounding.quote_table(spark.createDataFrame([(1, "shared beginning of all"), (2, "number 17 has this"), (2, "number 17 has this"), (3, "abcdefgh")], "q long, text string"), "q", "text")
    assert gram_index.score_indexed(spark, path, quotes, "d", 0.5).collect() == []
    docs = spark.createDataFrame([(f"s{i}", f"shared beginning of all, number {i} has this {'and more ' * i}") for i in range(400)], "d string, text string").coalesce(1)
    assert gram_index.add_sources(docs, "d", path) == 1
    postings = spark.read.parquet(f"{path}/postings").where("gram = 'shar'")
    assert postings.agg(F.sum("n"), F.count("*")).first() == (400, 1)
    want = grounding.score_quotes(grounding.folded_sources(docs, "d"), quotes, "d", least=0.9).collect()
    got = gram_index.score_indexed(spark, path, quotes, "d", 0.9).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 400
