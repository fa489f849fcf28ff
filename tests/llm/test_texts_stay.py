import random
import re

import brute
import pytest

from moorage.llm import near_dedup, ngram_join


def corpus():
    rng = random.Random(5)
    say = lambda k: [f"w{rng.randrange(300)}" for _ in range(k)]
    base, rows = say(90), [say(rng.randint(1, 60)) for _ in range(60)]
    for _ in range(30):
        own = base[:]
        own[rng.randrange(90)] = f"x{rng.getrandbits(30)}"
        rows.append(own)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    return rows + [(None, rows[70][1]), (None, rows[71][1]), (200, rows[72][1]), (72, rows[72][1]), (201, None), (202, " ")]


@pytest.mark.parametrize("way", ["near_dedup", "ngram_join"])
def test_texts_are_not_shuffled_and_a_full_filter_loses_nothing(spark, monkeypatch, way):
    module, run, like = (near_dedup, near_dedup.near_duplicates, 75) if way == "near_dedup" else (ngram_join, ngram_join.joined, 80)
    rows, sent, cut = corpus(), [], near_dedup.cut_lineage

    def seen(df):
        plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        sent.extend(re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan))
        return cut(df)

    monkeypatch.setattr(near_dedup, "cut_lineage", seen)
    monkeypatch.setattr(module, "cut_lineage", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, brute.near_groups(rows, like)))
    got = lambda: sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in run(docs).collect())
    # As with tables that are too large for a broadcast.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert got() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(sent) > 10 and not [x for x in sent if re.search(r"\btext#", x)]
    # One word of bits lets nearly every text through: the names of the sets decide.
    monkeypatch.setattr(near_dedup, "MOST_BITS", 64)
    assert got() == want
