import random

import brute
import corpus_pipeline
from moorage.llm import decontaminate, pii


def test_stages_on_a_small_table(spark, tmp_path):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()
    text = lambda k, n=30: " ".join(random.Random(k).choices(words, k=n))
    item = "the quick brown fox jumps over the lazy dog while seven wizards watch the river flow"
    rows = [(i, text(i), "en", "src0", 1) for i in range(80)]
    rows += [(200 + i, text(i), "en", "src0", 1) for i in range(5)]  # copies
    rows += [(300, f"{text(90)} {item}", "en", "s", 1), (301, f"{text(91)} mail me@x.example", "en", "s", 1), (None, text(92), None, None, None), (303, None, "en", "s", 0), (304, "", "en", "s", 0)]
    toxic = [(400 + i, f"{text(100 + i)} blorgous", "en", "s", 1) for i in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows + toxic, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(i, 1, 0) for i in range(80)] + [(r[0], 0, 1) for r in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.collect())
    after_toxicity = {r.doc_id for r in seen[0]}
    assert not after_toxicity & {r[0] for r in toxic} and after_toxicity >= {r[0] for r in rows}
    kept = [(r.doc_id, r.text) for r in seen[0]]
    groups = brute.near_groups(kept)
    assert {r.doc_id for r in seen[1] if brute.shingles(r.text) and r.doc_id is not None} == {c for _, n, c in groups if n and c is not None}
    part = decontaminate.build([(1, item)])
    assert sorted(str(r.doc_id) for r in seen[2]) == sorted(str(r.doc_id) for r in seen[1] if not decontaminate.overlaps(r.text, part))
    assert 300 not in {r.doc_id for r in seen[2]}
    assert len(seen[3]) == len(seen[2]) and not any(pii.base_spans(r.text) for r in seen[3])
    assert {r.doc_id for r in seen[4]} == {r.doc_id for r in seen[3]}
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(str(r) for r in spark.read.parquet(str(tmp_path / "packing")).select("doc_id", "start", "length", "ids_crc32").collect())
