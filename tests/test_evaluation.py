import random

from moorage.functions import hangul
from moorage.plans import evaluation
from moorage.sources import ingest
from pyspark.sql import functions as F


def test_rules_accept_true_quotes_and_no_others(spark):
    got = {r.checker: r for r in evaluation.grounding_prf(spark, "").collect()}
    assert got["new"].fn == 0 and got["new"].fp <= 1 and got["new"].f1 >= 0.98 and got["new"].tp >= 70
    assert got["old"].fn > 0 and got["old"].f1 < got["new"].f1
    kinds = {r.kind: r for r in evaluation.grounding_eval(spark, "").collect()}
    assert len(kinds) == 9 and kinds["cut short"].old_right < kinds["cut short"].new_right == kinds["cut short"].n


def test_numbers_synonyms_and_typos(spark):
    assert all(r.kind == r.expected for r in evaluation.number_eval(spark, "").collect())
    assert all(r.same == r.wanted for r in evaluation.synonym_eval(spark, "").collect())
    typed = evaluation.typo_recovery(spark, "").collect()
    assert len(typed) == len(evaluation.TYPED)
    assert sum(r.recovered for r in typed) >= 0.9 * sum(r.held_out for r in typed) > 20


def test_pruning_by_letter_classes_loses_nothing(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("가개게겨거각걱닥덕더도두무모마머", k=rng.randint(1, 5))) for _ in range(60)]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    told = pairs.select("a", "b", *[hangul.may_reach(hangul.letter_classes(F.col("a")), hangul.letter_classes(F.col("b")), t).alias(f"t{i}") for i, t in enumerate((0.86, 0.5))]).collect()
    assert any(not r.t0 for r in told)
    for r in told:
        s = hangul.pair_similarity(r.a, r.b)
        assert (r.t0 or s < 0.86) and (r.t1 or s < 0.5), r


def test_files_are_numbered_by_path(spark):
    paths = [f"/d/{i:04}" for i in random.Random(1).sample(range(3000), 500)]
    got = {r.path: r.n for r in ingest.numbered(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {p: i for i, p in enumerate(sorted(paths), 1)}
