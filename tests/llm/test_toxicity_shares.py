import random

from pyspark.sql import functions as F

from moorage.llm import toxicity


def test_a_bounded_sample_keeps_the_natural_share(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choices("abcdeflmnoprstu", k=rng.randint(2, 7))) for _ in range(200)]
    rows, labels = [], []
    for i in range(4000):
        toxic = int(i % 10 == 0)
        words = rng.choices(plain, k=20) + (["blorgous"] if rng.random() < (0.7 if toxic else 0.05) else [])
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    means = [toxicity.score(docs, toxicity.fit(docs, known, bound)).agg(F.avg("score")).first()[0] for bound in ((3000, 9000), (150, 450))]
    assert all(abs(m - 0.1) < 0.03 for m in means), means
