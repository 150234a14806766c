"""The classifier learns, keeps its rules, and is the same after save and load."""

import random
import tempfile

from pyspark.sql import functions as F

from wellspring.operators.clustering import TextClassifier


def frame(spark, n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        mood = ("negative", "neutral", "positive")[i % 3]
        rows.append((i, [rng.gauss(2.0 * (j == i % 3), 0.4) for j in range(3)], float(i % 5), mood))
    return spark.createDataFrame(rows, "id int, embedding array<float>, word_count double, mood string")


def test_fit_save_load_predict(spark):
    df = frame(spark)
    with_gap = df.union(df.limit(1).withColumn("mood", F.lit(None).cast("string")).withColumn("id", F.lit(-1)))
    model = TextClassifier.fit(with_gap, "mood", ["word_count"], n_trees=5, depth=3)
    assert model.labels == ["negative", "neutral", "positive"]
    path = tempfile.mkdtemp(prefix="ws-model-") + "/m"
    model.save(path, spark)
    loaded = TextClassifier.load(path, spark)
    assert (loaded.labels, loaded.meta_cols, loaded.emb_col) == (model.labels, ["word_count"], "embedding")
    fresh = frame(spark, 90, seed=2)
    rows = [[r for r in m.predict(fresh).orderBy("id").collect()] for m in (model, loaded)]
    assert rows[0] == rows[1]
    assert sum(r.sentiment_label == r.mood for r in rows[0]) >= 85
    for r in rows[0]:
        p = sorted(r.class_probabilities.values())
        assert abs(sum(p) - 1) < 2e-4 and abs(r.confidence_gap - (p[-1] - p[-2])) < 2e-4
        assert r.uncertainty_flag == (r.confidence < 0.5) and r.class_probabilities[r.sentiment_label] == p[-1] == r.confidence
    assert rows[0][0].__fields__[:4] == df.columns  # the frame's own columns stay


def test_absent_metadata_counts_as_zero(spark):
    model = TextClassifier.fit(frame(spark, 60), "mood", ["word_count"], n_trees=2, depth=2)
    fresh = frame(spark, 9, seed=3)
    zero = model.predict(fresh.withColumn("word_count", F.lit(0.0))).orderBy("id").collect()
    none = model.predict(fresh.withColumn("word_count", F.lit(None).cast("double"))).orderBy("id").collect()
    absent = model.predict(fresh.drop("word_count")).orderBy("id").collect()
    assert [r.class_probabilities for r in zero] == [r.class_probabilities for r in none] == [r.class_probabilities for r in absent]
