"""Registered MLlib queries. Iterative fits have no SQL twin; ``classifier_invariants`` counts the
rows for which what must hold of every fit does hold, and its twin says for how many.

``tests/test_ml.py`` holds the topic operators against invariants: every row is
assigned to its nearest centroid, the chosen k has the highest silhouette, fits
repeat with the same seeds. ``tests/test_classifier.py`` does so for the classifier.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clustering import (K_VALUES, TextClassifier, assemble_features, assign, fit_kmeans, predict, select_k,
                                    train_one_vs_rest)
from ..operators.sentiment import label_table
from ..session import cut_lineage, scratch_path
from ..sources import views as V
from ..sources.tables import read_table
from .registered_corpus import FIXTURE_THEMES, fixture_lexicon


def q_kmeans_topics(spark: SparkSession, data_dir: str) -> DataFrame:
    """ML2 + ML4 over the whole embeddings table: choose k, refit, assign. The fits read a checkpoint."""
    emb = cut_lineage(V.embedded_corpus(spark, data_dir).select("id", "embedding"))
    k, _scores = select_k(emb, K_VALUES)
    model = fit_kmeans(emb, k)
    return assign(emb, model).select("id", F.col("cluster_id").cast("int").alias("cluster_id"),
                                     F.lit(k).alias("k"))


def q_sentiment_classifier(spark: SparkSession, data_dir: str) -> DataFrame:
    """ML11-ML13: labels from the lexicon labeller, features = embedding +
    polarity, subjectivity, word count and five theme counts; one-vs-rest
    boosted trees; predictions with normalised probabilities."""
    ec = V.embedded_corpus(spark, data_dir)
    lab = ec.transform(label_table(fixture_lexicon(spark), FIXTURE_THEMES))
    meta = ["polarity", "subjectivity", "word_count", *[f"{t}_keywords" for t in FIXTURE_THEMES]]
    feats = assemble_features(lab.select("id", "embedding", "sentiment_label", *meta), "embedding", meta)
    feats = cut_lineage(feats.select("id", "sentiment_label", "features"))  # the fits of all classes read it
    classes = sorted(r[0] for r in feats.select("sentiment_label").distinct().collect())
    models = train_one_vs_rest(feats, "sentiment_label", classes)
    out = predict(feats, models)
    return out.select("id", F.col("sentiment_label").alias("predicted_label"), "confidence",
                      "confidence_gap", "uncertainty_flag")


def q_classifier_invariants(spark: SparkSession, data_dir: str) -> DataFrame:
    """SNK7 with ML11-ML13: fit on all embeddings, save, load, predict with both, and count the rows
    that keep the rules: probabilities in [0, 1] that sum to 1, the label on top, gap and flag as
    stated, and the loaded model's answer equal to the fitted one's."""
    emb = read_table(spark, data_dir, "embeddings").select(
        "vec_id", "embedding", F.element_at(F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive")),
                                            (1 + F.pmod("label", F.lit(3))).cast("int")).alias("mood"),
        (F.col("vec_id") % 7).alias("word_count"))
    model = TextClassifier.fit(emb, "mood", ["word_count"], n_trees=4, depth=3)
    path = scratch_path(spark, f"classifier-{uuid.uuid4().hex[:8]}")
    model.save(path, spark)
    loaded = TextClassifier.load(path, spark)
    answer = F.struct("sentiment_label", "confidence", "confidence_gap", "uncertainty_flag")
    out = model.predict(emb).withColumn("fitted", answer).drop("class_probabilities", "sentiment_label", "confidence",
                                                               "confidence_gap", "uncertainty_flag")
    out = loaded.predict(out).withColumn("same", F.col("fitted") == answer)
    p = F.array_sort(F.map_values("class_probabilities"))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)

    def rows(holds):
        return F.count(F.when(holds, 1))
    return out.agg(
        F.count(F.lit(1)).alias("n_rows"),
        rows((F.abs(total - 1) < 2e-4) & (p[0] >= 0) & (p[F.size(p) - 1] <= 1)).alias("n_distributions"),
        rows(F.col("class_probabilities")[F.col("sentiment_label")] == F.array_max(p)).alias("n_label_on_top"),
        rows(F.abs(F.col("confidence_gap") - (p[F.size(p) - 1] - p[F.size(p) - 2])) < 2e-4).alias("n_gaps"),
        rows(F.col("uncertainty_flag") | (F.col("confidence") >= 0.5)).alias("n_flags"),
        rows(F.col("same")).alias("n_same_after_load"))


def oracle_classifier_invariants() -> str:
    return ("SELECT " + ", ".join(f"count(*) AS {c}" for c in (
        "n_rows", "n_distributions", "n_label_on_top", "n_gaps", "n_flags", "n_same_after_load")) + " FROM embeddings")
