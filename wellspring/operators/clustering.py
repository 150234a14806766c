"""KMeans with k selection (ML2, ML4) and the text classifier (ML11-ML13).

MLlib does the k-means|| init and the gradient-boosted trees, ``lloyd`` the
iterations of all KMeans fits together. The reference's restarts (``n_init``)
become several seeds, keeping the fit with the lowest training cost; k is chosen by the exact squared-Euclidean
silhouette of ``topics.silhouette`` on the whole input (no pair sampling).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from multiprocessing.pool import ThreadPool
from typing import Callable, Sequence

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..session import cut_lineage
from .lloyd import Centroids, blocks, lloyd, nearest_center, vectors
from .topics import silhouette

K_VALUES = (10, 15, 20, 30)
#: Fits that run at a time. Their many short jobs fill the cores together.
PARALLEL = 5


def _side_by_side(spark: SparkSession, fit: Callable, items: Sequence) -> list:
    """``fit`` of each item, in the order of the items; ``PARALLEL`` at a time, as MLlib's ``CrossValidator`` does.
    Each fit has its own copy of Spark's local properties: a shared one loses its execution id to another's end."""
    if not items:
        return []
    fits = [inheritable_thread_target(spark)(partial(fit, i)) for i in items]
    with ThreadPool(min(PARALLEL, len(items))) as pool:
        return pool.map(lambda run: run(), fits, chunksize=1)


def _best_fits(df: DataFrame, k_values: Sequence[int], n: int, emb_col: str, seed: int, restarts: int,
               max_iter: int) -> list[Centroids]:
    """For each k the best of ``restarts`` seeded fits by training cost (ties: the first). MLlib chooses the centers
    that a fit begins with (a fit of no iterations); the iterations of all fits go together."""
    data = df.select(array_to_vector(F.col(emb_col)).alias("_features")).persist()
    data.count()  # once, not by several fits at a time

    def start(fit: tuple[int, int]) -> np.ndarray:
        k, r = fit
        return np.array(KMeans(k=k, seed=seed + r, maxIter=0, featuresCol="_features", predictionCol="cluster_id",
                               initMode="k-means||", solver="row").fit(data).clusterCenters())
    starts = _side_by_side(df.sparkSession, start, [(k, r) for k in k_values for r in range(restarts)])
    data.unpersist()
    rows = blocks(df, emb_col, n)
    fits = lloyd(rows, starts, max_iter)
    rows.unpersist()
    return [min(fits[i:i + restarts], key=lambda m: m.summary.trainingCost) for i in range(0, len(fits), restarts)]


def fit_kmeans(df: DataFrame, k: int, emb_col: str = "embedding", seed: int = 42,
               restarts: int = 10, max_iter: int = 300) -> Centroids:
    """ML4: best of ``restarts`` seeded fits by training cost (ties: the first). ``df`` is read several times:
    cut the lineage of an expensive one first."""
    return _best_fits(df, [k], df.count(), emb_col, seed, restarts, max_iter)[0]


def assign(df: DataFrame, model: Centroids, emb_col: str = "embedding") -> DataFrame:
    return df.withColumn("cluster_id", nearest_center(vectors(df, emb_col), model.centers))


def select_k(df: DataFrame, k_values: Sequence[int] = K_VALUES, emb_col: str = "embedding",
             seed: int = 42, restarts: int = 10, max_iter: int = 300) -> tuple[int, dict]:
    """ML2: k with the highest silhouette; k >= n rows and single-cluster
    fits are skipped; ties keep the first k; no valid k -> the first k."""
    n = df.count()
    scores: dict[int, float] = {}
    few = [k for k in k_values if k < n]
    for k, model in zip(few, _best_fits(df, few, n, emb_col, seed, restarts, max_iter) if few else []):
        labelled = assign(df, model, emb_col)
        if labelled.select("cluster_id").distinct().limit(2).count() < 2:
            continue
        s = silhouette(labelled, emb_col, "cluster_id").agg(F.avg("silhouette")).first()[0]
        scores[k] = round(float(s), 4)
    if not scores:
        return k_values[0], scores
    best = max(scores, key=lambda k: (scores[k], -list(k_values).index(k)))
    return best, scores


# --------------------------------------------------------------- classifier
def assemble_features(df: DataFrame, emb_col: str, meta_cols: Sequence[str], out: str = "features") -> DataFrame:
    """ML11: embedding + metadata columns in one vector."""
    base = df.withColumn("_emb", array_to_vector(F.col(emb_col)))
    return VectorAssembler(inputCols=["_emb", *meta_cols], outputCol=out).transform(base).drop("_emb")


def train_one_vs_rest(df: DataFrame, label_col: str, classes: Sequence[str], features: str = "features",
                      n_trees: int = 200, depth: int = 5, rate: float = 0.1, seed: int = 42) -> dict:
    """ML12: one binary boosted-tree model per class (GBTClassifier is binary). Each fit reads ``df``:
    cut the lineage of an expensive one first."""
    def fit(c: str):
        data = df.select(features, (F.col(label_col) == c).cast("double").alias("_y"))
        return GBTClassifier(featuresCol=features, labelCol="_y", maxIter=n_trees, maxDepth=depth,
                             stepSize=rate, seed=seed).fit(data)
    return dict(zip(classes, _side_by_side(df.sparkSession, fit, classes)))


def predict(df: DataFrame, models: dict, features: str = "features") -> DataFrame:
    """ML13: normalised class probabilities, label, confidence, top-2 gap
    and an uncertainty flag (< 0.5)."""
    out = df
    classes = sorted(models)
    for c in classes:
        out = models[c].transform(out).withColumn(f"_q_{c}", vector_to_array("probability")[1]) \
            .drop("prediction", "probability", "rawPrediction")
    total = sum((F.col(f"_q_{c}") for c in classes[1:]), F.col(f"_q_{classes[0]}"))
    probs = F.array(*[F.struct((F.col(f"_q_{c}") / total).alias("p"), F.lit(c).alias("label")) for c in classes])
    ranked = F.array_sort(probs, lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).otherwise(0))
    out = out.withColumn("_r", ranked)
    return (out.withColumn("sentiment_label", F.col("_r")[0]["label"])
               .withColumn("confidence", F.round(F.col("_r")[0]["p"], 4))
               .withColumn("confidence_gap", F.round(F.col("_r")[0]["p"] - F.col("_r")[1]["p"], 4))
               .withColumn("uncertainty_flag", F.col("_r")[0]["p"] < 0.5)
               .withColumn("class_probabilities", F.map_from_entries(F.transform(
                   "_r", lambda x: F.struct(x["label"], F.round(x["p"], 4)))))
               .drop("_r", *[f"_q_{c}" for c in classes]))


@dataclass
class TextClassifier:
    """ML11-ML13 and SNK7: the fitted trees with their label index and feature names.

    ``labels`` are in index order, ``meta_cols`` in the order of the feature vector after the embedding.
    A row without one of the metadata columns (or with NULL in it) has 0 there.
    """

    models: dict
    labels: list[str]
    meta_cols: list[str]
    emb_col: str = "embedding"

    @classmethod
    def fit(cls, df: DataFrame, label_col: str, meta_cols: Sequence[str], emb_col: str = "embedding",
            **tree_options) -> "TextClassifier":
        """One checkpoint of the features feeds the fits of all classes; rows without a label are left out."""
        feats = cls._features(df.filter(F.col(label_col).isNotNull()), meta_cols, emb_col)
        feats = cut_lineage(feats.select(label_col, "_features"))
        labels = sorted(r[0] for r in feats.select(label_col).distinct().collect())
        return cls(train_one_vs_rest(feats, label_col, labels, "_features", **tree_options), labels, list(meta_cols), emb_col)

    @staticmethod
    def _features(df: DataFrame, meta_cols: Sequence[str], emb_col: str) -> DataFrame:
        known = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in meta_cols}
        return assemble_features(df.withColumns({f"_m_{c}": v for c, v in known.items()}), emb_col,
                                 [f"_m_{c}" for c in meta_cols], "_features").drop(*[f"_m_{c}" for c in meta_cols])

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds the columns of ``predict`` to ``df``."""
        return predict(self._features(df, self.meta_cols, self.emb_col), self.models, "_features").drop("_features")

    def save(self, path: str, spark: SparkSession) -> None:
        """Writes the models and one row that names labels and features below ``path`` (any store)."""
        for i, label in enumerate(self.labels):
            self.models[label].write().overwrite().save(f"{path}/model-{i}")
        row = [(self.labels, self.meta_cols, self.emb_col)]
        spark.createDataFrame(row, "labels array<string>, meta_cols array<string>, emb_col string").write.mode(
            "overwrite").parquet(f"{path}/index")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "TextClassifier":
        row = spark.read.parquet(f"{path}/index").first()
        models = {label: GBTClassificationModel.load(f"{path}/model-{i}") for i, label in enumerate(row["labels"])}
        return cls(models, list(row["labels"]), list(row["meta_cols"]), row["emb_col"])
