"""Topic fits: nearest centroid, best k, repeatable seeds."""

import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Row
from pyspark.sql import functions as F

from wellspring.operators import clustering, lloyd
from wellspring.operators.clustering import assign, fit_kmeans, select_k
from wellspring.operators.topics import distance_sums, silhouette
from wellspring.plans import registered_ml, registry


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (np.array([10.0 * (i % 3), 5.0 * (i % 3 == 1)]) + rng.normal(0, 0.3, 2)).tolist()) for i in range(60)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").cache()


def test_rows_go_to_their_nearest_centroid_and_seeds_repeat(points):
    model = fit_kmeans(points, 3, restarts=2, max_iter=20)
    centers = np.array(model.clusterCenters())
    got = assign(points, model).orderBy("id").collect()
    for r in got:
        assert r.cluster_id == int(((centers - np.array(r.embedding)) ** 2).sum(axis=1).argmin())
    assert len({(r.id % 3, r.cluster_id) for r in got}) == 3
    again = assign(points, fit_kmeans(points, 3, restarts=2, max_iter=20)).orderBy("id").collect()
    assert [r.cluster_id for r in again] == [r.cluster_id for r in got]


def test_best_k_has_the_highest_silhouette(points):
    k, scores = select_k(points, (2, 3, 99), restarts=1, max_iter=20)
    assert k == 3 and scores[3] > scores[2] and 99 not in scores
    few = points.filter(F.col("id") < 2)
    assert select_k(few, (5, 7), restarts=1, max_iter=5) == (5, {})


def test_fits_run_side_by_side_and_keep_their_order(spark, points):
    meet = threading.Barrier(2, timeout=30)  # passes only if two fits are under way at once
    assert clustering._side_by_side(spark, lambda r: (meet.wait() >= 0, r), range(4)) == [(True, r) for r in range(4)]
    assert clustering._side_by_side(spark, lambda r: r, []) == []
    costs = [fit_kmeans(points, 3, seed=42 + r, restarts=1, max_iter=3).summary.trainingCost for r in range(4)]
    best = fit_kmeans(points, 3, restarts=4, max_iter=3).summary.trainingCost
    assert best == pytest.approx(min(costs))


def test_each_fit_has_local_properties_of_its_own(spark):
    meet = threading.Barrier(2, timeout=30)

    def fit(r):
        spark.sparkContext.setLocalProperty("wellspring.fit", str(r))
        meet.wait()
        return spark.sparkContext.getLocalProperty("wellspring.fit")
    assert clustering._side_by_side(spark, fit, range(2)) == ["0", "1"]


def test_all_fits_share_their_passes_and_equal_single_ones(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "id long, embedding array<double>")
    data = data.repartition(3).cache()
    calls = []
    monkeypatch.setattr(clustering, "lloyd", lambda rows, starts, *a: calls.append(len(starts)) or lloyd.lloyd(rows, starts, *a))
    select_k(data, (3, 6), restarts=4, max_iter=25)
    assert calls == [8]  # one way through the iterations for all fits
    vec = data.select(array_to_vector("embedding").alias("features"))
    for k in (3, 6):
        single = [KMeans(k=k, seed=42 + r, maxIter=25).fit(vec) for r in range(3)]
        best = min(single, key=lambda m: m.summary.trainingCost)
        got = fit_kmeans(data, k, restarts=3, max_iter=25)
        np.testing.assert_allclose(np.array(got.clusterCenters()), np.array(best.clusterCenters()), atol=1e-9)
        assert got.summary.trainingCost == pytest.approx(best.summary.trainingCost)
        assert got.summary.numIter == best.summary.numIter


def test_nearest_centers_are_exact_where_32_bits_cannot_tell(spark):
    x1 = np.array([[1.0 + i * 1e-7, 1e3, 1.0] for i in range(-5, 6)])
    centers = np.array([[[0.0, 1e3], [2.0, 1e3], [2.0, 1e3]]])
    near = lloyd.Nearest([centers]).masks(x1)[0][0]
    assert near.sum(axis=0).tolist() == [1] * 11  # of equal centers the first
    assert near[0, :4].all() and near[1, 7:].all() and not near[2].any()
    with pytest.raises(ValueError):
        lloyd.matrix(pa.array([[1.0, 2.0], [3.0]]))
    with pytest.raises(ValueError):
        lloyd.matrix(pa.array([[1.0, None]]))


def test_distance_sums_of_odd_vectors_are_null(spark):
    rows = [(0, 0, [0.0, 1.0]), (1, 0, [0.5, 1.0]), (2, 1, [4.0, 1.0]), (3, 1, [4.0, 2.0])]
    df = spark.createDataFrame(rows, "id int, cluster_id int, embedding array<float>")
    got = {r.id: r.silhouette for r in silhouette(df).collect()}
    a, b = 0.25, ((16 + 0) + (16 + 1)) / 2
    assert got[0] == pytest.approx((b - a) / b) and len(got) == 4
    sums = distance_sums(F.col("v"), [Row(cid=0, n=2, s=[1.0, 1.0], q=2.0)])
    odd = spark.createDataFrame([(None,), ([1.0],), ([1.0, None],), ([2.0, 0.0],)], "v array<double>").select(sums.alias("x"))
    assert [r.x for r in odd.collect()] == [[None], [None], [None], [6.0]]


class Stop(Exception):
    pass


@pytest.mark.parametrize("query, step", [("kmeans_topics", "select_k"), ("sentiment_classifier", "train_one_vs_rest")])
def test_fits_read_a_checkpoint_not_the_joined_tables(spark, monkeypatch, query, step):
    def seen(df, *_):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        raise Stop(plan)
    monkeypatch.setattr(registered_ml, step, seen)
    with pytest.raises(Stop) as plan:
        registry.queries()[query](spark, "/root/testdata/sf0.001")
    assert "Join" not in str(plan.value) and "parquet" not in str(plan.value)


def test_silhouette_sums_over_the_clusters_once_a_row(spark, points):
    rows = silhouette(points.withColumn("cluster_id", F.col("id") % 3))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("zip_with(") == 1
    one = rows.filter("id = 4").first()
    x, data = np.array(one.embedding), [(r.id % 3, np.array(r.embedding)) for r in points.collect()]
    mean = {c: sum(((x - y) ** 2).sum() for d, y in data if d == c) / (19 if c == 1 else 20) for c in range(3)}
    b = min(mean[0], mean[2])
    assert one.silhouette == pytest.approx((b - mean[1]) / max(mean[1], b)) and rows.columns[-1] == "silhouette"
