"""Dedup, sampling, recommendation and entry-point invariants."""
from pyspark.sql import functions as F

from wellspring.operators.dedup import keep_first
from wellspring.operators.recommend import recommend
from wellspring.operators.sampling import cap_per_group, stratified_sample


def test_keep_first_is_min_order(spark):
    rows = [("a", 3, "x3"), ("a", 1, "x1"), ("a", 2, "x2"), ("b", 5, "y")]
    df = spark.createDataFrame(rows, "text string, _row_ord int, payload string")
    got = {r.text: r.payload for r in df.transform(keep_first(["text"], ["_row_ord"])).collect()}
    assert got == {"a": "x1", "b": "y"}


def test_cap_per_group_skewed(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("id"),
                                  F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("channel"))
    out = df.transform(cap_per_group(25, "channel", "id", 42, salts=8))
    counts = {r.channel: r["count"] for r in out.groupBy("channel").count().collect()}
    assert all(c == 25 for c in counts.values()) and len(counts) == 8
    again = df.repartition(13).transform(cap_per_group(25, "channel", "id", 42, salts=3))
    assert sorted(r.id for r in out.collect()) == sorted(r.id for r in again.collect())


def test_stratified_sample_size(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"),
                                  (F.col("id") % 4).cast("string").alias("source"), F.lit("t").alias("type"))
    assert df.transform(stratified_sample(100)).count() == 100
    assert df.transform(stratified_sample(5000)).count() == 1000


def test_recommend_grid_always_five(spark):
    rows = [(i, t, s, d) for i, (t, s, d) in enumerate(
        [(t, s, d) for t in (5, 10, 15) for s in ("break_room", "commute", "home", "other")
         for d in ("body", "mind", "life", None)])]
    df = spark.createDataFrame(rows, "checkin_id int, time_available_min int, setting string, dominant_dimension string")
    out = df.transform(recommend(scales_col=None)).collect()
    per = {}
    for r in out:
        per.setdefault(r.checkin_id, []).append(r)
    assert all(len(v) == 5 for v in per.values())
    for v in per.values():
        v.sort(key=lambda r: r.rank)
        keys = [(not r.is_relevant, not r.available) for r in v]
        assert keys == sorted(keys)
    other_ids = {i for i, _, s, _ in rows if s == "other"}  # no variant lists 'other'
    assert all(not r.available for r in out if r.checkin_id in other_ids)


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "pct_missing_text" in df.columns
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs) and len(qs) >= 30
