"""Live streams in several micro-batches: restarts, idle workers, late rows, repeated batches."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from wellspring.operators.filters import guard_sources
from wellspring.sources import views as V
from wellspring.sources.tables import read_table
from wellspring.streaming import checkins as ST

DATA = "/root/testdata/sf0.001"
DAY = dt.datetime(2024, 1, 1)


def day(n, hours=0):
    return DAY + dt.timedelta(days=n, hours=hours)


class Arrivals:
    """A folder that a stream reads, and a job that is started anew for each arrival of rows."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.name = spark, schema, f"test_{uuid.uuid4().hex[:8]}"

    def land(self, rows):
        path = f"{ST.stream_dir(self.spark, self.name)}/landing"
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(path)

    def stream(self):
        path = f"{ST.stream_dir(self.spark, self.name)}/landing"
        return self.spark.readStream.schema(self.schema).parquet(path)


SCORED = "checkin_id long, worker_id long, ts timestamp, score double"


@pytest.mark.parametrize("idle_days, trend", [(10, None), (365, "worsening")])
def test_trend_state_outlives_restarts_and_ends_when_idle(spark, idle_days, trend):
    feed = Arrivals(spark, SCORED)
    for rows in ([(1, 1, day(0), 20.0), (2, 1, day(1), 20.0)], [(3, 1, day(2), 61.0)],
                 [(4, 2, day(60), 50.0)], [(5, 2, day(61), 50.0)], [(6, 1, day(62), 90.0)]):
        feed.land(rows)
        out = ST.run_available_now(ST.keyed_trend(feed.stream(), idle_days), feed.name)
    got = {r.checkin_id: (r.trend, r.consecutive_high_days) for r in spark.read.parquet(out).collect()}
    assert got[1] == got[2] == (None, 0) and got[3] == ("worsening", 1)
    assert got[6] == ((trend, 2) if trend else (None, 0))


def test_quarantine_keeps_all_rows_once(spark):
    events = read_table(spark, DATA, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    base = ST.stream_dir(spark, f"test_{uuid.uuid4().hex[:8]}")
    sink = ST.quarantine_sink(f"{base}/scored", f"{base}/bad")
    halves = [V.checkin_projection(events.filter(F.col("event_id") % 2 == k)) for k in (0, 1)]
    for batch_id in (0, 1, 1):  # the second batch comes twice, as after a lost driver
        sink(halves[batch_id], batch_id)
    scored, bad = spark.read.parquet(f"{base}/scored"), spark.read.parquet(f"{base}/bad")
    ids = [r.checkin_id for r in scored.select("checkin_id").union(bad.select("checkin_id")).collect()]
    assert sorted(ids) == sorted(r.event_id for r in events.collect())
    assert scored.filter("score is null").count() == 0 and bad.filter("size(errors) = 0").count() == 0
    assert {r.batch for r in scored.select("batch").distinct().collect()} == {0, 1}


def test_quarantine_catches_values_out_of_range(spark):
    good = dict(checkin_id=1, physical_worn_down=3, pain_soreness=3, mentally_drained=3, sleep_quality=3, work_stress=3,
                shift_safety_energy="yes", time_available_min=5, setting="home")
    rows = [good, {**good, "checkin_id": 2, "work_stress": 11}, {**good, "checkin_id": 3, "setting": "roof"},
            {**good, "checkin_id": 4, "sleep_quality": None}]
    schema = ("checkin_id long, physical_worn_down int, pain_soreness int, mentally_drained int, sleep_quality int, "
              "work_stress int, shift_safety_energy string, time_available_min int, setting string")
    base = ST.stream_dir(spark, f"test_{uuid.uuid4().hex[:8]}")
    ST.quarantine_sink(f"{base}/scored", f"{base}/bad")(spark.createDataFrame(rows, schema), 0)
    assert [r.checkin_id for r in spark.read.parquet(f"{base}/scored").collect()] == [1]
    errors = {r.checkin_id: list(r.errors) for r in spark.read.parquet(f"{base}/bad").collect()}
    assert errors == {2: ["work_stress must be 0-10, got 11"], 3: ["setting must be break_room/commute/home/other"],
                      4: ["sleep_quality must be 0-10, got None"]}


def test_feedback_join_forgets_what_is_late(spark):
    checkins = Arrivals(spark, "checkin_id long, worker_id long, ts timestamp")
    feedback = Arrivals(spark, "checkin_id long, feedback_ts timestamp, helpful boolean")
    arrivals = [([(1, 1, day(0))], [(1, day(0, 5), True), (9, day(0), True)]),
                ([(2, 1, day(30))], [(2, day(32), True)]),  # more than a day later
                ([(3, 1, day(0, 1)), (4, 1, day(31))], [(4, day(30, 40), False)]),  # check-in 3 is far behind
                ([(5, 1, day(33))], [(3, day(0, 2), True), (1, day(0, 6), True)])]  # feedback that is too late
    for left, right in arrivals:
        checkins.land(left)
        feedback.land(right)
        out = ST.run_available_now(ST.feedback_join(checkins.stream(), feedback.stream()), checkins.name)
    assert sorted((r.checkin_id, r.helpful) for r in spark.read.parquet(out).collect()) == [(1, True), (4, False)]


def test_posts_are_kept_once_and_late_ones_dropped(spark):
    feed = Arrivals(spark, "id string, source string, created_utc timestamp")
    for rows in ([("a", "forum", day(0)), ("a", "forum", day(0)), ("b", "forum", day(9))],
                 [("b", "forum", day(9)), ("c", "reviews", day(10))],
                 [("a", "forum", day(0)), ("d", "forum", day(1)), ("e", "forum", day(11))]):
        feed.land(rows)
        posts = feed.stream().transform(guard_sources(["forum", "reviews"]))
        out = ST.run_available_now(ST.dedup_posts(posts), feed.name)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "e"]
    feed.land([("f", "video", day(12))])
    with pytest.raises(Exception, match="source not allowed"):
        ST.run_available_now(ST.dedup_posts(feed.stream().transform(guard_sources(["forum", "reviews"]))), feed.name)


def test_strain_windows_over_two_batches(spark):
    feed = Arrivals(spark, "setting string, ts timestamp, score double")
    for rows in ([("home", day(0, 7), 10.0), ("home", day(0, 15), 50.0)], [("home", day(0, 8), 30.0), ("home", day(3, 7), 90.0)]):
        feed.land(rows)
        path = ST.drain_updates(ST.windowed_strain(feed.stream(), "1 day", None, "5 days"), feed.name)
    last = ST.latest_updates(spark.read.parquet(path), ["win", "setting", "shift"])
    got = {(r.win.start, r.shift): (r.avg_score, r.checkins) for r in last.collect()}
    assert got == {(day(0), "morning"): (20.0, 2), (day(0), "evening"): (50.0, 1), (day(3), "morning"): (90.0, 1)}


def test_one_file_of_events_is_dealt_to_all_cores_and_the_sink_holds_no_rows(spark):
    events = spark.range(0, 1000, 1, 1).select(
        F.col("id").alias("event_id"), F.lit(DAY).alias("ts"), (F.col("id") % 9).alias("user_id"), F.lit("x").alias("event_type"))
    checkins = ST.spread_checkins(events)
    assert checkins.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r.checkin_id for r in checkins.select("checkin_id").collect()) == list(range(1000))
    base = ST.stream_dir(spark, f"test_{uuid.uuid4().hex[:8]}")
    stored = spark.sparkContext._jsc.getPersistentRDDs().size()
    persist = type(checkins).persist
    try:
        type(checkins).persist = lambda *_: pytest.fail("rows with their answers are held in memory")
        ST.quarantine_sink(f"{base}/scored", f"{base}/bad")(checkins, 0)
    finally:
        type(checkins).persist = persist
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == stored
    assert sum(spark.read.parquet(f"{base}/{part}").count() for part in ("scored", "bad")) == 1000
