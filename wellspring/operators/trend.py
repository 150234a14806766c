"""Per-worker history windows (WIN1-WIN7, WIN9, WIN10).

The reference walks a list of earlier scores, newest first. Here the list is
a bounded ROWS frame over ``partitionBy(worker).orderBy(ts, id)``. A
check-in table holds at most one row per worker and day, so one window
partition is bounded by the number of days covered, whatever the share of
rows a single worker has; the frames used are at most 7 rows wide, plus
running maxima. Means over the frame are summed newest-first, in the same
order as the reference, so threshold comparisons agree bit for bit.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import PEAK_SEASON_MONTHS

Op = Callable[[DataFrame], DataFrame]

# --- fixed values: trend thresholds ------------------------------------------
TREND_DELTA = 8
HIGH_SCORE = 60
ALERT_DAYS = 3
SCORER_WINDOW = 7          # previous scores compared by the scorer
LABELER_WINDOW = 7         # history window incl. today (6 previous)
BAT12_TRIGGER_STREAK = 3
BAT12_TRIGGER_SCORE = 65
OLBI_TRIGGER_STREAK = 5
OLBI_MIN_DAYS_BETWEEN = 14


def _seq_mean(arr: Column) -> Column:
    s = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(arr) > 0, s / F.size(arr))


def _direction(current: Column, avg: Column, default) -> Column:
    return (F.when(current > avg + TREND_DELTA, "worsening")
             .when(current < avg - TREND_DELTA, "improving")
             .otherwise(F.lit(default)))


def score_trend(worker: str = "worker_id", ts: str = "ts", tie: str = "checkin_id",
                score: str = "score") -> Op:
    """WIN1/WIN2 (scorer rule): with at least two earlier check-ins, compare
    today with the mean of up to 7 earlier scores (+-8); streak = leading run
    of earlier scores > 60, plus today when > 60; otherwise NULL trend, 0."""
    def op(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(worker).orderBy(ts, tie)
        prev = w.rowsBetween(-SCORER_WINDOW, -1)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        out = (df.withColumn("_rn", F.row_number().over(w))
                 .withColumn("_recent", F.reverse(F.collect_list(score).over(prev)))
                 .withColumn("_last_calm", F.max(F.when(F.col(score) <= HIGH_SCORE, F.col("_rn"))).over(before)))
        n_prev = F.col("_rn") - 1
        avg_recent = _seq_mean(F.col("_recent"))
        prev_run = n_prev - F.coalesce(F.col("_last_calm"), F.lit(0))
        today = F.when(F.col(score) > HIGH_SCORE, 1).otherwise(0)
        return (out.withColumn("trend", F.when(n_prev >= 2, _direction(F.col(score), avg_recent, "stable")))
                   .withColumn("consecutive_high_days", F.when(n_prev >= 2, prev_run + today).otherwise(0))
                   .drop("_rn", "_recent", "_last_calm"))
    return op


def trend_features(worker: str = "worker_id", ts: str = "ts", tie: str = "checkin_id",
                   score: str = "score", worker_type: str = "worker_type") -> Op:
    """WIN3-WIN5 (labeler rule): mean of the 6 previous scores (1 dp),
    'stable' without history; streak includes today; alert at >= 3; peak
    season from the event month and the worker's sector."""
    def op(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(worker).orderBy(ts, tie)
        prior = w.rowsBetween(-(LABELER_WINDOW - 1), -1)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = (df.withColumn("_rn", F.row_number().over(w))
                 .withColumn("_prior", F.reverse(F.collect_list(score).over(prior)))
                 .withColumn("_last_calm", F.max(F.when(F.col(score) <= HIGH_SCORE, F.col("_rn"))).over(upto)))
        avg = _seq_mean(F.col("_prior"))
        streak = F.col("_rn") - F.coalesce(F.col("_last_calm"), F.lit(0))
        months = F.create_map(*[x for k, v in PEAK_SEASON_MONTHS.items()
                                for x in (F.lit(k), F.array(*[F.lit(m) for m in v]).cast("array<int>"))])
        peak = F.coalesce(F.array_contains(F.try_element_at(months, F.col(worker_type)), F.month(ts)), F.lit(False)) \
            if worker_type in df.columns else F.lit(False)
        return (out.withColumn("trend_label", F.when(avg.isNull(), "stable").otherwise(_direction(F.col(score), avg, "stable")))
                   .withColumn("streak_days", streak)
                   .withColumn("alert_flag", streak >= ALERT_DAYS)
                   .withColumn("peak_season_context", peak)
                   .withColumn("window_avg", F.round(avg, 1))
                   .withColumn("window_days", F.size("_prior"))
                   .drop("_rn", "_prior", "_last_calm"))
    return op


def scale_cadence(worker: str = "worker_id", ts: str = "ts", tie: str = "checkin_id",
                  score: str = "score", streak: str = "streak_days", olbi_col: str = "olbi_responses") -> Op:
    """WIN6: prompt scale A after a 3-day high streak or a score above 65;
    scale B after a 5-day streak when scale B was last answered 14 or more
    days ago (or never)."""
    def op(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(worker).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
        taken = F.col(olbi_col).isNotNull() & (F.size(F.col(olbi_col)) > 0) if olbi_col in df.columns else F.lit(False)
        last = F.last(F.when(taken, F.col(ts)), ignorenulls=True).over(w)
        days = F.datediff(F.to_date(ts), F.to_date(last))
        return (df.withColumn("days_since_scale_b", days)
                  .withColumn("scale_a_due", (F.col(streak) >= BAT12_TRIGGER_STREAK) | (F.col(score) > BAT12_TRIGGER_SCORE))
                  .withColumn("scale_b_due", (F.col(streak) >= OLBI_TRIGGER_STREAK)
                              & F.coalesce(F.col("days_since_scale_b") >= OLBI_MIN_DAYS_BETWEEN, F.lit(True))))
    return op


def weekly_extended_due(threshold: float = HIGH_SCORE, worker: str = "worker_id", ts: str = "ts",
                        score: str = "score") -> Callable[[DataFrame], DataFrame]:
    """WIN7: 7-day tumbling windows per worker; the weekly questions are due
    when the mean daily score of the week stays above ``threshold``.
    A partial aggregation - hot workers are pre-aggregated map-side."""
    def op(df: DataFrame) -> DataFrame:
        return (df.groupBy(worker, F.window(F.col(ts), "7 days").alias("week"))
                  .agg(F.avg(score).alias("week_avg"), F.count(F.lit(1)).alias("checkins"))
                  .withColumn("extended_due", F.col("week_avg") > threshold))
    return op


def next_activity(tracks_activities: DataFrame) -> DataFrame:
    """WIN9: next activity in its track, wrapping to the first."""
    w = Window.partitionBy("track_id").orderBy("activity_ord")
    wall = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return tracks_activities.withColumn(
        "next_activity_id", F.coalesce(F.lead("activity_id").over(w), F.first("activity_id").over(wall)))


def latest_rating(ratings: DataFrame, key: str = "activity_id", ts: str = "ts") -> DataFrame:
    """WIN10: the most recent rating row per activity (``max_by``, partial)."""
    cols = [c for c in ratings.columns if c != key]
    return (ratings.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(ts)).alias("_r"))
                   .select(key, "_r.*"))
