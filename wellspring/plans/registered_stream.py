"""Registered streaming queries: arriving events and posts under the batch rules.

Each query runs live streams over the given tables (or files that Spark writes from them, where
a stream must see its rows in several micro-batches) and returns what the sinks hold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checkin import with_score
from ..operators.filters import guard_sources
from ..sources import views as V
from ..sources.tables import read_table
from ..streaming import checkins as ST
from ..streaming.checkins import event_stream, run_available_now, scored_stream
from . import sqltext as S
from .registered_checkin import R, _history_sql, risk_sql, scored_sql


def _name(query: str) -> str:
    return f"{query}_{uuid.uuid4().hex[:8]}"


def _every_event_sql() -> str:
    """``scored`` over every event, not the last one of a day."""
    return scored_sql().replace("""FROM (SELECT e.*, ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE)
          ORDER BY ts DESC, event_id DESC) AS rn FROM events e) q
  WHERE rn = 1)""", "FROM events)")


def q_stream_scores(spark: SparkSession, data_dir: str) -> DataFrame:
    """STR1: file stream over events -> validate -> score -> parquet sink
    (availableNow), read back. Only valid check-ins reach the scored output
    (rows with a missing scale item go to the quarantine stream)."""
    valid, _bad = scored_stream(event_stream(spark, data_dir))
    out = valid.select("checkin_id", "worker_id", F.round("score", R).alias("score"), "risk_level",
                       "dominant_dimension")
    path = run_available_now(out, f"stream_scores_{uuid.uuid4().hex[:8]}")
    return spark.read.parquet(path)


def oracle_stream_scores() -> str:
    return f"""WITH {_every_event_sql()}, {V.ORACLE_CTES['answers']},
bad AS (SELECT DISTINCT checkin_id FROM answers WHERE (item <= 12 AND scale_a IS NULL) OR scale_b IS NULL)
SELECT checkin_id, worker_id, {S.rnd('score', R)} AS score, {risk_sql('score')} AS risk_level, dominant_dimension
FROM scored WHERE checkin_id NOT IN (SELECT checkin_id FROM bad)"""


# ------------------------------------------------------ quarantine (STR1)
def q_stream_quarantine(spark: SparkSession, data_dir: str) -> DataFrame:
    """STR1: one stream, two sinks: every event ends up scored or in quarantine with its errors."""
    checkins = ST.spread_checkins(event_stream(spark, data_dir))
    scored, bad = ST.drain_with_quarantine(checkins, _name("stream_quarantine"))
    good = spark.read.parquet(scored).select("checkin_id", F.lit("scored").alias("outcome"), F.round("score", R).alias("score"),
                                             F.lit("").alias("errors"))
    rest = spark.read.parquet(bad).select("checkin_id", F.lit("quarantined").alias("outcome"),
                                          F.lit(None).cast("double").alias("score"),
                                          F.array_join("errors", "; ").alias("errors"))
    return good.union(rest)


def oracle_stream_quarantine() -> str:
    return f"""WITH {_every_event_sql()}, {V.ORACLE_CTES['answers']},
miss AS (
  SELECT checkin_id, item, 0 AS part, 'Missing BAT-12 item: bat' || item AS msg FROM answers WHERE item <= 12 AND scale_a IS NULL
  UNION ALL SELECT checkin_id, item, 1, 'Missing OLBI item: olbi' || item FROM answers WHERE scale_b IS NULL),
errs AS (SELECT checkin_id, string_agg(msg, '; ' ORDER BY part, item) AS errors FROM miss GROUP BY checkin_id)
SELECT checkin_id, CASE WHEN errors IS NULL THEN 'scored' ELSE 'quarantined' END AS outcome,
  CASE WHEN errors IS NULL THEN {S.rnd('score', R)} END AS score, coalesce(errors, '') AS errors
FROM scored LEFT JOIN errs USING (checkin_id)"""


# ---------------------------------------------------- keyed trend (STR2)
def q_stream_trend(spark: SparkSession, data_dir: str) -> DataFrame:
    """STR2: the first half of the check-ins arrives, the query drains it and stops; the second
    half arrives, and the query starts again from its checkpoint."""
    name = _name("stream_trend")
    landing = f"{ST.stream_dir(spark, name)}/landing"
    scored = V.checkins(spark, data_dir, with_answers=False).transform(with_score()).select(
        "checkin_id", "worker_id", F.col("ts").cast("timestamp").alias("ts"), "score")
    middle = F.lit(scored.agg(F.percentile_approx("ts", 0.5)).first()[0])
    for half in (scored.filter(F.col("ts") <= middle), scored.filter(F.col("ts") > middle)):
        half.write.mode("append").parquet(landing)
        arriving = spark.readStream.schema(scored.schema).parquet(landing)
        out = run_available_now(ST.keyed_trend(arriving, idle_days=365), name)
    return spark.read.parquet(out).select("checkin_id", "worker_id", F.round("score", R).alias("score"), "trend",
                                          F.col("consecutive_high_days").cast("int").alias("consecutive_high_days"))


def oracle_stream_trend() -> str:
    return f"""WITH {_history_sql()}
SELECT checkin_id, worker_id, {S.rnd('score', R)} AS score,
  CASE WHEN rn - 1 >= 2 THEN (CASE WHEN score > avg7 + 8 THEN 'worsening' WHEN score < avg7 - 8 THEN 'improving' ELSE 'stable' END) END AS trend,
  CASE WHEN rn - 1 >= 2 THEN CAST((rn - 1) - coalesce(calm_before, 0) + CASE WHEN score > 60 THEN 1 ELSE 0 END AS INTEGER) ELSE 0 END AS consecutive_high_days
FROM h2"""


# ---------------------------------------------------- post ingest (STR3)
def q_stream_posts(spark: SparkSession, data_dir: str) -> DataFrame:
    """STR3: all posts arrive, every third of them twice; then every fifth once more. Each id is kept once."""
    name = _name("stream_posts")
    landing = f"{ST.stream_dir(spark, name)}/landing"
    docs = read_table(spark, data_dir, "documents")
    again = docs.filter("doc_id % 3 = 0")
    for arrival in (docs.unionByName(again), docs.filter("doc_id % 5 = 0")):
        arrival.write.mode("append").parquet(landing)
        posts = V.corpus_projection(spark.readStream.schema(docs.schema).parquet(landing))
        kept = ST.dedup_posts(posts.transform(guard_sources(["forum", "reviews"])))
        out = run_available_now(kept.select("id", "type", "source", "channel", "created_utc", F.md5("text").alias("text_md5")), name)
    return spark.read.parquet(out).withColumn("created_utc", F.date_format("created_utc", "yyyy-MM-dd HH:mm:ss"))


def oracle_stream_posts() -> str:
    return f"""{V.oracle_with('corpus')}
SELECT id, type, source, channel, {S.fmt_ts('created_utc')} AS created_utc, md5(text) AS text_md5 FROM corpus"""


# ------------------------------------------------- feedback join (STR4, JOI9)
def _feedback_columns(joined: DataFrame) -> DataFrame:
    return joined.select("checkin_id", "worker_id", "activity_id", "helpful",
                         (F.unix_timestamp("feedback_ts") - F.unix_timestamp("ts")).alias("seconds_after"))


def q_stream_feedback(spark: SparkSession, data_dir: str) -> DataFrame:
    """STR4: check-ins and feedback as two streams, joined where feedback comes within a day."""
    events = event_stream(spark, data_dir)
    checkins = V.checkin_projection(events, with_answers=False).select("checkin_id", "worker_id", "ts")
    joined = ST.feedback_join(checkins, V.feedback_projection(event_stream(spark, data_dir)))
    return spark.read.parquet(run_available_now(_feedback_columns(joined), _name("stream_feedback")))


def q_feedback_checkins(spark: SparkSession, data_dir: str) -> DataFrame:
    """JOI9: the same join over tables."""
    events = read_table(spark, data_dir, "events")
    checkins = V.checkin_projection(events, with_answers=False).select("checkin_id", "worker_id", "ts")
    return _feedback_columns(ST.feedback_join(checkins, V.feedback_projection(events)))


def oracle_feedback_checkins() -> str:
    return f"""WITH {V.ORACLE_CTES['feedback']}
SELECT e.event_id AS checkin_id, e.user_id AS worker_id, f.activity_id, f.helpful,
  CAST(floor(epoch(f.feedback_ts)) - floor(epoch(e.ts)) AS BIGINT) AS seconds_after
FROM events e JOIN feedback f ON f.checkin_id = e.event_id AND f.feedback_ts >= e.ts AND f.feedback_ts <= e.ts + INTERVAL 1 DAY"""


oracle_stream_feedback = oracle_feedback_checkins


# --------------------------------------------- strain by window (STR5)
def _strain(spark: SparkSession, data_dir: str, name: str, size: str, slide: str | None) -> DataFrame:
    scored = V.checkin_projection(event_stream(spark, data_dir), with_answers=False).transform(with_score())
    strain = ST.windowed_strain(scored, size, slide)
    strain = strain.select(F.date_format("win.start", "yyyy-MM-dd").alias("first_day"), "setting", "shift", "avg_score", "checkins")
    updates = spark.read.parquet(ST.drain_updates(strain, _name(name)))
    latest = ST.latest_updates(updates, ["first_day", "setting", "shift"])
    return latest.withColumn("avg_score", F.round("avg_score", R))


def _strain_sql(days: int) -> str:
    return f"""WITH {_every_event_sql()},
w AS (SELECT *, CAST(ts AS DATE) - CAST(unnest(range(0, {days})) AS INTEGER) AS first_day,
    CASE WHEN hour(ts) >= 6 AND hour(ts) < 14 THEN 'morning' WHEN hour(ts) >= 14 AND hour(ts) < 22 THEN 'evening' ELSE 'night' END AS shift
  FROM scored)
SELECT CAST(first_day AS VARCHAR) AS first_day, setting, shift, {S.rnd('avg(score)', R)} AS avg_score, count(*) AS checkins
FROM w GROUP BY first_day, setting, shift"""


def q_stream_strain_daily(spark: SparkSession, data_dir: str) -> DataFrame:
    """STR5: daily strain by setting and shift."""
    return _strain(spark, data_dir, "stream_strain_daily", "1 day", None)


def oracle_stream_strain_daily() -> str:
    return _strain_sql(1)


def q_stream_strain_weekly(spark: SparkSession, data_dir: str) -> DataFrame:
    """STR5: strain of seven days, moving by a day, by setting and shift."""
    return _strain(spark, data_dir, "stream_strain_weekly", "7 days", "1 day")


def oracle_stream_strain_weekly() -> str:
    return _strain_sql(7)
