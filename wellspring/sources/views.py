"""Domain views derived from the driver's tables.

The reference reads forum exports, review exports and single check-in
records. The test tables carry none of these, so each domain table is a
deterministic projection of a given table (same rules as FIXTURES.md §2):

* ``corpus``    <- documents      (forum posts/comments and reviews)
* ``checkins``  <- events         (latest event per worker and day)
* ``debriefs``  <- conversations  (user turns as free text)
* ``answers``   <- events         (scale answer maps, built in-row)
* ``feedback``  <- events         (ratings of activities after a check-in)
* ``debrief entries`` <- conversations (user turns with planted phrases)

Every view is a narrow projection (no shuffle) except ``checkins``, which
is one partial/final aggregation on (worker, day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import CHECKIN_BURNOUT_THEMES, KEYWORD_THEMES
from .dims import ACTIVITY_VARIANTS
from .tables import read_table


def corpus(spark: SparkSession, data_dir: str) -> DataFrame:
    return corpus_projection(read_table(spark, data_dir, "documents"))


def corpus_projection(d: DataFrame) -> DataFrame:
    """Posts, comments and reviews from document rows (narrow, works on streams too)."""
    k = F.col("doc_id") % 10
    days = ((F.col("doc_id") * 7) % 2300).cast("int")
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(k < 3, "post").when(k < 6, "comment").otherwise("review").alias("type"),
        F.when(k < 6, "forum").otherwise("reviews").alias("source"),
        F.when(k < 6, F.col("source")).otherwise(F.lit("")).alias("channel"),
        F.col("text"),
        F.date_add(F.lit("2019-07-01").cast("date"), days).cast("timestamp").alias("created_utc"),
        F.when(F.col("doc_id") % 23 == 0, F.lit(None)).otherwise(F.col("doc_id") % 7).alias("score"),
        F.col("doc_id").alias("_row_ord"),
    )


def _answer_map(prefix: str, n_items: int, value_fn) -> Column:
    """map<string,int> of answered items; unanswered items are absent."""
    entries = F.transform(
        F.sequence(F.lit(1), F.lit(n_items)),
        lambda i: F.struct(F.concat(F.lit(prefix), i.cast("string")).alias("k"),
                           value_fn(i).alias("v")))
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def scale_a_value(event_id: Column):
    return lambda i: F.when((event_id + i) % 17 == 0, F.lit(None)).otherwise(
        (F.lit(1) + (event_id * i) % 5).cast("int"))


def scale_b_value(event_id: Column):
    return lambda i: F.when((event_id + i) % 19 == 0, F.lit(None)).otherwise(
        (F.lit(1) + (event_id * i) % 4).cast("int"))


def checkin_projection(events: DataFrame, with_answers: bool = True) -> DataFrame:
    """Check-in answers derived from event rows (narrow projection, works on
    batch and streaming frames alike)."""
    e, u = F.col("event_id"), F.col("user_id")
    cols = [
        e.alias("checkin_id"), u.alias("worker_id"), F.col("ts"),
        (e % 11).alias("physical_worn_down"),
        ((e * 3 + u) % 11).alias("pain_soreness"),
        ((e * 5 + u * 2) % 11).alias("mentally_drained"),
        ((e * 7) % 11).alias("sleep_quality"),
        ((e * 2 + u) % 11).alias("work_stress"),
        F.when(e % 3 == 0, "yes").when(e % 3 == 1, "somewhat").otherwise("no").alias("shift_safety_energy"),
        (F.lit(5) * (F.lit(1) + e % 3)).alias("time_available_min"),
        F.when(e % 4 == 0, "break_room").when(e % 4 == 1, "commute")
         .when(e % 4 == 2, "home").otherwise("other").alias("setting"),
        F.when(u % 3 == 0, "warehouse").when(u % 3 == 1, "retail").otherwise("general").alias("worker_type"),
    ]
    if with_answers:
        cols += [_answer_map("bat", 12, scale_a_value(e)).alias("bat12_responses"),
                 _answer_map("olbi", 16, scale_b_value(e)).alias("olbi_responses")]
    return events.select(*cols)


def checkins(spark: SparkSession, data_dir: str, with_answers: bool = True) -> DataFrame:
    """One check-in per worker and day: the latest event of that day.

    ``max_by`` under ``groupBy`` is partially aggregated map-side, so a worker
    holding a third of all events never lands whole in one task.
    """
    ev = read_table(spark, data_dir, "events").select("event_id", "user_id", "ts")
    latest = (ev.groupBy("user_id", F.to_date("ts").alias("_day"))
                .agg(F.max_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("e"))
                .select("user_id", "e.event_id", "e.ts"))
    return checkin_projection(latest, with_answers)


def feedback_projection(events: DataFrame) -> DataFrame:
    """Feedback on activities, derived from event rows: two of three check-ins get one, 0 to 36 hours later."""
    e, u = F.col("event_id"), F.col("user_id")
    minutes = (e * 37 + u) % 2160
    activities = F.array(*[F.lit(v[0]) for v in ACTIVITY_VARIANTS])
    return events.filter(e % 3 != 2).select(
        e.alias("checkin_id"), F.get(activities, (e % len(ACTIVITY_VARIANTS)).cast("int")).alias("activity_id"),
        (F.col("ts") + F.make_dt_interval(mins=minutes.cast("int"))).alias("feedback_ts"),
        ((e + u) % 4 != 0).alias("helpful"),
        (e % 6).alias("energy_before"), ((e * 5 + u) % 6).alias("energy_after"),
        ((e * 3) % 6).alias("tension_before"), (u % 6).alias("tension_after"),
        ((e + u) % 6).alias("clarity_before"), ((e * 7 + 1) % 6).alias("clarity_after"))


def debrief_entries(spark: SparkSession, data_dir: str) -> DataFrame:
    """Shift debriefs: the user turns, each followed by phrases of the debrief lists, which the
    given texts lack; turn 0 of every eleventh conversation is blank."""
    phrases = [p for words in CHECKIN_BURNOUT_THEMES.values() for p in words] + [
        p for words in KEYWORD_THEMES.values() for p in words]
    table = F.array(*[F.lit(p) for p in phrases])
    k = F.col("conv_id") * 31 + F.col("turn") * 7
    said = [F.get(table, (k * m % (3 * len(phrases))).cast("int")) for m in (1, 5, 11)]
    blank = (F.col("turn") == 0) & (F.col("conv_id") % 11 == 0)
    return debriefs(spark, data_dir).withColumn(
        "text", F.when(blank, F.lit("  ")).otherwise(F.concat_ws(" ", "text", *said)))


def answers_long(spark: SparkSession, data_dir: str) -> DataFrame:
    """Long form (checkin_id, item, scale_a, scale_b); ``explode`` of a fixed
    16-element sequence, no join."""
    ev = read_table(spark, data_dir, "events").select("event_id")
    e = F.col("event_id")
    return (ev.select(e.alias("checkin_id"), F.explode(F.sequence(F.lit(1), F.lit(16))).alias("item"))
              .select("checkin_id", "item",
                      scale_a_value(F.col("checkin_id"))(F.col("item")).alias("scale_a"),
                      scale_b_value(F.col("checkin_id"))(F.col("item")).alias("scale_b")))


def debriefs(spark: SparkSession, data_dir: str) -> DataFrame:
    c = read_table(spark, data_dir, "conversations")
    return c.filter(F.col("role") == "user").select("conv_id", "turn", "text")


def embedded_corpus(spark: SparkSession, data_dir: str) -> DataFrame:
    """Corpus rows with an embedding and a cluster assignment (``label``)."""
    emb = read_table(spark, data_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), "embedding", F.col("label").alias("cluster_id"))
    return corpus(spark, data_dir).join(emb, "id")


# SQL text of the same views for the DuckDB oracle (tables pre-registered).
ORACLE_CTES = {
    "corpus": """corpus AS (
  SELECT CAST(doc_id AS VARCHAR) AS id,
    CASE WHEN doc_id % 10 < 3 THEN 'post' WHEN doc_id % 10 < 6 THEN 'comment' ELSE 'review' END AS type,
    CASE WHEN doc_id % 10 < 6 THEN 'forum' ELSE 'reviews' END AS source,
    CASE WHEN doc_id % 10 < 6 THEN source ELSE '' END AS channel,
    text,
    CAST(DATE '2019-07-01' + CAST((doc_id * 7) % 2300 AS INT) AS TIMESTAMP) AS created_utc,
    CASE WHEN doc_id % 23 = 0 THEN NULL ELSE doc_id % 7 END AS score,
    doc_id AS _row_ord
  FROM documents)""",
    "checkins": """checkins AS (
  SELECT event_id AS checkin_id, user_id AS worker_id, ts,
    event_id % 11 AS physical_worn_down, (event_id * 3 + user_id) % 11 AS pain_soreness,
    (event_id * 5 + user_id * 2) % 11 AS mentally_drained, (event_id * 7) % 11 AS sleep_quality,
    (event_id * 2 + user_id) % 11 AS work_stress,
    CASE event_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'somewhat' ELSE 'no' END AS shift_safety_energy,
    5 * (1 + event_id % 3) AS time_available_min,
    CASE event_id % 4 WHEN 0 THEN 'break_room' WHEN 1 THEN 'commute' WHEN 2 THEN 'home' ELSE 'other' END AS setting,
    CASE user_id % 3 WHEN 0 THEN 'warehouse' WHEN 1 THEN 'retail' ELSE 'general' END AS worker_type
  FROM (SELECT e.*, ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE)
          ORDER BY ts DESC, event_id DESC) AS rn FROM events e) q
  WHERE rn = 1)""",
    "answers": """answers AS (
  SELECT event_id AS checkin_id, i AS item,
    CASE WHEN (event_id + i) % 17 = 0 THEN NULL ELSE 1 + (event_id * i) % 5 END AS scale_a,
    CASE WHEN (event_id + i) % 19 = 0 THEN NULL ELSE 1 + (event_id * i) % 4 END AS scale_b
  FROM events CROSS JOIN (SELECT unnest(range(1, 17)) AS i) t)""",
    "feedback": f"""feedback AS (
  SELECT event_id AS checkin_id, [{', '.join(f"'{v[0]}'" for v in ACTIVITY_VARIANTS)}][1 + event_id % {len(ACTIVITY_VARIANTS)}] AS activity_id,
    ts + to_minutes(CAST((event_id * 37 + user_id) % 2160 AS BIGINT)) AS feedback_ts, (event_id + user_id) % 4 <> 0 AS helpful,
    event_id % 6 AS energy_before, (event_id * 5 + user_id) % 6 AS energy_after, (event_id * 3) % 6 AS tension_before,
    user_id % 6 AS tension_after, (event_id + user_id) % 6 AS clarity_before, (event_id * 7 + 1) % 6 AS clarity_after
  FROM events WHERE event_id % 3 <> 2)""",
    "debriefs": """debriefs AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')""",
}


def oracle_with(*names: str) -> str:
    return "WITH " + ",\n".join(ORACLE_CTES[n] for n in names)
