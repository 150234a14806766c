"""Structured Streaming versions of the check-in jobs (STR1-STR5).

The same column transformations as the batch jobs run on a stream. Sinks keep
their checkpoint under ``spark.checkpoint.dir``, so a restarted query goes on
from its offsets and its state; what a sink writes for a micro-batch is either
logged by the file sink or lies in a folder named by the batch's id, so a batch
that runs twice counts once. State is bounded everywhere: by the watermark
(windows, dedup, join) or by an idle time (keyed trend). Tests and the
registered queries use ``trigger(availableNow=True)``.
"""

from __future__ import annotations

import os
from typing import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.checkin import split_valid, with_score
from ..session import ensure_checkpoint_dir
from ..sources.views import checkin_projection

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, data_dir: str, max_files: int | None = None) -> DataFrame:
    """File stream over ``events.parquet``, one file or a folder of part files; ``ts``
    becomes a session-zone timestamp for watermarks and windows."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    s = reader.parquet(f"{data_dir.rstrip('/')}/events.parquet*")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def spread_checkins(events: DataFrame) -> DataFrame:
    """The check-ins of an event stream, dealt to all cores: the three columns that they are made from
    are shuffled, as a file of one row group is one task however many events it has."""
    parts = 2 * events.sparkSession.sparkContext.defaultParallelism
    return checkin_projection(events.select("event_id", "user_id", "ts").repartition(parts))


def scored_stream(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """STR1: (valid scored check-ins, quarantine) from an event stream."""
    valid, bad = split_valid(spread_checkins(events))
    return valid.transform(with_score()), bad


def shift_of(ts: Column) -> Column:
    """Shift by hour of day: 6-14 morning, 14-22 evening, else night."""
    h = F.hour(ts)
    return F.when((h >= 6) & (h < 14), "morning").when((h >= 14) & (h < 22), "evening").otherwise("night")


def windowed_strain(scored: DataFrame, size: str = "7 days", slide: str | None = "1 day",
                    watermark: str = "2 days") -> DataFrame:
    """STR5: average score and check-ins per window, setting and shift. ``slide=None`` gives
    tumbling windows (``"1 day"``: daily averages). Windows behind the watermark leave the state."""
    w = scored.withWatermark("ts", watermark)
    win = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (w.groupBy(win.alias("win"), "setting", shift_of(F.col("ts")).alias("shift"))
             .agg(F.avg("score").alias("avg_score"), F.count(F.lit(1)).alias("checkins")))


def dedup_posts(posts: DataFrame, key: str = "id", ts: str = "created_utc", watermark: str = "2 days") -> DataFrame:
    """STR3: the first row of each id; copies within the watermark are dropped by state, rows
    behind it are late and dropped, so ids behind it need no state."""
    return posts.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def feedback_join(checkins: DataFrame, feedback: DataFrame, bound: str = "1 day", watermark: str | None = None) -> DataFrame:
    """STR4/JOI9: feedback joined to its check-in if given within ``bound`` after it.

    Works on two streams or two tables. On streams each side has a watermark, and the interval
    tells how long a row may still find a partner: check-ins leave the state ``bound`` after
    the watermark, feedback when the watermark passes it.
    """
    c, f = checkins, feedback.withColumnRenamed("checkin_id", "_checkin")
    if checkins.isStreaming:
        c, f = c.withWatermark("ts", watermark or bound), f.withWatermark("feedback_ts", watermark or bound)
    on = F.expr(f"checkin_id = _checkin AND feedback_ts >= ts AND feedback_ts <= ts + INTERVAL {bound}")
    return c.join(f, on).drop("_checkin")


STATE_SCHEMA = "recent array<double>, run long, seen long"
OUT_SCHEMA = ("checkin_id long, worker_id long, ts timestamp, score double, trend string, "
              "consecutive_high_days long")


_OUT_COLUMNS = ["checkin_id", "worker_id", "ts", "score", "trend", "consecutive_high_days"]


def _trend_rows(pdfs: Iterator[pd.DataFrame], state: GroupState) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Updates a worker's state (last 7 scores newest first, run of scores > 60, count) by the rows
    of a micro-batch, which may come in several chunks of any order; returns the rows and the output."""
    recent, run, seen = (list(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], 0, 0)
    rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts", "checkin_id"], ignore_index=True)
    out = []
    for checkin, worker, ts, score in zip(rows["checkin_id"], rows["worker_id"], rows["ts"], rows["score"]):
        s = float(score)
        trend, streak = None, 0
        if seen >= 2:
            avg = sum(recent) / len(recent)
            trend = "worsening" if s > avg + 8 else "improving" if s < avg - 8 else "stable"
            streak = run + (1 if s > 60 else 0)
        out.append((checkin, worker, ts, s, trend, streak))
        recent = ([s] + recent)[:7]
        run = run + 1 if s > 60 else 0
        seen += 1
    state.update((recent, run, seen))
    return rows, pd.DataFrame(out, columns=_OUT_COLUMNS)


def _trend_state(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """STR2 with a processing-time idle limit; same rule as the batch ``score_trend`` when a
    worker's check-ins arrive in order."""
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([], columns=_OUT_COLUMNS)
        return
    _, out = _trend_rows(pdfs, state)
    state.setTimeoutDuration(7 * 24 * 3600 * 1000)
    yield out


def _trend_state_until(idle_ms: int):
    """STR2 with an idle limit in event time: a worker whose last check-in is ``idle_ms`` behind
    the watermark is forgotten, whenever the stream runs."""
    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=_OUT_COLUMNS)
            return
        rows, out = _trend_rows(pdfs, state)
        state.setTimeoutTimestamp(max(int(rows["ts_ms"].max()) + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield out
    return step


def keyed_trend(scored: DataFrame, idle_days: int | None = None, watermark: str = "7 days") -> DataFrame:
    """STR2 operator: per-worker state, dropped after a week without check-ins by the clock, or after
    ``idle_days`` of event time behind the watermark. A worker has one check-in a day, so the rows of
    one worker in a micro-batch are bounded by the days that it covers."""
    if idle_days is None:
        return (scored.select("checkin_id", "worker_id", "ts", "score")
                      .groupBy("worker_id")
                      .applyInPandasWithState(_trend_state, OUT_SCHEMA, STATE_SCHEMA, "append",
                                              GroupStateTimeout.ProcessingTimeTimeout))
    rows = scored.withWatermark("ts", watermark)
    return (rows.select("checkin_id", "worker_id", "ts", "score", F.unix_millis("ts").alias("ts_ms"))
                .groupBy("worker_id")
                .applyInPandasWithState(_trend_state_until(idle_days * 86_400_000), OUT_SCHEMA, STATE_SCHEMA, "append",
                                        GroupStateTimeout.EventTimeTimeout))


def stream_dir(spark: SparkSession, name: str) -> str:
    """Folder of a named stream below the checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name)


def _drain(df: DataFrame, name: str, sink: Callable[[DataFrame, int], None], mode: str) -> None:
    base = stream_dir(df.sparkSession, name)
    q = (df.writeStream.outputMode(mode).foreachBatch(sink).trigger(availableNow=True)
           .option("checkpointLocation", os.path.join(base, "checkpoint")).start())
    q.awaitTermination()


def quarantine_sink(scored_path: str, quarantine_path: str) -> Callable[[DataFrame, int], None]:
    """STR1: a ``foreachBatch`` sink that validates and writes valid, scored rows and rows with
    ``errors`` to two folders. Each batch overwrites its own sub-folders, so a repeated batch leaves
    the same rows. Both writes read the batch: its rows depend on the source's files alone, a shuffle
    before the sink is kept, and rows with their answer maps, over a KB each, are not held between them."""
    def write(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_valid(batch)
        good.transform(with_score()).write.mode("overwrite").parquet(f"{scored_path}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{quarantine_path}/batch={batch_id}")
    return write


def drain_with_quarantine(checkins: DataFrame, name: str) -> tuple[str, str]:
    """Drains a stream of check-ins into ``<stream>/scored`` and ``<stream>/quarantine``."""
    base = stream_dir(checkins.sparkSession, name)
    paths = os.path.join(base, "scored"), os.path.join(base, "quarantine")
    _drain(checkins, name, quarantine_sink(*paths), "append")
    return paths


def drain_updates(df: DataFrame, name: str) -> str:
    """Drains an aggregation in update mode: each batch's changed rows go to ``<stream>/updates/batch=<id>``."""
    path = os.path.join(stream_dir(df.sparkSession, name), "updates")
    _drain(df, name, lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}"), "update")
    return path


def latest_updates(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last value of each key that an update-mode stream wrote (``batch`` orders them)."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return (updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
                   .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]))


def run_available_now(df: DataFrame, name: str, mode: str = "append", fmt: str = "parquet") -> str:
    """Drain the source once into ``<checkpoint dir>/<name>``; returns the
    output path. The checkpoint sits next to it in the shared folder."""
    base = stream_dir(df.sparkSession, name)
    out = os.path.join(base, "data")
    q = (df.writeStream.format(fmt).outputMode(mode)
           .option("path", out).option("checkpointLocation", os.path.join(base, "checkpoint"))
           .trigger(availableNow=True).start())
    q.awaitTermination()
    return out
