"""Aggregate reports (AGG1-AGG4, AGG8).

Every report is a hash aggregation with a partial (map-side) phase, so hot
groups are pre-aggregated inside each input task before the shuffle.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as T

Op = Callable[[DataFrame], DataFrame]


def coverage_report(df: DataFrame, group_cols: Sequence[str] = ("source", "channel"),
                    text_col: str = "text", time_col: str = "created_utc") -> DataFrame:
    """AGG1: rows per (source, channel), % blank text (2 dp), first/last time;
    ordered by source asc, count desc. Groups with a NULL key are skipped."""
    cols = [c for c in group_cols if c in df.columns]
    if not cols:
        return df.sparkSession.createDataFrame([], "source string")
    for c in cols:
        df = df.filter(F.col(c).isNotNull())
    blank = F.when(F.coalesce(T.is_blank(text_col), F.lit(False)), 1.0).otherwise(0.0)
    aggs = [F.count(F.lit(1)).alias("count"),
            F.round(F.avg(blank) * 100, 2).alias("pct_missing_text")]
    if time_col in df.columns:
        aggs += [F.min(time_col).alias("date_min"), F.max(time_col).alias("date_max")]
    out = df.groupBy(*cols).agg(*aggs)
    return out.orderBy(F.col(cols[0]).asc(), F.col("count").desc())


def value_counts(df: DataFrame, col: str, share: bool = True) -> DataFrame:
    """AGG2/AGG4: count per value and its share (%) of all rows. Meant for
    low-cardinality columns (source, type, label): the share's key-less
    window runs over the aggregated result, one row per distinct value."""
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    if share:
        # the window has no partition key but runs over the aggregated
        # (one row per value) result only
        out = out.withColumn("pct", F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy()))
    return out


def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """AGG3: the ``n`` most frequent values (a top-k report)."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.col("count").desc(), F.col(col).asc()).limit(n))


def stage_counter(name: str) -> tuple[Op, Observation]:
    """AGG8: row count of a stage, collected as a side effect of the job that
    consumes the frame (``df.observe``), without an extra pass."""
    obs = Observation(name)
    return (lambda df: df.observe(obs, F.count(F.lit(1)).alias("rows"))), obs
