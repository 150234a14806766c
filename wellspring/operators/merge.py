"""Multi-source merge (SET1-SET3, PRJ20, EXT1).

A registry maps a source name to a ``DataFrame -> DataFrame`` normaliser
producing the base review schema (S4). ``merge_sources`` unions the
normalised frames by name, checks the source guard lazily and keeps the
first copy of each text.
"""

from __future__ import annotations

from typing import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import keep_first
from .filters import guard_sources

Normalizer = Callable[[DataFrame], DataFrame]

BASE_COLUMNS = ["review_id", "text", "source", "subreddit", "employee_job_title",
                "employee_status", "company_name", "rating_date", "rating_overall"]
BASE_TYPES = {"review_id": "string", "text": "string", "source": "string", "subreddit": "string",
              "employee_job_title": "string", "employee_status": "string",
              "company_name": "string", "rating_date": "timestamp", "rating_overall": "double"}


def _get(df: DataFrame, name: str, default):
    return F.col(name) if name in df.columns else F.lit(default)


def _carry(df: DataFrame) -> list:
    """Row-order columns travel through the built-in normalisers."""
    return [F.col(c) for c in ("_row_ord",) if c in df.columns]


def normalize_reviews(df: DataFrame) -> DataFrame:
    """Review export -> base schema (defaults as the reviews normaliser)."""
    return df.select(
        _get(df, "review_id", None).cast("string").alias("review_id"),
        _get(df, "text", "").cast("string").alias("text"),
        F.lit("glassdoor").alias("source"),
        F.lit(None).cast("string").alias("subreddit"),
        _get(df, "employee_job_title", "Unknown").cast("string").alias("employee_job_title"),
        _get(df, "employee_status", "Unknown").cast("string").alias("employee_status"),
        _get(df, "company_name", "Amazon").cast("string").alias("company_name"),
        _get(df, "rating_date", None).cast("timestamp").alias("rating_date"),
        _get(df, "rating_overall", None).cast("double").alias("rating_overall"),
        *_carry(df),
    )


def normalize_forum_posts(df: DataFrame) -> DataFrame:
    """Forum frame -> base schema. The date may arrive as ``created_date`` or
    ``rating_date``; the first present value is used."""
    dates = [F.col(c).cast("timestamp") for c in ("created_date", "rating_date") if c in df.columns]
    return df.select(
        _get(df, "review_id", None).cast("string").alias("review_id"),
        _get(df, "text", "").cast("string").alias("text"),
        F.lit("reddit").alias("source"),
        _get(df, "subreddit", None).cast("string").alias("subreddit"),
        F.lit("Unknown").alias("employee_job_title"),
        F.lit("Unknown").alias("employee_status"),
        _get(df, "company_name", "Various").cast("string").alias("company_name"),
        (F.coalesce(*dates) if dates else F.lit(None).cast("timestamp")).alias("rating_date"),
        F.lit(None).cast("double").alias("rating_overall"),
        *_carry(df),
    )


ALLOWED_SOURCES = {"reddit", "glassdoor"}
NORMALIZERS: dict[str, Normalizer] = {
    "glassdoor": normalize_reviews,
    "reddit": normalize_forum_posts,
}


def register_source(name: str, normalizer: Normalizer,
                    registry: dict[str, Normalizer] | None = None) -> None:
    """EXT1: add or replace a source normaliser at run time."""
    (NORMALIZERS if registry is None else registry)[name] = normalizer


def fill_base_columns(df: DataFrame) -> DataFrame:
    out = df
    for c in BASE_COLUMNS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(BASE_TYPES[c]))
    return out


def union_all(frames, allow_missing: bool = True) -> DataFrame | None:
    """SET1/SET2: union by column name (missing columns filled with NULL)."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=allow_missing)
    return out


def merge_sources(frames: Mapping[str, DataFrame], deduplicate: bool = True,
                  allowed=ALLOWED_SOURCES, registry: Mapping[str, Normalizer] | None = None,
                  order_col: str | None = None) -> DataFrame | None:
    """SET3: normalise each registered source, pass unregistered ones through,
    fill missing base columns, union in the given source order, guard the
    source values and keep the first copy of each text.

    Concatenation order is carried as ``(_src_ord, order_col)`` so "first" is
    deterministic; ``order_col`` is an optional per-source row order.
    """
    registry = NORMALIZERS if registry is None else registry
    parts = []
    for i, (name, df) in enumerate(frames.items()):
        if df is None:
            continue
        if order_col and order_col in df.columns:
            df = df.withColumn("_row_ord", F.col(order_col).cast("long"))
        norm = registry.get(name)
        out = fill_base_columns(norm(df) if norm is not None else df)
        if "_row_ord" not in out.columns:
            # normalisers are narrow projections, so this is still scan order
            out = out.withColumn("_row_ord", F.monotonically_increasing_id())
        parts.append(out.withColumn("_src_ord", F.lit(i)))
    if not parts:
        return None
    merged = union_all(parts).transform(guard_sources(allowed, stage="merge_sources"))
    if deduplicate:
        merged = merged.transform(keep_first(["text"], ["_src_ord", "_row_ord"]))
    return merged.drop("_src_ord", "_row_ord")
