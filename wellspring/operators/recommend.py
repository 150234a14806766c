"""Activity recommendations (CHK12, CHK13, JOI4-JOI6, SRT1-SRT4).

The catalog is a fixed 10-variant table, so instead of a theta join with the
check-ins it is inlined as an array literal and evaluated per check-in with
higher-order functions: filter the fitting variants, pick the longest (else
the shortest variant), flag relevance, sort the five categories, explode.
One narrow projection plus ``posexplode``; no join, no shuffle.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dims import (ACTIVITY_CATEGORIES, ACTIVITY_VARIANTS, DEFAULT_TRACK, DIM_TO_TRACK,
                            SUBSCALE_CATEGORY_MAP, SUBSCALE_HIGH)

Op = Callable[[DataFrame], DataFrame]


def _variant(vid, dur, audio, writing, best_for, settings) -> Column:
    return F.struct(F.lit(vid).alias("intervention_id"), F.lit(dur).alias("duration_min"),
                    F.lit(audio).alias("needs_audio"), F.lit(writing).alias("needs_writing"),
                    F.array(*[F.lit(b) for b in best_for]).alias("best_for"),
                    F.array(*[F.lit(s) for s in settings]).alias("settings"))


def catalog_literal() -> Column:
    cats = []
    for i, (cid, name) in enumerate(ACTIVITY_CATEGORIES):
        variants = [_variant(v, d, a, w, b, s) for v, c, d, a, w, b, s in ACTIVITY_VARIANTS if c == cid]
        cats.append(F.struct(F.lit(cid).alias("category_id"), F.lit(i).alias("category_ord"),
                             F.lit(name).alias("category_name"), F.array(*variants).alias("variants")))
    return F.array(*cats)


def subscale_map_literal() -> Column:
    return F.create_map(*[x for k, v in SUBSCALE_CATEGORY_MAP.items()
                          for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])


def categories_of(levels: Column) -> Column:
    """JOI6 over a map of subscale -> normalised level (0-10), as debriefs give it: the distinct
    categories of the high ones."""
    m, none = subscale_map_literal(), F.array().cast("array<string>")
    high = F.filter(F.map_entries(levels), lambda e: F.coalesce(e["value"] >= SUBSCALE_HIGH, F.lit(False)))
    cats = F.flatten(F.transform(high, lambda e: F.coalesce(F.try_element_at(m, e["key"]), none)))
    return F.array_distinct(F.coalesce(cats, none))


def boosted_categories(scales: Column) -> Column:
    """CHK12/JOI6: categories mapped from subscales with normalised >= 6.0,
    over both scales (distinct)."""
    m = subscale_map_literal()

    def from_scale(sc: Column) -> Column:
        elevated = F.filter(F.map_entries(sc["subscales"]),
                            lambda e: F.coalesce(e["value"]["normalized_0_10"] >= SUBSCALE_HIGH, F.lit(False)))
        cats = F.flatten(F.transform(elevated, lambda e: F.coalesce(F.try_element_at(m, e["key"]),
                                                                    F.array().cast("array<string>"))))
        return F.coalesce(cats, F.array().cast("array<string>"))
    empty = F.array().cast("array<string>")
    out = F.array_distinct(F.concat(from_scale(scales["bat12"]), from_scale(scales["olbi"])))
    return F.when(scales.isNull(), empty).otherwise(F.coalesce(out, empty))


def _first_by(arr: Column, better) -> Column:
    start = F.try_element_at(arr, F.lit(1))
    return F.aggregate(arr, start, lambda acc, v: F.when(better(v, acc), v).otherwise(acc))


def ranked_options(time_col: Column, setting_col: Column, dominant: Column, boosted: Column) -> Column:
    """CHK13/SRT1/SRT2: the five categories, each with its best variant,
    sorted relevant first, then available, then category order."""
    def per_category(c):
        fitting = F.filter(c["variants"], lambda v: (v["duration_min"] <= time_col)
                           & F.coalesce(F.array_contains(v["settings"], setting_col), F.lit(False)))
        available = F.size(fitting) > 0
        longest = _first_by(fitting, lambda v, acc: v["duration_min"] > acc["duration_min"])
        shortest = _first_by(c["variants"], lambda v, acc: v["duration_min"] < acc["duration_min"])
        best = F.when(available, longest).otherwise(shortest)
        dim_match = F.coalesce(F.array_contains(best["best_for"], dominant), F.lit(False))
        scale_match = F.array_contains(boosted, c["category_id"])
        relevant = dim_match | scale_match | (dominant.isNull() & (F.size(boosted) == 0))
        reason = F.when(scale_match & ~dim_match, "subscale").when(dim_match, "dimension")
        unavailable = F.when(~available, F.concat(F.lit("Needs "), best["duration_min"].cast("string"),
                                                  F.lit(" min or different setting")))
        return F.struct(
            F.when(relevant, 0).otherwise(1).alias("_k1"), F.when(available, 0).otherwise(1).alias("_k2"),
            c["category_ord"].alias("_k3"), c["category_id"].alias("category_id"),
            c["category_name"].alias("category_name"), best["intervention_id"].alias("intervention_id"),
            best["duration_min"].alias("duration_min"), best["needs_audio"].alias("needs_audio"),
            best["needs_writing"].alias("needs_writing"), available.alias("available"),
            relevant.alias("is_relevant"), reason.alias("relevance_reason"),
            unavailable.alias("unavailable_reason"))
    return F.array_sort(F.transform(catalog_literal(), per_category))


def _with_inputs(df: DataFrame, dominant_col, scales_col) -> DataFrame:
    """Dominant dimension and boosted categories as columns of their own, so
    the per-category lambdas read them instead of re-deriving them."""
    dom = F.col(dominant_col) if dominant_col and dominant_col in df.columns else F.lit(None).cast("string")
    boosted = (boosted_categories(F.col(scales_col)) if scales_col and scales_col in df.columns
               else F.array().cast("array<string>"))
    return df.withColumn("_dom", dom).withColumn("_boosted", boosted)


def recommend(time_col: str = "time_available_min", setting_col: str = "setting",
              dominant_col: str | None = "dominant_dimension", scales_col: str | None = "burnout_scales",
              keep: tuple = ("checkin_id",)) -> Op:
    """Five rows per input row: ``rank`` 1-5 and the option fields."""
    def op(df: DataFrame) -> DataFrame:
        df = _with_inputs(df, dominant_col, scales_col)
        opts = ranked_options(F.col(time_col), F.col(setting_col), F.col("_dom"), F.col("_boosted"))
        out = df.select(*keep, F.posexplode(opts).alias("_pos", "_o"))
        return out.select(*keep, (F.col("_pos") + 1).alias("rank"),
                          *[F.col(f"_o.{f}").alias(f) for f in (
                              "category_id", "category_name", "intervention_id", "duration_min",
                              "needs_audio", "needs_writing", "available", "is_relevant",
                              "relevance_reason", "unavailable_reason")])
    return op


def top_option(time_col: str = "time_available_min", setting_col: str = "setting",
               dominant_col: str | None = "dominant_dimension", scales_col: str | None = "burnout_scales") -> Op:
    """SRT4: first relevant option, else the first (= rank 1 of the order)."""
    def op(df: DataFrame) -> DataFrame:
        d2 = _with_inputs(df, dominant_col, scales_col)
        d2 = d2.withColumn("_first", F.element_at(
            ranked_options(F.col(time_col), F.col(setting_col), F.col("_dom"), F.col("_boosted")), 1))
        return (d2.withColumn("top_category_id", F.col("_first")["category_id"])
                  .withColumn("top_intervention_id", F.col("_first")["intervention_id"])
                  .drop("_first", "_dom", "_boosted"))
    return op


def fallback_track(dominant: Column) -> Column:
    """JOI4: dominant dimension -> track, default ``restore``."""
    m = F.create_map(*[F.lit(x) for kv in DIM_TO_TRACK.items() for x in kv])
    return F.coalesce(F.try_element_at(m, dominant), F.lit(DEFAULT_TRACK))
