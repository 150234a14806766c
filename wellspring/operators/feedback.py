"""Feedback on activities: rating changes (CHK14) and helpful rates (CHK15, over JOI9)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Op = Callable[[DataFrame], DataFrame]

#: Ratings before and after an activity; of tension a lower one is better.
RATINGS = {"energy": 1, "tension": -1, "clarity": 1}


def rating_changes() -> Op:
    """CHK14: adds ``<rating>_change``, after less before, the sign of tension flipped, so that a positive
    change is always a better one; NULL if either rating is missing."""
    return lambda df: df.withColumns({
        f"{name}_change": (F.col(f"{name}_after") - F.col(f"{name}_before")) * sign for name, sign in RATINGS.items()})


def activity_outcomes(key: str = "activity_id") -> Op:
    """CHK14/CHK15 for a fleet: per activity the number of ratings, the share that found it helpful
    (of those that say) and the mean changes; partial aggregation, so a frequent activity is no hot task."""
    def op(df: DataFrame) -> DataFrame:
        return df.transform(rating_changes()).groupBy(key).agg(
            F.count(F.lit(1)).alias("n_feedback"), F.avg(F.col("helpful").cast("int")).alias("helpful_rate"),
            *[F.avg(f"{name}_change").alias(f"avg_{name}_change") for name in RATINGS])
    return op
