"""Check-in job: validate -> score -> scales -> history -> recommend.

One narrow projection scores every check-in (no shuffle); the history
windows add one shuffle on the worker key; recommendations are an in-row
evaluation of the fixed catalog followed by ``posexplode``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.checkin import with_scales, with_score
from ..operators.trend import score_trend, trend_features


def score_checkins(checkins: DataFrame) -> DataFrame:
    """Scores and scales for every check-in (CHK1-CHK10)."""
    return checkins.transform(with_score()).transform(with_scales())


def score_with_history(checkins: DataFrame) -> DataFrame:
    """Scores plus both trend rules (WIN1-WIN5); one shuffle on worker."""
    return score_checkins(checkins).transform(score_trend()).transform(trend_features())
