"""Signals in shift debriefs (TXT13, CHK11) and what they boost (JOI6).

Both rules are narrow projections: the text is lower-cased once and every phrase of the lists is
looked for in it. Which phrases were found comes back with the counts.
"""

from __future__ import annotations

from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import (CHECKIN_BURNOUT_THEMES, KEYWORD_THEMES, NEGATIVE_FACTOR, STRENGTH_CAP, THEME_STRENGTH,
                               THEME_TO_DOMAIN)

Op = Callable[[DataFrame], DataFrame]


def phrases_found(lowered: Column, phrases: Sequence[str]) -> Column:
    """The phrases that a lower-cased text contains, in the order of the list."""
    return F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(p)), F.lit(p)) for p in phrases]))


def debrief_signals(text_col: str = "text", lists: Mapping[str, Sequence[str]] = CHECKIN_BURNOUT_THEMES) -> Op:
    """TXT13: adds ``has_debrief``, ``domain_signals`` (domain -> count and keywords found, every
    domain present) and ``word_count``. A NULL or blank text has no debrief, no signals and 0 words."""
    def op(df: DataFrame) -> DataFrame:
        raw = F.coalesce(F.col(text_col), F.lit(""))
        out = df.withColumns({"has_debrief": ~T.is_blank(raw), "_low": F.lower(raw)})
        out = out.withColumns({f"_{name}": phrases_found(F.col("_low"), words) for name, words in lists.items()})
        entries = F.array(*[F.struct(F.lit(name).alias("key"), F.struct(
            F.size(f"_{name}").alias("count"), F.col(f"_{name}").alias("keywords_found")).alias("value")) for name in lists])
        shown = F.when(F.col("has_debrief"), entries).otherwise(F.slice(entries, 1, 0))
        return (out.withColumn("domain_signals", F.map_from_entries(shown)).withColumn("word_count", T.word_count(raw))
                   .drop("_low", *[f"_{name}" for name in lists]))
    return op


def domain_strengths(text_col: str = "text", label_col: str = "sentiment_label",
                     themes: Mapping[str, Sequence[str]] = KEYWORD_THEMES,
                     domains: Mapping[str, str] = THEME_TO_DOMAIN) -> Op:
    """CHK11: adds ``themes_detected`` and ``domain_strengths`` (domain -> normalised 0-10).

    Each theme found adds its share to its domain, up to the cap; a negative debrief counts more;
    the result is on the scales' range with two decimals. Domains without a theme are absent, and so
    are all of a NULL or blank text.
    """
    def op(df: DataFrame) -> DataFrame:
        out = df.withColumn("_low", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
        out = out.withColumns({f"_{name}": F.size(phrases_found(F.col("_low"), words)) > 0 for name, words in themes.items()})
        found = F.array_compact(F.array(*[F.when(F.col(f"_{name}"), F.lit(name)) for name in themes]))
        factor = F.when(F.col(label_col) == "negative", F.lit(NEGATIVE_FACTOR)).otherwise(F.lit(1.0))
        entries = []
        for domain in dict.fromkeys(domains[name] for name in themes if name in domains):
            hits = sum((F.col(f"_{name}").cast("int") for name in themes if domains.get(name) == domain), F.lit(0))
            strength = F.least(hits * F.lit(THEME_STRENGTH), F.lit(STRENGTH_CAP))
            level = F.round(F.least(F.lit(10.0), strength * factor * 10), 2)
            entries.append(F.when(hits > 0, F.struct(F.lit(domain).alias("key"), level.alias("value"))))
        return (out.withColumn("themes_detected", found)
                   .withColumn("domain_strengths", F.map_from_entries(F.array_compact(F.array(*entries))))
                   .drop("_low", *[f"_{name}" for name in themes]))
    return op
