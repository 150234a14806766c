"""Cleaning a table of texts (TXT8): clean each text by its source's rules, drop short ones, keep each text once."""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .dedup import dedup_text
from .filters import filter_min_words

Op = Callable[[DataFrame], DataFrame]


def clean_table(min_words: int = 10, order: Sequence[str] = ("id",), text_col: str = "text", source_col: str = "source") -> Op:
    """TXT8: TXT7, FIL10 and DED2 in this order, so copies are found among cleaned texts. Of equal
    texts the row that is least in ``order`` stays. Without a source column no source's rules apply;
    NULL texts count as empty and go."""
    def op(df: DataFrame) -> DataFrame:
        source = F.col(source_col) if source_col in df.columns else None
        # a generator's output: the filter on it is not pushed below the cleaning, which would be done again for it
        out = df.withColumn(text_col, F.explode_outer(F.array(T.clean_text(F.col(text_col), source))))
        return out.transform(filter_min_words(min_words, text_col)).transform(dedup_text(order, text_col))
    return op
