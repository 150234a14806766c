"""Keep-first deduplication (DED1, DED2).

"First" means the smallest ``(order columns)`` tuple, e.g. ``(_src_ord,
_row_ord)`` for concatenation order. Implemented as ``groupBy(key)`` with
``min_by(struct(row), struct(order))``: the aggregate is partial, so copies
collapse map-side before the shuffle and a key holding a third of all rows
is reduced inside each input task instead of landing whole in one reducer.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Op = Callable[[DataFrame], DataFrame]


def keep_first(keys: Sequence[str], order: Sequence[str]) -> Op:
    keys, order = list(keys), list(order)

    def op(df: DataFrame) -> DataFrame:
        others = [c for c in df.columns if c not in keys]
        if not others:
            return df.dropDuplicates(keys)
        row = F.struct(*[F.col(c) for c in others])
        ordering = F.struct(*[F.col(c) for c in order])
        return (df.groupBy(*keys)
                  .agg(F.min_by(row, ordering).alias("_first"))
                  .select(*keys, *[F.col("_first")[c].alias(c) for c in others])
                  .select(*df.columns))
    return op


def deduplicate(order: Sequence[str] = ("_row_ord",), id_col: str = "id",
                text_col: str = "text") -> Op:
    """DED1: on ``id`` when the column exists, else on exact text."""
    def op(df: DataFrame) -> DataFrame:
        key = id_col if id_col in df.columns else text_col
        return df.transform(keep_first([key], order))
    return op


def dedup_text(order: Sequence[str] = ("_row_ord",), text_col: str = "text") -> Op:
    """DED2: exact-text dedup across sources, first occurrence kept."""
    return keep_first([text_col], order)
