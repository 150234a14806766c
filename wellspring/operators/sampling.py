"""Repeatable sampling (SMP1-SMP3).

Random order is a seeded hash of the row id, ``md5('<seed>:<id>')``: the same
rows are chosen whatever the partitioning, on every retry after executor loss,
and an SQL engine can reproduce the choice. Per-group caps are skew-safe: a
first ``row_number`` pass runs per (group, salt) so a hot group is spread
over many tasks; the second pass sees at most ``cap * salts`` rows per group.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Op = Callable[[DataFrame], DataFrame]

DEFAULT_SALTS = 32
# a stratum table larger than this is joined with a shuffle, not broadcast
BROADCAST_ROWS = 100_000


def sample_key(id_col: str = "id", seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def _top_per_group(df: DataFrame, groups: Sequence[str], limit: Column, order: Sequence[Column],
                   salts: int) -> DataFrame:
    """Rows ranked <= ``limit`` (a column, may vary per group) within groups."""
    groups = list(groups)
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    w1 = Window.partitionBy(*groups, "_salt").orderBy(*order)
    w2 = Window.partitionBy(*groups).orderBy(*order)
    return (df.withColumn("_salt", salt)
              .withColumn("_rn", F.row_number().over(w1))
              .filter(F.col("_rn") <= limit)
              .withColumn("_rn", F.row_number().over(w2))
              .filter(F.col("_rn") <= limit)
              .drop("_salt", "_rn"))


def cap_per_group(max_rows: int, group_col: str = "channel", id_col: str = "id",
                  seed: int = 42, salts: int = DEFAULT_SALTS) -> Op:
    """SMP1: at most ``max_rows`` rows per group, chosen by seeded hash."""
    def op(df: DataFrame) -> DataFrame:
        if group_col not in df.columns:
            return df
        keyed = df.withColumn("_sk", sample_key(id_col, seed))
        order = [F.col("_sk"), F.col(id_col)]
        return _top_per_group(keyed, [group_col], F.lit(max_rows), order, salts).drop("_sk")
    return op


def stratified_sample(n: int, strata: Sequence[str] = ("source", "type"), id_col: str = "id",
                      seed: int = 42, force_full: bool = False, salts: int = DEFAULT_SALTS) -> Op:
    """SMP2: sample proportional to strata sizes.

    Per stratum ``min(max(1, round_half_even(n * size / total)), size)`` rows;
    when rounding overshoots, trimmed to ``n`` by the same hash order.
    Identity when ``total <= n`` or ``force_full``.
    """
    def op(df: DataFrame) -> DataFrame:
        if force_full:
            return df
        cols = [c for c in strata if c in df.columns]
        total = df.count()
        if total <= n:
            return df
        keyed = df.withColumn("_sk", sample_key(id_col, seed))
        order = [F.col("_sk"), F.col(id_col)]
        if not cols:
            return keyed.orderBy(*order).limit(n).drop("_sk")
        sizes = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_size"))
        n_strata = sizes.count()
        take = F.least(F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("_size") / F.lit(total), 0)),
                       F.col("_size")).cast("long")
        sizes = sizes.withColumn("_take", take)
        if n_strata <= BROADCAST_ROWS:
            sizes = F.broadcast(sizes)
        joined = keyed.join(sizes, [keyed[c].eqNullSafe(sizes[c]) for c in cols]).drop(*[sizes[c] for c in cols])
        picked = _top_per_group(joined, cols, F.col("_take"), order, salts).drop("_size", "_take")
        # rounding can overshoot by at most one row per stratum: trim by hash
        return picked.orderBy(*order).limit(n).drop("_sk")
    return op


def hash_subsample(n: int, id_col: str = "id", seed: int = 42) -> Op:
    """SMP3: fixed subsample of ``n`` rows (k selection, metric sample)."""
    return lambda df: df.orderBy(sample_key(id_col, seed), F.col(id_col)).limit(n)
