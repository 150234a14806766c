"""Array/vector column helpers (FN7)."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

_STOP_FILE = os.path.join(os.path.dirname(__file__), "stopwords_en.txt")


def default_stop_words() -> list[str]:
    """Spark's built-in English stop-word list (181 words), shipped as data
    so plans and SQL twins need no running JVM to read it."""
    with open(_STOP_FILE, encoding="utf-8") as fh:
        return [w for w in fh.read().split("\n") if w]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def sq_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))


def sq_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
                       F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column, eps: float = 1e-10) -> Column:
    """ML7: cosine with the 1e-10 guard added to both norms."""
    return dot(a, b) / ((F.sqrt(sq_norm(a)) + eps) * (F.sqrt(sq_norm(b)) + eps))
