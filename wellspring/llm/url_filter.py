"""URL filters: rules first, else logistic regression on hashed character n-grams.

Host and path are cut into character n-grams (edges marked, host and path apart), hashed
to ``BITS`` bits, and a logistic regression is fitted by MLlib on a small labelled table
of URLs. A URL that a rule fits gets the rule's verdict; of several the longest wins
(then the first by name). DataFrame and MLlib operations only.

Defined results: a NULL URL or one without ``://`` has empty host and path, fits no rule and
is judged by the model's intercept; rules number at most ``MAX_RULES`` (they are part of the
plan); a labelled table with one class or no rows gives that class's share (0.5 for no rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
SIZES = (3, 4, 5)
MAX_RULES = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _grams(text: Column, tag: str) -> Column:
    """All n-grams of ``^text$`` with a tag in front; none of an empty text."""
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(chars) - n + 1, F.lit(1))),
                           lambda i: F.concat(F.lit(tag), F.array_join(F.slice(chars, i, F.lit(n)), "")))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.concat(*[of(n) for n in SIZES]))


def featured(df: DataFrame, host: str, path: str) -> DataFrame:
    grams = F.concat(_grams(F.col(host), "h:"), _grams(F.col(path), "p:"))
    return HashingTF(numFeatures=1 << BITS, binary=True, inputCol="_grams", outputCol="_features").transform(
        df.withColumn("_grams", grams)).drop("_grams")


class Model:
    def __init__(self, fitted: LogisticRegressionModel | None, share: float):
        self.fitted, self.share = fitted, share

    def score(self, df: DataFrame, host: str, path: str, name: str) -> DataFrame:
        """Add ``name``: the probability that the URL is to be blocked."""
        if self.fitted is None:
            return df.withColumn(name, F.lit(self.share))
        out = self.fitted.transform(featured(df, host, path))
        return out.withColumn(name, vector_to_array("_p")[1]).drop("_features", "_p")


def train(labelled: DataFrame, url: str = "url", label: str = "label", ridge: float = 0.01) -> Model:
    """Fit on a small table of ``url`` and ``label`` (1: to be blocked)."""
    host, path = host_path(F.col(url))
    rows = labelled.filter(F.col(label).isNotNull()).select(host.alias("_host"), path.alias("_path"),
                                                            F.col(label).cast("double").alias("_label"))
    n, blocked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_label"), F.lit(0.0))).first()
    if blocked == 0 or blocked == n:
        return Model(None, blocked / n if n else 0.5)
    fit = LogisticRegression(featuresCol="_features", labelCol="_label", probabilityCol="_p", rawPredictionCol="",
                             predictionCol="", regParam=ridge, maxIter=60, standardization=False)
    return Model(fit.fit(featured(rows, "_host", "_path").coalesce(1)), 0.0)


def _fits(host: Column, path: Column, rule: str) -> Column:
    own, _, below = rule.partition("/")
    return ((host == own) | host.endswith("." + own)) & path.startswith("/" + below)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], model: Model, keep: Sequence[str] = ("page_id",),
          url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``keep`` columns, host, path, rule, score and verdict of every row.

    ``rules`` are ``(verdict, "host/path")`` pairs; a host stands for all its subdomains too.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    host, path = host_path(F.col(url))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    order = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    fit = F.coalesce(*[F.when(_fits(F.col("host"), F.col("path"), r), F.struct(F.lit(r).alias("rule"), F.lit(v).alias("v")))
                       for v, r in order], F.lit(None).cast("struct<rule:string,v:string>"))
    rows = model.score(rows, "host", "path", "score").withColumn("_fit", fit)
    verdict = F.coalesce("_fit.v", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return rows.select(*keep, "host", "path", F.col("_fit.rule").alias("rule"), "score", verdict.alias("verdict"))
