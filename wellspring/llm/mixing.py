"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate, target rows / rows it has. A document's
number of copies is the inverse Poisson distribution function at a uniform number
hashed from seed and doc_id, so a retry or another partitioning gives the same
copies. Documents are exploded by their count and shuffled globally: dealt to
partitions and sorted inside them by a hash of seed, doc_id and copy.

Rates above ``PART`` are split into equal Poisson parts (their sum has the same
distribution), so the distribution function never underflows.

Defined results: NULL is a source of its own and a NULL doc_id hashes as the text
"null"; rows that repeat a doc_id get the same copies; texts are carried, never
read; a source without weight is left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.session import cut_lineage

#: Largest mean of one Poisson part, and the terms of its distribution function (the tail beyond is under 1e-20).
PART = 8.0
TERMS = 48
#: Up to so many sources their rates are broadcast (a few MB); beyond, they are joined by shuffle.
BROADCAST_SOURCES = 50_000


def uniform(seed: int, *what: Column) -> Column:
    """A number in [0, 1) hashed from seed and values: 52 bits of MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in what])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, source: str = "source", weights: Mapping[str, float] | None = None,
                 temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """``(source, n, rate)``: mean copies of a source's documents.

    Target weights are given per source, or else the sources' sizes to the power
    ``temperature``. The mixture has ``epochs`` times the rows of the input on average.
    """
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        if any(not w >= 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None)
        weight = F.coalesce(table[F.col("source")].cast("double"), F.lit(0.0)) if weights else F.lit(0.0)
    counts = cut_lineage(counts.withColumn("w", weight))
    rows, total = counts.agg(F.sum("n"), F.sum("w")).first()
    mean = F.lit(float(epochs) * (rows or 0) / total) * F.col("w") / F.col("n") if total else F.lit(0.0)
    return counts.select("source", "n", mean.alias("rate"))


def _distribution(mean: Column) -> Column:
    """P(X <= 0), ..., P(X <= TERMS - 1) of a Poisson variable."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    step = lambda acc, j: F.struct(
        (acc["p"] * mean / j).alias("p"),
        F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * mean / j)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda acc: acc["c"])


def replicate(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", seed: int = 17,
              weights: Mapping[str, float] | None = None, temperature: float = 0.5,
              epochs: float = 1.0) -> DataFrame:
    """``docs`` replicated and shuffled, with ``copy_no`` (from 1), ``n_copies`` and ``shuffle_key``.

    These three replace input columns of the same names.
    """
    docs = docs.drop("copy_no", "n_copies", "shuffle_key")
    cols = docs.columns
    rates = cut_lineage(source_rates(docs, source, weights, temperature, epochs))
    parts = F.ceil(F.col("rate") / PART).cast("int")
    rates = rates.select(F.col("source").alias("_source"), parts.alias("_parts"),
                         _distribution(F.col("rate") / F.greatest(parts, F.lit(1))).alias("_cdf"))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    met = docs.join(rates, F.col(source).eqNullSafe(F.col("_source")))
    # the number is made once for a part, not once for each term that it is compared with
    part = lambda i: F.get(F.transform(F.array(uniform(seed, F.col(doc_id), i)), lambda u: F.size(
        F.filter("_cdf", lambda c: c <= u))), F.lit(0))
    first = F.when(F.col("_parts") > 0, part(F.lit(1))).otherwise(0)
    more = F.when(F.col("_parts") > 1, F.aggregate(F.sequence(F.lit(2), F.greatest("_parts", F.lit(2))), F.lit(0),
                                                   lambda acc, i: acc + part(i))).otherwise(0)
    copies = met.withColumn("n_copies", first + more).filter("n_copies > 0")
    copies = copies.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    key = F.md5(F.concat_ws(":", F.lit(f"shuffle-{seed}"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")),
                            F.col("copy_no").cast("string")))
    out = copies.select(*cols, "copy_no", "n_copies", key.alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
