"""Quality by importance resampling of hashed n-gram models.

Two bag-of-n-gram models over ``BUCKETS`` hashed words and word pairs: the target's,
counted over labelled good documents (at most ``max_target``, the first by hash: the
documented bound of the fit), and the raw text's, counted over every document. A text's
importance weight is the sum over its n-grams of log(target / raw), scaled to
``LENGTH`` n-grams so that a long text doesn't win by length. Documents are resampled
without replacement by Gumbel top-k: weight plus Gumbel noise hashed from the doc_id, the
``k`` largest are taken.

The counts are summed in Spark and come to the driver as ``BUCKETS`` numbers. The k-th
largest key is found exactly: a histogram of keys gives the bin that holds it, and only that
bin's rows are ordered.

Defined results: NULL and empty texts have weight 0 (no evidence); equal keys are taken by
smaller doc_id, NULL ids last; ``fraction`` None takes the share of good documents among the
labelled ones; without labels all weights are 0 and everything is taken; labels given twice
count as good only if all rows say so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm import ngrams
from wellspring.llm.common import blocks, bounded_batches, map_texts
from wellspring.session import cut_lineage

BUCKETS = 1 << 14
LENGTH = 100.0
SMOOTH = 1.0

_U = np.uint64


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs (lower-cased, by white space) and their texts' numbers."""
    hashed, offsets = ngrams.words([t.lower() for t in texts])
    pair, own = ngrams.runs(hashed, offsets, 2)
    value = np.concatenate([ngrams.mix(hashed + _U(29)), pair])
    return (value & _U(BUCKETS - 1)).astype(np.int64), np.concatenate([ngrams.owners(offsets), own])


def _count(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for part, texts in blocks(batches, "_text"):
        at, own = grams(texts)
        good = np.array(part.column(0).to_pylist(), dtype=bool)
        raw += np.bincount(at, minlength=BUCKETS)
        target += np.bincount(at[good[own]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["at", "raw", "target"])


def target_ids(labels: DataFrame, max_target: int, seed: int) -> tuple[DataFrame, float]:
    """Ids of at most ``max_target`` good documents, the first by hash, and the share of good ones."""
    one = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.min("quality").alias("q"))
    n, good = one.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("q") == 1).cast("long")), F.lit(0))).first()
    ids = one.filter("q = 1").select("_id").orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(max_target)
    return ids, good / n if n else 1.0


def log_ratios(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """log(target / raw) of every bucket."""
    bounded_batches(docs.sparkSession)
    good = F.broadcast(ids.withColumn("_good", F.lit(True)))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(good, "_id", "left")
    rows = rows.select(F.coalesce("_good", F.lit(False)).alias("_good"), "_text")
    sums = rows.mapInArrow(_count, "at bigint, raw bigint, target bigint").groupBy("at").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    raw[sums["at"]] += sums["raw"]
    target[sums["at"]] += sums["target"]
    if target.sum() == SMOOTH * BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def gumbel(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise hashed from the id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(doc_id, F.lit(0))), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def weigh(docs: DataFrame, ratios: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``n_grams``, ``log_weight`` and ``score`` (0 to 1) of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(texts: list[str]) -> dict[str, pa.Array]:
        at, own = grams(texts)
        n = np.bincount(own, minlength=len(texts))
        total = np.bincount(own, weights=shared.value[at], minlength=len(texts))
        weight = total * LENGTH / np.maximum(n, LENGTH)
        return {"n_grams": pa.array(n.astype(np.int64)), "log_weight": pa.array(weight),
                "score": pa.array(1 / (1 + np.exp(-np.clip(weight, -35, 35))))}

    return map_texts(docs, keep, text, run, "n_grams bigint, log_weight double, score double")


def top_k(weighed: DataFrame, k: int, doc_id: str, key: str, bin_width: float = 0.01) -> DataFrame:
    """Add ``kept``: whether the row is among the ``k`` largest keys. Exact at any size."""
    bins = weighed.groupBy(F.floor(F.col(key) / bin_width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    above, cut, rest = 0, None, 0
    for b, n in bins.orderBy(F.desc("bin")).toLocalIterator():  # one row for each occupied bin
        if above + n > k:
            cut, rest = b, k - above
            break
        above += n
    if cut is None:
        return weighed.withColumn("kept", F.lit(True))
    spot = F.floor(F.col(key) / bin_width)
    order = Window.partitionBy("_bin").orderBy(F.desc(key), F.col(doc_id).asc_nulls_last())
    edge = weighed.withColumn("_bin", spot).filter(F.col("_bin") == cut)
    edge = edge.withColumn("kept", F.row_number().over(order) <= rest).drop("_bin")
    return weighed.filter(spot != cut).withColumn("kept", spot > cut).union(edge)


def resample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
             fraction: float | None = None, max_target: int = 20_000, seed: int = 7) -> DataFrame:
    """doc_id, n_grams, log_weight, score, gumbel_key and kept of every document."""
    ids, share = target_ids(labels, max_target, seed)
    ratios = log_ratios(docs, ids, doc_id, text)
    out = weigh(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), ratios, ["doc_id"])
    out = cut_lineage(out.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)))
    return top_k(out, round(out.count() * (share if fraction is None else fraction)), "doc_id", "gumbel_key")
