"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or absent: words, pairs of neighbours and pairs with one word
between, lower-cased, hashed to ``BITS`` bits. FTRL keeps a sum of gradients z and of
squared gradients n for each feature, so every coordinate has its own learning rate, and
its L1 term leaves most weights at exactly 0: the model is the list of the others.

Fitting uses at most ``max_rows`` labelled documents, the first by hash (the documented
bound). Their features are made where the rows are; the learner, which is sequential, then
takes that bounded sample through one task for a few epochs and gives back the non-zero
weights alone, which are broadcast.
Scoring reads every whole text in Arrow blocks.

Defined results: NULL and empty texts have no features and get the score of the bias alone;
labels given twice count as toxic if any row says so; a NULL doc_id isn't held out and never
trains; without labels, or with one class, the score is the share of toxic labels (0 if none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm import ngrams
from wellspring.llm.common import blocks, bounded_batches, map_texts
from wellspring.session import cut_lineage

BITS = 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.0

_U = np.uint64


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, all in one array ordered by text, and where each text starts.
    Feature 0 is the bias and isn't listed."""
    hashed, offsets = ngrams.words([t.lower() for t in texts], "alnum")
    own = [ngrams.owners(offsets)]
    value = [ngrams.mix(hashed + _U(11))]
    for gap in (0, 1):
        h, o = ngrams.runs(hashed, offsets, 2, gap)
        value.append(h)
        own.append(o)
    place = np.concatenate(value) % _U((1 << BITS) - 1) + _U(1)
    both = np.unique((np.concatenate(own).astype(_U) << _U(BITS)) | place)
    return (both & _U((1 << BITS) - 1)).astype(np.int64), np.searchsorted(
        both >> _U(BITS), np.arange(len(texts) + 1, dtype=_U)).astype(np.int64)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass over ``(features, label)`` rows, changing z and n in place."""
    for at, label in rows:
        w = weights(z[at], n[at])
        g = float(sigmoid(w.sum())) - label
        more = n[at] + g * g
        z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
        n[at] = more


class Model:
    def __init__(self, at: np.ndarray, weight: np.ndarray, bias: float):
        self.at, self.weight, self.bias = at, weight, bias

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.at] = self.weight
        return out


def labelled_sample(labels: DataFrame, max_rows: int, seed: int) -> DataFrame:
    """``(_id, _label)`` of at most ``max_rows`` labelled ids, the first by hash."""
    one = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max("toxic").cast("int").alias("_label"))
    return one.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(max_rows)


def _learner(epochs: int):
    """Goes over the sample ``epochs`` times, in an order hashed from ids and epoch; yields the weights that aren't 0."""
    def run(batches):
        ids, label, at = [], [], []
        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            label += batch.column(1).to_pylist()
            lists = batch.column(2)
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            at += np.split(flat, (ends - ends[0])[1:-1]) if len(ends) > 1 else []
        if not ids or not 0 < sum(label) < len(label):
            return
        z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        bias = np.log(sum(label) / (len(label) - sum(label)))  # start at the labels' log odds
        z[0], n[0] = -bias * ((BETA + 1) / ALPHA + L2) - np.sign(bias) * L1, 1.0
        number = np.concatenate(ids).astype(np.int64).view(_U)
        rows = [(np.concatenate([[0], a]).astype(np.int64), y) for a, y in zip(at, label)]
        for epoch in range(epochs):
            ftrl([rows[i] for i in np.lexsort((number, ngrams.mix(number + _U(epoch + 1))))], z, n)
        w = weights(z, n)
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(w[used])], names=["at", "w"])

    return run


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_rows: int = 20_000,
          epochs: int = 6, seed: int = 3) -> Model:
    """Fit on ``labels(doc_id, toxic)`` (callers leave out what is held out)."""
    bounded_batches(docs.sparkSession)
    ids = F.broadcast(labelled_sample(labels, max_rows, seed))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(ids, "_id")
    # of rows that share an id the least text is learned: max_rows bounds rows as well as ids
    rows = rows.groupBy("_id", "_label").agg(F.min("_text").alias("_text"))

    def featured(batches):
        for part, texts in blocks(batches, "_text"):
            at, start = features(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(
                pa.array(start.astype(np.int32)), pa.array(at.astype(np.int32)))], names=["id", "label", "at"])

    rows = rows.select("_id", "_label", "_text").mapInArrow(featured, "id bigint, label int, at array<int>")
    rows = cut_lineage(rows)
    seen = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if seen[1] == 0 or seen[1] == seen[0]:
        share = seen[1] / seen[0] if seen[0] else 0.0
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    # the documented bound: at most max_rows rows, by one task
    found = rows.repartition(1).mapInArrow(_learner(epochs), "at bigint, w double").toPandas()
    at, w = found["at"].to_numpy(np.int64), found["w"].to_numpy()
    return Model(at[at != 0], w[at != 0].astype(np.float32), float(w[at == 0].sum()))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``keep`` columns, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ready: dict[str, np.ndarray] = {}

    def run(texts: list[str]) -> dict[str, pa.Array]:
        if "w" not in ready:
            ready["w"] = shared.value.dense()
        at, start = features(texts)
        value = np.concatenate([[0.0], np.cumsum(ready["w"][at], dtype=np.float64)])
        p = sigmoid(value[start[1:]] - value[start[:-1]] + shared.value.bias)
        return {"score": pa.array(p, pa.float64()), "predicted": pa.array((p >= threshold).astype(np.int32))}

    return map_texts(docs, keep, text, run, "score double, predicted int")
