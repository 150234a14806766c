"""Language ID by language-bitmask filters of character n-grams.

Training: from documents with a known language, up to ``per_lang`` of each by hash
order (the documented bound of the fitted sample), the counts of n-grams of 1 to
``MAX_N`` letters are summed in Spark by language. An n-gram belongs to a language
when its rate there is at least ``MIN_RATE`` and ``MIN_SHARE`` of its highest rate in
any language. All languages' n-grams go into one bit-sliced Bloom filter: ``SLOTS``
slots of a bitmask of languages, ``HASHES`` slots for each n-gram. The AND of an
n-gram's slots are all languages that hold it (and a few false ones).

Prediction: per language, the n-grams of the text whose mask has its bit are counted
and corrected for the filter's false positives, (hits - n * f) / (1 - f) where f is the
share of set bits of that language to the power ``HASHES``; the highest corrected count
wins (ties: the first language by name). ``score`` is that count over the number of
n-grams, 0 to 1: how much of the text the language explains. Training and prediction
read whole texts, in Arrow blocks with numpy.

Defined results: a text that is NULL or has no letters is ``und`` with score 0, and so
is everything if no language is known; up to 64 languages, else an error; documents
without id or language don't train (an id that is NULL counts as not held out).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm import ngrams
from wellspring.llm.common import blocks, bounded_batches, map_texts

MAX_N = 4
MIN_RATE = 2e-5
MIN_SHARE = 0.2
SLOTS = 1 << 20
HASHES = 2

_U = np.uint64


def letter_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the lower-cased texts' words, edges marked, and their texts' numbers."""
    points, starts = ngrams.code_points([t.lower() for t in texts])
    letter = ngrams._table("alpha")[points]
    own = np.searchsorted(starts, np.arange(len(points)), side="right") - 1
    # letters keep their code; all else is the edge 32, and of a run of edges only the first stays
    code = np.where(letter, points, 32).astype(_U)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code, own = code[keep], own[keep]
    is_letter = code != _U(32)
    before = np.ones(len(code), bool)
    before[1:] = ~is_letter[:-1]
    found, texts_of = [], []
    value = ngrams.mix(code + _U(977))
    # a gram's hash goes on from the one that is a letter shorter; one at a word's start is another
    h = value + before.astype(_U) * _U(0xD6E8FEB86659FD93)
    ok = is_letter.copy()
    for n in range(1, MAX_N + 1):
        count = len(code) - n + 1
        if count <= 0:
            break
        if n > 1:
            with np.errstate(over="ignore"):
                h = ngrams.mix(h[:count] * _U(3) + value[n - 1:])
            ok = ok[:count] & (own[:count] == own[n - 1:])
            if n > 2:  # inside, letters only; the last may be the word's end
                ok &= is_letter[n - 2:n - 2 + count]
        found.append(h[ok])
        texts_of.append(own[:count][ok])
    if not found:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(texts_of)


def sample_ids(docs: DataFrame, doc_id: str, lang: str, per_lang: int, seed: int) -> DataFrame:
    """``(doc_id, lang)`` of at most ``per_lang`` documents of each language, the first by hash.
    An id on many rows counts once for each of its languages."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
    known = known.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"))
    # hashes under a bound that leaves a language about 1.5 x per_lang rows: what is ranked doesn't grow with it
    sizes = known.groupBy("_lang").agg(F.approx_count_distinct("_id").alias("_n"))  # at most 64 rows, see train()
    spot = F.xxhash64(F.lit(seed), "_id")
    part = F.shiftrightunsigned(spot, 11).cast("double") / float(1 << 53)
    known = known.join(F.broadcast(sizes), "_lang").filter(part * F.col("_n") < 1.5 * per_lang + 100)
    known = known.dropDuplicates(["_id", "_lang"])
    order = Window.partitionBy("_lang").orderBy(part, "_id")
    return known.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_lang).drop("_rank", "_n")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in blocks(batches, "_text"):
        langs = np.array(part.column(part.schema.get_field_index("_lang")).to_pylist(), dtype=object)
        h, own = letter_grams(texts)
        for name in sorted(set(langs)):
            gram, n = np.unique(h[langs[own] == name], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)),
                                              pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


class Model:
    """Languages, their slots and false-positive rates."""

    def __init__(self, langs: list[str], grams: np.ndarray, masks: np.ndarray):
        self.langs = langs
        self.slots = np.zeros(SLOTS, _U)
        for at in self.places(grams):
            np.bitwise_or.at(self.slots, at, masks)
        bits = [((self.slots >> _U(i)) & _U(1)).mean() for i in range(len(langs))]
        self.false = np.array(bits, float) ** HASHES

    @staticmethod
    def places(grams: np.ndarray) -> list[np.ndarray]:
        h = ngrams.mix(grams + _U(4242))
        return [((h >> _U(20 * j)) & _U(SLOTS - 1)).astype(np.int64) for j in range(HASHES)]

    def masks(self, grams: np.ndarray) -> np.ndarray:
        a, *rest = (self.slots[at] for at in self.places(grams))
        for b in rest:
            a = a & b
        return a

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        grams, own = letter_grams(texts)
        total = np.bincount(own, minlength=len(texts)).astype(float)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        mask = self.masks(grams)
        hits = np.stack([np.bincount(own, weights=((mask >> _U(i)) & _U(1)).astype(float), minlength=len(texts))
                         for i in range(len(self.langs))], axis=1)
        fixed = (hits - total[:, None] * self.false) / np.maximum(1 - self.false, 1e-9)
        best = fixed.argmax(axis=1)
        score = np.clip(fixed[np.arange(len(texts)), best] / np.maximum(total, 1), 0, 1)
        return [self.langs[b] if n else "und" for b, n in zip(best, total)], np.where(total > 0, score, 0.0)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 4000,
          seed: int = 5) -> Model:
    """Fit on the documents given (callers leave out what is held out). The ids of the sample, at
    most ``per_lang`` x 64, are broadcast; the n-gram table comes back already filtered."""
    spark = docs.sparkSession
    names = sorted(r[0] for r in docs.filter(F.col(lang).isNotNull()).select(lang).distinct().limit(65).collect())
    if len(names) > 64:
        raise ValueError("more than 64 languages: one mask has 64 bits")
    if not names:
        return Model([], np.zeros(0, _U), np.zeros(0, _U))
    bounded_batches(spark)
    ids = sample_ids(docs, doc_id, lang, per_lang, seed)
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    # of rows that share id and language the least text is learned: the sample's size bounds the rows
    texts = texts.join(F.broadcast(ids), ["_id", "_lang"]).groupBy("_id", "_lang").agg(F.min("_text").alias("_text"))
    counts = texts.select("_lang", "_text").mapInArrow(_counted, "lang string, gram bigint, n bigint")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter("n >= 3")
    rate = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    counts = counts.join(F.broadcast(rate), "lang").withColumn("rate", F.col("n") / F.col("all"))
    counts = counts.filter(F.col("rate") >= MIN_RATE)  # at most 1 / MIN_RATE n-grams of a language and length pass
    kept = counts.toPandas()
    top = kept.groupby("gram")["rate"].transform("max")
    kept = kept[kept["rate"] >= MIN_SHARE * top]
    bit = {name: i for i, name in enumerate(names)}
    masks = (np.ones(len(kept), _U) << kept["lang"].map(bit).to_numpy().astype(_U))
    return Model(names, kept["gram"].to_numpy(np.int64).view(_U), masks)


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of every row."""
    bounded_batches(docs.sparkSession)
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> dict[str, pa.Array]:
        langs, score = shared.value.predict(texts)
        return {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(score, pa.float64())}

    return map_texts(docs, keep, text, run, "lang_pred string, score double")
