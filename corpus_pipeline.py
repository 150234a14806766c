"""The corpus pipeline: documents -> stages, each written as Parquet and read again for the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.llm import exact_dedup, language_id, mixing, near_dedup, queries, sentencepiece_codec
from wellspring.llm.common import held_out
from wellspring.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a known language that explains enough of their text."""
    model = language_id.train(docs.filter(~held_out(F.col("doc_id"))))
    judged = language_id.identify(docs, model, list(COLUMNS))
    keep = (F.col("lang_pred") != "und") & (F.col("score") >= queries.MIN_LANGUAGE_SCORE)
    return judged.filter(keep).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text that is the same without white space."""
    return exact_dedup.dedup(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return near_dedup.keep_one(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicates documents to the sources' target weights and shuffles them."""
    return mixing.replicate(docs.select(*COLUMNS)).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text, and checks that decoding gives it back."""
    return sentencepiece_codec.round_trip(docs, f"{queries.TOKENIZERS}/{queries.PIECES}")


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix),
          ("sentencepiece", pieces)]

#: Trained models, similarity classes and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, in a new folder below the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    base = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
