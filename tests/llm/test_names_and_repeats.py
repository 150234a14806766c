"""Extra columns that bear helper names come back as they were; an id on a third of all rows stays one example."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.llm import exact_dedup, language_id, line_dedup, near_dedup, toxicity

HELPERS = ["_k", "_may", "_page", "_bits", "_lost", "_key", "_text", "_h", "_lines", "_uid", "uid", "_wins", "_kept", "_all", "col_0",
           "col_1", "places", "deleted_", "_salt"]
LINE = " ".join(f"word{i}" for i in range(30))


@pytest.fixture(scope="module")
def named(spark):
    rows = [(1, f"{LINE}\none more"), (2, f"{LINE}\none  more"), (3, f"{LINE}\nanother end of it"), (4, "alone"), (None, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select(*[F.concat(F.lit(f"{h}:"), F.coalesce("doc_id", F.lit(0))).alias(h) for h in HELPERS], "doc_id", "text")


def test_extra_columns_with_helper_names(named):
    def rows(df):
        return {r.doc_id: tuple(r[h] for h in HELPERS) for r in df.collect()}

    truth = rows(named)
    for df in (exact_dedup.dedup(named), line_dedup.dedup_lines(named), near_dedup.keep_one(named)):
        assert df.columns[:len(named.columns)] == named.columns
        got = rows(df)
        assert got and all(truth[i] == v for i, v in got.items())
    assert line_dedup.dedup_lines(named).count() == 6


def many(spark):
    """One id on a third of all rows, with two texts and two languages."""
    rows = [(7, "the hot text of an id" if i % 2 else "le texte", "en" if i % 2 else "fr") for i in range(300)]
    rows += [(100 + i, f"some english words {i}" if i % 2 else f"quelques mots {i}", "en" if i % 2 else "fr") for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_sample_has_an_id_once(spark, monkeypatch):
    docs = many(spark)
    ids = language_id.sample_ids(docs, "doc_id", "lang", 400, 5).collect()
    assert len(ids) == len({(r._id, r._lang) for r in ids}) == 602
    small = language_id.sample_ids(docs, "doc_id", "lang", 20, 5).groupBy("_lang").count().collect()
    assert {r._lang: r["count"] for r in small} == {"en": 20, "fr": 20}
    once = docs.dropDuplicates(["doc_id", "lang"])
    a, b = language_id.train(docs), language_id.train(once)
    assert a.langs == b.langs and np.array_equal(a.slots, b.slots)
    assert a.predict(["words", "mots"])[0] == ["en", "fr"]


def test_toxicity_learns_an_id_once(spark):
    docs = many(spark).select("doc_id", "text")
    labels = spark.createDataFrame([(7, 1)] * 50 + [(100 + i, i % 2) for i in range(600)], "doc_id long, toxic int")
    least = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    a, b = toxicity.train(docs, labels), toxicity.train(least, labels)
    assert np.array_equal(a.at, b.at) and np.array_equal(a.weight, b.weight) and a.bias == b.bias
    assert toxicity.train(docs, labels, max_rows=1).at.size == 0  # one row, whatever the id: one label only
