"""Filters that Spark adds or pushes down don't make a text's words, terms or cleaning a second time."""

from pyspark.sql import functions as F

from wellspring.functions import text as T
from wellspring.operators import topics
from wellspring.operators.cleaning import clean_table
from wellspring.operators.sentiment import contextual_compound


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _docs(spark):
    rows = [(1, "reddit", "one **two** three four"), (2, "reddit", "one two three four"), (3, "glassdoor", "Pros: five six seven eight"),
            (4, None, "a b"), (5, "reddit", None), (6, "reddit", ""), (7, "other", "nine ten **x** twelve")]
    return spark.createDataFrame(rows, "id long, source string, text string")


def test_a_text_is_cleaned_once(spark):
    out = _docs(spark).transform(clean_table(min_words=4))
    assert _plan(out).count(T.CLEAN_EMAIL_PATTERN) == 1
    assert {r.id: r.text for r in out.collect()} == {
        1: "one two three four", 3: "five six seven eight", 7: "nine ten **x** twelve"}


def test_terms_are_made_once_and_large_vocabularies_are_joined(spark, monkeypatch):
    plans, cut = [], topics.cut_lineage
    monkeypatch.setattr(topics, "cut_lineage", lambda df: plans.append(_plan(df)) or cut(df))
    docs = spark.createDataFrame([(str(i), i % 2, f"apple pear w{i % 3} apple") for i in range(12)] + [("x", 0, ""), ("y", 1, None)],
                                 "id string, cluster_id int, text string")
    def keywords():
        return sorted((r.cluster_id, r.rank, r.term, round(r.weight, 9)) for r in topics.cluster_keywords(docs, min_df=1, max_df=1.0).collect())
    few = keywords()
    assert plans[0].count("regexp_extract_all") == 1
    monkeypatch.setattr(topics, "BROADCAST_TERMS", 0)
    assert keywords() == few and few[0][2] == "apple"


def test_words_in_context_are_split_once(spark):
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "word string, valence double")
    docs = spark.createDataFrame([(1, "good good"), (2, "bad"), (3, ""), (4, None)], "id long, text string")
    out = docs.transform(contextual_compound(lexicon, boosters={}, negations=["not"]))
    assert _plan(out).count("regexp_extract_all") == 1
    got = {r.id: r.compound for r in out.select("id", F.round("compound", 6).alias("compound")).collect()}
    assert got == {1: round(4 / 31 ** 0.5, 6), 2: round(-2 / 19 ** 0.5, 6), 3: 0.0, 4: 0.0}
