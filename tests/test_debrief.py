"""Sentiment in context by hand, and debrief signals."""

import math

import pytest

from wellspring.functions.vocab import CHECKIN_BURNOUT_THEMES
from wellspring.operators.debrief import debrief_signals, domain_strengths
from wellspring.operators import sentiment
from wellspring.operators.recommend import categories_of
from wellspring.operators.sentiment import add_sentiment, contextual_compound
from pyspark.sql import functions as F


def test_negations_and_boosters(spark):
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "word string, valence double")
    cases = {
        "good": 1.9, "very good": 1.9 + 0.293, "Not good.": 1.9 * -0.74, "not very good": (1.9 + 0.293) * -0.74,
        "very bad": -(2.5 + 0.293), "slightly bad": -(2.5 - 0.293), "don't feel good": 1.9 * -0.74,
        "very a good": 1.9 + 0.293 * 0.95, "very a b good": 1.9 + 0.293 * 0.9, "very a b c good": 1.9,
        "not a b c good": 1.9, "never not good": 1.9 * 0.74 * 0.74, "good not": 1.9,
        "good, bad; very good": 1.9 + -2.5 + 1.9 + 0.293, "": 0.0, "nothing here": 0.0,
    }
    rows = [(str(i), text) for i, text in enumerate(cases)] + [("null", None)]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r.text: r.compound for r in df.transform(contextual_compound(lexicon)).collect()}
    for text, s in {**cases, None: 0.0}.items():
        assert abs(got[text] - s / math.sqrt(s * s + 15)) < 1e-9, text
    out = df.transform(add_sentiment("context", lexicon)).filter("text = 'not very good'").first()
    assert (out.sentiment_label, out.sentiment_source) == ("negative", "context")


def test_a_large_lexicon_gives_the_same(spark, monkeypatch):
    lexicon = spark.createDataFrame([("good", 1.9), ("BAD", -2.5)], "word string, valence double")
    df = spark.createDataFrame([("a", "not very good, bad bad"), ("b", "so bad"), ("c", "x")], "id string, text string")
    small = sorted((r.id, r.compound) for r in df.transform(contextual_compound(lexicon)).collect())
    monkeypatch.setattr(sentiment, "BROADCAST_WORDS", 1)
    assert sorted((r.id, r.compound) for r in df.transform(contextual_compound(lexicon)).collect()) == small
    with pytest.raises(ValueError):
        df.transform(contextual_compound(lexicon.union(spark.createDataFrame([("bad", 1.0)], lexicon.schema))))


def test_debrief_signals(spark):
    rows = [(1, "Totally EXHAUSTED and drained. Can't focus. Counting down until I quit."), (2, ""), (3, None), (4, " \n"),
            (5, "fine")]
    out = {r.id: r for r in spark.createDataFrame(rows, "id int, text string").transform(debrief_signals()).collect()}
    assert [out[i].has_debrief for i in range(1, 6)] == [True, False, False, False, True]
    assert out[2].domain_signals == out[3].domain_signals == out[4].domain_signals == {}
    assert out[1].word_count == 11 and out[3].word_count == 0
    assert set(out[1].domain_signals) == set(out[5].domain_signals) == set(CHECKIN_BURNOUT_THEMES)
    found = {d: list(s.keywords_found) for d, s in out[1].domain_signals.items() if s["count"]}
    assert found == {"exhaustion": ["exhausted", "drained"], "cognitive_impairment": ["can't focus"],
                     "disengagement": ["quit", "counting down"]}


def test_domain_strengths_and_what_they_boost(spark):
    rows = [(1, "burned out, in pain, overtime", "negative"), (2, "burned out", "neutral"), (3, "an unsafe place", "negative"),
            (4, "", "neutral"), (5, None, None), (6, "BURNOUT and fatigue", "positive")]
    df = spark.createDataFrame(rows, "id int, text string, sentiment_label string").transform(domain_strengths())
    out = {r.id: r for r in df.withColumn("boosted", F.sort_array(categories_of(F.col("domain_strengths")))).collect()}
    assert out[1].domain_strengths == {"exhaustion": 10.0, "cognitive_impairment": 6.5}
    assert out[1].themes_detected == ["burnout", "physical_demands", "workload"]
    assert out[1].boosted == ["body_sketch", "shift_debrief", "sound_reset"]
    assert out[2].domain_strengths == {"exhaustion": 5.0} and out[2].boosted == []
    assert out[3].domain_strengths == {"emotional_impairment": 6.5} and out[3].boosted == ["shift_debrief", "three_thing"]
    assert out[4].domain_strengths == out[5].domain_strengths == {} and out[6].domain_strengths == {"exhaustion": 10.0}
