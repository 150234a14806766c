"""Cleaning a table, and outcomes of activities, by hand."""

import unicodedata

from wellspring.operators.cleaning import clean_table
from wellspring.operators.feedback import activity_outcomes, rating_changes
from wellspring.sources import views as V
from wellspring.plans import registry

TEN = "one two three four five six seven eight nine ten"


def test_copies_are_found_among_cleaned_texts(spark):
    rows = [(1, TEN, "reddit"), (2, "**one** two three four five six   seven eight nine ten", "reddit"),
            (3, "**one** two three four five six seven eight nine ten", "glassdoor"),
            (4, TEN + " https://x.example/a", "other"), (5, "too short", "reddit"), (6, None, "reddit"), (7, "", None),
            (8, "ﬁrst two three four five six seven eight nine ten", None), (0, "\n" + TEN + " ", None)]
    df = spark.createDataFrame(rows, "id int, text string, source string")
    got = {r.id: r.text for r in df.transform(clean_table()).collect()}
    assert set(got) == {0, 3, 8} and got[0] == TEN and got[8].startswith("first two")
    assert got[3].startswith("**one**")  # forum rules are not for reviews
    assert {r.id for r in df.drop("source").transform(clean_table()).collect()} == {0, 2, 8}  # 2 and 3 are equal then
    assert df.limit(0).transform(clean_table()).count() == 0
    assert {r.id for r in df.transform(clean_table(min_words=2)).collect()} == {0, 3, 8}  # clean texts have three words


def test_clean_table_query_against_plain_python(spark):
    data = "/root/testdata/sf0.001"
    out = registry.queries()["clean_table"](spark, data).collect()
    texts = {r.id: r.text for r in V.corpus(spark, data).collect()}
    assert len({r.text_md5 for r in out}) == len(out)
    words = {i: len(unicodedata.normalize("NFKD", t or "").split()) for i, t in texts.items()}
    kept = {r.id for r in out}
    assert all(words[i] >= 10 for i in kept)
    plain = {i for i, t in texts.items() if words[i] >= 10 and t and not any(c in t for c in "*_~#[]&<>@-=:★/|")}
    first = {}
    for i in sorted(plain, key=int):
        first.setdefault(" ".join(unicodedata.normalize("NFKD", texts[i]).split()), i)
    assert plain and set(first.values()) <= kept


def test_outcomes(spark):
    cols = "activity_id string, helpful boolean, " + ", ".join(
        f"{n}_{w} int" for n in ("energy", "tension", "clarity") for w in ("before", "after"))
    df = spark.createDataFrame([("a", True, 2, 4, 5, 1, 3, 3), ("a", False, 2, 1, 1, 2, None, 3), ("b", None, 1, 1, 1, 1, 1, 1)], cols)
    r = df.transform(rating_changes()).collect()
    assert (r[0].energy_change, r[0].tension_change, r[0].clarity_change) == (2, 4, 0)
    assert (r[1].energy_change, r[1].tension_change, r[1].clarity_change) == (-1, -1, None)
    out = {x.activity_id: x for x in df.transform(activity_outcomes()).collect()}
    assert (out["a"].n_feedback, out["a"].helpful_rate, out["a"].avg_energy_change, out["a"].avg_clarity_change) == (2, 0.5, 0.5, 0.0)
    assert out["b"].helpful_rate is None and out["b"].n_feedback == 1
