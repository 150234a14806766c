"""Text functions against Python re-implementations on hand-made cases."""
import re
import unicodedata

from pyspark.sql import functions as F

from wellspring.functions import text as T
from wellspring.operators.filters import filter_text_quality

CASES = [None, "", "nan", "[deleted]", " [Removed] ", "http://x.io/a", "http://a.b https://c.d",
         "see http://x.io and more words here to pass", "a" * 29, "a" * 30,
         "smart “quotes” and ‘single’ — dash… nbsp here ok",
         "ﬁne ligature words here", "emoji \U0001F600 text goes here",
         "**bold** and *it* and ~~gone~~ [link](http://x) ### Head &amp;gt; done",
         "Pros: good pay 4.5 out of 5 stars ----- Former Employee said fine",
         "mail me at joe.doe@example.com or +1 (555) 123-4567 now www.site.org/x"]


def _py_clean(text, source):
    if text is None or not text:
        return ""
    t = unicodedata.normalize("NFKD", text)
    for a, b in T.UNICODE_REPLACEMENTS:
        t = t.replace(a, b)
    t = re.sub(r"https?://[^\s]+", "", t)
    t = re.sub(T.CLEAN_EMAIL_PATTERN, "", t)
    if source == "reddit":
        for p, r in T.MARKDOWN_RULES:
            t = re.sub(p.replace("(?U)", ""), r.replace("$1", r"\1"), t)
    elif source == "glassdoor":
        for p, r in T.REVIEW_ARTIFACT_RULES:
            flags = re.IGNORECASE if "(?i" in p else 0
            t = re.sub(re.sub(r"^\(\?[iU]+\)", "", p), r, t, flags=flags)
    t = re.sub(r"\n+", " ", t)
    t = re.sub(r"\s+", " ", t).strip()
    return "" if len(t.split()) < 3 else t


def test_clean_text_matches_python(spark):
    rows = [(i, c, s) for i, c in enumerate(CASES) for s in ("reddit", "glassdoor", "other")]
    df = spark.createDataFrame(rows, "i int, text string, source string")
    got = {(r.i, r.source): r.c for r in df.select("i", "source", T.clean_text("text", "source").alias("c")).collect()}
    for i, c, s in rows:
        assert got[(i, s)] == _py_clean(c, s), (c, s)


def test_redaction_and_word_count(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "text string")
    out = df.select("text", T.redact("text").alias("r"), T.word_count(F.coalesce("text", F.lit(""))).alias("n")).collect()
    for r in out:
        assert r.n == len((r.text or "").split())
    red = [r.r for r in out if r.text and "joe.doe" in r.text][0]
    assert "[EMAIL]" in red and "[PHONE]" in red and "[URL]" in red and "example.com" not in red


def test_quality_filter(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "i int, text string")
    kept = {r.i for r in df.transform(filter_text_quality(30)).collect()}
    assert 9 in kept and 8 not in kept and 5 not in kept and 6 not in kept and 0 not in kept
