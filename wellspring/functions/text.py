"""Text column expressions.

All helpers return ``Column`` expressions that run inside whole-stage codegen
(``regexp_replace``, ``translate``, higher-order functions). The only Python
step is Unicode NFKD (Spark SQL has no normalisation function), done as an
Arrow-batched ``pandas_udf``.

Regex note: Java's ``\\s \\w \\d \\b`` are ASCII by default while the
behaviour being reproduced uses Unicode classes, so patterns that rely on
them carry the ``(?U)`` flag.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .vocab import DELETED_VALUES

# --- fixed values: patterns -------------------------------------------------
URL_ONLY_PATTERN = r"(?U)^\s*(https?://\S+\s*)+$"
INLINE_URL_PATTERN = r"(?U)https?://\S+"
CLEAN_URL_PATTERN = r"(?U)https?://[^\s]+"
CLEAN_EMAIL_PATTERN = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
REDACT_URL_PATTERN = r"(?U)https?://\S+|www\.\S+"
REDACT_EMAIL_PATTERN = r"(?U)\b\S+@\S+\b"
REDACT_PHONE_PATTERN = r"(?U)[\+\(]?[\d][\d\s\-\(\)\.]{8,}[\d]"
REDACT_URL, REDACT_EMAIL, REDACT_PHONE = "[URL]", "[EMAIL]", "[PHONE]"
# sequential markdown rules: (pattern, replacement), applied in this order
MARKDOWN_RULES = [
    (r"\*\*(.+?)\*\*", "$1"),
    (r"\*(.+?)\*", "$1"),
    (r"~~(.+?)~~", "$1"),
    (r"&gt;", ">"),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"\[(.+?)\]\(.+?\)", "$1"),
    (r"(?U)#{1,6}\s*", ""),
]
# review export artefacts, applied in this order
REVIEW_ARTIFACT_RULES = [
    (r"(?iU)^(Pros|Cons|Advice to management)\s*:\s*", ""),
    ("&amp;", "&"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"),
    ("&quot;", '"'), ("&#39;", "'"),
    (r"(?iU)\d+(\.\d+)?\s*(out of|/)\s*\d+\s*stars?", ""),
    (r"[-=_]{4,}", " "),
    (r"(?iU)\b(Former|Current)\s+Employee\b", ""),
]
# typographic characters replaced after NFKD
UNICODE_REPLACEMENTS = [
    ("\u2018", "'"), ("\u2019", "'"),
    ("\u201c", '"'), ("\u201d", '"'),
    ("\u2013", "-"), ("\u2014", "-"),
    ("\u2026", "..."),
    ("\u00a0", " "),
]
# Unicode "word" characters (letters, digits, underscore) for tokenising;
# written as explicit classes so Spark and RE2 (the SQL oracle) agree.
WORD_CLASS = r"[\p{L}\p{N}_]"
TOKEN_PATTERN = WORD_CLASS + "{2,}"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_all(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def is_blank(col) -> Column:
    return _c(col).rlike(r"(?U)^\s*$")


def clean_channel_name(col) -> Column:
    """Drop a leading ``r/``/``R/``, then strip and lowercase (PRJ4)."""
    return F.lower(strip_all(F.regexp_replace(_c(col).cast("string"), r"^[rR]/", "")))


def is_placeholder(col) -> Column:
    """Deleted/removed/empty placeholder text (FIL2)."""
    return F.lower(strip_all(_c(col))).isin(DELETED_VALUES)


def is_url_only(col) -> Column:
    """URL-only text (FIL3). Avoids a backtracking-prone pattern: remove the
    URLs and test that only whitespace is left, with at least one URL."""
    c = _c(col)
    return c.rlike(INLINE_URL_PATTERN) & is_blank(F.regexp_replace(c, INLINE_URL_PATTERN, ""))


def length_without_urls(col) -> Column:
    return F.length(strip_all(F.regexp_replace(_c(col), INLINE_URL_PATTERN, "")))


def word_count(col) -> Column:
    """``len(text.split())``: number of whitespace-separated tokens; 0 for ''."""
    return F.size(F.filter(F.split(_c(col), r"(?U)\s+"), lambda t: t != ""))


def collapse_whitespace(col) -> Column:
    """TXT6: newlines and whitespace runs to one space, then strip."""
    c = F.regexp_replace(_c(col), r"\n+", " ")
    c = F.regexp_replace(c, r"(?U)\s+", " ")
    return strip_all(c)


def remove_urls(col) -> Column:
    return F.regexp_replace(_c(col), CLEAN_URL_PATTERN, "")


def remove_emails(col) -> Column:
    return F.regexp_replace(_c(col), CLEAN_EMAIL_PATTERN, "")


def _apply_rules(c: Column, rules) -> Column:
    for pat, rep in rules:
        c = F.regexp_replace(c, pat, rep)
    return c


def strip_markdown(col) -> Column:
    """TXT4: bold, italic, strike, three entities, links, headers - in order."""
    return _apply_rules(_c(col), MARKDOWN_RULES)


def strip_review_artifacts(col) -> Column:
    """TXT5: leading label, six entities, star ratings, dividers, status."""
    return _apply_rules(_c(col), REVIEW_ARTIFACT_RULES)


@F.pandas_udf(StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """Unicode NFKD, vectorised over an Arrow batch."""
    return s.map(lambda t: unicodedata.normalize("NFKD", t) if isinstance(t, str) else t)


def normalize_unicode(col) -> Column:
    """TXT1: NFKD then the typographic replacements."""
    c = nfkd(_c(col))
    singles = [(a, b) for a, b in UNICODE_REPLACEMENTS if len(b) == 1]
    c = F.translate(c, "".join(a for a, _ in singles), "".join(b for _, b in singles))
    for a, b in UNICODE_REPLACEMENTS:
        if len(b) != 1:
            c = F.replace(c, F.lit(a), F.lit(b))
    return c


def clean_text(col, source_col=None, min_words: int = 3) -> Column:
    """TXT7: source-aware cleaning; '' when fewer than ``min_words`` remain.

    Each step that is used more than once is bound by a lambda, so a text is normalised and cleaned once."""
    raw = _c(col)

    def cleaned(c: Column) -> Column:
        c = remove_emails(remove_urls(c))
        if source_col is not None:
            src = _c(source_col)
            c = F.transform(F.array(c), lambda t: F.when(src == "reddit", strip_markdown(t))
                            .when(src == "glassdoor", strip_review_artifacts(t)).otherwise(t))[0]
        return F.transform(F.array(collapse_whitespace(c)),
                           lambda t: F.when(word_count(t) < min_words, F.lit("")).otherwise(t))[0]
    out = F.transform(F.array(normalize_unicode(raw)), cleaned)[0]
    return F.when(raw.isNull() | (raw == ""), F.lit("")).otherwise(out)


def redact(col) -> Column:
    """TXT9: URL -> [URL], e-mail -> [EMAIL], phone -> [PHONE], in that order.
    Blank or NULL text is returned unchanged."""
    c = _c(col)
    r = F.regexp_replace(c, REDACT_URL_PATTERN, REDACT_URL)
    # the pattern backtracks over long unbroken tokens, so only texts that can match are searched
    r = F.when(F.contains(r, F.lit("@")), F.regexp_replace(r, REDACT_EMAIL_PATTERN, REDACT_EMAIL)).otherwise(r)
    r = F.regexp_replace(r, REDACT_PHONE_PATTERN, REDACT_PHONE)
    return F.when(c.isNull() | is_blank(c), c).otherwise(r)


def classifier_clean(col) -> Column:
    """TXT10: collapse whitespace, keep word chars, whitespace and ``.,!?-``."""
    c = F.coalesce(_c(col).cast("string"), F.lit(""))
    c = F.regexp_replace(c, r"(?U)\s+", " ")
    c = F.regexp_replace(c, r"(?U)[^\w\s.,!?-]", "")
    return strip_all(c)


def tokens(col, lowercase: bool = True) -> Column:
    """TXT14: Unicode word tokens of two or more characters."""
    c = _c(col)
    if lowercase:
        c = F.lower(c)
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({TOKEN_PATTERN})"), 1)


def remove_stop_words(tok: Column, stop_words) -> Column:
    stops = F.array(*[F.lit(w) for w in sorted(set(stop_words))])
    return F.filter(tok, lambda t: ~F.array_contains(stops, t))


def with_bigrams(tok: Column) -> Column:
    """Unigrams followed by adjacent bigrams (joined by one space).

    ``zip_with`` of two slices evaluates the token array once per row; a
    lambda that indexes into ``tok`` would re-derive it per element."""
    n = F.size(tok)
    pairs = F.zip_with(F.slice(tok, 1, F.greatest(n - 1, F.lit(0))),
                       F.slice(tok, F.lit(2), F.greatest(n - 1, F.lit(0))),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(tok, F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>")))


def keyword_hits(col, keywords, lowered: bool = False) -> Column:
    """Distinct keywords of ``keywords`` that occur as substrings of lower(text).
    Pass an already lowercased column with ``lowered=True`` (a column
    reference) so the lambda does not lowercase the text per keyword."""
    low = _c(col) if lowered else F.lower(F.coalesce(_c(col), F.lit("")))
    found = F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in keywords])
    return F.array_compact(found)


def keyword_count(col, keywords, lowered: bool = False) -> Column:
    """TXT11: number of distinct keywords present as substrings."""
    low = _c(col) if lowered else F.lower(F.coalesce(_c(col), F.lit("")))
    return sum((F.contains(low, F.lit(k)).cast("int") for k in keywords), F.lit(0))


def snippet(col, n: int = 300) -> Column:
    """PRJ24: first ``n`` characters."""
    return F.substring(F.coalesce(_c(col), F.lit("")), 1, n)
