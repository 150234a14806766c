"""Review and forum exports to clean records (SRC6-SRC8, PRJ8-PRJ18, FIL7-FIL9).

Each job is one narrow projection and one keep-first aggregation on a hash of fixed length, so long
texts are not compared with each other. "First" is the least ``order`` (columns that number the
export's rows); without any it is the least row, which does not depend on the partitioning.
"""

from __future__ import annotations

import logging
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import TARGET_CHANNELS, TARGET_COMPANIES, WORK_KEYWORDS
from .dedup import keep_first
from .filters import filter_channels_or_keywords, filter_min_length, filter_terms
from .merge import BASE_COLUMNS
from .normalize import (RATING_COLS, REVIEW_COLUMN_MAP, coerce_ratings, combine_review_text, find_col, hash_firm, infer_company,
                        parse_review_date, rename_lower, review_row_id, text_id, title_is_warehouse)

Op = Callable[[DataFrame], DataFrame]
log = logging.getLogger(__name__)

# --- fixed values: columns of posts, and texts that stand for deleted ones ----
POST_TEXT_COLUMNS = ["selftext", "body", "text", "title"]
TOPIC_TEXT_COLUMNS = ["body", "selftext", "text", "content", "post_text", "comment"]
CHANNEL_COLUMNS = ["subreddit", "sub", "subreddit_name"]
POST_DATE_COLUMNS = ["created_utc", "created", "date", "timestamp", "date_created"]
DELETED_POSTS = ["[deleted]", "[removed]", ".", ""]

#: Review columns besides the ratings, in order.
REVIEW_COLUMNS = ["id", "type", "source", "channel", "title", "text", "author", "created_utc", "score", "url",
                  "source_file", "firm_id", "location", "job_title", "current"]


def _string(df: DataFrame, name: str, default: str | None = "") -> Column:
    c = F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")
    return c if default is None else F.coalesce(c, F.lit(default))


def keep_first_by(key: Column, order: Sequence[str] = ()) -> Op:
    """The first row of each ``key``; ``order`` columns that the frame lacks don't count."""
    def op(df: DataFrame) -> DataFrame:
        by = [c for c in order if c in df.columns] or df.columns
        return df.withColumn("_key", key).transform(keep_first(["_key"], by)).drop("_key")
    return op


def review_records(source: str = "reviews", source_file: str = "", keep_firm: bool = False, keep_location: bool = False,
                   min_length: int = 30, salt: str = "", order: Sequence[str] = ()) -> Op:
    """A review export to records without personal data: column names by ``lower(trim)``; headline, pros
    and cons redacted by field and once more when joined; short texts dropped; ids from content; firm names
    hashed (``salt``), locations blanked unless kept; times and ratings parsed (NULL where they don't parse);
    one record an id. An export without headline, pros or cons gives no record."""
    def op(df: DataFrame) -> DataFrame:
        df = rename_lower(df, {})
        missing = {"headline", "pros", "cons"} - set(df.columns)
        if missing:
            log.warning("review export without %s: no records", sorted(missing))
            df = df.filter(F.lit(False))
        carried = [c for c in order if c in df.columns]
        firm = _string(df, "firm", None)
        # lambda variables hold each text once; the generator drops short texts without a filter that redacts anew
        parts = F.transform(F.array(*[_string(df, c) for c in ("headline", "pros", "cons")]), T.redact)
        df = df.withColumn("_parts", parts)
        headline, pros, cons = (F.col("_parts")[i] for i in range(3))
        whole = F.transform(F.array(combine_review_text(headline, pros, cons)), T.redact)
        df = df.select("*", F.explode(F.filter(whole, lambda t: F.length(t) >= min_length)).alias("_text"))
        df = coerce_ratings(df)
        fields = {
            "id": review_row_id(firm, _string(df, "date_review"), _string(df, "job_title"), headline, pros, cons),
            "type": F.lit("review"), "source": F.lit(source), "channel": F.lit(""), "title": headline,
            "text": F.col("_text"), "author": F.lit(""), "created_utc": parse_review_date(_string(df, "date_review", None)),
            "score": F.lit(None).cast("long"), "url": F.lit(""), "source_file": F.lit(source_file),
            "firm_id": hash_firm(firm, salt) if "firm" in df.columns else F.lit(""),
            "location": _string(df, "location") if keep_location else F.lit(""),
            "job_title": _string(df, "job_title"), "current": _string(df, "current"),
        }
        if keep_firm and "firm" in df.columns:
            fields["firm"] = firm
        out = df.select(*[c.alias(n) for n, c in fields.items()], *RATING_COLS,
                        *[F.col(c).alias(f"_order_{c}") for c in carried])
        out = out.transform(keep_first_by(F.col("id"), [f"_order_{c}" for c in carried]))
        return out.drop(*[f"_order_{c}" for c in carried])
    return op


def company_reviews(companies: Sequence[str] | None = TARGET_COMPANIES, min_length: int = 20, source: str = "company_reviews",
                    order: Sequence[str] = ()) -> Op:
    """SRC6: reviews of companies whose name contains one of ``companies`` (None: all), in the base review
    schema plus ``is_warehouse`` and what else the export has under its mapped name; one row a text.
    Rows without a company name go. Without a job title column ``is_warehouse`` is NULL."""
    def op(df: DataFrame) -> DataFrame:
        df = rename_lower(df, REVIEW_COLUMN_MAP)
        if companies and "company_name" in df.columns:
            df = df.transform(filter_terms(companies, "company_name"))
        parts = [_string(df, c) for c in ("summary_text", "pros_text", "cons_text")]
        df = df.withColumn("text", combine_review_text(*parts, pros_label="Pros: ", cons_label="Cons: ", sep=" "))
        df = df.transform(filter_min_length(min_length))
        title = "employee_job_title"
        made = {
            "review_id": text_id(F.col("text"), "co_"), "source": F.lit(source), "subreddit": F.lit(None).cast("string"),
            "is_warehouse": title_is_warehouse(F.col(title)) if title in df.columns else F.lit(None).cast("boolean"),
            "rating_date": parse_review_date(_string(df, "rating_date", None)),
        }
        ratings = [c for c in df.columns if c.startswith("rating_") and c != "rating_date"]
        made.update({c: F.col(c).cast("string").try_cast("double") for c in {*ratings, "rating_overall"} if c in df.columns})
        made.setdefault("rating_overall", F.lit(None).cast("double"))
        made.update({c: F.lit("Unknown") for c in (title, "employee_status", "company_name") if c not in df.columns})
        df = df.withColumns(made)
        out = df.transform(keep_first_by(F.sha2("text", 256), order))
        return out.select(*BASE_COLUMNS, *[c for c in out.columns if c not in BASE_COLUMNS])
    return op


def _posts(df: DataFrame, text: Column, channel: Column, source: str, order: Sequence[str]) -> DataFrame:
    """Posts in the base review schema: ids from texts, companies named in them."""
    date = find_col(df.columns, [c for name in df.columns for c in POST_DATE_COLUMNS if c == name.lower()])
    if date is None:
        when = F.lit(None).cast("timestamp")
    elif "utc" in date.lower():  # epoch seconds
        when = F.timestamp_seconds(F.col(f"`{date}`").cast("string").try_cast("double"))
    else:
        when = parse_review_date(F.col(f"`{date}`"))
    fields = {"review_id": text_id(text), "text": T.strip_all(text), "source": F.lit(source), "subreddit": channel,
              "employee_job_title": F.lit("Unknown"), "employee_status": F.lit("Unknown"), "company_name": infer_company(text),
              "rating_date": when, "rating_overall": F.lit(None).cast("double")}
    return df.select(*[fields[c].alias(c) for c in BASE_COLUMNS], *[c for c in order if c in df.columns])


def channel_posts(channel: str, min_length: int = 30, source: str = "forum", order: Sequence[str] = ()) -> Op:
    """SRC7: the posts of one sub-forum: title, ". " and body, or the one text that there is; deleted and
    short ones go. An export without any text column gives no rows."""
    def op(df: DataFrame) -> DataFrame:
        body, title = find_col(df.columns, POST_TEXT_COLUMNS), find_col(df.columns, ["title"])
        if body is None:
            log.warning("posts without a text column: no rows")
            return _posts(df.filter(F.lit(False)), F.lit(""), F.lit(channel), source, order)
        whole = _string(df, body)
        if title is not None and title != body:
            whole = F.concat(_string(df, title), F.lit(". "), whole)
        df = df.withColumn("_whole", whole).filter(~F.lower("_whole").isin(DELETED_POSTS))
        return _posts(df.transform(filter_min_length(min_length, "_whole")), F.col("_whole"), F.lit(channel), source, order)
    return op


def topic_posts(channels: Sequence[str] = TARGET_CHANNELS, keywords: Sequence[str] = WORK_KEYWORDS, min_length: int = 30,
                source: str = "forum", default_channel: str = "forum_topics", order: Sequence[str] = ()) -> Op:
    """SRC8, FIL9: posts of the ``channels`` or, if the export has no sub-forum column, those whose text
    contains one of the ``keywords``; short ones and those without a text go."""
    def op(df: DataFrame) -> DataFrame:
        body, sub = find_col(df.columns, TOPIC_TEXT_COLUMNS), find_col(df.columns, CHANNEL_COLUMNS)
        if body is None:
            log.warning("posts without a text column: no rows")
            return _posts(df.filter(F.lit(False)), F.lit(""), F.lit(default_channel), source, order)
        df = df.transform(filter_channels_or_keywords(channels, keywords, sub or "", body))
        df = df.transform(filter_min_length(min_length, body))
        channel = F.lower(F.col(f"`{sub}`")) if sub else F.lit(default_channel)
        return _posts(df, F.col(f"`{body}`"), channel, source, order)
    return op


def merge_posts(frames: Sequence[DataFrame], order: Sequence[str] = ()) -> DataFrame:
    """SRC8: the union of post frames, one row a text: that of the first frame, there the first row."""
    out = None
    for i, frame in enumerate(frames):
        frame = frame.withColumn("_frame", F.lit(i))
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    by = ["_frame", *[c for c in order if c in out.columns]]
    by += [c for c in BASE_COLUMNS if len(by) == 1]
    return out.transform(keep_first_by(F.sha2("text", 256), by)).select(*BASE_COLUMNS)
