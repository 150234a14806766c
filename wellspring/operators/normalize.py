"""Schema mapping and derived columns (PRJ1-PRJ24).

Raw exports are mapped to one common forum schema (S1) in a single
``select`` decided at plan time from the input's column names. The only
data-dependent decision (PRJ6: epoch or ISO time) is one aggregate.
"""

from __future__ import annotations

from typing import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import COMPANY_MENTIONS, CORPORATE_TERMS, SUBREDDIT_GROUPS, TITLE_WAREHOUSE_TERMS, WAREHOUSE_TERMS

Op = Callable[[DataFrame], DataFrame]

FORUM_COLUMNS = ["id", "type", "channel", "title", "text", "author",
                 "created_utc", "score", "url", "source_file"]
UNION_COLUMNS = ["id", "type", "source", "channel", "title", "text", "author",
                 "created_utc", "score", "url",
                 "sentiment_score", "sentiment_label", "sentiment_source"]

# --- fixed values: candidate column names, first present wins ---------------
ID_CANDIDATES = ["id", "post_id", "comment_id", "link_id"]
TEXT_CANDIDATES = ["selftext", "body", "text", "content", "post_text"]
SUBREDDIT_CANDIDATES = ["subreddit", "subreddit_name_prefixed", "subreddit_name", "sub"]
DATE_CANDIDATES = ["created_utc", "created", "timestamp", "date", "created_at", "date_created"]
TITLE_CANDIDATES = ["title", "post_title", "name"]
SCORE_CANDIDATES = ["score", "upvotes", "ups"]
AUTHOR_CANDIDATES = ["author", "username", "user"]

# --- fixed values: field maps of the five forum exports ---------------------
FIELD_MAPS = {
    "forum_posts_a": {"id": "id", "title": "title", "selftext": "text", "author": "author",
                      "subreddit": "subreddit", "subreddit.name": "subreddit", "score": "score",
                      "created_utc": "created_utc", "url": "url"},
    "forum_comments_a": {"id": "id", "body": "text", "author": "author", "subreddit": "subreddit",
                         "subreddit.name": "subreddit", "score": "score",
                         "created_utc": "created_utc", "link_id": "url"},
    "forum_posts_b": {"id": "id", "title": "title", "selftext": "text", "author": "author",
                      "subreddit": "subreddit", "score": "score", "created_utc": "created_utc",
                      "url": "url"},
    "forum_comments_b": {"id": "id", "body": "text", "author": "author", "subreddit": "subreddit",
                         "score": "score", "created_utc": "created_utc"},
    "forum_user_posts_b": {"id": "id", "title": "title", "selftext": "text", "author": "author",
                           "subreddit": "subreddit", "score": "score",
                           "created_utc": "created_utc", "url": "url"},
}
RECORD_TYPES = {"forum_posts_a": "post", "forum_comments_a": "comment", "forum_posts_b": "post",
                "forum_comments_b": "comment", "forum_user_posts_b": "post"}


def find_col(columns: Sequence[str], candidates: Iterable[str]) -> str | None:
    """PRJ1: first candidate present, compared case-insensitively."""
    lower = {c.lower(): c for c in columns}  # like a dict over columns: last wins
    for cand in candidates:
        if cand.lower() in lower:
            return lower[cand.lower()]
    return None


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def str_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def py_str(c: Column) -> Column:
    """String form of a value as ``str()`` prints it, NULL as ``nan``."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def surrogate_id(cols: Sequence[Column]) -> Column:
    """PRJ5: md5 of the first three columns joined by '|', 16 hex chars."""
    return F.substring(F.md5(F.concat_ws("|", *[py_str(c) for c in cols[:3]])), 1, 16)


def epoch_share(df: DataFrame, col: str) -> float:
    """Share of rows whose value parses as a number (PRJ6 pre-pass)."""
    r = df.agg(F.avg(F.col(col).cast("string").try_cast("double").isNotNull().cast("double"))).first()
    return float(r[0] or 0.0)


def parse_time(c: Column, epoch: bool) -> Column:
    """PRJ6/FN1: epoch seconds or ISO-like strings to a UTC timestamp."""
    if epoch:
        return F.timestamp_seconds(c.cast("string").try_cast("double"))
    return F.coalesce(F.try_to_timestamp(c.cast("string")),
                      F.try_to_timestamp(c.cast("string"), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
                      F.try_to_timestamp(c.cast("string"), F.lit("yyyy-MM-dd HH:mm:ssXXX")))


def score_to_long(c: Column) -> Column:
    """PRJ7: numeric text to a nullable integer ('12.5' -> 12, 'x' -> NULL)."""
    return c.cast("string").try_cast("double").cast("long")


def normalize_forum(df: DataFrame, record_type: str, source_file: str = "",
                    field_map: Mapping[str, str] | None = None,
                    epoch_time: bool | None = None) -> DataFrame:
    """PRJ2: any raw forum frame to the common schema (S1).

    ``field_map`` renames first (first present source column wins per target);
    an explicit ``text`` column wins over candidates; missing text/title/
    author/url default to ''. ``epoch_time`` decides PRJ6; when None it is
    computed with one aggregate (more than half numeric -> epoch seconds).
    """
    cols = list(df.columns)
    if field_map:
        taken: dict[str, str] = {}
        for src, tgt in field_map.items():
            if src in cols and tgt not in taken:
                taken[tgt] = src
        keep = [c for c in cols if c not in taken.values() and c not in taken]
        df = df.select(*[_q(c) for c in keep], *[_q(s).alias(t) for t, s in taken.items()])
        cols = list(df.columns)

    def pick(cands):
        name = find_col(cols, cands)
        return _q(name) if name else None

    idc = pick(ID_CANDIDATES)
    id_col = idc.cast("string") if idc is not None else surrogate_id([_q(c) for c in cols])
    type_col = _q("type").cast("string") if "type" in cols else F.lit(record_type)
    sub = pick(SUBREDDIT_CANDIDATES)
    chan = F.coalesce(T.clean_channel_name(sub), F.lit("")) if sub is not None else F.lit("")
    title = pick(TITLE_CANDIDATES)
    text = _q("text") if "text" in cols else pick(TEXT_CANDIDATES)
    author = pick(AUTHOR_CANDIDATES)
    date_name = find_col(cols, DATE_CANDIDATES)
    if date_name is not None:
        if epoch_time is None:
            epoch_time = epoch_share(df, f"`{date_name}`") > 0.5
        created = parse_time(_q(date_name), epoch_time)
    else:
        created = F.lit(None).cast("timestamp")
    score = pick(SCORE_CANDIDATES)
    return df.select(
        id_col.alias("id"), type_col.alias("type"), chan.alias("channel"),
        (str_or_empty(title) if title is not None else F.lit("")).alias("title"),
        (str_or_empty(text) if text is not None else F.lit("")).alias("text"),
        (str_or_empty(author) if author is not None else F.lit("")).alias("author"),
        created.alias("created_utc"),
        (score_to_long(score) if score is not None else F.lit(None).cast("long")).alias("score"),
        (str_or_empty(_q("url")) if "url" in cols else F.lit("")).alias("url"),
        (_q("source_file").cast("string") if "source_file" in cols else F.lit(source_file)).alias("source_file"),
    )


# ------------------------------------------------------------ review columns
def _valid_part(c: Column) -> Column:
    s = T.strip_all(c.cast("string"))
    return F.when(c.isNotNull() & (s != "") & ~F.lower(s).isin("nan", "none"), s)


def combine_review_text(headline: Column, pros: Column, cons: Column,
                        pros_label: str = "PROS: ", cons_label: str = "CONS: ",
                        sep: str = "\n") -> Column:
    """PRJ8/PRJ9: headline, labelled pros and cons; empty parts skipped."""
    h, p, c = _valid_part(headline), _valid_part(pros), _valid_part(cons)
    return F.concat_ws(sep, h, F.concat(F.lit(pros_label), p), F.concat(F.lit(cons_label), c))


def review_row_id(firm: Column, date: Column, job: Column, headline: Column,
                  pros: Column, cons: Column) -> Column:
    """PRJ10: sha256 of the six trimmed fields joined by '|', 16 chars."""
    parts = [T.strip_all(F.coalesce(x.cast("string"), F.lit(""))) for x in (firm, date, job, headline, pros, cons)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def text_id(text: Column, prefix: str = "rd_") -> Column:
    """PRJ11: prefix + 12 hex chars of md5 of the first 120 characters."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.substring(F.coalesce(text, F.lit("")), 1, 120)), 1, 12))


def hash_firm(firm: Column, salt: str = "") -> Column:
    """PRJ12: pseudonymised firm name, 12 chars of sha256(lower(strip))."""
    return F.substring(F.sha2(F.concat(F.lit(salt), F.lower(T.strip_all(F.coalesce(firm.cast("string"), F.lit(""))))), 256), 1, 12)


# --- fixed values: rating columns of review exports --------------------------
RATING_COLS = ["overall_rating", "work_life_balance", "culture_values", "diversity_inclusion",
               "career_opp", "comp_benefits", "senior_mgmt", "recommend", "ceo_approv", "outlook"]
# --- fixed values: review date formats tried in order -------------------------
REVIEW_DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MMM d, yyyy", "MM/dd/yyyy", "dd/MM/yyyy"]


def coerce_ratings(df: DataFrame, cols: Sequence[str] = RATING_COLS) -> DataFrame:
    """PRJ14: rating columns to double; absent columns become NULL."""
    return df.withColumns({c: (F.col(c).cast("string").try_cast("double") if c in df.columns
                               else F.lit(None).cast("double")) for c in cols})


def parse_review_date(c: Column) -> Column:
    """PRJ15: first format that parses, as a UTC timestamp."""
    s = c.cast("string")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in REVIEW_DATE_FORMATS])


# --- fixed values: review columns of the company-scoped reader ----------------
REVIEW_COLUMN_MAP = {
    "firm": "company_name", "date_review": "rating_date", "job_title": "employee_job_title",
    "current": "employee_status", "location": "location", "overall_rating": "rating_overall",
    "work_life_balance": "rating_work_life", "culture_values": "rating_culture",
    "diversity_inclusion": "rating_diversity", "career_opp": "rating_career",
    "comp_benefits": "rating_comp", "senior_mgmt": "rating_mgmt",
    "recommend": "recommend_to_friend", "ceo_approv": "ceo_approval",
    "outlook": "business_outlook", "headline": "summary_text", "pros": "pros_text",
    "cons": "cons_text",
}


def rename_lower(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """PRJ16: every name to ``lower(trim(name))`` and those of ``mapping`` renamed.
    Of columns that come to one name the first stays."""
    named: dict[str, Column] = {}
    for c in df.columns:
        key = c.strip().lower()
        named.setdefault(mapping.get(key, key), _q(c))
    return df.select(*[col.alias(name) for name, col in named.items()])


def mention_rules(mentions: Sequence[tuple[str, Sequence[str]]] = COMPANY_MENTIONS) -> list[tuple[str, str]]:
    """``(pattern, company)``: any of a company's phrases as whole words."""
    return [("|".join(rf"(?U)\b{p}\b" for p in phrases), name) for name, phrases in mentions]


def infer_company(text: Column, rules: Sequence[tuple[str, str]] | None = None, default: str = "Various") -> Column:
    """PRJ17: company from ordered regex rules; a later match overrides an
    earlier one, so the ``when`` chain is built in reverse order."""
    rules = mention_rules() if rules is None else rules
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for pattern, name in reversed(list(rules)):
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return F.lit(default) if out is None else out.otherwise(default)


def title_is_warehouse(title: Column, terms: Sequence[str] = TITLE_WAREHOUSE_TERMS) -> Column:
    """PRJ18: any term of a warehouse role in lower(title); false without a title."""
    return F.coalesce(F.lower(title.cast("string")).rlike("|".join(terms)), F.lit(False))


def is_warehouse(title: Column, text: Column) -> Column:
    """PRJ19: title decides first (warehouse term -> true, corporate -> false),
    otherwise more warehouse than corporate term hits in the text."""
    t = F.lower(F.coalesce(title.cast("string"), F.lit("")))
    x = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    hits = lambda c, terms: sum((F.contains(c, F.lit(k)).cast("int") for k in terms), F.lit(0))
    t_wh, t_co = hits(t, WAREHOUSE_TERMS) > 0, hits(t, CORPORATE_TERMS) > 0
    hits_wh, hits_co = hits(x, WAREHOUSE_TERMS), hits(x, CORPORATE_TERMS)
    return (F.when((t != "") & t_wh, True).when((t != "") & t_co, False)
             .otherwise(hits_wh > hits_co))


def channel_category(channel: Column) -> Column:
    """PRJ21: sector category of a sub-forum (small fixed map literal)."""
    m = {s.lower(): cat for cat, subs in SUBREDDIT_GROUPS.items() for s in subs}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.lower(channel))


def union_columns(df: DataFrame, columns: Sequence[str] = UNION_COLUMNS) -> DataFrame:
    """PRJ22: the shared column subset, in order."""
    return df.select(*[c for c in columns if c in df.columns])
