"""Registered queries over review and forum exports, with their SQL twins.

The given tables hold no exports: documents are written as such (CSV and Parquet folders), found, read and
mapped. What decides identity (firm, date, job) depends on the text's length, so copies of a text are one review.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import COMPANY_MENTIONS, TARGET_CHANNELS, TARGET_COMPANIES, TITLE_WAREHOUSE_TERMS, WORK_KEYWORDS
from ..operators.reviews import channel_posts, company_reviews, review_records, topic_posts
from ..session import scratch_path
from ..sources.specs import load_export, load_posts
from ..sources.tables import read_table
from . import sqltext as S
from .registered_corpus import redact_sql

FIRMS = ["Amazon ", "WALMART", "Invented Trade", "ups store", None, "Acme", "Dollar General"]
JOBS = ["Warehouse Associate", "Software Engineer", "Forklift driver", None, "Team Lead FC"]
STATUS = ["Current Employee", "Former Employee", None]
TITLES = ["Amazon or target?", None, "Sam's Club", "Mail carrier, UPS"]
RECOMMEND = ["v", "x", "1"]


def _of(values: list, by: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def _of_sql(values: list, by: str) -> str:
    return f"[{', '.join('NULL' if v is None else S.q(v) for v in values)}][1 + {by} % {len(values)}]"


def raw_reviews(spark: SparkSession, data_dir: str) -> DataFrame:
    """Documents dressed as a raw review export."""
    d = read_table(spark, data_dir, "documents")
    n, half = F.coalesce(F.col("n_chars"), F.lit(0)), F.floor(F.length("text") / 2).cast("int")
    day = F.date_add(F.lit("2019-07-01").cast("date"), ((n * 7) % 2300).cast("int"))
    date = F.when(n % 5 == 0, F.date_format(day, "yyyy-MM-dd")).when(n % 5 == 1, F.date_format(day, "MM/dd/yyyy")).when(
        n % 5 == 2, F.date_format(day, "MMM d, yyyy")).when(n % 5 == 3, "soon")
    rating = F.when(F.col("doc_id") % 11 == 0, "n/a").otherwise((F.col("doc_id") % 5 + 1).cast("string"))
    return d.select(
        F.col("doc_id").alias("row"), _of(FIRMS, n).alias("Firm"), date.alias("Date_Review"), _of(JOBS, n).alias("job_title"),
        _of(STATUS, n).alias("current"), F.concat(F.lit("Town "), n % 9).alias("location"), rating.alias("overall_rating"),
        (F.col("doc_id") % 4 + 1).cast("string").alias("work_life_balance"), _of(RECOMMEND, F.col("doc_id")).alias("recommend"),
        F.when(n % 6 == 1, "None").when(n % 6 > 1, F.concat(F.lit("Review of "), "source")).alias("headline"),
        F.substring("text", F.lit(1), half).alias("pros"), F.substring("text", half + 1, F.length("text")).alias("cons"))


def _raw_reviews_sql() -> str:
    return f"""WITH d AS (SELECT doc_id, source, text, coalesce(n_chars, 0) AS n, length(text) // 2 AS half,
  DATE '2019-07-01' + CAST((coalesce(n_chars, 0) * 7) % 2300 AS INTEGER) AS day FROM documents),
raw AS (SELECT doc_id, n, day, {_of_sql(FIRMS, 'n')} AS firm,
  CASE n % 5 WHEN 0 THEN strftime(day, '%Y-%m-%d') WHEN 1 THEN strftime(day, '%m/%d/%Y')
    WHEN 2 THEN strftime(day, '%b %-d, %Y') WHEN 3 THEN 'soon' END AS date,
  CASE WHEN n % 5 < 3 THEN strftime(day, '%Y-%m-%d 00:00:00') END AS seen, {_of_sql(JOBS, 'n')} AS job,
  {_of_sql(STATUS, 'n')} AS status, CASE WHEN doc_id % 11 <> 0 THEN CAST(doc_id % 5 + 1 AS DOUBLE) END AS overall,
  CAST(doc_id % 4 + 1 AS DOUBLE) AS balance, CASE WHEN doc_id % 3 = 2 THEN 1.0::DOUBLE END AS recommend,
  CASE WHEN n % 6 = 1 THEN 'None' WHEN n % 6 > 1 THEN 'Review of ' || source END AS headline,
  substring(text, 1, half) AS pros, substring(text, half + 1) AS cons FROM d)"""


def _combined_sql(h: str, p: str, c: str, pros: str, cons: str, sep: str) -> str:
    def part(x: str, label: str = "") -> str:
        s = S.strip(f"coalesce({x}, '')")
        return f"CASE WHEN {s} <> '' AND lower({s}) NOT IN ('nan', 'none') THEN '{label}' || {s} END"
    return f"concat_ws({sep}, {part(h)}, {part(p, pros)}, {part(c, cons)})"


# ------------------------------------------------ review job (PRJ8, PRJ10-PRJ15)
def q_review_normalized(spark: SparkSession, data_dir: str) -> DataFrame:
    """SRC5 with the review stage: two exports, CSV and Parquet, to records without personal data."""
    base, raw = scratch_path(spark, f"reviews-{uuid.uuid4().hex[:8]}"), raw_reviews(spark, data_dir)
    raw.filter("row % 2 = 0").write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{base}/csv")
    raw.filter("row % 2 = 1").write.parquet(f"{base}/parquet")
    out = None
    for kind in ("csv", "parquet"):
        # numbers come back from CSV as text: their order is that of the least row number only as a number
        job = lambda df, k=kind: df.withColumn("row", F.col("row").cast("long")).transform(
            review_records(source_file=k, order=["row"]))
        part = load_export(spark, f"{base}/{kind}", job)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return out.select("id", "type", "source", "title", F.md5("text").alias("text_md5"),
                      F.date_format("created_utc", "yyyy-MM-dd HH:mm:ss").alias("created_utc"), "score", "source_file", "firm_id",
                      "location", "job_title", "current", "overall_rating", "work_life_balance", "culture_values", "recommend")


def oracle_review_normalized() -> str:
    key = " || '|' || ".join(S.strip(f"coalesce({c}, '')") for c in ("firm", "date", "job", "h", "p", "c"))
    firm = "lower(" + S.strip("coalesce(firm, '')") + ")"
    return f"""{_raw_reviews_sql()},
red AS (SELECT *, {redact_sql("coalesce(headline, '')")} AS h, {redact_sql("coalesce(pros, '')")} AS p,
  {redact_sql("coalesce(cons, '')")} AS c FROM raw),
joined AS (SELECT *, {_combined_sql('h', 'p', 'c', 'PROS: ', 'CONS: ', 'chr(10)')} AS whole FROM red),
texts AS (SELECT *, {redact_sql('whole')} AS t FROM joined),
ids AS (SELECT *, substring(sha256({key}), 1, 16) AS id FROM texts WHERE length(t) >= 30),
one AS (SELECT *, row_number() OVER (PARTITION BY doc_id % 2, id ORDER BY doc_id) AS rn FROM ids)
SELECT id, 'review' AS type, 'reviews' AS source, h AS title, md5(t) AS text_md5, seen AS created_utc,
  CAST(NULL AS BIGINT) AS score, CASE doc_id % 2 WHEN 0 THEN 'csv' ELSE 'parquet' END AS source_file,
  substring(sha256({firm}), 1, 12) AS firm_id, '' AS location, coalesce(job, '') AS job_title,
  coalesce(status, '') AS current, overall AS overall_rating, balance AS work_life_balance,
  CAST(NULL AS DOUBLE) AS culture_values, recommend FROM one WHERE rn = 1"""


# ------------------------------------------------- company reviews (SRC6, FIL8)
def q_company_reviews(spark: SparkSession, data_dir: str) -> DataFrame:
    """SRC6: reviews of the target companies in the base review schema."""
    out = raw_reviews(spark, data_dir).transform(company_reviews(order=["row"]))
    return out.select("review_id", F.md5("text").alias("text_md5"), "source", "subreddit", "employee_job_title",
                      "employee_status", "company_name", F.date_format("rating_date", "yyyy-MM-dd HH:mm:ss").alias("rating_date"),
                      "rating_overall", "rating_work_life", "recommend_to_friend", "is_warehouse")


def oracle_company_reviews() -> str:
    return f"""{_raw_reviews_sql()},
texts AS (SELECT *, {_combined_sql('headline', 'pros', 'cons', 'Pros: ', 'Cons: ', "' '")} AS t FROM raw
  WHERE regexp_matches(lower(firm), {S.q('|'.join(TARGET_COMPANIES).replace('.', '[.]'))})),
one AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS rn FROM texts WHERE length(t) >= 20)
SELECT 'co_' || substring(md5(substring(t, 1, 120)), 1, 12) AS review_id, md5(t) AS text_md5, 'company_reviews' AS source,
  CAST(NULL AS VARCHAR) AS subreddit, job AS employee_job_title, status AS employee_status, firm AS company_name,
  seen AS rating_date, overall AS rating_overall, balance AS rating_work_life,
  {_of_sql(RECOMMEND, 'doc_id')} AS recommend_to_friend,
  coalesce(regexp_matches(lower(job), {S.q('|'.join(TITLE_WAREHOUSE_TERMS))}), false) AS is_warehouse FROM one WHERE rn = 1"""


# ------------------------------------------ forum posts (SRC7, SRC8, FIL9, PRJ17)
def q_forum_posts(spark: SparkSession, data_dir: str) -> DataFrame:
    """SRC7, SRC8: posts of one sub-forum, of target sub-forums and by keyword, from files; one row a text."""
    base, d = scratch_path(spark, f"posts-{uuid.uuid4().hex[:8]}"), read_table(spark, data_dir, "documents")
    n = F.coalesce(F.col("n_chars"), F.lit(0))
    row = F.col("doc_id").alias("row")
    d.filter("doc_id % 3 = 0").select(row, _of(TITLES, n).alias("title"), F.col("text").alias("selftext"),
                                      (F.lit(1577836800) + n * 3600).cast("string").alias("created_utc")).write.parquet(f"{base}/one")
    day = F.date_add(F.lit("2019-07-01").cast("date"), ((n * 7) % 2300).cast("int"))
    channel = F.when(n % 4 == 0, "AntiWork").when(n % 4 == 1, "jobs").when(n % 4 == 2, F.col("source"))
    d.filter("doc_id % 3 = 1").select(row, channel.alias("subreddit"), F.col("text").alias("body"),
                                      F.date_format(day, "yyyy-MM-dd").alias("date")).write.parquet(f"{base}/channels")
    d.filter("doc_id % 3 = 2").select(row, F.col("text").alias("Comment")).write.parquet(f"{base}/keywords")
    out = load_posts(spark, [(f"{base}/one", channel_posts("antiwork", order=["row"])),
                             (f"{base}/channels", topic_posts(order=["row"])),
                             (f"{base}/keywords", topic_posts(order=["row"]))], order=["row"])
    return out.select("review_id", F.md5("text").alias("text_md5"), "source", "subreddit", "employee_job_title",
                      "company_name", F.date_format("rating_date", "yyyy-MM-dd HH:mm:ss").alias("rating_date"), "rating_overall")


def oracle_forum_posts() -> str:
    edge = r"[^\p{L}\p{M}\p{N}_]"
    company = " ".join(f"WHEN regexp_matches(lower(t), {S.q(f'(^|{edge})(' + '|'.join(phrases) + f')($|{edge})')}) THEN {S.q(name)}"
                       for name, phrases in reversed(COMPANY_MENTIONS))
    return f"""WITH d AS (SELECT doc_id, source, text, coalesce(n_chars, 0) AS n FROM documents),
a AS (SELECT 0 AS frame, doc_id, coalesce({_of_sql(TITLES, 'n')}, '') || '. ' || coalesce(text, '') AS t, 'antiwork' AS subreddit,
  {S.fmt_ts("to_timestamp(1577836800 + n * 3600)")} AS seen FROM d WHERE doc_id % 3 = 0),
b AS (SELECT 1, doc_id, text, lower(CASE n % 4 WHEN 0 THEN 'AntiWork' WHEN 1 THEN 'jobs' WHEN 2 THEN source END) AS sub,
  strftime(DATE '2019-07-01' + CAST((n * 7) % 2300 AS INTEGER), '%Y-%m-%d 00:00:00') FROM d WHERE doc_id % 3 = 1),
c AS (SELECT 2, doc_id, text, 'forum_topics', CAST(NULL AS VARCHAR) FROM d
  WHERE doc_id % 3 = 2 AND regexp_matches(lower(text), {S.q('|'.join(WORK_KEYWORDS))})),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE sub IN {S.in_list(TARGET_CHANNELS)} UNION ALL SELECT * FROM c),
k AS (SELECT *, {S.strip('t')} AS bare FROM u WHERE length(t) >= 30 AND lower(t) NOT IN ('[deleted]', '[removed]', '.', '')),
one AS (SELECT *, row_number() OVER (PARTITION BY bare ORDER BY frame, doc_id) AS rn FROM k)
SELECT 'rd_' || substring(md5(substring(t, 1, 120)), 1, 12) AS review_id, md5(bare) AS text_md5, 'forum' AS source, subreddit,
  'Unknown' AS employee_job_title, CASE {company} ELSE 'Various' END AS company_name, seen AS rating_date,
  CAST(NULL AS DOUBLE) AS rating_overall FROM one WHERE rn = 1"""
