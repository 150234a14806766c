"""Registered corpus queries and their SQL twins.

Each query reads the driver's tables through the domain views and returns a
DataFrame; timestamps are printed as text and doubles rounded in both twins so
the two engines can be compared value by value.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters as FL
from ..operators.dedup import dedup_text
from ..operators.merge import merge_sources
from ..operators.normalize import normalize_forum
from ..operators.reports import top_values, value_counts
from ..operators.sampling import cap_per_group, stratified_sample
from ..operators.sentiment import (compound_label, label_table, lexicon_features, polarity_label, themes_detected,
                                   valence_compound, word_tokens)
from ..session import scratch_path
from ..sources import views as V
from ..sources.specs import forum_specs, load_sources
from ..sources.tables import read_table
from . import sqltext as S
from .corpus import CorpusOptions, build_corpus, corpus_coverage, write_corpus

# Fixture dictionaries (FIXTURES.md §2): the invented prose of the test
# tables contains none of the real theme words, so queries over the test
# tables take these small dictionaries as parameters.
FIXTURE_ALLOWLIST = [f"src{i}" for i in range(10)]
FIXTURE_THEMES = {
    "burnout": ["thatin", "ononst"],
    "physical_demands": ["inoran", "hehely"],
    "management_issues": ["rewh"],
    "workload": ["orantion", "from"],
    "environment": ["work", "this"],
}
FIXTURE_LEXICON = [("that", 0.5, 0.3), ("with", -0.4, 0.6), ("this", 0.8, 0.9),
                   ("from", -0.7, 0.5), ("tion", -0.2, 0.1)]


def fixture_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXTURE_LEXICON, "word string, polarity double, subjectivity double")


def _ts(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss")


def corpus_options() -> CorpusOptions:
    return CorpusOptions(allowlist=FIXTURE_ALLOWLIST)


# ------------------------------------------------------------- coverage (AGG1)
def q_coverage_report(spark: SparkSession, data_dir: str) -> DataFrame:
    rep = corpus_coverage(V.corpus(spark, data_dir), corpus_options())
    return rep.withColumn("date_min", _ts("date_min")).withColumn("date_max", _ts("date_max"))


def _forum_stage_sql(name: str, where: str, opt: CorpusOptions) -> str:
    return f"""{name}_a AS (
  SELECT * FROM corpus WHERE {where}
    AND lower({S.strip("regexp_replace(channel, '^[rR]/', '')")}) IN {S.in_list(opt.allowlist)}
    AND NOT coalesce(lower({S.strip('text')}) IN {S.in_list(['[deleted]', '[removed]', '[deleted by user]', 'nan', ''])}, false)
    AND NOT coalesce(regexp_matches(text, 'https?://[^{S.WS[1:-1]}]+') AND {S.is_blank(f"regexp_replace(text, 'https?://[^{S.WS[1:-1]}]+', '', 'g')")}, false)
    AND length({S.strip(f"regexp_replace(text, 'https?://[^{S.WS[1:-1]}]+', '', 'g')")}) >= {opt.min_text_length}
    AND coalesce(TRY_CAST(CAST(score AS VARCHAR) AS DOUBLE), 0) >= {opt.min_score}),
{name}_b AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY _row_ord) AS rn FROM {name}_a) WHERE rn = 1),
{name}_c AS (SELECT * FROM {name}_b WHERE created_utc >= TIMESTAMP '{opt.date_from}' AND created_utc <= TIMESTAMP '{opt.date_to}'),
{name} AS (SELECT * EXCLUDE (rn), 'forum' AS src2 FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY {S.sample_key('id', opt.seed)}, id) AS rn FROM {name}_c) WHERE {f"rn <= {opt.max_per_channel}" if opt.max_per_channel else "true"})"""


def redact_sql(expr: str) -> str:
    nws = f"[^{S.WS[1:-1]}]"
    r = f"regexp_replace({expr}, 'https?://{nws}+|www\\.{nws}+', '[URL]', 'g')"
    r = f"regexp_replace({r}, '\\b{nws}+@{nws}+\\b', '[EMAIL]', 'g')"
    r = f"regexp_replace({r}, '[\\+\\(]?[0-9][0-9\\t\\n\\x0b\\f\\r\\x{{85}}\\p{{Z}}\\-\\(\\)\\.]{{8,}}[0-9]', '[PHONE]', 'g')"
    return f"CASE WHEN {expr} IS NULL OR {S.is_blank(expr)} THEN {expr} ELSE {r} END"


def _review_stage_sql(opt: CorpusOptions) -> str:
    nws = f"[^{S.WS[1:-1]}]"
    return f"""reviews_a AS (SELECT * REPLACE ({redact_sql('text')} AS text) FROM corpus WHERE source = 'reviews'),
reviews_b AS (
  SELECT * FROM reviews_a WHERE
    NOT coalesce(lower({S.strip('text')}) IN {S.in_list(['[deleted]', '[removed]', '[deleted by user]', 'nan', ''])}, false)
    AND NOT coalesce(regexp_matches(text, 'https?://{nws}+') AND {S.is_blank(f"regexp_replace(text, 'https?://{nws}+', '', 'g')")}, false)
    AND length({S.strip(f"regexp_replace(text, 'https?://{nws}+', '', 'g')")}) >= {opt.min_text_length}),
reviews_c AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY _row_ord) AS rn FROM reviews_b) WHERE rn = 1),
reviews AS (SELECT * FROM reviews_c WHERE created_utc >= TIMESTAMP '{opt.date_from}' AND created_utc <= TIMESTAMP '{opt.date_to}')"""


def corpus_union_sql(opt: CorpusOptions) -> str:
    return ",\n".join([
        V.ORACLE_CTES["corpus"],
        _forum_stage_sql("posts", "source = 'forum' AND type = 'post'", opt),
        _forum_stage_sql("comments", "source = 'forum' AND type = 'comment'", opt),
        _review_stage_sql(opt),
        """canon AS (
  SELECT id, type, 'forum' AS source, channel, text, created_utc, score FROM posts
  UNION ALL SELECT id, type, 'forum', channel, text, created_utc, score FROM comments
  UNION ALL SELECT id, type, 'reviews', channel, text, created_utc, score FROM reviews)""",
    ])


def stage_counts_sql(opt: CorpusOptions) -> str:
    """Rows of each stage of the corpus job, from the CTEs of ``corpus_union_sql``."""
    url = f"https?://[^{S.WS[1:-1]}]+"
    quality = f"""NOT coalesce(lower({S.strip('text')}) IN {S.in_list(['[deleted]', '[removed]', '[deleted by user]', 'nan', ''])}, false)
    AND NOT coalesce(regexp_matches(text, '{url}') AND {S.is_blank(f"regexp_replace(text, '{url}', '', 'g')")}, false)
    AND length({S.strip(f"regexp_replace(text, '{url}', '', 'g')")}) >= {opt.min_text_length}"""
    channel = f"lower({S.strip("regexp_replace(channel, '^[rR]/', '')")}) IN {S.in_list(opt.allowlist)}"
    rows = []
    for part, name in (("post", "posts"), ("comment", "comments")):
        rows += [(part, "read", f"corpus WHERE source = 'forum' AND type = '{part}'"),
                 (part, "channels", f"corpus WHERE source = 'forum' AND type = '{part}' AND {channel}"),
                 (part, "quality", f"corpus WHERE source = 'forum' AND type = '{part}' AND {channel} AND {quality}"),
                 (part, "score", f"{name}_a"), (part, "dedup", f"{name}_b"), (part, "dates", f"{name}_c")]
    rows += [("review", "read", "corpus WHERE source = 'reviews'"), ("review", "quality", "reviews_b"),
             ("review", "dedup", "reviews_c"), ("review", "dates", "reviews")]
    rows += [(s, "written", f"canon WHERE source = '{s}' HAVING count(*) > 0") for s in ("forum", "reviews")]
    return f"WITH {corpus_union_sql(opt)}\n" + " UNION ALL ".join(
        f"SELECT {S.q(p)} AS part, {S.q(st)} AS stage, count(*) AS rows FROM {rest}" for p, st, rest in rows)


def oracle_coverage_report() -> str:
    opt = corpus_options()
    return f"""WITH {corpus_union_sql(opt)}
SELECT source, channel, count(*) AS count,
  round(avg(CASE WHEN coalesce({S.is_blank('text')}, false) THEN 1.0 ELSE 0.0 END) * 100, 2) AS pct_missing_text,
  {S.fmt_ts('min(created_utc)')} AS date_min, {S.fmt_ts('max(created_utc)')} AS date_max
FROM canon WHERE source IS NOT NULL AND channel IS NOT NULL
GROUP BY source, channel ORDER BY source, count DESC"""


# ------------------------------------------------- canonical corpus (SNK2 body)
def q_canonical_corpus(spark: SparkSession, data_dir: str) -> DataFrame:
    out = build_corpus(V.corpus(spark, data_dir), corpus_options())
    return out.select("id", "type", "source", "channel", F.md5("text").alias("text_md5"),
                      _ts("created_utc").alias("created_utc"), "score", "sentiment_source")


def oracle_canonical_corpus() -> str:
    opt = corpus_options()
    return f"""WITH {corpus_union_sql(opt)}
SELECT id, type, source, channel, md5(text) AS text_md5, {S.fmt_ts('created_utc')} AS created_utc,
  score, 'none' AS sentiment_source FROM canon"""


# --------------------------------------------------------- channel cap (SMP1)
CAP_SAMPLE = 8


def q_channel_cap_sample(spark: SparkSession, data_dir: str) -> DataFrame:
    forum = V.corpus(spark, data_dir).filter(F.col("source") == "forum")
    return forum.transform(cap_per_group(CAP_SAMPLE, "channel", "id", 42)).select("id", "channel", "type")


def oracle_channel_cap_sample() -> str:
    return f"""{V.oracle_with('corpus')}
SELECT id, channel, type FROM (
  SELECT *, row_number() OVER (PARTITION BY channel ORDER BY {S.sample_key('id')}, id) AS rn
  FROM corpus WHERE source = 'forum') WHERE rn <= {CAP_SAMPLE}"""


# ------------------------------------------------------------ text dedup (DED2)
def q_dedup_text(spark: SparkSession, data_dir: str) -> DataFrame:
    c = V.corpus(spark, data_dir)
    return (c.transform(dedup_text(("_row_ord",)))
             .select("id", "source", F.md5("text").alias("text_md5")))


def oracle_dedup_text() -> str:
    return f"""{V.oracle_with('corpus')}
SELECT id, source, md5(text) AS text_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY _row_ord) AS rn FROM corpus) WHERE rn = 1"""


# -------------------------------------------------------- stratified (SMP2)
STRAT_N = 300


def q_stratified_sample(spark: SparkSession, data_dir: str) -> DataFrame:
    c = V.corpus(spark, data_dir)
    return c.transform(stratified_sample(STRAT_N, ("source", "type"), "id", 42)).select("id", "source", "type")


def oracle_stratified_sample() -> str:
    return f"""{V.oracle_with('corpus')},
sizes AS (SELECT source, type, count(*) AS size FROM corpus GROUP BY source, type),
tot AS (SELECT count(*) AS total FROM corpus),
takes AS (SELECT s.source, s.type, s.size,
  least(greatest(1, round_even({STRAT_N} * s.size / t.total, 0)), s.size) AS take FROM sizes s, tot t),
ranked AS (SELECT c.*, k.take, row_number() OVER (PARTITION BY c.source, c.type ORDER BY {S.sample_key('c.id')}, c.id) AS rn
  FROM corpus c JOIN takes k ON c.source IS NOT DISTINCT FROM k.source AND c.type IS NOT DISTINCT FROM k.type),
picked AS (SELECT * FROM ranked WHERE rn <= take)
SELECT id, source, type FROM (
  SELECT * FROM picked ORDER BY {S.sample_key('id')}, id LIMIT {STRAT_N}
) WHERE (SELECT total FROM tot) > {STRAT_N}
UNION ALL SELECT id, source, type FROM corpus WHERE (SELECT total FROM tot) <= {STRAT_N}"""


# ---------------------------------------------------- quality filters (FIL1-6)
def q_quality_filtered(spark: SparkSession, data_dir: str) -> DataFrame:
    opt = corpus_options()
    c = V.corpus(spark, data_dir).filter(F.col("source") == "forum")
    out = (c.transform(FL.filter_channels(opt.allowlist))
            .transform(FL.filter_text_quality(opt.min_text_length))
            .transform(FL.filter_min_score(opt.min_score))
            .transform(FL.filter_dates(opt.date_from, opt.date_to)))
    return out.select("id", "channel", "score")


def oracle_quality_filtered() -> str:
    opt = corpus_options()
    stage = _forum_stage_sql("f", "source = 'forum'", opt)
    return f"""{V.oracle_with('corpus')},
{stage}
SELECT id, channel, score FROM f_a
WHERE created_utc >= TIMESTAMP '{opt.date_from}' AND created_utc <= TIMESTAMP '{opt.date_to}'"""


# ------------------------------------------------------------- redaction (TXT9)
def q_redacted_reviews(spark: SparkSession, data_dir: str) -> DataFrame:
    c = V.corpus(spark, data_dir).filter(F.col("source") == "reviews")
    return c.select("id", T.redact("text").alias("text"))


def oracle_redacted_reviews() -> str:
    return f"""{V.oracle_with('corpus')}
SELECT id, {redact_sql('text')} AS text FROM corpus WHERE source = 'reviews'"""


# --------------------------------------------------------- normalise (PRJ2-7)
def raw_forum_export(spark: SparkSession, data_dir: str) -> DataFrame:
    """The documents table dressed as a raw forum comment export."""
    d = read_table(spark, data_dir, "documents")
    return d.select(
        F.col("doc_id").alias("comment_id"),
        F.concat(F.lit("r/"), F.upper("source")).alias("Subreddit"),
        F.col("text").alias("body"),
        F.col("lang").alias("username"),
        (F.lit(1577836800) + F.col("n_chars") * 3600).cast("string").alias("created"),
        (F.col("n_chars") % 50).cast("string").alias("ups"),
    )


def q_normalized_forum(spark: SparkSession, data_dir: str) -> DataFrame:
    raw = raw_forum_export(spark, data_dir)
    out = normalize_forum(raw, "comment", source_file="documents.parquet")
    return out.select("id", "type", "channel", "title", F.md5("text").alias("text_md5"), "author",
                      _ts("created_utc").alias("created_utc"), "score", "url", "source_file")


def oracle_normalized_forum() -> str:
    return f"""SELECT CAST(doc_id AS VARCHAR) AS id, 'comment' AS type,
  lower({S.strip("regexp_replace('r/' || upper(source), '^[rR]/', '')")}) AS channel,
  '' AS title, md5(coalesce(text, '')) AS text_md5, coalesce(lang, '') AS author,
  {S.fmt_ts("to_timestamp(CAST(CAST(1577836800 + n_chars * 3600 AS VARCHAR) AS DOUBLE))")} AS created_utc,
  CAST(TRY_CAST(CAST(n_chars % 50 AS VARCHAR) AS DOUBLE) AS BIGINT) AS score, '' AS url,
  'documents.parquet' AS source_file
FROM documents"""


# ------------------------------------------------------------- merge (SET3)
def q_merged_sources(spark: SparkSession, data_dir: str) -> DataFrame:
    c = V.corpus(spark, data_dir)
    forum = c.filter(F.col("source") == "forum").select(
        F.col("id").alias("review_id"), "text", F.col("channel").alias("subreddit"),
        F.col("created_utc").alias("created_date"), "_row_ord")
    reviews = c.filter(F.col("source") == "reviews").select(
        F.col("id").alias("review_id"), "text", F.col("created_utc").alias("rating_date"),
        (F.col("score") + 1).cast("double").alias("rating_overall"), "_row_ord")
    merged = merge_sources({"glassdoor": reviews, "reddit": forum}, order_col="_row_ord")
    return merged.select("review_id", "source", "subreddit", "employee_job_title", "company_name",
                         _ts("rating_date").alias("rating_date"), "rating_overall")


def oracle_merged_sources() -> str:
    return f"""{V.oracle_with('corpus')},
u AS (
  SELECT id AS review_id, text, 'glassdoor' AS source, CAST(NULL AS VARCHAR) AS subreddit,
    'Unknown' AS employee_job_title, 'Amazon' AS company_name, created_utc AS rating_date,
    CAST(score + 1 AS DOUBLE) AS rating_overall, 0 AS src_ord, _row_ord
  FROM corpus WHERE source = 'reviews'
  UNION ALL
  SELECT id, text, 'reddit', channel, 'Unknown', 'Various', created_utc, CAST(NULL AS DOUBLE), 1, _row_ord
  FROM corpus WHERE source = 'forum')
SELECT review_id, source, subreddit, employee_job_title, company_name,
  {S.fmt_ts('rating_date')} AS rating_date, rating_overall
FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY src_ord, _row_ord) AS rn FROM u) WHERE rn = 1"""


# ------------------------------------------------------- source shares (AGG2)
def q_source_shares(spark: SparkSession, data_dir: str) -> DataFrame:
    out = build_corpus(V.corpus(spark, data_dir), corpus_options())
    return value_counts(out, "type").withColumn("pct", F.round("pct", 4))


def oracle_source_shares() -> str:
    opt = corpus_options()
    return f"""WITH {corpus_union_sql(opt)}
SELECT type, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct
FROM canon GROUP BY type"""


# ----------------------------------------------------------- top values (AGG3)
def q_top_channels(spark: SparkSession, data_dir: str) -> DataFrame:
    c = V.corpus(spark, data_dir).filter(F.col("source") == "forum")
    q = c.transform(FL.filter_text_quality(30))
    return top_values(q, "channel", 10)


def quality_sql(opt_len: int) -> str:
    nws = f"[^{S.WS[1:-1]}]"
    return f"""NOT coalesce(lower({S.strip('text')}) IN {S.in_list(['[deleted]', '[removed]', '[deleted by user]', 'nan', ''])}, false)
    AND NOT coalesce(regexp_matches(text, 'https?://{nws}+') AND {S.is_blank(f"regexp_replace(text, 'https?://{nws}+', '', 'g')")}, false)
    AND length({S.strip(f"regexp_replace(text, 'https?://{nws}+', '', 'g')")}) >= {opt_len}"""


def oracle_top_channels() -> str:
    return f"""{V.oracle_with('corpus')}
SELECT channel, count(*) AS count FROM corpus WHERE source = 'forum' AND {quality_sql(30)}
GROUP BY channel ORDER BY count DESC, channel ASC LIMIT 10"""


# -------------------------------------------------------------- labels (SEN6)
def q_labelled_corpus(spark: SparkSession, data_dir: str) -> DataFrame:
    c = V.corpus(spark, data_dir)
    out = c.transform(label_table(fixture_lexicon(spark), FIXTURE_THEMES))
    return out.select("id", "polarity", "subjectivity", "sentiment_label", "confidence",
                      *[f"{t}_keywords" for t in FIXTURE_THEMES], "is_warehouse", "word_count",
                      F.array_join(themes_detected(FIXTURE_THEMES), ",").alias("themes"))


def _contains_any_sql(expr: str, words) -> list:
    return [f"(CASE WHEN contains({expr}, {S.q(w)}) THEN 1 ELSE 0 END)" for w in words]


def oracle_labelled_corpus() -> str:
    from ..functions.vocab import CORPORATE_TERMS, WAREHOUSE_TERMS
    pol_case = "CASE x " + " ".join(f"WHEN {S.q(w)} THEN CAST({p} AS DECIMAL(30,9))" for w, p, _ in FIXTURE_LEXICON) + " END"
    sub_case = "CASE x " + " ".join(f"WHEN {S.q(w)} THEN CAST({s} AS DECIMAL(30,9))" for w, _, s in FIXTURE_LEXICON) + " END"
    low = "lower(coalesce(text, ''))"
    themes = ",\n  ".join(f"({' + '.join(_contains_any_sql(low, kws))}) AS {name}_keywords"
                           for name, kws in FIXTURE_THEMES.items())
    theme_names = ", ".join(f"CASE WHEN ({' + '.join(_contains_any_sql(low, kws))}) > 0 THEN {S.q(name)} END"
                            for name, kws in FIXTURE_THEMES.items())
    wh = " + ".join(_contains_any_sql(low, WAREHOUSE_TERMS))
    co = " + ".join(_contains_any_sql(low, CORPORATE_TERMS))
    # half up on the number as it prints, as Spark rounds doubles
    shown = lambda x: f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18)), 4) AS DOUBLE)"
    return f"""{V.oracle_with('corpus')},
t AS (SELECT c.*, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS toks FROM corpus c),
v AS (SELECT *, list_filter(list_transform(toks, lambda x: {pol_case}), lambda y: y IS NOT NULL) AS pv,
        list_filter(list_transform(toks, lambda x: {sub_case}), lambda y: y IS NOT NULL) AS sv FROM t),
b AS (SELECT *, coalesce(text, '') = '' AS empty,
        CASE WHEN coalesce(text, '') = '' OR len(pv) = 0 THEN 0.0 ELSE CAST(list_reduce(pv, lambda a, z: a + z) AS DOUBLE) / len(pv) END AS p,
        CASE WHEN coalesce(text, '') = '' OR len(sv) = 0 THEN 0.0 ELSE CAST(list_reduce(sv, lambda a, z: a + z) AS DOUBLE) / len(sv) END AS s
      FROM v),
l AS (SELECT *, CASE WHEN p > 0.1 THEN 'positive' WHEN p < -0.1 THEN 'negative' ELSE 'neutral' END AS lab FROM b)
SELECT id, {shown('p')} AS polarity, {shown('s')} AS subjectivity, lab AS sentiment_label,
  CAST(round(CAST(CASE WHEN empty THEN 0.0 ELSE greatest(
    CASE WHEN lab = 'positive' THEN least((p - 0.1) / 0.9, 1.0)
         WHEN lab = 'negative' THEN least((-0.1 - p) / 0.9, 1.0)
         ELSE 1.0 - abs(p) / 0.1 END, 0.0) END AS DECIMAL(38,18)), 4) AS DOUBLE) AS confidence,
  {themes},
  ({wh}) > ({co}) AS is_warehouse,
  {S.word_count("coalesce(text, '')")} AS word_count,
  concat_ws(',', {theme_names}) AS themes
FROM l"""


# ------------------------------------------- sentiment by a large lexicon (SEN2-SEN4)
# The lexicon is derived from the tables: every word of the corpus, with values from its length.
def word_lexicon(corpus: DataFrame) -> DataFrame:
    n = F.length("word")
    return (corpus.select(F.explode(F.array_distinct(word_tokens("text"))).alias("word")).distinct()
            .select("word", ((n * 7) % 21 - 10).cast("double").alias("valence"),
                    (((n * 5) % 19 - 9) / 10).alias("polarity"), ((n % 11) / 10).alias("subjectivity")))


_WORDS_SQL = """toks AS (SELECT id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) AS word FROM corpus),
hits AS (SELECT id, (length(word) * 7) % 21 - 10 AS valence, (length(word) * 5) % 19 - 9 AS polarity,
  length(word) % 11 AS subjectivity FROM toks),
sums AS (SELECT id, sum(valence) AS v, sum(polarity) AS p, sum(subjectivity) AS s, count(*) AS n FROM hits GROUP BY id)"""


def q_sentiment_compound(spark: SparkSession, data_dir: str) -> DataFrame:
    c = V.corpus(spark, data_dir)
    out = c.transform(valence_compound(word_lexicon(c)))
    return out.select("id", F.round("compound", 6).alias("compound"),
                      compound_label(F.round("compound", 9)).alias("label"))


def oracle_sentiment_compound() -> str:
    return f"""{V.oracle_with('corpus')}, {_WORDS_SQL},
s2 AS (SELECT c.id, coalesce(v, 0) / sqrt(coalesce(v, 0) * coalesce(v, 0) + 15.0) AS x FROM corpus c LEFT JOIN sums USING (id))
SELECT id, round(x, 6) AS compound, CASE WHEN round(x, 9) >= 0.05 THEN 'positive' WHEN round(x, 9) <= -0.05 THEN 'negative'
  ELSE 'neutral' END AS label FROM s2"""


def q_sentiment_polarity(spark: SparkSession, data_dir: str) -> DataFrame:
    c = V.corpus(spark, data_dir)
    out = c.transform(lexicon_features(word_lexicon(c)))
    return out.select("id", F.round("polarity", 6).alias("polarity"), F.round("subjectivity", 6).alias("subjectivity"),
                      polarity_label(F.col("polarity")).alias("label"))


def oracle_sentiment_polarity() -> str:
    return f"""{V.oracle_with('corpus')}, {_WORDS_SQL},
s2 AS (SELECT c.id, coalesce(p / 10.0 / n, 0) AS p, coalesce(s / 10.0 / n, 0) AS s FROM corpus c LEFT JOIN sums USING (id))
SELECT id, round(p, 6) AS polarity, round(s, 6) AS subjectivity, CASE WHEN round(p, 9) > 0.1 THEN 'positive'
  WHEN round(p, 9) < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM s2"""


# ------------------------------------------------ stage counts (AGG8, SNK2)
def q_stage_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    """AGG8: the corpus job writes its Parquet by source and tells the rows of every stage."""
    path = scratch_path(spark, f"corpus-{uuid.uuid4().hex[:8]}")
    rows = write_corpus(V.corpus(spark, data_dir), corpus_options(), path)
    written = spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    written = written.select(F.col("source").alias("part"), F.lit("written").alias("stage"), "rows")
    return spark.createDataFrame(rows, "part string, stage string, rows long").union(written)


def oracle_stage_counts() -> str:
    return stage_counts_sql(corpus_options())


# ------------------------------------------ source specs (SRC3, SRC4, SRC8)
def write_forum_exports(spark: SparkSession, data_dir: str, base: str) -> None:
    """The documents as the five known forum exports: CSV, line JSON and Parquet, each with its own columns."""
    d = read_table(spark, data_dir, "documents")
    common = {"id": F.concat(F.lit("x"), "doc_id"), "author": F.col("lang"), "score": (F.col("n_chars") % 50).cast("string"),
              "created_utc": (F.lit(1577836800) + F.col("n_chars") * 3600).cast("string")}
    channel = F.concat(F.lit("r/"), F.upper("source"))
    post = {"title": F.concat(F.lit("Title "), "doc_id"), "selftext": F.col("text"), "url": F.concat(F.lit("u/"), "doc_id")}
    exports = {
        "forum_posts_a": ("csv", {**common, **post, "subreddit.name": channel}),
        "forum_comments_a": ("json", {**common, "body": F.col("text"), "subreddit": channel, "link_id": F.concat(F.lit("t3_"), "doc_id")}),
        "forum_posts_b": ("parquet", {**common, **post, "subreddit": channel}),
        "forum_comments_b": ("csv", {**common, "body": F.col("text"), "subreddit": channel}),
        "forum_user_posts_b": ("json", {**common, **post, "subreddit": channel}),
    }
    for k, (name, (kind, columns)) in enumerate(exports.items()):
        out = d.filter(F.col("doc_id") % 5 == k).select(*[c.alias(n) for n, c in columns.items()])
        w = out.write.mode("overwrite")
        if kind == "csv":
            w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
                "ignoreTrailingWhiteSpace", False).csv(f"{base}/{name}")
        elif kind == "json":
            w.option("compression", "none").json(f"{base}/{name}")
        else:
            w.parquet(f"{base}/{name}")


def q_forum_exports(spark: SparkSession, data_dir: str) -> DataFrame:
    """SRC3, SRC4, SRC8: five exports of differing kinds and columns, found, read and united."""
    base = scratch_path(spark, f"exports-{uuid.uuid4().hex[:8]}")
    write_forum_exports(spark, data_dir, base)
    out, _counts = load_sources(spark, forum_specs(base))
    return out.select("id", "type", "channel", "title", F.md5("text").alias("text_md5"), "author",
                      _ts("created_utc").alias("created_utc"), "score", "url",
                      F.element_at(F.split("source_file", "/"), -1).alias("export"))


def oracle_forum_exports() -> str:
    names = "['forum_posts_a', 'forum_comments_a', 'forum_posts_b', 'forum_comments_b', 'forum_user_posts_b']"
    return f"""SELECT 'x' || doc_id AS id, CASE WHEN doc_id % 5 IN (1, 3) THEN 'comment' ELSE 'post' END AS type,
  lower({S.strip("source")}) AS channel, CASE WHEN doc_id % 5 IN (1, 3) THEN '' ELSE 'Title ' || doc_id END AS title,
  md5(coalesce(text, '')) AS text_md5, coalesce(lang, '') AS author,
  {S.fmt_ts("to_timestamp(1577836800 + n_chars * 3600)")} AS created_utc, n_chars % 50 AS score,
  CASE doc_id % 5 WHEN 3 THEN '' WHEN 1 THEN 't3_' || doc_id ELSE 'u/' || doc_id END AS url,
  {names}[1 + doc_id % 5] AS export
FROM documents"""
