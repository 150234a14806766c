"""Registered queries over shift debriefs, feedback, cleaned texts and sentiment in context, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import CHECKIN_BURNOUT_THEMES, KEYWORD_THEMES, NEGATION_FACTOR, THEME_TO_DOMAIN
from ..operators.cleaning import clean_table
from ..operators.debrief import debrief_signals, domain_strengths
from ..operators.feedback import RATINGS, activity_outcomes
from ..operators.recommend import categories_of
from ..operators.sentiment import compound_label, contextual_compound, lexicon_features, polarity_label, word_tokens
from ..sources import dims as D
from ..sources import views as V
from ..sources.tables import read_table
from . import sqltext as S

#: The given texts are invented prose: some of their commonest words stand for boosters and negations.
BOOSTERS = {"the": 0.293, "la": 0.293, "of": -0.293, "de": -0.293}
NEGATED = ["is", "le", "die"]
DOMAINS = list(dict.fromkeys(THEME_TO_DOMAIN.values()))
_WORDS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+')"


def partial_lexicon(texts: DataFrame) -> DataFrame:
    """Words of odd length of the given texts, with values from their length: the other words are misses."""
    n = F.length("word")
    return (texts.select(F.explode(F.array_distinct(word_tokens("text"))).alias("word")).distinct().filter(n % 2 == 1)
            .select("word", ((n * 7) % 21 - 10).cast("double").alias("valence"),
                    (((n * 5) % 19 - 9) / 10).alias("polarity"), ((n % 11) / 10).alias("subjectivity")))


def q_sentiment_context(spark: SparkSession, data_dir: str) -> DataFrame:
    """SEN2: negations and boosters before each word."""
    c = V.corpus(spark, data_dir).select("id", "text")
    lexicon = partial_lexicon(c.select(F.translate("text", "'’", "").alias("text")))
    out = c.transform(contextual_compound(lexicon, boosters=BOOSTERS, negations=NEGATED))
    return out.select("id", F.round("compound", 6).alias("compound"), compound_label(F.round("compound", 9)).alias("label"))


def oracle_sentiment_context() -> str:
    step = " + ".join(
        f"{fade} * coalesce(CASE p{k} {' '.join(f'WHEN {S.q(w)} THEN {v}' for w, v in BOOSTERS.items())} END, 0)"
        for k, fade in ((1, "1.0"), (2, "0.95"), (3, "0.9")))
    turns = " + ".join(f"CASE WHEN p{k} IN {S.in_list(NEGATED)} THEN 1 ELSE 0 END" for k in (1, 2, 3))
    bare = "lower(replace(replace(coalesce(text, ''), chr(39), ''), chr(8217), ''))"
    return f"""{V.oracle_with('corpus')},
t AS (SELECT id, {_WORDS.format(bare)} AS ws FROM corpus),
u AS (SELECT id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM t),
c AS (SELECT *, lag(word, 1) OVER w AS p1, lag(word, 2) OVER w AS p2, lag(word, 3) OVER w AS p3 FROM u WINDOW w AS (PARTITION BY id ORDER BY place)),
v AS (SELECT id, CAST((length(word) * 7) % 21 - 10 AS DOUBLE) AS v, CAST({step} AS DOUBLE) AS step, {turns} AS turns FROM c WHERE length(word) % 2 = 1),
s AS (SELECT id, sum(CAST((v + sign(v) * step) * pow({NEGATION_FACTOR}, turns) AS DECIMAL(28, 12))) AS s FROM v GROUP BY id),
x AS (SELECT corpus.id, CAST(coalesce(s, 0) AS DOUBLE) AS s FROM corpus LEFT JOIN s USING (id)),
y AS (SELECT id, s / sqrt(s * s + 15.0) AS x FROM x)
SELECT id, round(x, 6) AS compound, CASE WHEN round(x, 9) >= 0.05 THEN 'positive' WHEN round(x, 9) <= -0.05 THEN 'negative'
  ELSE 'neutral' END AS label FROM y"""


# ---------------------------------------------------- debriefs (TXT13, CHK11)
def q_debrief_signals(spark: SparkSession, data_dir: str) -> DataFrame:
    """TXT13: which phrases of the five lists each debrief holds."""
    out = V.debrief_entries(spark, data_dir).transform(debrief_signals())
    signals = F.col("domain_signals")
    counts = [F.coalesce(signals[d]["count"], F.lit(0)).alias(f"n_{d}") for d in CHECKIN_BURNOUT_THEMES]
    found = [F.array_join(signals[d]["keywords_found"], ",").alias(f"found_{d}") for d in CHECKIN_BURNOUT_THEMES]
    return out.select("conv_id", "turn", "has_debrief", "word_count", *counts, *found)


def _entries_sql() -> str:
    phrases = [p for words in (*CHECKIN_BURNOUT_THEMES.values(), *KEYWORD_THEMES.values()) for p in words]
    table = "[" + ", ".join(S.q(p) for p in phrases) + "]"
    said = ", ".join(f"{table}[1 + ((conv_id * 31 + turn * 7) * {m}) % {3 * len(phrases)}]" for m in (1, 5, 11))
    return f"""{V.ORACLE_CTES['debriefs']},
entries AS (SELECT conv_id, turn, CASE WHEN turn = 0 AND conv_id % 11 = 0 THEN '  ' ELSE concat_ws(' ', text, {said}) END AS text
  FROM debriefs),
low AS (SELECT *, lower(coalesce(text, '')) AS low, NOT {S.is_blank("coalesce(text, '')")} AS has_debrief FROM entries)"""


def _hits_sql(words) -> str:
    return f"list_filter([{', '.join(S.q(w) for w in words)}], lambda p: contains(low, p))"


def oracle_debrief_signals() -> str:
    hits = ", ".join(f"{_hits_sql(words)} AS h_{d}" for d, words in CHECKIN_BURNOUT_THEMES.items())
    counts = ", ".join(f"CASE WHEN has_debrief THEN CAST(len(h_{d}) AS INTEGER) ELSE 0 END AS n_{d}" for d in CHECKIN_BURNOUT_THEMES)
    found = ", ".join(f"CASE WHEN has_debrief THEN array_to_string(h_{d}, ',') END AS found_{d}" for d in CHECKIN_BURNOUT_THEMES)
    return f"""WITH {_entries_sql()}, h AS (SELECT *, {hits} FROM low)
SELECT conv_id, turn, has_debrief, CAST({S.word_count("coalesce(text, '')")} AS INTEGER) AS word_count, {counts}, {found} FROM h"""


def q_debrief_domains(spark: SparkSession, data_dir: str) -> DataFrame:
    """CHK11 and JOI6: strengths of the debriefs' domains and the activity categories they boost."""
    d = V.debrief_entries(spark, data_dir).withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    out = d.transform(lexicon_features(partial_lexicon(d)))
    out = out.withColumn("sentiment_label", polarity_label(F.round("polarity", 9))).transform(domain_strengths())
    levels = [F.col("domain_strengths")[d].alias(d) for d in DOMAINS]
    boosted = F.array_join(F.array_sort(categories_of(F.col("domain_strengths"))), ",").alias("boosted")
    return out.select("conv_id", "turn", "sentiment_label", F.array_join("themes_detected", ",").alias("themes"), *levels, boosted)


def oracle_debrief_domains() -> str:
    flags = ", ".join(f"CAST(len({_hits_sql(words)}) > 0 AS INTEGER) AS t_{name}" for name, words in KEYWORD_THEMES.items())
    themes = "concat_ws(',', " + ", ".join(f"CASE WHEN t_{name} = 1 THEN {S.q(name)} END" for name in KEYWORD_THEMES) + ")"
    levels = []
    for domain in DOMAINS:
        hits = " + ".join(f"t_{name}" for name, d in THEME_TO_DOMAIN.items() if d == domain)
        level = f"least(10.0, least(0.5 * ({hits}), 1.0) * (CASE WHEN sentiment_label = 'negative' THEN 1.3 ELSE 1.0 END) * 10)"
        levels.append(f"CASE WHEN {hits} > 0 THEN CAST(round({level}, 2) AS DOUBLE) END AS {domain}")
    boost = " UNION ".join(f"SELECT conv_id, turn, {S.q(c)} AS cat FROM z WHERE {d} >= {D.SUBSCALE_HIGH}"
                           for d in DOMAINS for c in D.SUBSCALE_CATEGORY_MAP[d])
    return f"""WITH {_entries_sql()},
toks AS (SELECT conv_id, turn, unnest({_WORDS.format('low')}) AS word FROM low),
pol AS (SELECT conv_id, turn, sum((length(word) * 5) % 19 - 9) / 10.0 / count(*) AS p FROM toks WHERE length(word) % 2 = 1 GROUP BY ALL),
lab AS (SELECT low.*, CASE WHEN round(p, 9) > 0.1 THEN 'positive' WHEN round(p, 9) < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment_label
  FROM low LEFT JOIN pol USING (conv_id, turn)),
f AS (SELECT *, {flags} FROM lab),
z AS (SELECT conv_id, turn, sentiment_label, {themes} AS themes, {', '.join(levels)} FROM f),
b AS (SELECT conv_id, turn, string_agg(cat, ',' ORDER BY cat) AS boosted FROM ({boost}) GROUP BY ALL)
SELECT z.*, coalesce(boosted, '') AS boosted FROM z LEFT JOIN b USING (conv_id, turn)"""


# ------------------------------------------------- feedback (CHK14, CHK15)
def q_activity_outcomes(spark: SparkSession, data_dir: str) -> DataFrame:
    """CHK14, CHK15: what activities changed, and for how many they were of help."""
    out = V.feedback_projection(read_table(spark, data_dir, "events")).transform(activity_outcomes())
    return out.select("activity_id", "n_feedback", *[F.round(c, 6).alias(c) for c in (
        "helpful_rate", *[f"avg_{name}_change" for name in RATINGS])])


def oracle_activity_outcomes() -> str:
    changes = ", ".join(f"{S.rnd(f'avg(({name}_after - {name}_before) * {sign})', 6)} AS avg_{name}_change" for name, sign in RATINGS.items())
    return f"""WITH {V.ORACLE_CTES['feedback']}
SELECT activity_id, count(*) AS n_feedback, {S.rnd('avg(CAST(helpful AS INTEGER))', 6)} AS helpful_rate, {changes}
FROM feedback GROUP BY activity_id"""


# --------------------------------------------------------- clean a table (TXT8)
def q_clean_table(spark: SparkSession, data_dir: str) -> DataFrame:
    """TXT8 over the corpus. Unicode normalisation has no SQL form; a test holds it against plain Python."""
    c = V.corpus(spark, data_dir).withColumn("source", F.when(F.col("source") == "forum", "reddit").otherwise("glassdoor"))
    return c.transform(clean_table(order=("_row_ord",))).select("id", "source", F.md5("text").alias("text_md5"))
