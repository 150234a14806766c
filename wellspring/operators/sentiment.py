"""Sentiment and corpus labelling (SEN1-SEN6, TXT11-TXT12, PRJ19, PRJ23).

The per-row sentiment libraries of the reference are re-aimed as lexicon
lookups: a lexicon is an input table ``(word, polarity, subjectivity)`` or
``(word, valence)`` of any size. Tokens are exploded, counted per row, joined
to the lexicon and aggregated per row by a given id; Catalyst chooses the join.
"""

from __future__ import annotations

from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import (BOOSTER_FADE, BOOSTER_STEP, BOOSTERS_DOWN, BOOSTERS_UP, COMPOUND_NEGATIVE,
                               COMPOUND_POSITIVE, KEYWORD_THEMES, NEGATION_FACTOR, NEGATIONS, POLARITY_NEGATIVE,
                               POLARITY_POSITIVE)
from ..session import cut_lineage
from .normalize import is_warehouse

Op = Callable[[DataFrame], DataFrame]

WORD_PATTERN = T.WORD_CLASS + "+"
# published VADER normalisation constant (Hutto & Gilbert, 2014)
VADER_ALPHA = 15.0
# words of a lexicon that is broadcast, some 50 MB of memory
BROADCAST_WORDS = 500_000


def word_tokens(col) -> Column:
    c = F.lower(F.coalesce(T._c(col), F.lit("")))
    return F.regexp_extract_all(c, F.lit(f"({WORD_PATTERN})"), 1)


def _lexicon(lexicon: DataFrame, value_cols: Sequence[str]) -> DataFrame:
    """The lexicon by lower-cased word; a word given twice raises."""
    out = lexicon.select(F.lower("word").alias("_tok"), *[F.col(c).cast("double").alias(c) for c in value_cols])
    twice = out.groupBy("_tok").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_tok").take(1)
    if twice:
        raise ValueError(f"lexicon lists a word more than once: {twice[0][0]!r}")
    return out


def _matched(df: DataFrame, lexicon: DataFrame, text_col: str, id_col: str, aggs: Sequence[Column]) -> DataFrame:
    """Aggregates over a row's lexicon tokens, joined back by ``id_col`` (unique and not NULL).

    Tokens are counted per row before the join, so a frequent word costs one row a document.
    """
    tokens = df.select(F.col(id_col).alias("_id"), F.explode(word_tokens(text_col)).alias("_tok"))
    tokens = tokens.groupBy("_id", "_tok").agg(F.count(F.lit(1)).alias("_n"))
    scored = tokens.join(lexicon, "_tok").groupBy("_id").agg(*aggs)
    return df.join(scored, F.col(id_col) == F.col("_id"), "left").drop("_id")


def lexicon_features(lexicon: DataFrame, text_col: str = "text", id_col: str = "id") -> Op:
    """Adds ``polarity`` and ``subjectivity``: means over matched tokens
    (each occurrence counts), 0.0 when nothing matches."""
    def op(df: DataFrame) -> DataFrame:
        cols = ["polarity", "subjectivity"]
        # summed as decimals (9 places), so that the order of rows can't move a mean over a label's threshold
        means = [(F.sum(F.col(c).cast("decimal(18,9)") * F.col("_n")).cast("double") / F.sum("_n")).alias(c) for c in cols]
        return _matched(df.drop(*cols), _lexicon(lexicon, cols), text_col, id_col, means).fillna({c: 0.0 for c in cols})
    return op


def polarity_label(p: Column) -> Column:
    """SEN4 (polarity): > .1 positive, < -.1 negative."""
    return (F.when(p > POLARITY_POSITIVE, "positive")
             .when(p < POLARITY_NEGATIVE, "negative").otherwise("neutral"))


def compound_label(c: Column) -> Column:
    """SEN4 (compound): >= .05 positive, <= -.05 negative."""
    return (F.when(c >= COMPOUND_POSITIVE, "positive")
             .when(c <= COMPOUND_NEGATIVE, "negative").otherwise("neutral"))


def polarity_confidence(p: Column, label: Column) -> Column:
    """SEN5: distance from the neutral band, clipped to [0, 1]."""
    conf = (F.when(label == "positive", F.least((p - POLARITY_POSITIVE) / 0.9, F.lit(1.0)))
             .when(label == "negative", F.least((POLARITY_NEGATIVE - p) / 0.9, F.lit(1.0)))
             .otherwise(F.lit(1.0) - F.abs(p) / max(abs(POLARITY_POSITIVE), 0.01)))
    return F.greatest(conf, F.lit(0.0))


def valence_compound(lexicon: DataFrame, text_col: str = "text", id_col: str = "id") -> Op:
    """SEN2: adds ``compound``, the sum of token valences normalised by ``s / sqrt(s^2 + 15)``."""
    def op(df: DataFrame) -> DataFrame:
        out = _matched(df.drop("compound"), _lexicon(lexicon, ["valence"]), text_col, id_col,
                       [F.sum(F.col("valence") * F.col("_n")).alias("compound")])
        s = F.coalesce(F.col("compound"), F.lit(0.0))
        return out.withColumn("compound", s / F.sqrt(s * s + F.lit(VADER_ALPHA)))
    return op


def contextual_compound(lexicon: DataFrame, text_col: str = "text", id_col: str = "id",
                        boosters: Mapping[str, float] | None = None, negations: Sequence[str] = NEGATIONS) -> Op:
    """SEN2 in context: adds ``compound``, where each scored word is seen with the three words before it.

    A booster among them strengthens (or weakens) the word's valence by its step, faded by distance;
    each negation turns and damps it by the published factor. The words before come from the token
    array itself, so a word's context is known before the join. A lexicon of at most
    ``BROADCAST_WORDS`` words goes to the tokens, whose sums then collapse per row before any shuffle; the tokens go
    to a larger one. Apostrophes are left out ("don't" is "dont"). Boosters and negations
    themselves are scored only if the lexicon lists them; a word listed twice raises.
    """
    steps = dict(boosters) if boosters is not None else {**{w: BOOSTER_STEP for w in BOOSTERS_UP},
                                                         **{w: -BOOSTER_STEP for w in BOOSTERS_DOWN}}

    def op(df: DataFrame) -> DataFrame:
        text = F.translate(F.coalesce(T._c(text_col), F.lit("")), "'\u2019", "")
        words = df.select(F.col(id_col).alias("_id"), word_tokens(text).alias("_words"))
        # outer, as posexplode adds a filter on the array's size, for which a text would be split once more
        words = words.select("_id", "_words", F.posexplode_outer("_words").alias("_at", "_tok")).filter("_tok is not null")
        before = [F.get("_words", F.col("_at") - k) for k in (1, 2, 3)]  # NULL before the first word
        step, turns = F.lit(0.0), F.lit(0)
        for word, fade in zip(before, BOOSTER_FADE):
            size = F.lit(0.0)
            for value in sorted(set(steps.values())):
                size = F.when(word.isin([w for w, v in steps.items() if v == value]), F.lit(float(value))).otherwise(size)
            step = step + size * fade
            turns = turns + F.when(word.isin(list(negations)), 1).otherwise(0)
        seen = words.select("_id", "_tok", step.alias("_step"), turns.cast("byte").alias("_turns"))
        lex = cut_lineage(lexicon.select(F.lower("word").alias("_tok"), F.col("valence").cast("double").alias("valence")))
        listed, distinct = lex.agg(F.count("_tok"), F.count_distinct("_tok")).first()
        if listed != distinct:
            raise ValueError(f"lexicon lists {listed - distinct} words more than once")
        hits = seen.join(F.broadcast(lex) if listed <= BROADCAST_WORDS else lex, "_tok")
        felt = (F.col("valence") + F.signum("valence") * F.col("_step")) * F.pow(F.lit(NEGATION_FACTOR), F.col("_turns"))
        # summed as decimals, so that the order of rows can't move a sum over a label's threshold
        sums = hits.groupBy("_id").agg(F.sum(felt.cast("decimal(18,12)")).cast("double").alias("_s"))
        out = df.drop("compound").join(sums, F.col(id_col) == F.col("_id"), "left").drop("_id")
        s = F.coalesce(F.col("_s"), F.lit(0.0))
        return out.withColumn("compound", s / F.sqrt(s * s + F.lit(VADER_ALPHA))).drop("_s")
    return op


def add_sentiment(mode: str = "none", lexicon: DataFrame | None = None,
                  text_col: str = "text", id_col: str = "id") -> Op:
    """SEN1: three fixed output columns; the strategy is chosen at plan time.

    * ``none``     -> NULL, NULL, 'none'
    * ``textblob`` -> mean polarity of a (word, polarity, subjectivity) lexicon
    * ``vader``    -> compound of a (word, valence) lexicon
    * ``context``  -> the same with boosters and negations before each word
    Without a lexicon the scores fall back to ``none``.
    """
    def op(df: DataFrame) -> DataFrame:
        if mode == "none" or lexicon is None:
            return (df.withColumn("sentiment_score", F.lit(None).cast("double"))
                      .withColumn("sentiment_label", F.lit(None).cast("string"))
                      .withColumn("sentiment_source", F.lit("none")))
        if mode in ("vader", "context"):
            score = valence_compound if mode == "vader" else contextual_compound
            return (df.transform(score(lexicon, text_col, id_col))
                      .withColumnRenamed("compound", "sentiment_score")
                      .withColumn("sentiment_label", compound_label(F.col("sentiment_score")))
                      .withColumn("sentiment_source", F.lit(mode)))
        if mode == "textblob":
            out = df.transform(lexicon_features(lexicon, text_col, id_col))
            return (out.withColumn("sentiment_score", F.col("polarity"))
                       .withColumn("sentiment_label", polarity_label(F.col("polarity")))
                       .withColumn("sentiment_source", F.lit("textblob"))
                       .drop("polarity", "subjectivity"))
        raise ValueError(f"unknown sentiment mode {mode!r}")
    return op


def theme_counts(themes: Mapping[str, Sequence[str]] = KEYWORD_THEMES, text_col: str = "text",
                 suffix: str = "_keywords") -> Op:
    """TXT11: per theme, the number of distinct keywords present."""
    def op(df: DataFrame) -> DataFrame:
        low = df.withColumn("_low", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
        return low.withColumns({f"{name}{suffix}": T.keyword_count("_low", kws, lowered=True)
                                for name, kws in themes.items()}).drop("_low")
    return op


def themes_detected(themes: Mapping[str, Sequence[str]] = KEYWORD_THEMES, text_col: str = "text") -> Column:
    """TXT12: names of themes with at least one keyword present, in order."""
    flags = [F.when(T.keyword_count(text_col, kws) > 0, F.lit(name)) for name, kws in themes.items()]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def label_table(lexicon: DataFrame, themes: Mapping[str, Sequence[str]] = KEYWORD_THEMES,
                text_col: str = "text", title_col: str = "employee_job_title", id_col: str = "id") -> Op:
    """SEN6: polarity/subjectivity (4 dp), label, confidence (4 dp), theme
    counts, warehouse flag and word count. Empty text is neutral with 0.0."""
    def op(df: DataFrame) -> DataFrame:
        out = df.transform(lexicon_features(lexicon, text_col, id_col))
        empty = F.coalesce(F.col(text_col), F.lit("")) == ""
        p = F.when(empty, F.lit(0.0)).otherwise(F.col("polarity"))
        s = F.when(empty, F.lit(0.0)).otherwise(F.col("subjectivity"))
        out = out.withColumn("polarity", p).withColumn("subjectivity", s)
        label = polarity_label(F.col("polarity"))
        conf = F.when(empty, F.lit(0.0)).otherwise(polarity_confidence(F.col("polarity"), label))
        title = F.col(title_col) if title_col in df.columns else F.lit("")
        out = (out.withColumn("sentiment_label", label)
                  .withColumn("confidence", F.round(conf, 4))
                  .withColumn("polarity", F.round("polarity", 4))
                  .withColumn("subjectivity", F.round("subjectivity", 4))
                  .transform(theme_counts(themes, text_col))
                  .withColumn("_low", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
                  .withColumn("is_warehouse", is_warehouse(title, F.col("_low")))
                  .drop("_low")
                  .withColumn("word_count", T.word_count(F.coalesce(F.col(text_col), F.lit("")))))
        return out
    return op
