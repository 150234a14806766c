"""Quality rules with risk-controlled thresholds.

Every rule compares one statistic of a text with a cutoff and rejects what is above.
Cutoffs are chosen from a fixed grid on labelled documents (``quality`` 1 is good):
for each stratum (language), rule and cutoff, x of the stratum's n good documents
would be rejected. The cutoff is certified when the exact binomial test rejects "the
false rejection rate is over ``risk``": P(Binomial(n, risk) <= x) <= delta / number
of tests (Bonferroni over strata, rules and cutoffs). Of a rule's certified cutoffs the
strictest one is used; without one the rule is off in that stratum. ``risk`` is the
total tolerated rate divided by the number of rules, so the union of all rules rejects
no more than ``total_risk`` of good documents of any stratum, with confidence 1 - delta.

Statistics of a text are computed inside its row. DataFrame functions only; the
binomial tail is summed in SQL over a table of at most strata x rules x cutoffs rows.

Defined results: NULL text has no words and fails the base rules; an unlabelled or NULL
language forms a stratum of its own; labels given twice for a document count once if
equal, and a document with contradicting labels isn't good; without labels no rule is on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import WHITE_SPACE, without_space
from wellspring.session import cut_lineage

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: The rules' statistics (see ``statistics``) and the cutoffs tried for each.
CUTOFFS = {
    "symbol_share": [0.005 * i for i in range(1, 21)],
    "upper_share": [0.1 + 0.05 * i for i in range(15)],
    "exclaim_share": [0.01 * i for i in range(1, 16)],
    "repeat_share": [0.02 * i for i in range(1, 16)],
    "dup_line_share": [0.05 * i for i in range(1, 16)],
    "mean_word": [6.0 + 0.5 * i for i in range(18)],
}


def base_columns(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text (long)."""
    whole = F.coalesce(text, F.lit(""))
    spaced = F.translate(whole, WHITE_SPACE, " " * len(WHITE_SPACE))
    solid = without_space(whole)
    words = F.filter(F.split(spaced, " +"), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: without_space(x) != "")
    out = {
        "n_words": F.size(words),
        "word_chars": F.length(solid),
        "n_symbols": F.length(whole) - F.length(F.translate(whole, SYMBOLS, "")),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": _let(words, _repeat_words),
    }
    return {k: v.cast("long") for k, v in out.items()}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more in the text."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = _let(hashes, lambda h: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(h) - WINDOW + 1, F.lit(1))),
        lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW)))))
    return F.when(F.size(words) < WINDOW, 0).otherwise(_let(windows, lambda w: F.when(
        F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_covered(w))))


def _covered(windows: Column) -> Column:
    def places(e: Column) -> Column:
        again = F.filter(e, lambda t, i: t["x"].eqNullSafe(F.get(e, i + 1)["x"])
                         | t["x"].eqNullSafe(F.get(e, i - 1)["x"]))
        return F.array_sort(F.transform(again, lambda t: t["p"]))

    ordered = F.sort_array(F.transform(windows, lambda x, p: F.struct(x.alias("x"), p.alias("p"))))
    at = _let(ordered, places)
    # a window adds the words up to the next one's start, all of them if that is farther
    return _let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(
        F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda acc, x: acc + x))


def statistics(docs: DataFrame, doc_id: str, text: str, stratum: str) -> DataFrame:
    """Base columns of every text and the statistics that the rules compare."""
    whole = F.coalesce(F.col(text), F.lit(""))
    letters = lambda pattern: F.length(whole) - F.length(F.regexp_replace(whole, pattern, ""))
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(stratum), F.lit("")).alias("stratum"),
                      *[c.alias(k) for k, c in base_columns(F.col(text)).items()],
                      (F.length(whole) - F.length(F.translate(whole, "!", ""))).cast("long").alias("n_exclaim"),
                      letters(r"\p{Lu}").cast("long").alias("n_upper"),
                      F.size(F.filter(F.split(whole, "\n"), lambda x: without_space(x) != "")).cast("long").alias("n_lines"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)).cast("double")
    return out.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "upper_share": share("n_upper", "word_chars"),
        "exclaim_share": share("n_exclaim", "word_chars"), "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "mean_word": share("word_chars", "n_words")})


def log_tail(n: Column, x: Column, risk: float) -> Column:
    """P(Binomial(n, risk) <= x), summed from the largest term down to the first, in logarithms."""
    odds = math.log(risk / (1 - risk))
    start = F.struct((n * F.lit(math.log1p(-risk))).cast("double").alias("t"),
                     (n * F.lit(math.log1p(-risk))).cast("double").alias("s"))

    def add(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1) / i) + F.lit(odds)
        high, low = F.greatest(t, acc["s"]), F.least(t, acc["s"])
        return F.struct(t.alias("t"), (high + F.log1p(F.exp(low - high))).alias("s"))

    return F.when(x == 0, start["s"]).otherwise(
        F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(x, F.lit(1).cast("long"))), start, add,
                    lambda acc: acc["s"]))


def cutoffs(stats: DataFrame, labels: DataFrame, total_risk: float, delta: float) -> DataFrame:
    """``(stratum, rule, cutoff, n_good, n_lost)``: the certified cutoffs in use."""
    risk = total_risk / len(CUTOFFS)
    good = (labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id"))
            .agg(F.min("quality").alias("q")).filter("q = 1").select("_id"))
    held = stats.filter("n_words > 0").join(good, F.col("doc_id") == F.col("_id"), "left_semi")
    # how many grid cutoffs lie below each value: one narrow row for every stratum and rule, summed map-side
    tried = [(rule, c) for rule, grid in CUTOFFS.items() for c in grid]
    counts = held.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum((F.col(rule) > F.lit(c)).cast("long")).alias(f"x{i}") for i, (rule, c) in enumerate(tried)])
    counts = cut_lineage(counts)
    tests = max(1, counts.count() * len(tried))
    long = counts.select("stratum", "n", F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"x{i}").alias("x"))
        for i, (rule, c) in enumerate(tried)])).alias("t")).select("stratum", "n", "t.*")
    # beyond the mean the test can't succeed, so the sum needs no more terms than n * risk
    sure = long.filter(F.col("x") <= F.col("n") * F.lit(risk)).withColumn("p", log_tail(F.col("n"), F.col("x"), risk))
    best = sure.filter(F.col("p") <= math.log(delta / tests)).groupBy("stratum", "rule").agg(
        F.min(F.struct("cutoff", "n", "x")).alias("b"))
    return best.select("stratum", "rule", F.col("b.cutoff").alias("cutoff"), F.col("b.n").alias("n_good"),
                       F.col("b.x").alias("n_lost"))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang",
          total_risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per document: base columns, ``base_failed``, ``failed`` (names of rules) and ``kept``."""
    stats = cut_lineage(statistics(docs, doc_id, text, stratum))
    chosen = cutoffs(stats, labels, total_risk, delta)
    # one row per stratum with a column for each rule: a table as long as the list of strata
    wide = chosen.groupBy("stratum").agg(*[
        F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in CUTOFFS])
    wide = cut_lineage(wide)
    out = stats.join(F.broadcast(wide) if wide.count() <= 10_000 else wide, "stratum", "left")
    failed = F.filter(F.array(*[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in CUTOFFS]), lambda x: x.isNotNull())
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      base.alias("base_failed"), failed.alias("failed"), (~base & (F.size(failed) == 0)).alias("kept"))
