"""Check-in validation, strain dimensions, compound score and scales.

CHK1-CHK10, GRD2, GRD3. The reference scores one record at a time; here
every rule is a column expression over a ``checkins`` table (or stream), so
scoring is a single narrow projection: no shuffle, whole-stage codegen.
Answer sets are ``map<string,int>`` columns scored with higher-order
functions in item order.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Op = Callable[[DataFrame], DataFrame]

# --- fixed values: check-in answer domains ----------------------------------
SLIDERS = ["physical_worn_down", "pain_soreness", "mentally_drained", "sleep_quality", "work_stress"]
SAFETY_VALUES = ["yes", "somewhat", "no"]
MOOD_VALUES = ["calming", "energizing", "distracting"]
MODALITY_VALUES = ["sound", "visuals", "reflection"]
TIME_VALUES = [5, 10, 15]
SETTING_VALUES = ["break_room", "commute", "home", "other"]
SAFETY_STRAIN = {"yes": 0, "somewhat": 4, "no": 8}
SAFETY_STRAIN_DEFAULT = 4

# --- fixed values: compound scorer parameters --------------------------------
DIMENSION_WEIGHTS = {"body": 0.40, "mind": 0.35, "life": 0.25}
COMPOUND_THRESHOLD = 55
COMPOUND_PAIRS = [("body", "mind", 1.15), ("body", "life", 1.12), ("mind", "life", 1.10)]
TRIPLE_COMPOUND = 1.25
RISK_BANDS = [("low", 0, 30), ("moderate", 30, 55), ("high", 55, 75), ("critical", 75, 100)]
SLEEP_STRAIN_AMPLIFY_AT = 6
LIFE_AMPLIFIER = 1.2

# --- fixed values: burnout scales --------------------------------------------
BAT12_SUBSCALES = [
    ("exhaustion", ["bat1", "bat2", "bat3"]),
    ("mental_distance", ["bat4", "bat5", "bat6"]),
    ("cognitive_impairment", ["bat7", "bat8", "bat9"]),
    ("emotional_impairment", ["bat10", "bat11", "bat12"]),
]
BAT12_RANGE = (1, 5)
OLBI_SUBSCALES = [
    ("exhaustion", ["olbi2", "olbi4", "olbi5", "olbi8", "olbi10", "olbi12", "olbi14", "olbi16"]),
    ("disengagement", ["olbi1", "olbi3", "olbi6", "olbi7", "olbi9", "olbi11", "olbi13", "olbi15"]),
]
OLBI_REVERSE_ITEMS = ["olbi2", "olbi3", "olbi4", "olbi6", "olbi8", "olbi9", "olbi11", "olbi12"]
OLBI_RANGE = (1, 4)


def _col_or(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


# ------------------------------------------------------------- validation
def validation_errors(df: DataFrame) -> Column:
    """GRD2/GRD3: array of error messages (empty = valid) in rule order."""
    msgs = []
    for s in SLIDERS:
        v = F.col(s)
        bad = v.isNull() | (v < 0) | (v > 10) | (v != F.floor(v))
        msgs.append(F.when(bad, F.concat(F.lit(f"{s} must be 0-10, got "), F.coalesce(v.cast("string"), F.lit("None")))))
    safety = _col_or(df, "shift_safety_energy", "yes")
    msgs.append(F.when(~F.coalesce(safety.isin(SAFETY_VALUES), F.lit(False)),
                       F.lit("shift_safety_energy must be yes/somewhat/no")))
    mood = _col_or(df, "intervention_mood", "calming")
    msgs.append(F.when(~F.coalesce(mood.isin(MOOD_VALUES), F.lit(False)),
                       F.lit("intervention_mood must be calming/energizing/distracting")))
    modality = _col_or(df, "intervention_modality", "reflection")
    msgs.append(F.when(~F.coalesce(modality.isin(MODALITY_VALUES), F.lit(False)),
                       F.lit("intervention_modality must be sound/visuals/reflection")))
    t = _col_or(df, "time_available_min", 10)
    msgs.append(F.when(~F.coalesce(t.isin(TIME_VALUES), F.lit(False)),
                       F.lit("time_available_min must be 5, 10, or 15")))
    setting = _col_or(df, "setting", "break_room")
    msgs.append(F.when(~F.coalesce(setting.isin(SETTING_VALUES), F.lit(False)),
                       F.lit("setting must be break_room/commute/home/other")))
    base = F.filter(F.array(*msgs), lambda m: m.isNotNull())
    parts = [base]
    if "bat12_responses" in df.columns:
        parts.append(_scale_errors("bat12_responses", "bat", 12, BAT12_RANGE, "BAT-12"))
    if "olbi_responses" in df.columns:
        parts.append(_scale_errors("olbi_responses", "olbi", 16, OLBI_RANGE, "OLBI"))
    return F.concat(*parts) if len(parts) > 1 else base


def _scale_errors(map_col: str, prefix: str, n: int, rng: tuple, label: str) -> Column:
    lo, hi = rng
    none = F.array().cast("array<string>")

    def errors(m: Column) -> Column:
        def item_error(key):
            v = F.try_element_at(m, key)
            return (F.when(v.between(lo, hi), F.lit(None))
                     .when(~F.map_contains_key(m, key), F.concat(F.lit(f"Missing {label} item: "), key))
                     .otherwise(F.concat(key, F.lit(f" must be {lo}-{hi}, got "), F.coalesce(v.cast("string"), F.lit("None")))))
        keys = F.array(*[F.lit(f"{prefix}{i}") for i in range(1, n + 1)])
        return F.when(m.isNull(), none).otherwise(F.filter(F.transform(keys, item_error), lambda e: e.isNotNull()))
    # bound by a lambda: a filter on the errors goes below the projection that makes the map, which
    # then takes the map's place and, named in the items' lambda, would be worked out for each item
    return F.transform(F.array(F.col(map_col)), errors)[0]


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Route rows: (valid, quarantine with ``errors``). Both are lazy views
    of one projection; cache or write the projection when both are used."""
    checked = df.withColumn("errors", validation_errors(df))
    return (checked.filter(F.size("errors") == 0).drop("errors"),
            checked.filter(F.size("errors") > 0))


# ------------------------------------------------------------- dimensions
def body_raw() -> Column:
    """CHK1: (worn + pain + (10 - sleep)) / 3 on the 0-10 scale."""
    return (F.col("physical_worn_down") + F.col("pain_soreness") + (F.lit(10) - F.col("sleep_quality"))) / 3


def mind_raw() -> Column:
    """CHK2: (drained + stress + safety strain) / 3; safety yes 0, somewhat 4,
    no 8, anything else 4."""
    strain = F.create_map(*[F.lit(x) for kv in SAFETY_STRAIN.items() for x in kv])
    safety = F.coalesce(F.try_element_at(strain, F.col("shift_safety_energy")), F.lit(SAFETY_STRAIN_DEFAULT))
    return (F.col("mentally_drained") + F.col("work_stress") + safety) / 3


def life_raw(body: Column, mind: Column) -> Column:
    """CHK3: mean of body and mind, x1.2 capped at 10 when sleep strain >= 6."""
    combined = (body + mind) / 2
    return F.when(F.lit(10) - F.col("sleep_quality") >= SLEEP_STRAIN_AMPLIFY_AT,
                  F.least(F.lit(10.0), combined * LIFE_AMPLIFIER)).otherwise(combined)


def with_dimensions() -> Op:
    """Adds ``body_raw``, ``mind_raw``, ``life_raw`` (0-10)."""
    def op(df: DataFrame) -> DataFrame:
        out = df.withColumn("body_raw", body_raw()).withColumn("mind_raw", mind_raw())
        return out.withColumn("life_raw", life_raw(F.col("body_raw"), F.col("mind_raw")))
    return op


def _norm100(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c * 10))


def risk_level(score: Column) -> Column:
    """CHK6: half-open bands, anything else critical."""
    expr = None
    for name, lo, hi in RISK_BANDS:
        cond = (score >= lo) & (score < hi)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise("critical")


def with_score() -> Op:
    """CHK4-CHK7: normalised dimensions, weighted base, interaction
    multiplier and pairs, capped score, risk band and dominant dimension."""
    def op(df: DataFrame) -> DataFrame:
        out = df.transform(with_dimensions())
        out = (out.withColumn("body_score", _norm100(F.col("body_raw")))
                  .withColumn("mind_score", _norm100(F.col("mind_raw")))
                  .withColumn("life_score", _norm100(F.col("life_raw"))))
        dims = {d: F.col(f"{d}_score") for d in ("body", "mind", "life")}
        base = (dims["body"] * DIMENSION_WEIGHTS["body"] + dims["mind"] * DIMENSION_WEIGHTS["mind"]
                + dims["life"] * DIMENSION_WEIGHTS["life"])
        elev = {d: c > COMPOUND_THRESHOLD for d, c in dims.items()}
        pair_mults = [F.when(elev[a] & elev[b], F.lit(m)).otherwise(F.lit(1.0)) for a, b, m in COMPOUND_PAIRS]
        triple = elev["body"] & elev["mind"] & elev["life"]
        mult = F.when(triple, F.greatest(F.lit(TRIPLE_COMPOUND), *pair_mults)).otherwise(F.greatest(F.lit(1.0), *pair_mults))
        pairs = F.filter(F.array(*[F.when(elev[a] & elev[b], F.lit(f"{a}+{b}")) for a, b, _ in COMPOUND_PAIRS]),
                         lambda p: p.isNotNull())
        pairs = F.when(triple, F.array(F.lit("body+mind+life"))).otherwise(pairs)
        dominant = (F.when((dims["body"] >= dims["mind"]) & (dims["body"] >= dims["life"]), "body")
                     .when(dims["mind"] >= dims["life"], "mind").otherwise("life"))
        return (out.withColumn("base_score", base)
                   .withColumn("compound_multiplier", mult)
                   .withColumn("interaction_pairs", pairs)
                   .withColumn("score", F.least(F.lit(100.0), F.col("base_score") * F.col("compound_multiplier")))
                   .withColumn("risk_level", risk_level(F.col("score")))
                   .withColumn("dominant_dimension", dominant))
    return op


# ------------------------------------------------------------------ scales
def _normalize(mean: Column, lo: int, hi: int) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), ((mean - lo) / (hi - lo)) * 10.0))


def _mean_struct(mean: Column, n: Column, lo: int, hi: int) -> Column:
    return F.struct(mean.alias("raw_mean"), _normalize(mean, lo, hi).alias("normalized_0_10"), n.alias("n_items"))


def _total(values: list[Column]) -> Column:
    """Sum from left to right, NULLs left out."""
    out = F.lit(0.0)
    for v in values:
        out = out + F.coalesce(v, F.lit(0.0))
    return out


def _answered(values: list[Column]) -> Column:
    return sum((v.isNotNull().cast("int") for v in values), F.lit(0))


def scale_score(map_col: str, out_col: str, subscales, rng: tuple, label: str, reverse=()) -> Op:
    """CHK8/CHK9: adds ``out_col``, per-subscale means of answered items (reverse-scored items as
    ``lo + hi - v``), normalised to 0-10, and their mean as the total; NULL without an answer map.

    Each step is a projection of its own: first the items, each looked up once, then sums and
    counts, then means, then the struct, so no step repeats the expressions of the one before.
    """
    lo, hi = rng

    def op(df: DataFrame) -> DataFrame:
        m, kept = F.col(map_col), df.columns

        def item(key: str) -> Column:
            v = F.try_element_at(m, F.lit(key)).cast("double")
            return F.lit(float(hi + lo)) - v if key in reverse else v
        keys = {name: [f"_{out_col}_{k}" for k in items] for name, items in subscales}
        out = df.withColumns({c: item(k) for name, items in subscales for c, k in zip(keys[name], items)})
        out = out.select(*kept, *[x for name, _ in subscales for x in (
            _total([F.col(c) for c in keys[name]]).alias(f"_{out_col}_{name}_sum"),
            _answered([F.col(c) for c in keys[name]]).alias(f"_{out_col}_{name}_n"))])
        sums = {name: (F.col(f"_{out_col}_{name}_sum"), F.col(f"_{out_col}_{name}_n")) for name, _ in subscales}
        out = out.withColumns({f"_{out_col}_{name}_mean": F.when(n > 0, total / n) for name, (total, n) in sums.items()})
        means = [F.col(f"_{out_col}_{name}_mean") for name, _ in subscales]
        out = out.withColumns({f"_{out_col}_sum": _total(means), f"_{out_col}_n": _answered(means)})
        n_means = F.col(f"_{out_col}_n")
        out = out.withColumn(f"_{out_col}_mean", F.when(n_means > 0, F.col(f"_{out_col}_sum") / n_means))
        subs = F.map_from_arrays(
            F.array(*[F.lit(name) for name, _ in subscales]),
            F.array(*[_mean_struct(mean, sums[name][1], lo, hi) for mean, (name, _) in zip(means, subscales)]))
        total = _mean_struct(F.col(f"_{out_col}_mean"), sum((n for _, n in sums.values()), F.lit(0)), lo, hi)
        st = F.struct(F.lit(label).alias("scale"), F.lit(sum(len(items) for _, items in subscales)).alias("item_count"),
                      subs.alias("subscales"), total.alias("total"))
        return out.select(*kept, F.when(m.isNotNull(), st).alias(out_col))
    return op


def with_scales() -> Op:
    """CHK10: ``bat12_scores``, ``olbi_scores`` and ``burnout_scales`` struct(bat12, olbi); NULL when neither taken."""
    def op(df: DataFrame) -> DataFrame:
        scales = (("bat12_responses", "bat12_scores", BAT12_SUBSCALES, BAT12_RANGE, "BAT-12", ()),
                  ("olbi_responses", "olbi_scores", OLBI_SUBSCALES, OLBI_RANGE, "OLBI", OLBI_REVERSE_ITEMS))
        out = df
        for map_col, out_col, *how in scales:
            out = out.transform(scale_score(map_col, out_col, *how)) if map_col in df.columns else out.withColumn(out_col, F.lit(None))
        both_null = F.col("bat12_scores").isNull() & F.col("olbi_scores").isNull()
        return out.withColumn("burnout_scales", F.when(~both_null, F.struct(
            F.col("bat12_scores").alias("bat12"), F.col("olbi_scores").alias("olbi"))))
    return op


def score_record() -> Column:
    """SNK9: the score as a nested record with the serialisation rounding."""
    return F.struct(
        F.round("score", 1).alias("score"), F.col("risk_level"),
        F.struct(F.round("body_score", 1).alias("body"), F.round("mind_score", 1).alias("mind"),
                 F.round("life_score", 1).alias("life")).alias("dimensions"),
        F.col("dominant_dimension"), F.round("compound_multiplier", 2).alias("compound_multiplier"),
        F.col("interaction_pairs"))
