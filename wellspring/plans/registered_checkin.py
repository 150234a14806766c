"""Registered check-in queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checkin import validation_errors
from ..operators.recommend import fallback_track, recommend, top_option
from ..operators.trend import scale_cadence, score_trend, trend_features, weekly_extended_due
from ..sources import dims as D
from ..sources import views as V
from . import sqltext as S
from .checkins import score_checkins

R = 6  # decimals for doubles in both twins


def _r(c, n=R):
    if isinstance(c, str):
        return F.round(F.col(c), n).alias(c)
    return F.round(c, n)


# ------------------------------------------------------------ SQL building
def scored_sql() -> str:
    """CTEs ``checkins`` -> ``scored`` (dimensions, score, risk, dominant)."""
    return V.ORACLE_CTES["checkins"] + """,
d1 AS (SELECT *,
    (physical_worn_down + pain_soreness + (10 - sleep_quality)) / 3 AS body_raw,
    (mentally_drained + work_stress + CASE shift_safety_energy WHEN 'yes' THEN 0 WHEN 'somewhat' THEN 4
       WHEN 'no' THEN 8 ELSE 4 END) / 3 AS mind_raw
  FROM checkins),
d2 AS (SELECT *, CASE WHEN 10 - sleep_quality >= 6 THEN least(CAST(10.0 AS DOUBLE), ((body_raw + mind_raw) / 2) * CAST(1.2 AS DOUBLE))
                      ELSE (body_raw + mind_raw) / 2 END AS life_raw FROM d1),
d3 AS (SELECT *, greatest(0.0, least(100.0, body_raw * 10)) AS body_score,
                 greatest(0.0, least(100.0, mind_raw * 10)) AS mind_score,
                 greatest(0.0, least(100.0, life_raw * 10)) AS life_score FROM d2),
d4 AS (SELECT *, body_score > 55 AS eb, mind_score > 55 AS em, life_score > 55 AS el,
    body_score * CAST(0.40 AS DOUBLE) + mind_score * CAST(0.35 AS DOUBLE) + life_score * CAST(0.25 AS DOUBLE) AS base_score FROM d3),
d5 AS (SELECT *,
    CASE WHEN eb AND em AND el THEN CAST(1.25 AS DOUBLE)
         ELSE greatest(CAST(1.0 AS DOUBLE), CASE WHEN eb AND em THEN CAST(1.15 AS DOUBLE) ELSE 1.0 END,
                       CASE WHEN eb AND el THEN CAST(1.12 AS DOUBLE) ELSE 1.0 END,
                       CASE WHEN em AND el THEN CAST(1.10 AS DOUBLE) ELSE 1.0 END) END AS compound_multiplier,
    CASE WHEN eb AND em AND el THEN 'body+mind+life'
         ELSE concat_ws(',', CASE WHEN eb AND em THEN 'body+mind' END, CASE WHEN eb AND el THEN 'body+life' END,
                        CASE WHEN em AND el THEN 'mind+life' END) END AS pairs
  FROM d4),
scored AS (SELECT *, least(CAST(100.0 AS DOUBLE), base_score * compound_multiplier) AS score,
    CASE WHEN body_score >= mind_score AND body_score >= life_score THEN 'body'
         WHEN mind_score >= life_score THEN 'mind' ELSE 'life' END AS dominant_dimension
  FROM d5)"""


def risk_sql(expr: str) -> str:
    return (f"CASE WHEN {expr} >= 0 AND {expr} < 30 THEN 'low' WHEN {expr} >= 30 AND {expr} < 55 THEN 'moderate' "
            f"WHEN {expr} >= 55 AND {expr} < 75 THEN 'high' ELSE 'critical' END")


BAT_SUBS = [("exhaustion", 1, 3), ("mental_distance", 4, 6), ("cognitive_impairment", 7, 9),
            ("emotional_impairment", 10, 12)]
OLBI_EXH = [2, 4, 5, 8, 10, 12, 14, 16]
OLBI_REV = [2, 3, 4, 6, 8, 9, 11, 12]


def scales_sql() -> str:
    """CTEs over ``answers`` -> ``scales`` (one row per check-in)."""
    bat_case = " ".join(f"WHEN item BETWEEN {a} AND {b} THEN {i}" for i, (_, a, b) in enumerate(BAT_SUBS))
    rev = ", ".join(str(i) for i in OLBI_REV)
    exh = ", ".join(str(i) for i in OLBI_EXH)
    bat_cols = ",\n    ".join(
        f"max(CASE WHEN sub = {i} THEN m END) AS bat_{n}_raw, max(CASE WHEN sub = {i} THEN n END) AS bat_{n}_n"
        for i, (n, _, _) in enumerate(BAT_SUBS))
    return V.ORACLE_CTES["answers"] + f""",
ans AS (SELECT a.* FROM answers a JOIN checkins c USING (checkin_id)),
subs AS (SELECT checkin_id, s.sub FROM checkins CROSS JOIN (SELECT unnest(range(0, 4)) AS sub) s),
bat_items AS (SELECT checkin_id, CASE {bat_case} END AS sub, CAST(scale_a AS DOUBLE) AS v
  FROM ans WHERE item <= 12 AND scale_a IS NOT NULL),
bat_sub AS (SELECT s.checkin_id, s.sub, avg(b.v) AS m, count(b.v) AS n
  FROM subs s LEFT JOIN bat_items b ON s.checkin_id = b.checkin_id AND s.sub = b.sub GROUP BY s.checkin_id, s.sub),
bat_w AS (SELECT checkin_id, {bat_cols},
    list(m ORDER BY sub) FILTER (WHERE m IS NOT NULL) AS means, sum(n) AS bat_items FROM bat_sub GROUP BY checkin_id),
olbi_items AS (SELECT checkin_id, CASE WHEN item IN ({exh}) THEN 0 ELSE 1 END AS sub,
    CAST(CASE WHEN item IN ({rev}) THEN 5 - scale_b ELSE scale_b END AS DOUBLE) AS v
  FROM ans WHERE scale_b IS NOT NULL),
olbi_sub AS (SELECT s.checkin_id, s.sub, avg(o.v) AS m, count(o.v) AS n
  FROM (SELECT * FROM subs WHERE sub < 2) s LEFT JOIN olbi_items o ON s.checkin_id = o.checkin_id AND s.sub = o.sub
  GROUP BY s.checkin_id, s.sub),
olbi_w AS (SELECT checkin_id, max(CASE WHEN sub = 0 THEN m END) AS olbi_exhaustion_raw,
    max(CASE WHEN sub = 1 THEN m END) AS olbi_disengagement_raw,
    list(m ORDER BY sub) FILTER (WHERE m IS NOT NULL) AS means, sum(n) AS olbi_items FROM olbi_sub GROUP BY checkin_id),
scales AS (SELECT b.*, o.olbi_exhaustion_raw, o.olbi_disengagement_raw, o.olbi_items,
    CASE WHEN len(b.means) > 0 THEN list_reduce(b.means, lambda x, y: x + y) / len(b.means) END AS bat_total_raw,
    CASE WHEN len(o.means) > 0 THEN list_reduce(o.means, lambda x, y: x + y) / len(o.means) END AS olbi_total_raw
  FROM bat_w b JOIN olbi_w o USING (checkin_id))"""


def norm_sql(expr: str, lo: int, hi: int) -> str:
    return f"greatest(0.0, least(10.0, (({expr} - {lo}) / {hi - lo}) * 10.0))"


# ------------------------------------------------------------ scores (CHK1-7)
def q_checkin_scores(spark: SparkSession, data_dir: str) -> DataFrame:
    s = score_checkins(V.checkins(spark, data_dir, with_answers=False))
    return s.select("checkin_id", "worker_id", _r("body_score"), _r("mind_score"), _r("life_score"),
                    _r("base_score"), _r("compound_multiplier"),
                    F.array_join("interaction_pairs", ",").alias("pairs"), _r("score"), "risk_level",
                    "dominant_dimension", _r(F.round("score", 1), 1).alias("score_1dp"))


def oracle_checkin_scores() -> str:
    return f"""WITH {scored_sql()}
SELECT checkin_id, worker_id, {S.rnd('body_score', R)} AS body_score, {S.rnd('mind_score', R)} AS mind_score,
  {S.rnd('life_score', R)} AS life_score, {S.rnd('base_score', R)} AS base_score,
  {S.rnd('compound_multiplier', R)} AS compound_multiplier, pairs, {S.rnd('score', R)} AS score,
  {risk_sql('score')} AS risk_level, dominant_dimension, {S.rnd('score', 1)} AS score_1dp
FROM scored"""


# ------------------------------------------------------- validation (GRD2-3)
def q_checkin_validation(spark: SparkSession, data_dir: str) -> DataFrame:
    c = V.checkins(spark, data_dir)
    errs = validation_errors(c)
    return c.select("checkin_id", F.size(errs).alias("n_errors"), F.array_join(errs, "; ").alias("errors"))


def oracle_checkin_validation() -> str:
    return f"""WITH {V.ORACLE_CTES['checkins']}, {V.ORACLE_CTES['answers']},
miss AS (
  SELECT a.checkin_id, a.item, 0 AS part, 'Missing BAT-12 item: bat' || a.item AS msg
  FROM answers a JOIN checkins c USING (checkin_id) WHERE a.item <= 12 AND a.scale_a IS NULL
  UNION ALL
  SELECT a.checkin_id, a.item, 1, 'Missing OLBI item: olbi' || a.item
  FROM answers a JOIN checkins c USING (checkin_id) WHERE a.scale_b IS NULL)
SELECT c.checkin_id, count(m.msg) AS n_errors, coalesce(string_agg(m.msg, '; ' ORDER BY m.part, m.item), '') AS errors
FROM checkins c LEFT JOIN miss m USING (checkin_id) GROUP BY c.checkin_id"""


# ------------------------------------------------------------ scales (CHK8-10)
def q_scale_scores(spark: SparkSession, data_dir: str) -> DataFrame:
    s = score_checkins(V.checkins(spark, data_dir))
    bat, olbi = F.col("bat12_scores"), F.col("olbi_scores")
    cols = [F.col("checkin_id")]
    for name, _, _ in BAT_SUBS:
        sub = bat["subscales"][name]
        cols += [_r(sub["raw_mean"]).alias(f"bat_{name}_raw"), _r(sub["normalized_0_10"]).alias(f"bat_{name}_norm")]
    cols += [_r(bat["total"]["raw_mean"]).alias("bat_total_raw"), _r(bat["total"]["normalized_0_10"]).alias("bat_total_norm"),
             bat["total"]["n_items"].alias("bat_items")]
    for name in ("exhaustion", "disengagement"):
        sub = olbi["subscales"][name]
        cols += [_r(sub["raw_mean"]).alias(f"olbi_{name}_raw"), _r(sub["normalized_0_10"]).alias(f"olbi_{name}_norm")]
    cols += [_r(olbi["total"]["raw_mean"]).alias("olbi_total_raw"),
             _r(olbi["total"]["normalized_0_10"]).alias("olbi_total_norm"), olbi["total"]["n_items"].alias("olbi_items")]
    return s.select(*cols)


def oracle_scale_scores() -> str:
    cols = []
    for name, _, _ in BAT_SUBS:
        cols += [f"{S.rnd(f'bat_{name}_raw', R)} AS bat_{name}_raw",
                 f"{S.rnd(norm_sql(f'bat_{name}_raw', 1, 5), R)} AS bat_{name}_norm"]
    cols += [f"{S.rnd('bat_total_raw', R)} AS bat_total_raw", f"{S.rnd(norm_sql('bat_total_raw', 1, 5), R)} AS bat_total_norm",
             "CAST(bat_items AS INTEGER) AS bat_items"]
    for name in ("exhaustion", "disengagement"):
        cols += [f"{S.rnd(f'olbi_{name}_raw', R)} AS olbi_{name}_raw",
                 f"{S.rnd(norm_sql(f'olbi_{name}_raw', 1, 4), R)} AS olbi_{name}_norm"]
    cols += [f"{S.rnd('olbi_total_raw', R)} AS olbi_total_raw", f"{S.rnd(norm_sql('olbi_total_raw', 1, 4), R)} AS olbi_total_norm",
             "CAST(olbi_items AS INTEGER) AS olbi_items"]
    return f"""WITH {V.ORACLE_CTES['checkins']}, {scales_sql()}
SELECT checkin_id, {', '.join(cols)} FROM scales"""


# -------------------------------------------------------- trend (WIN1-2, WIN3-5)
def _history_sql() -> str:
    return f"""{scored_sql()},
h AS (SELECT *, row_number() OVER w AS rn,
    list(score) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS recent7,
    list(score) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS recent6,
    max(CASE WHEN score <= 60 THEN rn0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS calm_before,
    max(CASE WHEN score <= 60 THEN rn0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS calm_upto
  FROM (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY ts, checkin_id) AS rn0 FROM scored)
  WINDOW w AS (PARTITION BY worker_id ORDER BY ts, checkin_id)),
h2 AS (SELECT *,
    CASE WHEN coalesce(len(recent7), 0) > 0 THEN list_reduce(list_reverse(recent7), lambda x, y: x + y) / len(recent7) END AS avg7,
    CASE WHEN coalesce(len(recent6), 0) > 0 THEN list_reduce(list_reverse(recent6), lambda x, y: x + y) / len(recent6) END AS avg6
  FROM h)"""


def q_score_trend(spark: SparkSession, data_dir: str) -> DataFrame:
    s = score_checkins(V.checkins(spark, data_dir, with_answers=False)).transform(score_trend())
    return s.select("checkin_id", "worker_id", _r("score"), "trend", "consecutive_high_days")


def oracle_score_trend() -> str:
    return f"""WITH {_history_sql()}
SELECT checkin_id, worker_id, {S.rnd('score', R)} AS score,
  CASE WHEN rn - 1 >= 2 THEN (CASE WHEN score > avg7 + 8 THEN 'worsening' WHEN score < avg7 - 8 THEN 'improving' ELSE 'stable' END) END AS trend,
  CASE WHEN rn - 1 >= 2 THEN CAST((rn - 1) - coalesce(calm_before, 0) + CASE WHEN score > 60 THEN 1 ELSE 0 END AS INTEGER) ELSE 0 END AS consecutive_high_days
FROM h2"""


def q_trend_features(spark: SparkSession, data_dir: str) -> DataFrame:
    s = score_checkins(V.checkins(spark, data_dir, with_answers=False)).transform(trend_features())
    return s.select("checkin_id", "trend_label", F.col("streak_days").cast("int").alias("streak_days"),
                    "alert_flag", "peak_season_context", "window_avg", "window_days")


def oracle_trend_features() -> str:
    return f"""WITH {_history_sql()}
SELECT checkin_id,
  CASE WHEN avg6 IS NULL THEN 'stable' WHEN score > avg6 + 8 THEN 'worsening' WHEN score < avg6 - 8 THEN 'improving' ELSE 'stable' END AS trend_label,
  CAST(rn - coalesce(calm_upto, 0) AS INTEGER) AS streak_days,
  rn - coalesce(calm_upto, 0) >= 3 AS alert_flag,
  CASE worker_type WHEN 'warehouse' THEN month(ts) IN (10, 11, 12, 1) WHEN 'retail' THEN month(ts) IN (11, 12, 1) ELSE false END AS peak_season_context,
  {S.rnd('avg6', 1)} AS window_avg, CAST(coalesce(len(recent6), 0) AS INTEGER) AS window_days
FROM h2"""


# ---------------------------------------------------------------- cadence (WIN6)
def q_scale_cadence(spark: SparkSession, data_dir: str) -> DataFrame:
    s = (score_checkins(V.checkins(spark, data_dir)).transform(trend_features())
         .transform(scale_cadence()))
    return s.select("checkin_id", "scale_a_due", "scale_b_due", "days_since_scale_b")


def oracle_scale_cadence() -> str:
    return f"""WITH {_history_sql()},
c2 AS (SELECT *, rn - coalesce(calm_upto, 0) AS streak,
    lag(ts) OVER (PARTITION BY worker_id ORDER BY ts, checkin_id) AS prev_ts FROM h2)
SELECT checkin_id, streak >= 3 OR score > 65 AS scale_a_due,
  streak >= 5 AND coalesce(datediff('day', CAST(prev_ts AS DATE), CAST(ts AS DATE)) >= 14, true) AS scale_b_due,
  CAST(datediff('day', CAST(prev_ts AS DATE), CAST(ts AS DATE)) AS INTEGER) AS days_since_scale_b
FROM c2"""


# ----------------------------------------------------------- weekly (WIN7)
def q_weekly_extended_due(spark: SparkSession, data_dir: str) -> DataFrame:
    s = score_checkins(V.checkins(spark, data_dir, with_answers=False))
    w = s.transform(weekly_extended_due())
    return w.select("worker_id", F.date_format("week.start", "yyyy-MM-dd HH:mm:ss").alias("week_start"),
                    _r("week_avg"), "checkins", "extended_due")


def oracle_weekly_extended_due() -> str:
    return f"""WITH {scored_sql()},
wk AS (SELECT *, TIMESTAMP '1970-01-01' + to_days(CAST(floor(epoch(ts) / 604800) AS BIGINT) * 7) AS week_start FROM scored)
SELECT worker_id, {S.fmt_ts('week_start')} AS week_start, {S.rnd('avg(score)', R)} AS week_avg,
  count(*) AS checkins, avg(score) > 60 AS extended_due
FROM wk GROUP BY worker_id, week_start"""


# ------------------------------------------------------ recommendations (CHK13)
def _reco_input(spark: SparkSession, data_dir: str) -> DataFrame:
    return score_checkins(V.checkins(spark, data_dir))


def q_recommendations(spark: SparkSession, data_dir: str) -> DataFrame:
    return _reco_input(spark, data_dir).transform(recommend()).select(
        "checkin_id", "rank", "category_id", "intervention_id", "duration_min", "available",
        "is_relevant", "relevance_reason", "unavailable_reason")


def catalog_sql() -> str:
    cats = ", ".join(f"({S.q(c)}, {i})" for i, (c, _) in enumerate(D.ACTIVITY_CATEGORIES))
    variants = ", ".join(
        f"({S.q(v)}, {S.q(c)}, {d}, [{', '.join(S.q(b) for b in bf)}], [{', '.join(S.q(x) for x in st)}], {j})"
        for j, (v, c, d, _, _, bf, st) in enumerate(D.ACTIVITY_VARIANTS))
    submap = " UNION ALL ".join(f"SELECT {S.q(k)} AS sub, {S.q(c)} AS cat" for k, cs in D.SUBSCALE_CATEGORY_MAP.items() for c in cs)
    return f"""cats(category_id, category_ord) AS (VALUES {cats}),
variants(intervention_id, category_id, duration_min, best_for, settings, var_ord) AS (VALUES {variants}),
submap AS ({submap})"""


def reco_sql() -> str:
    bat_names = [n for n, _, _ in BAT_SUBS]
    elevated = " UNION ALL ".join(
        [f"SELECT checkin_id, {S.q(n)} AS sub FROM scales WHERE {norm_sql(f'bat_{n}_raw', 1, 5)} >= 6.0" for n in bat_names]
        + [f"SELECT checkin_id, {S.q(n)} FROM scales WHERE {norm_sql(f'olbi_{n}_raw', 1, 4)} >= 6.0"
           for n in ("exhaustion", "disengagement")])
    return f"""{scored_sql()}, {scales_sql()}, {catalog_sql()},
boost AS (SELECT DISTINCT e.checkin_id, m.cat FROM ({elevated}) e JOIN submap m ON e.sub = m.sub),
nboost AS (SELECT checkin_id, count(*) AS nb FROM boost GROUP BY checkin_id),
x AS (SELECT s.checkin_id, s.time_available_min, s.setting, s.dominant_dimension, v.*,
        v.duration_min <= s.time_available_min AND list_contains(v.settings, s.setting) AS fits
      FROM scored s CROSS JOIN variants v),
pc AS (SELECT checkin_id, category_id, any_value(dominant_dimension) AS dom, bool_or(fits) AS available,
        arg_max(intervention_id, duration_min * 1000 - var_ord) FILTER (WHERE fits) AS best_fit,
        arg_min(intervention_id, duration_min * 1000 + var_ord) AS shortest
      FROM x GROUP BY checkin_id, category_id),
pb AS (SELECT pc.*, CASE WHEN available THEN best_fit ELSE shortest END AS intervention_id FROM pc),
pr AS (SELECT pb.checkin_id, pb.category_id, c.category_ord, pb.intervention_id, v.duration_min, pb.available,
        coalesce(list_contains(v.best_for, pb.dom), false) AS dim_match,
        b.cat IS NOT NULL AS scale_match, coalesce(n.nb, 0) AS nb, pb.dom
      FROM pb JOIN variants v ON v.intervention_id = pb.intervention_id JOIN cats c ON c.category_id = pb.category_id
      LEFT JOIN boost b ON b.checkin_id = pb.checkin_id AND b.cat = pb.category_id
      LEFT JOIN nboost n ON n.checkin_id = pb.checkin_id),
rel AS (SELECT *, dim_match OR scale_match OR (dom IS NULL AND nb = 0) AS is_relevant FROM pr),
ranked AS (SELECT *, row_number() OVER (PARTITION BY checkin_id ORDER BY CASE WHEN is_relevant THEN 0 ELSE 1 END,
        CASE WHEN available THEN 0 ELSE 1 END, category_ord) AS rank FROM rel)"""


def oracle_recommendations() -> str:
    return f"""WITH {reco_sql()}
SELECT checkin_id, CAST(rank AS INTEGER) AS rank, category_id, intervention_id, duration_min, available, is_relevant,
  CASE WHEN scale_match AND NOT dim_match THEN 'subscale' WHEN dim_match THEN 'dimension' END AS relevance_reason,
  CASE WHEN NOT available THEN 'Needs ' || duration_min || ' min or different setting' END AS unavailable_reason
FROM ranked"""


def q_top_recommendation(spark: SparkSession, data_dir: str) -> DataFrame:
    s = _reco_input(spark, data_dir).transform(top_option())
    return s.select("checkin_id", "top_category_id", "top_intervention_id",
                    fallback_track(F.col("dominant_dimension")).alias("fallback_track"))


def oracle_top_recommendation() -> str:
    tracks = " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in D.DIM_TO_TRACK.items())
    return f"""WITH {reco_sql()}
SELECT checkin_id, category_id AS top_category_id, intervention_id AS top_intervention_id,
  CASE dom {tracks} ELSE {S.q(D.DEFAULT_TRACK)} END AS fallback_track
FROM ranked WHERE rank = 1"""


# --------------------------------------------------- strain by setting (STR5)
def q_strain_by_setting(spark: SparkSession, data_dir: str) -> DataFrame:
    s = score_checkins(V.checkins(spark, data_dir, with_answers=False))
    return (s.groupBy("setting", F.to_date("ts").alias("day"))
             .agg(F.avg("score").alias("avg_score"), F.count(F.lit(1)).alias("checkins"))
             .select("setting", F.col("day").cast("string").alias("day"), _r("avg_score"), "checkins"))


def oracle_strain_by_setting() -> str:
    return f"""WITH {scored_sql()}
SELECT setting, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {S.rnd('avg(score)', R)} AS avg_score, count(*) AS checkins
FROM scored GROUP BY setting, CAST(ts AS DATE)"""
