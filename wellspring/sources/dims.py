"""Small fixed dimension tables: activity catalog, tracks, personas.

FIXED VALUES: ids, durations, settings, flags, dimension targets and
cluster lists must equal the reference's catalog for equal results; they are
stated plainly below in their natural order. Display prose is not carried.

These tables have a fixed, tiny size (10 variants, 8 tracks, 8 personas), so
they are safe to broadcast or to inline as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: activity categories, in presentation order ---------------
ACTIVITY_CATEGORIES = [
    ("body_sketch", "Body sketch"),
    ("shift_debrief", "Shift debrief"),
    ("sound_reset", "Sound reset"),
    ("three_thing", "3-thing notice"),
    ("quick_challenge", "Quick challenge"),
]

# --- fixed values: activity variants ------------------------------------------
# (id, category, duration_min, needs_audio, needs_writing, best_for, settings)
ACTIVITY_VARIANTS = [
    ("body_sketch_5", "body_sketch", 5, False, False, ["body"], ["break_room", "commute", "home"]),
    ("body_sketch_10", "body_sketch", 10, False, False, ["body"], ["break_room", "home"]),
    ("shift_debrief_5", "shift_debrief", 5, False, True, ["mind"], ["break_room", "commute", "home"]),
    ("shift_debrief_10", "shift_debrief", 10, False, True, ["mind", "life"], ["break_room", "commute", "home"]),
    ("sound_reset_5", "sound_reset", 5, True, False, ["mind", "body"], ["commute", "home"]),
    ("sound_reset_10", "sound_reset", 10, True, False, ["mind", "body"], ["commute", "home"]),
    ("three_thing_5", "three_thing", 5, False, False, ["mind", "life"], ["break_room", "commute", "home"]),
    ("three_thing_10", "three_thing", 10, False, True, ["mind", "life"], ["commute", "home"]),
    ("quick_challenge_5", "quick_challenge", 5, False, False, ["mind"], ["break_room", "home"]),
    ("quick_challenge_10", "quick_challenge", 10, False, True, ["mind", "body"], ["break_room", "home"]),
]

# --- fixed values: elevated subscale -> categories it addresses -------------
SUBSCALE_HIGH = 6.0
SUBSCALE_CATEGORY_MAP = {
    "exhaustion": ["body_sketch", "sound_reset"],
    "mental_distance": ["three_thing", "quick_challenge"],
    "cognitive_impairment": ["sound_reset", "shift_debrief"],
    "emotional_impairment": ["shift_debrief", "three_thing"],
    "disengagement": ["quick_challenge", "three_thing"],
}

# --- fixed values: dominant dimension -> fallback track ----------------------
DIM_TO_TRACK = {"body": "restore", "mind": "ground", "life": "rebalance"}
DEFAULT_TRACK = "restore"

# --- fixed values: tracks (track_id, cluster_ids, [(activity_id, minutes, settings)])
TRACKS = [
    ("restore", [8, 19, 28], [
        ("restore_box_breath", 5, ["break_room", "commute", "home"]),
        ("restore_tension_release", 7, ["break_room", "home"]),
        ("restore_micro_walk", 5, ["break_room"]),
        ("restore_power_rest", 10, ["break_room", "home"])]),
    ("ground", [2, 10, 13, 25], [
        ("ground_sensory_anchor", 5, ["break_room", "commute", "home"]),
        ("ground_thought_distance", 5, ["commute", "home", "break_room"]),
        ("ground_write_release", 5, ["break_room", "home"]),
        ("ground_body_shake", 3, ["break_room", "home"])]),
    ("rebalance", [1, 8], [
        ("rebalance_threshold", 3, ["commute", "home"]),
        ("rebalance_values", 5, ["break_room", "commute", "home"]),
        ("rebalance_exhale_breath", 5, ["home", "commute"])]),
    ("aspire", [3, 19], [
        ("aspire_strengths_moment", 5, ["break_room", "commute", "home"]),
        ("aspire_one_line_vision", 5, ["break_room", "home"]),
        ("aspire_progress_spots", 3, ["commute", "home", "break_room"])]),
    ("steady", [21, 23], [
        ("steady_worry_postpone", 5, ["break_room", "commute", "home"]),
        ("steady_controllables", 5, ["home", "break_room"]),
        ("steady_anchor", 3, ["commute", "home", "break_room"])]),
    ("connect", [9, 11], [
        ("connect_perspective_anchor", 5, ["commute", "home", "break_room"]),
        ("connect_micro_contribution", 5, ["break_room"]),
        ("connect_meaning_map", 7, ["home", "break_room"])]),
    ("thrive", [16, 18], [
        ("thrive_appreciation_note", 3, ["break_room", "home"]),
        ("thrive_strength_spot", 5, ["break_room", "home", "commute"]),
        ("thrive_small_wins", 5, ["home", "break_room"])]),
    ("decompress", [17], [
        ("decompress_empathy_reset", 5, ["break_room", "commute", "home"]),
        ("decompress_sensory_shift", 3, ["break_room"]),
        ("decompress_role_debrief", 5, ["commute", "home"])]),
]

# --- fixed values: personas (persona_id, cluster_ids, default_track_id) ------
PERSONAS = [
    ("overtime_fatigue", [8, 19, 28], "restore"),
    ("manager_friction", [2, 13, 10], "ground"),
    ("career_stagnation", [3, 19], "aspire"),
    ("work_life_imbalance", [1, 8], "rebalance"),
    ("financial_pressure", [21, 23], "steady"),
    ("systemic_frustration", [9, 11], "connect"),
    ("customer_burnout", [17], "decompress"),
    ("toxic_culture", [25, 16], "thrive"),
]


def catalog_df(spark: SparkSession) -> DataFrame:
    """SRC11: one row per activity variant with its category order."""
    cat_ord = {c: i for i, (c, _) in enumerate(ACTIVITY_CATEGORIES)}
    names = dict(ACTIVITY_CATEGORIES)
    rows = [(vid, cat, cat_ord[cat], names[cat], d, a, w, bf, st)
            for vid, cat, d, a, w, bf, st in ACTIVITY_VARIANTS]
    return spark.createDataFrame(rows, "intervention_id string, category_id string, category_ord int, "
                                       "category_name string, duration_min int, needs_audio boolean, "
                                       "needs_writing boolean, best_for array<string>, settings array<string>")


def tracks_df(spark: SparkSession) -> DataFrame:
    """SRC10: tracks with cluster ids and nested activities."""
    rows = [(tid, i, cids, [(aid, i2, m, env) for i2, (aid, m, env) in enumerate(acts)])
            for i, (tid, cids, acts) in enumerate(TRACKS)]
    return spark.createDataFrame(rows, "track_id string, track_ord int, cluster_ids array<int>, "
                                       "activities array<struct<activity_id:string, activity_ord:int, "
                                       "duration_minutes:int, environment:array<string>>>")


def personas_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PERSONAS, "persona_id string, cluster_ids array<int>, default_track_id string")
