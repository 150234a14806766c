"""Check-in scoring against hand-derived goldens."""
import pytest
from pyspark.sql import functions as F

from wellspring.operators.checkin import split_valid, validation_errors, with_scales, with_score
from wellspring.sources import views as V

COLS = ("checkin_id long, physical_worn_down int, pain_soreness int, mentally_drained int, "
        "sleep_quality int, work_stress int, shift_safety_energy string, time_available_min int, "
        "setting string, bat12_responses map<string,int>, olbi_responses map<string,int>")


def _frame(spark, rows):
    return spark.createDataFrame(rows, COLS)


def test_high_and_low_checkins(spark):
    rows = [(1, 9, 8, 9, 1, 9, "no", 10, "break_room", None, None),
            (2, 1, 1, 1, 9, 1, "yes", 10, "break_room", None, None)]
    out = {r.checkin_id: r for r in _frame(spark, rows).transform(with_score()).collect()}
    hi, lo = out[1], out[2]
    assert hi.score == pytest.approx(100.0)
    assert hi.risk_level == "critical" and hi.dominant_dimension == "life"
    assert hi.interaction_pairs == ["body+mind+life"] and hi.compound_multiplier == pytest.approx(1.25)
    assert lo.score == pytest.approx(8.4166667, rel=1e-6)
    assert lo.risk_level == "low" and lo.dominant_dimension == "body"
    assert lo.compound_multiplier == pytest.approx(1.0) and lo.interaction_pairs == []


def test_risk_band_edges(spark):
    from wellspring.operators.checkin import risk_level
    df = spark.createDataFrame([(x,) for x in (0.0, 29.99, 30.0, 54.99, 55.0, 74.99, 75.0, 100.0)], "s double")
    got = [r[0] for r in df.select(risk_level(F.col("s"))).collect()]
    assert got == ["low", "low", "moderate", "moderate", "high", "high", "critical", "critical"]


def test_scales_goldens(spark):
    bat = {f"bat{i}": 4 for i in range(1, 13)}
    olbi = {f"olbi{i}": 3 for i in range(1, 17)}
    rows = [(1, 0, 0, 0, 10, 0, "yes", 5, "home", bat, olbi), (2, 0, 0, 0, 10, 0, "yes", 5, "home", None, None)]
    out = {r.checkin_id: r for r in _frame(spark, rows).transform(with_scales()).collect()}
    b = out[1].bat12_scores
    assert b.total.normalized_0_10 == pytest.approx(7.5) and b.total.n_items == 12
    o = out[1].olbi_scores
    assert o.subscales["exhaustion"].normalized_0_10 == pytest.approx(5.0)
    assert o.subscales["disengagement"].normalized_0_10 == pytest.approx(5.0)
    assert out[2].burnout_scales is None


def test_partial_scale_and_validation(spark):
    bat = {"bat1": 5, "bat2": 1}
    rows = [(1, 11, 0, 0, 10, 0, "maybe", 7, "moon", bat, None)]
    df = _frame(spark, rows)
    errs = df.select(validation_errors(df).alias("e")).first().e
    assert "physical_worn_down must be 0-10, got 11" in errs
    assert "shift_safety_energy must be yes/somewhat/no" in errs
    assert "time_available_min must be 5, 10, or 15" in errs
    assert "Missing BAT-12 item: bat3" in errs and len([e for e in errs if e.startswith("Missing")]) == 10
    valid, bad = split_valid(df)
    assert valid.count() == 0 and bad.count() == 1
    s = df.transform(with_scales()).first().bat12_scores
    assert s.subscales["exhaustion"].raw_mean == pytest.approx(3.0) and s.subscales["exhaustion"].n_items == 2
    assert s.subscales["mental_distance"].raw_mean is None


def test_a_filter_on_errors_makes_each_answer_map_a_few_times_only(spark):
    rows = [(i, i + 7, None) for i in range(40)]
    checkins = V.checkin_projection(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp"))
    valid, bad = split_valid(checkins)
    plan = valid.select("checkin_id")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("map_from_entries(") <= 4  # the filter below the projection has one for each set of answers
    want = {i: [f"Missing BAT-12 item: bat{k}" for k in range(1, 13) if (i + k) % 17 == 0]
            + [f"Missing OLBI item: olbi{k}" for k in range(1, 17) if (i + k) % 19 == 0] for i, _, _ in rows}
    assert {r.checkin_id for r in valid.collect()} == {i for i, e in want.items() if not e}
    assert {r.checkin_id: r.errors for r in bad.collect()} == {i: e for i, e in want.items() if e}


def test_scale_values_out_of_range_and_null(spark):
    df = _frame(spark, [(1, 1, 0, 0, 10, 0, "yes", 5, "home", {"bat1": 9, "bat2": None, **{f"bat{i}": 3 for i in range(3, 13)}}, None)])
    assert df.select(validation_errors(df).alias("e")).first().e == ["bat1 must be 1-5, got 9", "bat2 must be 1-5, got None"]
