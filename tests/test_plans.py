"""Physical-plan checks: pruning/pushdown reach the scan, no cartesian joins."""
import __spark_entry__ as E

DATA = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_pruned_and_filtered(spark):
    plan = _plan(E.queries()["quality_filtered"](spark, DATA))
    assert "PushedFilters" in plan
    read_schemas = [line for line in plan.split("\n") if "ReadSchema" in line]
    assert read_schemas and all("lang" not in s and "n_chars" not in s for s in read_schemas)


def test_no_cartesian_or_nested_loop_joins(spark):
    for name in ("recommendations", "coverage_report", "cluster_silhouette", "cluster_representatives",
                 "score_trend", "dedup_text", "channel_cap_sample"):
        plan = _plan(E.queries()[name](spark, DATA))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scales_look_each_answer_up_once(spark):
    from wellspring.plans import registry
    for name in ("scale_scores", "recommendations", "top_recommendation"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        for key in [f"bat{i}," for i in range(1, 13)] + [f"olbi{i}," for i in range(1, 17)]:
            assert plan.count(f"_responses, {key}") + plan.count(f"], {key}") <= 1, (name, key)
        assert plan.count("element_at(") < 60
