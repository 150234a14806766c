"""History windows against a brute-force walk of the reference rules."""
import random

from wellspring.operators.trend import score_trend, trend_features


def _scorer_rule(history_newest_first, today):
    if len(history_newest_first) < 2:
        return None, 0
    recent = history_newest_first[:7]
    avg = sum(recent) / len(recent)
    trend = "worsening" if today > avg + 8 else "improving" if today < avg - 8 else "stable"
    c = 0
    for h in history_newest_first:
        if h > 60:
            c += 1
        else:
            break
    return trend, c + (1 if today > 60 else 0)


def _labeler_rule(hist_incl_today):
    current, prior = hist_incl_today[0], hist_incl_today[1:7]
    avg = sum(prior) / len(prior) if prior else None
    trend = "stable"
    if avg is not None:
        trend = "worsening" if current > avg + 8 else "improving" if current < avg - 8 else "stable"
    c = 0
    for s in hist_incl_today:
        if s > 60:
            c += 1
        else:
            break
    return trend, c, len(prior)


def test_trends_equal_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for w in range(6):
        for d in range(rnd.randint(0, 14)):
            rows.append((w * 100 + d, w, f"2024-01-{d + 1:02d} 08:00:00", float(rnd.choice([20, 55, 61, 68, 90, 60, 52]))))
    df = spark.createDataFrame(rows, "checkin_id long, worker_id long, ts string, score double") \
        .selectExpr("checkin_id", "worker_id", "to_timestamp(ts) AS ts", "score", "'general' AS worker_type")
    got = {r.checkin_id: r for r in df.transform(score_trend()).transform(trend_features()).collect()}
    by_worker = {}
    for cid, w, ts, s in rows:
        by_worker.setdefault(w, []).append((ts, cid, s))
    for w, items in by_worker.items():
        items.sort()
        for i, (_, cid, s) in enumerate(items):
            prev = [x[2] for x in items[:i]][::-1]
            t, c = _scorer_rule(prev, s)
            assert got[cid].trend == t and got[cid].consecutive_high_days == c
            lt, lc, ld = _labeler_rule([s] + prev)
            assert got[cid].trend_label == lt and got[cid].streak_days == lc and got[cid].window_days == ld
