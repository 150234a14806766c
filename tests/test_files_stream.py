"""File sources/sinks and stream == batch for the keyed trend state."""
import os
import tempfile

from pyspark.sql import functions as F

from wellspring.operators.checkin import with_score
from wellspring.operators.trend import score_trend
from wellspring.sources import files as FS
from wellspring.sources import views as V
from wellspring.streaming.checkins import keyed_trend

DATA = "/root/testdata/sf0.001"


def test_csv_skip_bad_lines(spark):
    d = tempfile.mkdtemp(prefix="ws-csv-")
    p = os.path.join(d, "x.csv")
    with open(p, "w") as fh:
        fh.write('id,text\n1,"ok line"\n2,"too",many\n3\n4,"multi\nline"\n')
    df = FS.read_csv_skip_bad(spark, p, ["id", "text"])
    got = {r.id: r.text for r in df.collect()}
    assert got == {"1": "ok line", "3": None, "4": "multi\nline"}
    assert FS.read_any(spark, os.path.join(d, "missing.csv")).count() == 0


def test_report_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="ws-rep-")
    p = os.path.join(d, "rep.csv")
    with open(p, "w") as fh:
        fh.write("cluster_id,source_counts\n0,\"{'forum': 3, 'reviews': 1}\"\n1,\n")
    df = FS.read_report(spark, p, ["source_counts"])
    got = {r.cluster_id: r.source_counts for r in df.collect()}
    assert got == {"0": {"forum": 3, "reviews": 1}, "1": {}}
    out = os.path.join(d, "out")
    assert FS.write_parquet(df, out) and not FS.write_parquet(df.limit(0), os.path.join(d, "empty"))


def test_keyed_trend_stream_equals_batch(spark):
    scored = V.checkins(spark, DATA, with_answers=False).transform(with_score()) \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    batch = {r.checkin_id: (r.trend, r.consecutive_high_days)
             for r in scored.transform(score_trend()).collect()}
    # the state function on the whole (bounded) test table as one batch
    rows = scored.select("checkin_id", "worker_id", "ts", "score").toPandas()
    from wellspring.streaming.checkins import _trend_state

    class _State:
        exists = hasTimedOut = False
        def update(self, v): pass
        def setTimeoutDuration(self, ms): pass

    got = {}
    for w, g in rows.groupby("worker_id"):
        g = g.sort_values("ts", ascending=False)  # two chunks, the later rows first
        for out in _trend_state((w,), iter([g.iloc[:len(g) // 2], g.iloc[len(g) // 2:]]), _State()):
            for r in out.itertuples(index=False):
                got[r.checkin_id] = (r.trend, r.consecutive_high_days)
    assert got == batch


def test_keyed_trend_drops_state_on_timeout():
    from wellspring.streaming.checkins import _trend_state

    class _Idle:
        exists, hasTimedOut, removed = True, True, False
        def remove(self): self.removed = True

    state = _Idle()
    assert [len(p) for p in _trend_state((1,), iter([]), state)] == [0] and state.removed


def test_guard_survives_column_pruning(spark):
    import pytest
    from wellspring.operators.filters import assert_allowed_sources, guard_sources
    df = spark.createDataFrame([("1", "forum"), ("2", "video"), ("3", None)], "id string, source string")
    guarded = df.transform(guard_sources(["forum"]))
    with pytest.raises(Exception, match="source not allowed"):
        guarded.select("id").collect()
    with pytest.raises(Exception, match="source not allowed"):
        guarded.count()
    assert df.filter("id = 1").transform(guard_sources(["forum"])).count() == 1
    with pytest.raises(ValueError, match="2 rows"):
        assert_allowed_sources(df, ["forum"])


def test_csv_long_lines_are_skipped_without_columns(spark):
    p = os.path.join(tempfile.mkdtemp(prefix="ws-csv-"), "a.csv")
    with open(p, "w") as fh:
        fh.write("id,text\n1,ok\n2,too,many\n3\n")
    assert sorted((r.id, r.text) for r in FS.read_any(spark, p).collect()) == [("1", "ok"), ("3", None)]


def test_large_lexicon_keeps_its_words(spark):
    import pytest
    from wellspring.operators.sentiment import valence_compound
    words = [(f"w{i}", 1.0) for i in range(5000)]
    lex = spark.createDataFrame(words, "word string, valence double")
    df = spark.createDataFrame([("a", "w1 W2 x"), ("b", None)], "id string, text string")
    got = {r.id: r.compound for r in df.transform(valence_compound(lex)).collect()}
    assert got["b"] == 0 and abs(got["a"] - 2 / 19 ** 0.5) < 1e-12
    with pytest.raises(ValueError):
        df.transform(valence_compound(lex.union(lex.limit(1))))
