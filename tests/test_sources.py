"""Sources by specification: encodings, kinds of files, unions; counts of the corpus job."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from wellspring.plans.corpus import CorpusOptions, build_corpus, write_corpus
from wellspring.sources import specs as SP
from wellspring.sources import views as V

DATA = "/root/testdata/sf0.001"


def write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as fh:
        fh.write(text)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="ws-src-")


def test_each_file_is_read_in_its_encoding(spark, folder):
    write(f"{folder}/a.csv", 'id,text\n1,"naïve café, 漢字"\n2,plain\n')
    write(f"{folder}/b.csv", 'id,text\n3,"très fatigué"\n4,"two\nlines ñ"\n5,too,many\n', "latin-1")
    write(f"{folder}/c.csv", "id,text\n6,ascii only\n", "latin-1")
    files = SP.find_files(spark, folder)
    assert [os.path.basename(f) for f in files] == ["a.csv", "b.csv", "c.csv"]
    assert {os.path.basename(f) for f in SP.invalid_utf8_files(spark, files)} == {"b.csv"}
    got = {r.id: r.text for r in SP.read_csv_by_encoding(spark, files).collect()}
    assert got == {"1": "naïve café, 漢字", "2": "plain", "3": "très fatigué", "4": "two\nlines ñ", "6": "ascii only"}


def test_kinds_are_searched_in_order(spark, folder):
    write(f"{folder}/x.jsonl", '{"id": "j", "text": "json"}\n')
    spark.createDataFrame([("p", "parquet")], "id string, text string").toPandas().to_parquet(f"{folder}/x.parquet")
    write(f"{folder}/_skip.csv", "id,text\nhidden,x\n")
    spec = SP.SourceSpec("x", folder)
    assert [r.id for r in SP.load_source(spark, spec).collect()] == ["j"]
    write(f"{folder}/y.CSV", "id,text\nc,csv\n")
    assert [r.id for r in SP.load_source(spark, spec).collect()] == ["c"]
    assert [r.id for r in SP.load_source(spark, SP.SourceSpec("x", f"{folder}/x.parquet")).collect()] == ["p"]


def test_an_extra_dataset_is_one_more_spec(spark, folder):
    write(f"{folder}/forum_posts_b/posts.csv",
          "id,title,selftext,author,subreddit,score,created_utc,url\na,T,body,me,r/Jobs,12.5,1577836800,u\n")
    write(f"{folder}/extra/d.jsonl", '{"key": "k1", "words": "hello", "when": "2021-02-03T04:05:06Z", "votes": "x"}\n')
    extra = SP.SourceSpec("extra", f"{folder}/extra", "comment", {"key": "id", "words": "text", "when": "created_utc", "votes": "score"})
    out, counts = SP.load_sources(spark, [*SP.forum_specs(folder), extra])
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema).replace("bigint", "long") == SP.FORUM_SCHEMA
    rows = {r.id: r for r in out.withColumn("at", F.date_format("created_utc", "yyyy-MM-dd HH:mm:ss")).collect()}
    assert set(rows) == {"a", "k1"}
    a, k = rows["a"], rows["k1"]
    assert (a.type, a.channel, a.title, a.text, a.score, a.at, a.url) == ("post", "jobs", "T", "body", 12, "2020-01-01 00:00:00", "u")
    assert (k.type, k.channel, k.title, k.text, k.score, k.at, k.url) == ("comment", "", "", "hello", None, "2021-02-03 04:05:06", "")
    assert k.source_file == f"{folder}/extra"
    assert {n: c.get["rows"] for n, c in counts.items()} == {**{n: 0 for n in SP.FIELD_MAPS}, "forum_posts_b": 1, "extra": 1}
    empty, _ = SP.load_sources(spark, [])
    assert empty.count() == 0 and empty.columns == out.columns


def jobs_of(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    out = action()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("other", "other")
    return n, out


def test_corpus_job_counts_its_stages_without_a_job(spark, folder):
    corpus = V.corpus(spark, DATA)
    opt = CorpusOptions(allowlist=[f"src{i}" for i in range(10)])
    plain, _ = jobs_of(spark, "plain", lambda: build_corpus(corpus, opt).write.partitionBy("source").parquet(f"{folder}/plain"))
    counted, rows = jobs_of(spark, "counted", lambda: write_corpus(corpus, opt, f"{folder}/counted"))
    assert counted == plain
    got = {(part, stage): n for part, stage, n in rows}
    posts = corpus.filter("type = 'post'")
    assert got["post", "read"] == posts.count()
    assert got["post", "channels"] == posts.filter(F.col("channel").isin(opt.allowlist)).count()
    assert got["post", "read"] > got["post", "channels"] >= got["post", "quality"] >= got["post", "score"] >= got["post", "dates"] > 0
    written = spark.read.parquet(f"{folder}/counted")
    assert written.count() == sum(got[part, "dates"] for part in ("post", "comment", "review"))
    assert sorted(os.listdir(f"{folder}/counted"))[-2:] == ["source=forum", "source=reviews"]


def test_corpus_job_stops_at_a_foreign_source(spark):
    corpus = V.corpus(spark, DATA)
    opt = CorpusOptions(allowlist=["src1"])
    for source in ("video", None):
        strange = corpus.limit(1).withColumn("source", F.lit(source).cast("string"))
        with pytest.raises(Exception, match="source not allowed"):
            build_corpus(corpus.union(strange), opt).count()
