"""Review and forum exports: hand cases, files, missing columns, copies."""

import hashlib

from pyspark.sql import functions as F

from wellspring.operators.normalize import infer_company, parse_review_date, rename_lower, title_is_warehouse
from wellspring.operators.reports import stage_counter
from wellspring.operators.reviews import channel_posts, company_reviews, merge_posts, review_records, topic_posts
from wellspring.sources.specs import load_export, load_posts

REVIEW = "row long, ` Firm` string, date_review string, job_title string, Headline string, pros string, cons string, overall_rating string"
LONG = "a text that is long enough to be kept here"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_review_record_by_hand(spark):
    raw = spark.createDataFrame([(1, " Acme Ltd ", "Jul 4, 2021", "Picker", "Fine", "write to me@mail.example or www.site.example",
                                  "call 555 123 4567 89 now", "4.5")], REVIEW)
    r = one(raw.transform(review_records(source="s", source_file="f")))
    pros, cons = "write to [EMAIL] or [URL]", "call [PHONE] now"
    assert r.text == f"Fine\nPROS: {pros}\nCONS: {cons}"
    assert r.title == "Fine" and r.type == "review" and r.source == "s" and r.source_file == "f" and r.channel == "" == r.author
    assert r.firm_id == hashlib.sha256(b"acme ltd").hexdigest()[:12] and r.location == "" and "firm" not in r.asDict()
    assert r.id == hashlib.sha256(f"Acme Ltd|Jul 4, 2021|Picker|Fine|{pros}|{cons}".encode()).hexdigest()[:16]
    assert str(r.created_utc) == "2021-07-04 00:00:00" and r.overall_rating == 4.5 and r.culture_values is None


def test_firm_and_location_on_request(spark):
    raw = spark.createDataFrame([("Acme", "Town", LONG, "", "")], "firm string, location string, headline string, pros string, cons string")
    r = one(raw.transform(review_records(keep_firm=True, keep_location=True, salt="x")))
    assert (r.firm, r.location) == ("Acme", "Town") and r.firm_id == hashlib.sha256(b"xacme").hexdigest()[:12]
    assert one(raw.drop("firm").transform(review_records(keep_firm=True))).firm_id == ""


def test_nulls_short_texts_copies_and_order(spark):
    rows = [(3, None, None, None, None, LONG, None, "2"), (1, None, None, None, None, LONG, None, "x"),
            (2, None, None, None, "short", None, None, "1"), (4, None, None, None, "nan", "none", "None", "1"),
            (5, None, None, None, None, None, None, None)]
    raw = spark.createDataFrame(rows, REVIEW)
    r = one(raw.transform(review_records(order=["row"])))
    assert r.text == "PROS: " + LONG and r.overall_rating is None  # row 1 came first
    assert one(raw.transform(review_records())).text == r.text  # without an order: some one row, the least
    assert raw.limit(0).transform(review_records(order=["row"])).count() == 0
    assert raw.drop("pros").transform(review_records(order=["row"])).count() == 0
    assert set(raw.transform(review_records(order=["row"])).columns) == set(raw.drop("pros").transform(review_records()).columns)


def test_redaction_is_not_repeated_for_the_length_filter(spark):
    raw = spark.createDataFrame([], REVIEW)
    plan = raw.transform(review_records())._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (length" not in plan and plan.count("[PHONE]") <= 2


def test_dates_in_each_format(spark):
    cases = {"2020-02-03": "2020-02-03 00:00:00", "2020-02-03 04:05:06": "2020-02-03 04:05:06", "Feb 3, 2020": "2020-02-03 00:00:00",
             "02/13/2020": "2020-02-13 00:00:00", "13/02/2020": "2020-02-13 00:00:00", "soon": "None", None: "None"}
    df = spark.createDataFrame([(k,) for k in cases], "d string").select("d", parse_review_date(F.col("d")).alias("t"))
    assert {r.d: str(r.t) for r in df.collect()} == cases


def test_names_that_clash_after_lowering(spark):
    df = spark.createDataFrame([("a", "b", "c")], "` Firm` string, location string, Other string")
    assert rename_lower(df, {"firm": "company_name"}).columns == ["company_name", "location", "other"]
    twice = spark.createDataFrame([("a", "b")], ["x ", " x"])
    assert one(rename_lower(twice, {})).asDict() == {"x": "a"}


def test_companies_and_roles(spark):
    cases = {"I work at amazon": "Amazon", "amazon or UPS": "UPS", "ups and downs at Target": "Target", "startups": "Various",
             "sam's club": "Walmart", "the post office": "USPS", None: "Various", "UPS, then fed ex": "FedEx"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", infer_company(F.col("t")).alias("c"))
    assert {r.t: r.c for r in df.collect()} == cases
    jobs = {"Tier 1 Associate": True, "AFC lead": True, "Engineer": False, "": False, None: False}
    df = spark.createDataFrame([(k,) for k in jobs], "t string").select("t", title_is_warehouse(F.col("t")).alias("w"))
    assert {r.t: r.w for r in df.collect()} == jobs


def test_company_reviews(spark):
    schema = "row long, Firm string, headline string, pros string, cons string, date_review string, overall_rating string, odd string"
    rows = [(2, "Amazon.com", "Good place", "pay", None, "2020-01-01", "3", "second"), (1, "WALMART", "Good place", "pay", "", "soon", "no", "first"),
            (3, None, LONG, None, None, None, None, None), (4, "Acme", LONG, None, None, None, None, None), (5, "ups", "x", None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    r = one(df.transform(company_reviews(order=["row"])))
    assert r.text == "Good place Pros: pay" and r.review_id == "co_" + hashlib.md5(r.text.encode()).hexdigest()[:12]
    assert (r.company_name, r.rating_date, r.rating_overall, r.odd) == ("WALMART", None, None, "first")
    assert (r.employee_job_title, r.employee_status, r.subreddit, r.is_warehouse) == ("Unknown", "Unknown", None, None)
    assert df.transform(company_reviews(companies=None, order=["row"])).count() == 2  # LONG twice is one row
    assert df.limit(0).transform(company_reviews()).count() == 0


def test_channel_posts(spark):
    rows = [(1, "Title", LONG, "1577836800"), (2, None, None, "x"), (3, "T", None, None), (4, "[deleted]", "[removed]", None)]
    df = spark.createDataFrame(rows, "row long, title string, selftext string, created_utc string")
    r = one(df.transform(channel_posts("work")))
    assert (r.text, r.subreddit, str(r.rating_date)) == (f"Title. {LONG}", "work", "2020-01-01 00:00:00")
    only = spark.createDataFrame([("[Deleted]",), ("",), (".",), (None,), ("x",)], "title string")
    assert [x.text for x in only.transform(channel_posts("work", min_length=0)).collect()] == ["x"]
    assert spark.createDataFrame([(1,)], "row long").transform(channel_posts("work")).count() == 0


def test_topic_posts(spark):
    with_channel = spark.createDataFrame([("Jobs", LONG), ("cats", LONG + " work"), (None, LONG), ("jobs", "short"), ("jobs", None)],
                                         "Subreddit string, body string")
    r = one(with_channel.transform(topic_posts()))
    assert (r.subreddit, r.text, r.rating_date) == ("jobs", LONG, None)
    without = spark.createDataFrame([(LONG + " about my BOSS",), (LONG,), (None,)], "comment string")
    r = one(without.transform(topic_posts()))
    assert r.subreddit == "forum_topics" and r.text.endswith("BOSS")
    merged = merge_posts([without.transform(topic_posts()), without.transform(topic_posts(default_channel="other"))])
    assert one(merged).subreddit == "forum_topics"  # the first frame's


def test_exports_from_files(spark, tmp_path):
    csv = tmp_path / "csv"
    csv.mkdir()
    (csv / "a.csv").write_bytes(f'headline,pros,cons\n"caf\xe9, {LONG}",x,y\n'.encode("latin-1"))
    (csv / "b.csv").write_text(f'headline,pros,cons\n"thé, {LONG}",x,y\nbad,line,with,more,fields\n', encoding="utf-8")
    count, seen = stage_counter("reviews")
    got = load_export(spark, str(csv), review_records(), count)
    assert sorted(r.title for r in got.collect()) == [f"café, {LONG}", f"thé, {LONG}"]
    assert seen.get["rows"] == 2
    assert load_export(spark, str(tmp_path / "none"), review_records()) is None
    spark.createDataFrame([(LONG + " job",)], "text string").write.parquet(str(tmp_path / "posts"))
    posts = load_posts(spark, [(str(tmp_path / "posts"), topic_posts()), (str(tmp_path / "none"), topic_posts())])
    assert posts.count() == 1
    assert load_posts(spark, [(str(tmp_path / "none"), topic_posts())]) is None
