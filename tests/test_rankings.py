"""Delivery, owners, and small rules of what is shown."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterlight.operators import rankings as K

T = dt.datetime


def test_delivery_tells_unknown_from_zero(spark):
    rows = [
        (1, "a", T(2024, 1, 1, 10), T(2024, 1, 1, 11), 50.0, False), (2, "a", T(2024, 1, 1, 23, 50), T(2024, 1, 2, 0, 30), 50.0, False), (3, "x", T(2024, 1, 1), T(2024, 1, 2), 50.0, False),
        (4, None, T(2024, 1, 1), T(2024, 1, 2), 50.0, False), (5, "a", None, None, 50.0, False), (6, "b", T(2024, 1, 5), T(2024, 1, 5, 1), 50.0, True), (7, "b", T(2024, 1, 5), T(2024, 1, 5, 1), 19.0, False),
        (8, "b", T(2024, 1, 5), T(2024, 1, 5, 1), 20.0, False),
    ]
    sessions = spark.createDataFrame(rows, "session_id int, repo string, start timestamp_ntz, end timestamp_ntz, usd double, has_pr boolean")
    at = [("a", T(2024, 1, 1, 10)), ("a", T(2024, 1, 1, 11, 1)), ("a", T(2024, 1, 1, 11, 1, 1)), ("a", T(2024, 1, 1, 9, 59, 59)), ("a", T(2024, 1, 2, 0, 31)), ("b", T(2024, 1, 9))]
    commits = spark.createDataFrame(at, "repo string, at timestamp_ntz")
    got = K.delivered(sessions, commits, commits.select("repo"))
    assert {r.session_id: r.commits for r in got.collect()} == {1: 2, 2: 1, 3: None, 4: None, 5: None, 6: 0, 7: 0, 8: 0}
    found = K.delivery_findings(got)
    assert [(r.session_id, r.category, r["count"], r.usd) for r in found.collect()] == [(8, "delivery", 1, 0.0)]
    reports = spark.createDataFrame([(8, 1, 2.5), (6, 0, 0.5)], "session_id int, findings long, score double")
    assert {r.session_id: (r.findings, r.score) for r in K.with_delivery(reports, found).collect()} == {8: (2, 3.5), 6: (0, 0.5)}


def test_commits_are_counted_without_pairs(spark):
    """Of a busy repository: rows that are joined grow with sessions and commits, not with their product, nor with the days of a session."""
    t = lambda n: T(2024, 1, 1) + dt.timedelta(seconds=n)
    spans = [(k, "a" if k % 3 else "b", t(k * 1000), t(k * 1000 + k * k * 40)) for k in range(60)] + [(60, "a", T(1, 1, 1), T(9999, 1, 1)), (61, "a", t(9), t(-99_999))]
    made = [("a" if n % 5 else "b", t(n % 70 * 1500)) for n in range(700)]
    sessions = spark.createDataFrame(spans, "session_id int, repo string, start timestamp_ntz, end timestamp_ntz")
    commits = spark.createDataFrame(made, "repo string, at timestamp_ntz")
    got = K.delivered(sessions, commits, commits.select("repo"))
    want = {k: sum(r == repo and start <= at <= end + dt.timedelta(minutes=1) for r, at in made) for k, repo, start, end in spans}
    assert {r.session_id: r.commits for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "<= upto" not in plan


def test_owner_is_the_longest_root(spark):
    paths = spark.createDataFrame([("/h/a/x.jsonl",), ("/h/a/b/y.jsonl",), ("/h/ab/z.jsonl",), ("/q",)], "path string")
    sources = spark.createDataFrame([("one", "/h/a/"), ("two", "/h/a/b")], "id string, root string")
    assert {r.path: r.id for r in K.owners(paths, sources).collect()} == {"/h/a/x.jsonl": "one", "/h/a/b/y.jsonl": "two", "/h/ab/z.jsonl": None, "/q": None}


def test_newest_of_the_last_days(spark):
    files = spark.createDataFrame([(f"f{k}", T(2024, 1, 20) - dt.timedelta(hours=5 * k)) for k in range(60)], "path string, mtime timestamp_ntz")
    got = K.newest(files, T(2024, 1, 20), most=50).orderBy("place").collect()
    assert [r.path for r in got] == [f"f{k}" for k in range(39)]
    assert K.newest(files, T(2024, 1, 20), most=5).count() == 5


@pytest.mark.parametrize(("text", "want"), [('so {"a": "}{", "b": {"c": "\\"}"}} and {}', '{"a": "}{", "b": {"c": "\\"}"}}'), ("none", None), ("{ open", None), ("", None)])
def test_first_object(text, want):
    assert K.first_object(text) == want


def test_small_rules(spark):
    assert [K.bucket_kind(x) for x in ("day", "month", "week", "", "year")] == ["day", "month", "week", "week", "week"]
    assert K.report_since(T(2024, 4, 1), 0) == T(2024, 1, 2) and K.report_since(T(2024, 4, 1), 1) == T(2024, 3, 31)
    assert K.footer("", 0, 0) == [] and len(K.footer("old prices", 2, 1)) == 3
    row = spark.range(1).select(
        K.line_ratio_text(F.lit(0.00123)).alias("a"), K.line_ratio_text(F.lit(0.0)).alias("b"), K.coverage_suffix(F.lit(3), F.lit(4)).alias("c"), K.coverage_suffix(F.lit(4), F.lit(4)).alias("d"),
        K.token_ratio_text(F.lit(-1.0)).alias("e"), K.reply_json(F.lit('x {"k": 1} y')).alias("f"),
    ).first()
    assert tuple(row) == ("$0.0012", "—", " ~75%", "", "—", '{"k": 1}')
    days = spark.createDataFrame([(dt.date(2024, 1, k), 1.0) for k in range(1, 6)], "day date, usd double")
    assert K.clamped(days, T(2024, 1, 3, 15)).count() == 3
