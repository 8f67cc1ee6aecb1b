"""Windows of scans and reports, periods with their coverage, and names as they are shown."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from meterlight.functions import text as X
from meterlight.operators import reports as R
from meterlight.operators import usage as U
from meterlight.sources import jsonl
from meterlight.sources import repositories as G
from meterlight.sources import transcripts as T


@pytest.mark.parametrize(
    ("name", "short", "tail", "told"),
    [
        ("", "(unknown)", "(unknown)", "(unknown)"), ("-Users-me-src-foo", "-Users-me-src-foo", "-Users-me-src-foo", "Users-me-src-foo"), ("-Users-me-src-tries-2026-04-24-x", "2026-04-24-x", "2026-04-24-x", "2026-04-24-x"),
        ("-Users-me-src-a-", "-Users-me-src-a-", "-Users-me-src-a-", "Users-me-src-a-"), ("a/b/c", "a/b/c", "c", "a/b/c"), ("-a--b-c-d-e", "d-e", "d-e", "e"), ("plain", "plain", "plain", "plain"),
    ],
)
def test_project_names(spark, name, short, tail, told):
    n = F.lit(name)
    assert tuple(spark.range(1).select(X.short_project(n).alias("a"), X.short_project_tail(n).alias("b"), X.short_project_name(n).alias("c")).first()) == (short, tail, told)


def test_cut_by_bytes(spark):
    row = spark.range(1).select(X.trimmed_right(F.lit("abcdef"), 6).alias("a"), X.trimmed_right(F.lit("abcdef"), 4).alias("b"), X.short_model(F.lit("x-opus-1")).alias("c"), X.short_model_tag(F.lit("other")).alias("d")).first()
    assert tuple(row) == ("abcdef", "abc…", "Opus", "other")


def test_prompts_since(spark):
    t = dt.datetime(2024, 1, 2)
    rows = [("a", 1, t, "plan"), ("a", 2, t + dt.timedelta(days=3), "bypassPermissions"), ("b", 1, t, "plan"), ("c", 1, None, "plan")]
    prompts = spark.createDataFrame(rows, "session_id string, ord int, ts timestamp, mode string").selectExpr("*", "'/w' cwd", "'cli' entrypoint", "session_id project")
    assert {r.project: (r.turns, r.bypass_pct) for r in R.safety(prompts, t + dt.timedelta(days=1)).collect()} == {"a": (1, 100.0)}
    assert R.safety(prompts).count() == 3 and R.safety_summary(prompts, t + dt.timedelta(days=9)).first().bypass_pct == 0


def test_main_transcripts_of_a_window(spark, tmp_path):
    def put(path, at):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps({"type": "user", "timestamp": "2024-01-02T03:00:00Z", "permissionMode": "plan", "message": {"content": "x"}}) + "\n")
        os.utime(path, (at, at))

    put(tmp_path / "p" / "new.jsonl", 2_000_000_000)
    put(tmp_path / "p" / "old.jsonl", 1_000_000_000)
    put(tmp_path / "p" / "new" / "subagents" / "agent-a.jsonl", 2_000_000_000)
    source = jsonl.Source("claude", "x", str(tmp_path))
    names = lambda rows: sorted((r.session_id, r.is_sub) for r in rows.collect())
    assert names(T.session_lines(spark, source, main_only=True)) == [("new", False), ("old", False)]
    assert names(T.session_lines(spark, source, dt.datetime(2020, 1, 1))) == [("new", False), ("new", True)]
    assert names(T.session_lines(spark, source, dt.datetime(2020, 1, 1), main_only=True)) == [("new", False)]


def test_days_before_the_report_do_not_count(spark):
    days = spark.createDataFrame([("p", "/r/a", dt.date(2024, 1, d), 1.0, 10) for d in (1, 2, 3)] + [("q", "/x", dt.date(2024, 1, d), 1.0, 10) for d in (1, 2)], "project string, cwd string, day date, usd double, tokens long")
    roots = spark.createDataFrame([("/r/a", "/r", "")], "cwd string, root string, email string")
    since = dt.datetime(2024, 1, 2, 17)
    assert sorted(r.day.day for r in G.repository_days(days, roots, since).collect()) == [2, 3]
    assert (G.skipped(days, roots, since).first().skipped, G.skipped(days, roots).first().skipped) == (1, 2)


def test_period_and_its_coverage(spark):
    as_of = dt.date(2024, 1, 10)
    cell = [(dt.date(2024, 1, d), "p", "s", v, "claude-opus-4-7", False, 10**6, 0, 0, 0, 10**6, 0, 0, 0, 0.0, 1) for d, v in ((10, "a"), (9, "a"), (10, "b"))]
    tokens = ", ".join(f"{x}tok_{t} long" for x in ("", "p_") for t in ("in", "out", "cw", "cr"))
    cells = spark.createDataFrame(cell, f"day date, project string, source string, vendor string, model string, is_sub boolean, {tokens}, costed_usd double, events long")
    covered = spark.createDataFrame([(dt.date(2024, 1, 10), "a", 4, 1), (dt.date(2024, 1, 9), "a", 4, 4), (dt.date(2023, 1, 9), "b", 1, 0)], "day date, vendor string, turns long, with_usage long")
    assert {r.vendor: r.coverage for r in U.period(cells, covered, "day", as_of).collect()} == {"a": 0.25, "b": None}
    week = {r.vendor: (r.coverage, r.tokens) for r in U.period(cells, covered, "week", as_of).collect()}
    assert week == {"a": (0.625, 2 * 10**6), "b": (None, 10**6)}
