"""Which repository a directory belongs to, billing lines, and rows of findings."""

import datetime as dt
import json

from pyspark.sql import functions as F

from meterlight.operators import exports as E
from meterlight.operators import rankings as K
from meterlight.operators import sessions as S
from meterlight.sources import jsonl
from meterlight.sources import repositories as G


def test_nearest_root_above(spark, tmp_path):
    one, inner, tree = tmp_path / "one", tmp_path / "one" / "vendor" / "inner", tmp_path / "tree"
    for root in (one, inner):
        (root / ".git").mkdir(parents=True)
    (one / ".git" / "config").write_text('[core]\n\tbare = false\n[remote "origin"]\n\turl = x\n[user]\n\temail = "me@example.org"\n\tname = me\n')
    (inner / ".git" / "config").write_text("[user\nbroken")
    tree.mkdir()
    (tree / ".git").write_text("gitdir: /elsewhere\n")
    (tmp_path / "plain").mkdir()
    cwds = [f"{one}/src/deep/", str(one), f"{inner}/x", str(tree), f"{tmp_path}/plain", "/nowhere/at/all", "", None]
    frame = spark.createDataFrame([(c,) for c in cwds], "cwd string")
    none = spark.createDataFrame([], G.LOOKED_AT)
    known = G.look_at(G.unknown_folders(frame, none))
    got = {r.cwd: (r.root, r.email) for r in G.resolved(frame, known).collect()}
    assert got == {cwds[0]: (str(one), "me@example.org"), cwds[1]: (str(one), "me@example.org"), cwds[2]: (str(inner), ""), cwds[3]: (str(tree), "")}
    # what was looked at isn't looked at again
    known = spark.createDataFrame(known.collect(), G.LOOKED_AT)
    assert G.unknown_folders(frame, known).count() == 0
    more = spark.createDataFrame([(f"{one}/src/deep/new",)], "cwd string")
    assert [r.folder for r in G.unknown_folders(more, known).collect()] == [f"{one}/src/deep/new"]


def test_spend_by_repository(spark):
    day = dt.datetime(2024, 1, 2, 5)
    rows = [(1, day, "p", None, 1000), (2, day, "p", "/r/a/x", 1000), (3, day, "p", "/elsewhere", 1000), (4, day, "q", "/r/a/y", 500), (5, day, "n", "/none", 1), (6, day, "m", "", 1)]
    schema = "ord long, ts timestamp, project string, cwd string, tok_in long"
    events = spark.createDataFrame(rows, schema).selectExpr("*", "'s' source", "'v' vendor", "'claude-opus-4-7' model", "cast(null as string) message_id", "cast(null as string) request_id", "false is_sub", "0L tok_out", "0L tok_cw", "0L tok_cr", "false costed", "cast(null as decimal(18,9)) cost_usd")
    days = G.project_days(events)
    assert {r.project: r.cwd for r in days.collect()} == {"p": "/r/a/x", "q": "/r/a/y", "n": "/none", "m": ""}
    roots = G.resolved(days.select("cwd"), spark.createDataFrame([("/r/a", True, ""), ("/none", False, "")], G.LOOKED_AT))
    assert [(r.repo, r.tokens) for r in G.repository_days(days, roots).collect()] == [("/r/a", 3500)]
    assert G.skipped(days, roots).first().skipped == 2


def billing(ts, pct, end="2024-01-11T20:00:00Z", msg=jsonl.BILLING, tier="pro"):
    return json.dumps({"ts": ts, "msg": msg, "ctx": {"config": {"creditUsagePercent": pct, "currentPeriod": {"end": end}}, "subscriptionTier": tier}})


def test_billing_line(spark):
    lines = [
        billing("2024-01-05T10:00:00Z", 12.5), billing("2024-01-05T12:00:00Z", 20.0), billing("2024-01-05T12:00:00Z", 99.0), billing("2024-01-05T13:00:00Z", 50.0, msg="other"), "not " + jsonl.BILLING,
        billing("2024-01-05T14:00:00Z", 60.0, end="soon"), billing("whenever", 70.0), json.dumps({"msg": "x", "text": jsonl.BILLING}), "{",
    ]
    rows = spark.createDataFrame(list(enumerate(lines)), "ord long, value string")
    got = jsonl.billing_lines(rows)
    assert got.count() == 3
    (last,) = jsonl.latest_billing(got, dt.datetime(2024, 1, 11, 19)).collect()
    assert (last.vendor, last.label, last.pct, last.stale, last.plan) == ("grok", "wk", 20.0, False, "pro")
    assert jsonl.latest_billing(got, dt.datetime(2024, 1, 12)).first().stale
    assert jsonl.latest_billing(got.limit(0), dt.datetime(2024, 1, 12)).count() == 0


def _session(spark):
    t = dt.datetime(2024, 1, 2, 3)
    events = [(k, t + dt.timedelta(hours=k), "s", "p", "claude-opus-4-7", f"m{k}", "r", False, 1000 * k, 10, 60_000 if k == 2 else 0, 0) for k in range(1, 7)]
    events += [(9, t, "quiet", "q", "other", None, None, False, 1, 1, 0, 0), (10, t, "s", "p", "claude-opus-4-7", "m1", "r", True, 7, 7, 0, 0)]
    e = spark.createDataFrame(events, "ord long, ts timestamp, session_id string, project string, model string, message_id string, request_id string, is_sub boolean, tok_in long, tok_out long, tok_cw long, tok_cr long")
    calls = [("s", t, k, "Read", 'a "b"\\\n', k == 0, False) for k in range(4)] + [("s", t, 10 + k, "Edit", f"t{k % 2}", False, True) for k in range(6)] + [("only", t, 30, "Bash", "", True, False)]
    c = spark.createDataFrame(calls, "session_id string, ts timestamp, ord long, name string, target string, is_err boolean, is_sub boolean")
    return e, c, spark.createDataFrame([("s", 1)], "session_id string, ord long")


def test_findings_are_worded(spark):
    e, c, p = _session(spark)
    got = {(r.session_id, r.category, r.detail): r["count"] for r in S.findings(e, c, p).collect()}
    assert got == {
        ("s", "waste_failed", "1 failed tool call(s) — each burns a round-trip"): 1, ("only", "waste_failed", "1 failed tool call(s) — each burns a round-trip"): 1,
        ("s", "waste_reads", "3 redundant Read(s) across 1 file(s)"): 3, ("s", "waste_context", "1 turn(s) injected big new context but produced tiny output"): 1,
        ("s", "abuse", 'Read "a \\"b\\"\\\\\\n" called 4×'): 4, ("s", "abuse", 'Edit "t0" called 3×'): 3, ("s", "abuse", 'Edit "t1" called 3×'): 3,
        ("s", "loop", 'main stream: cycle [Read a "b"\\\n] repeated 4×'): 4, ("s", "loop", "subagent stream: cycle [Edit t0 → Edit t1] repeated 3×"): 3,
        ("s", "sprawl", "long session: 1 prompts over 6.0h — consider splitting or delegating to subagents"): 1,
    }


def test_rows_of_findings(spark):
    e, c, p = _session(spark)
    done = spark.createDataFrame([("s", "r", 50.0, False, 0), ("quiet", "r", 50.0, True, 0)], "session_id string, repo string, usd double, has_pr boolean, commits long")
    landed = K.delivery_findings(done)
    rows = E.finding_rows(e, c, p, delivery=landed)
    assert rows.columns == ["session", "project", "usd", "waste_usd", "category", "detail", "count", "finding_usd"]
    got = rows.collect()
    assert {r.session for r in got} == {"s", "quiet"} and all(len(r.usd.split(".")[1]) == 4 for r in got)
    (quiet,) = [r for r in got if r.session == "quiet"]
    assert (quiet.category, quiet.detail, quiet["count"], quiet.finding_usd) == ("", "", "", "")
    assert ("delivery", "$50.00 session with no commit and no PR — did the work land?", "1", "0.0000") in {(r.category, r.detail, r["count"], r.finding_usd) for r in got}
    assert {r.category for r in got} == {"", "waste", "abuse", "loop", "sprawl", "delivery"}
    report = {r.session_id: r for r in S.reports(e, c, p, delivery=landed).collect()}
    assert report["s"].findings == 10 and report["quiet"].findings == 0 and set(report) == {"s", "quiet"}
    cost = {r.session_id: (r.turns, r.unpriced) for r in S.session_cost(e).collect()}
    assert cost == {"s": (6, 0), "quiet": (1, 1)}
    total = S.corpus_totals(S.reports(e, c, p)).first()
    assert total.total_usd == round(sum(r.usd for r in report.values()), 8)
    assert S.corpus_totals(S.reports(e, c, p).limit(0)).first().total_usd == 0


def test_hours_are_not_cut_to_seconds(spark):
    """Lengths just short of 4.15 and 4 hours, whose ends lie in seconds that are as far apart as the whole."""
    t = dt.datetime(2024, 1, 2, 3, 0, 0, 200_000)
    ends = {"tenth": 14_940, "least": 14_400}
    events = [(k, at, name, "p", "other", f"{name}{k}", "r", False, 1, 1, 0, 0) for name, s in ends.items() for k, at in enumerate((t, t + dt.timedelta(seconds=s - 0.1)))]
    e = spark.createDataFrame(events, _session(spark)[0].schema)
    _, c, p = (x.limit(0) for x in _session(spark))
    assert [r.detail for r in S.findings(e, c, p).collect()] == ["long session: 0 prompts over 4.1h — consider splitting or delegating to subagents"]
    assert [r.session_id for r in S.sprawl(e, p).collect()] == ["tenth"]


def test_loops_read_a_long_stream_once(spark):
    """No window reaches to the stream's end from each of its rows, which costs the square of its length."""
    n = 5000
    cut = F.when(F.col("id") == 100, "x").otherwise(F.concat(F.lit("t"), (F.col("id") % 3).cast("string")))
    c = spark.range(n).select(F.lit("s").alias("session_id"), F.lit(0).alias("ts"), F.col("id").alias("ord"), F.lit("Edit").alias("name"), cut.alias("target"), F.lit(False).alias("is_sub"))
    got = S.loops(c)
    (row,) = got.collect()
    assert (row.reps, row.w, row.start, row.cycle) == ((n - 101) // 3, 3, 101, ["Edit:t2", "Edit:t0", "Edit:t1"])
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()


def test_prompts_of_a_project(spark):
    said = spark.createDataFrame([("a", 2, "a2"), ("a", 1, "a1"), ("b", 1, "b1"), ("b", 2, None), ("c", 1, "c1")], "session_id string, ord int, text string")
    reports = spark.createDataFrame([("a", "p", 1.0, 5.0), ("b", "p", 2.0, 1.0), ("c", "q", 0.0, 0.0)], "session_id string, project string, score double, usd double")
    got = K.project_prompts(said, reports, most=2).orderBy("project", "place").collect()
    assert [(r.project, r.place, r.text) for r in got] == [("p", 1, "b1"), ("p", 2, "a1"), ("q", 1, "c1")]


def test_fixed_digits(spark):
    from meterlight.functions.text import fixed

    values = {12.35: ("12.3", 1), 0.125: ("0.12", 2), 1234567.5: ("1234568", 0), 2.5: ("2", 0), 1234.00005: ("1234.0001", 4)}
    row = spark.range(1).select(*(fixed(F.lit(v), n).alias(f"c{k}") for k, (v, (_, n)) in enumerate(values.items()))).first()
    assert list(row) == [f"{v:.{n}f}" for v, (_, n) in values.items()] == [w for w, _ in values.values()]
