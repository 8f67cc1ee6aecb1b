"""Whole sessions, subagents and commit logs, written here, and what is read from them."""

import json

from meterlight.operators import reports as R
from meterlight.operators import sessions as S
from meterlight.sources import transcripts as T
from meterlight.sources.git import parse_log
from meterlight.sources.jsonl import Source


def put(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines))


def said(minute, content, mode="default", **more):
    return {"type": "user", "timestamp": f"2024-03-01T10:{minute:02d}:00Z", "cwd": "/w/x", "entrypoint": "cli", "permissionMode": mode, "message": {"role": "user", "content": content}} | more


def did(minute, mid, req, tokens, *blocks, model="claude-opus-4-7"):
    keys = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
    return {"type": "assistant", "timestamp": f"2024-03-01T10:{minute:02d}:30Z", "requestId": req, "message": {"id": mid, "model": model, "usage": dict(zip(keys, tokens)), "content": list(blocks)}}


def use(k, name, **given):
    return {"type": "tool_use", "id": k, "name": name, "input": given}


def result(minute, k, bad=False):
    return said(minute, [{"type": "tool_result", "tool_use_id": k, "content": "x", "is_error": bad}], mode=None)


def lines(spark, tmp_path):
    main, sub = tmp_path / "proj" / "abc.jsonl", tmp_path / "proj" / "abc" / "subagents" / "agent-1.jsonl"
    edit = did(4, "m2", "r2", (10, 5, 0, 0), use("t2", "Edit", file_path="/w/x/a.go", n=3))
    put(
        main,
        {"type": "system", "timestamp": "2024-03-01T10:00:00Z"},
        said(1, "do it <system-reminder>not me</system-reminder>"),
        did(1, "m1", "r1", (100, 50, 1000, 2000), use("t1", "Bash", command="go test ./...")),
        result(2, "t1"),
        said(3, [{"type": "text", "text": "and"}, {"type": "image"}, {"type": "text", "text": "this"}], mode="bypassPermissions"),
        edit, edit, result(5, "t2", bad=True), "{broken",
        said(6, "[1] looks like a list", mode="bypassPermissions", isMeta=True), said(6, "<command-name>x", mode="bypassPermissions"),
        {"type": "pr-link", "timestamp": "2024-03-01T10:09:00Z"},
    )
    put(sub, did(2, "m9", "r9", (7, 3, 0, 0), use("t9", "Read", command=7, file_path="/w/x/go.mod"), {"type": "tool_use", "name": "Bash", "input": {"command": ""}}, model="claude-haiku-4-5"), said(2, "machine", mode="plan"))
    put(sub.with_name("agent-1.meta.json"), {"description": "Review the change", "spawnDepth": 1})
    put(sub.with_name("agent-2.meta.json"), "no json")
    put(tmp_path / "proj" / "deep" / "other" / "x.jsonl", said(1, "not a session"))
    return Source("claude", "x", str(tmp_path))


def test_session(spark, tmp_path):
    rows = T.session_lines(spark, lines(spark, tmp_path))
    over = T.overview(rows).collect()
    assert [(r.session_id, r.project, r.cwd, r.entrypoint, r.has_pr_link, r.start.minute, r.end.minute) for r in over] == [("abc", "proj", "/w/x", "cli", True, 0, 9)]

    prompts = T.prompts(rows)
    assert [(r.mode, r.text) for r in prompts.orderBy("ord").collect()] == [("default", "do it"), ("bypassPermissions", "and\nthis"), ("bypassPermissions", None), ("bypassPermissions", None)]
    assert S.mode_chain(prompts).first().chain == "default → bypassPermissions(!)"

    calls = S.matched_calls(T.tool_calls(rows), T.tool_results(rows)).orderBy("ts", "ord").collect()
    assert [(r.name, r.target, r.is_sub, r.is_err) for r in calls] == [("Bash", "go test ./...", False, False), ("Read", "/w/x/go.mod", True, False), ("Bash", "", True, False), ("Edit", "/w/x/a.go", False, True)]

    totals = S.totals(T.session_events(rows)).first()
    assert (totals.tok_in, totals.tok_out, totals.tok_cw, totals.tok_cr, totals.peak_context, totals.turns) == (117, 58, 1000, 2000, 3100, 3)


def test_findings_of_a_session(spark, tmp_path):
    rows = T.session_lines(spark, lines(spark, tmp_path))
    events, prompts = T.session_events(rows), T.prompts(rows)
    calls = S.matched_calls(T.tool_calls(rows), T.tool_results(rows))
    found = S.reports(events, calls, prompts).collect()
    assert [r.session_id for r in found] == ["abc"]
    assert any(r.category == "waste_failed" and r["count"] == 1 for r in S.findings(events, calls, prompts).collect())


def test_subagents(spark, tmp_path):
    source = lines(spark, tmp_path)
    rows = T.session_lines(spark, source)
    got = R.agents_of(T.subagents(spark, source), T.session_events(rows), T.tool_calls(rows)).collect()
    assert [(r.agent_id.rsplit("/", 1)[1], r.project, r.depth, r.phase, r.lang, r.tier) for r in got] == [("agent-1", "proj", 1, "review", "unknown", "haiku")]
    assert abs(got[0].usd - (7 * 1 + 3 * 5) / 1e6) < 1e-12


def test_commits(spark):
    log = "\x00h1\tme@x\t1704164645\n3\t2\ta b.py\n-\t-\tpic.png\n\n\x00h2\tother@x\t1704164700\n\x00short\n12\t0\tz\n1\t1"
    rows = spark.createDataFrame([("r", log), ("none", None), ("empty", ""), ("odd", "stray\n1\t2\tx")], "repo string, log string")
    got = parse_log(rows, "me@x").orderBy("hash").collect()
    assert [(r.repo, r.hash, r.author, r.mine, r.files, r.added, r.deleted) for r in got] == [("r", "h1", "me@x", True, 2, 3, 2), ("r", "h2", "other@x", False, 0, 0, 0), ("r", "short", None, False, 1, 12, 0)]
    assert got[0].date.timestamp() == 1704164645
    assert not parse_log(rows).where("mine").count()
