"""What is kept between runs: cells, keys, offsets and parsers' state, and session reports."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from meterlight.operators import usage as U
from meterlight.plans.pricing import PriceTable
from meterlight.sources import jsonl
from meterlight.sources import transcripts as T
from meterlight.state import reports, warm
from meterlight.state.store import Store

NOW = dt.datetime(2024, 1, 31, 12)


def line(x):
    return ((x if isinstance(x, str) else json.dumps(x)) + "\n").encode()


def append(path, *rows, tail=b"", at=NOW):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("ab") as f:
        f.write(b"".join(map(line, rows)) + tail)
    stamp = at.replace(tzinfo=dt.UTC).timestamp()
    os.utime(path, (stamp, stamp))


def said(n, model="claude-opus-4-7", mid=None, ts="2024-01-30T03:04:05Z"):
    keys = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
    return {"type": "assistant", "timestamp": ts, "sessionId": "s", "requestId": mid and "r", "message": {"id": mid, "model": model, "usage": dict.fromkeys(keys, n)}}


def totals(i, c, o, at="2024-01-30T03:04:05Z"):
    return {"timestamp": at, "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "total_tokens": i + o}}}}


def turn(prompt, ticks=2e9):
    u = {"inputTokens": 100, "outputTokens": 5, "cachedReadTokens": 40, "costUsdTicks": ticks}
    return {"timestamp": 1706583845, "params": {"sessionId": "g", "update": {"sessionUpdate": "turn_completed", "prompt_id": prompt, "usage": u}}}


@pytest.fixture
def corpus(tmp_path):
    """Three vendors' files, in a first state and, by the function that it gives, in a second."""
    a, c, g = tmp_path / "a", tmp_path / "c", tmp_path / "g"
    append(a / "p1" / "u1.jsonl", said(1, mid="m1"), said(2, mid="m2"), said(3), tail=line(said(4, mid="m4"))[:30])
    append(a / "p1" / "u1" / "subagents" / "agent-x.jsonl", said(5, mid="m5", model="nobody"))
    append(a / "p2" / "old.jsonl", said(100, mid="m9"), at=NOW - dt.timedelta(days=40))
    append(c / "rollout-1.jsonl", {"type": "session_meta", "payload": {"session_id": "c", "cwd": "/w"}}, totals(100, 0, 10), {"type": "event_msg", "payload": {"type": "thread_settings_applied", "thread_settings": {"model": "gpt-x"}}})
    append(g / "%2Fw" / "s" / "updates.jsonl", turn("t1"), turn("t1"))

    def grow():
        append(a / "p1" / "u1.jsonl", tail=line(said(4, mid="m4"))[30:] + line(said(1, mid="m1")) + line(said(6, mid="m5")))
        append(a / "p3" / "u2.jsonl", said(7, mid="m7", ts="2024-02-01T00:00:00Z"), "not json")
        append(c / "rollout-1.jsonl", totals(100, 0, 10), totals(160, 20, 15), totals(5, 0, 1), totals(9, 0, 1))
        append(c / "rollout-2.jsonl", totals(1, 0, 1))
        append(g / "%2Fw" / "s" / "updates.jsonl", turn("t1"), turn("t2", 0))

    return [jsonl.Source("claude", "x", str(a)), jsonl.Source("codex", "y", str(c)), jsonl.Source("grok", "z", str(g))], grow


def table(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def test_warm_is_cold(spark, tmp_path, corpus):
    sources, grow = corpus
    at = str(tmp_path / "store")
    assert warm.kept(spark, at) is None
    first = warm.refresh(spark, sources, at, NOW)
    assert first.manifest["read_files"] == 4 and first.dupes == 2
    again = warm.refresh(spark, sources, at, NOW)
    assert (again.manifest["read_files"], again.manifest["read_bytes"], again.dupes) == (0, 0, 2) and table(again.cells()) == table(first.cells())
    grow()
    sizes = {r.path: r.end for r in again.files().collect()}
    second = warm.refresh(spark, sources, at, NOW)
    assert second.manifest["read_files"] == 5
    grown = sum(r.end - sizes.get(r.path, 0) for r in second.files().collect())
    assert second.manifest["read_bytes"] == grown > 0
    cold = warm.refresh(spark, sources, str(tmp_path / "other"), NOW)
    for name in ("cells", "coverage", "unknown"):
        assert table(getattr(second, name)()) == table(getattr(cold, name)()), name
    assert table(second.hours(NOW)) == table(cold.hours(NOW)) and second.dupes == cold.dupes
    # and both are what the engine makes of all files
    events = jsonl.events(spark, sources, NOW - dt.timedelta(days=35))
    want = U.cells(events.where("not coverage_only"))
    assert table(second.cells().drop("source")) == table(want.select(second.cells().drop("source").columns))
    assert {(r.model, r.message) for r in second.unknown().collect()} >= {("nobody", "m5")}


def test_lost_state_is_read_again_and_versions_start_anew(spark, tmp_path, corpus, monkeypatch):
    sources, grow = corpus
    at = str(tmp_path / "store")
    first = warm.refresh(spark, sources, at, NOW)
    store = Store(spark, at, warm.VERSION)
    # without what was in effect, the lines before are read again but count once
    lost = store.begin()
    store.commit(lost, first.manifest | {"tables": {k: v for k, v in first.manifest["tables"].items() if k != "parsers"}})
    grow()
    second = warm.refresh(spark, sources, at, NOW)
    cold = warm.refresh(spark, sources, str(tmp_path / "other"), NOW)
    assert table(second.cells()) == table(cold.cells())
    monkeypatch.setattr(warm, "VERSION", 2)
    assert warm.kept(spark, at) is None
    anew = warm.refresh(spark, sources, at, NOW)
    assert table(anew.cells()) == table(cold.cells()) and anew.manifest["read_files"] == 6


def test_sources_come_and_go_and_files_shrink(spark, tmp_path, corpus):
    sources, _ = corpus
    at = str(tmp_path / "store")
    one = warm.refresh(spark, sources[:1], at, NOW)
    assert {r.vendor for r in one.cells().collect()} == {"claude"}
    three = warm.refresh(spark, sources, at, NOW)
    assert {r.vendor for r in three.cells().collect()} == {"claude", "codex", "grok"} and three.manifest["read_files"] == 2
    gone = warm.refresh(spark, [jsonl.Source("claude", "nowhere", str(tmp_path / "nowhere")), *sources[1:]], at, NOW)
    assert table(gone.cells()) == table(three.cells())
    path = tmp_path / "a" / "p1" / "u1.jsonl"
    path.write_bytes(b"")
    append(path, said(2, mid="m2"), said(9, mid="m11"))
    shorter = warm.refresh(spark, sources, at, NOW)
    tokens = lambda k: k.cells().where("vendor = 'claude'").agg(F.sum("tok_in")).first()[0]
    assert tokens(shorter) == tokens(three) + 9
    assert warm.refresh(spark, [], str(tmp_path / "none"), NOW).cells().count() == 0


def test_hours_are_kept_for_thirty_days(spark, tmp_path, corpus):
    sources, grow = corpus
    at = str(tmp_path / "store")
    first = warm.refresh(spark, sources, at, NOW)
    assert {str(r.day) for r in first.hours(NOW).collect()} == {"2024-01-30"}
    later = NOW + dt.timedelta(days=28)
    assert warm.kept(spark, at).hours(later).count() > 0 and warm.kept(spark, at).hours(later + dt.timedelta(days=1)).count() == 0
    grow()
    second = warm.refresh(spark, sources, at, later + dt.timedelta(days=1))
    held = second.store.table(second.manifest, "hours", warm.HOURS)
    assert {str(r.day) for r in held.collect()} == {"2024-02-01"} or held.count() == 0
    assert "2024-01-30" in {str(r.day) for r in second.cells().collect()}


def test_two_runs_at_once(spark, tmp_path):
    a, b = (Store(spark, str(tmp_path / "s"), 1) for _ in range(2))
    x, y = a.begin(), b.begin()
    rows = spark.range(3)
    a.commit(x, {"tables": {"t": [a.write(x, "t", rows)]}})
    part = b.write(y, "t", rows)
    with pytest.raises(RuntimeError, match="another run"):
        b.commit(y, {"tables": {"t": [part]}})
    assert a.table(a.manifest(), "t", "id long").count() == 3
    for _ in range(3):
        x = a.begin()
        a.commit(x, {"tables": {"t": [a.write(x, "t", rows)]}})
    assert len([n for n in a._names() if n.startswith("gen-")]) == 2 and a.table(a.manifest(), "t", "id long").count() == 3
    a.forget()
    assert a.manifest() is None


def user(text, mode="default"):
    return {"type": "user", "timestamp": "2024-01-02T03:00:00Z", "cwd": "/w", "permissionMode": mode, "message": {"content": text}}


def call(n, target):
    return {"type": "assistant", "timestamp": f"2024-01-02T03:00:{n:02d}Z", "message": {"id": f"c{n}", "content": [{"type": "tool_use", "id": f"t{n}", "name": "Read", "input": {"file_path": target}}]}}


def test_only_changed_sessions_are_made_again(spark, tmp_path):
    root, at = tmp_path / "in", str(tmp_path / "store")
    source = jsonl.Source("claude", "x", str(root))
    for k in range(4):
        append(root / f"p{k % 2}" / f"s{k}.jsonl", user("do it"), said(1000 * k, mid=f"m{k}"), *(call(n, "/f") for n in range(k + 1)))
    append(root / "p1" / "s3" / "subagents" / "agent-a.jsonl", said(10, mid="sub"))
    append(root / "loose.jsonl", said(1))

    def plain():
        rows = T.session_lines(spark, source)
        return reports.made(rows, lambda _, df: df)

    made = lambda: Store(spark, at, reports.VERSION).manifest()["made"]
    generation = lambda: Store(spark, at, reports.VERSION).manifest()["tables"]
    first = reports.cached_reports(spark, source, at)
    assert table(first) == table(plain()) and first.count() == 4 and made() == 4
    kept = generation()
    assert table(reports.cached_reports(spark, source, at)) == table(first) and generation() == kept
    append(root / "p1" / "s3" / "subagents" / "agent-a.jsonl", said(20, mid="sub2"))
    second = reports.cached_reports(spark, source, at)
    assert made() == 1 and table(second) == table(plain()) != table(first)
    (root / "p0" / "s2.jsonl").unlink()
    third = reports.cached_reports(spark, source, at)
    assert made() == 0 and {r.session_id for r in third.collect()} == {"s0", "s1", "s3"}
    dear = PriceTable.from_toml('[models."claude-opus-4-7"]\ninput = 100.0\noutput = 2.0\ncache_creation = 3.0\ncache_read = 4.0\n')
    fourth = reports.cached_reports(spark, source, at, dear)
    assert made() == 3 and table(fourth) != table(third)
    assert reports.cached_reports(spark, source, at, dear, refresh=True).count() == 3 and made() == 3
    (tmp_path / "empty").mkdir()
    assert reports.cached_reports(spark, jsonl.Source("claude", "e", str(tmp_path / "empty")), str(tmp_path / "e")).count() == 0


def test_a_line_too_long_ends_its_file(spark, tmp_path):
    root = tmp_path / "in"
    append(root / "p" / "s.jsonl", user("first"), said(1, mid="a"), {"type": "x", "pad": "y" * (20 << 20)}, said(2, mid="b"))
    append(root / "p" / "t.jsonl", user("other"), {"type": "x", "pad": "y" * (15 << 20)}, said(4, mid="c"), tail=b"no newline")
    source = jsonl.Source("claude", "x", str(root))
    events = T.session_events(T.session_lines(spark, source))
    assert sorted((r.session_id, r.tok_in) for r in events.collect()) == [("s", 1), ("t", 4)]
    assert jsonl.lines(spark, source, longest=16 << 20, names="s.jsonl").count() == 2
    assert jsonl.lines(spark, source, names="s.jsonl").count() == 4
