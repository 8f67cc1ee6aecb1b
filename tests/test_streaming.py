"""Growing files on streams: the change index, the second vendor's parser state, sessions with timers, and what several consumers get."""

import datetime as dt
import json
import time
from decimal import Decimal

import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from meterlight.operators import reports as R
from meterlight.operators import usage as U
from meterlight.sources import jsonl
from meterlight.sources.growing import changed, last_line_end, line_start, listed, read_ranges, split_lines, with_ends
from meterlight.streaming import live
from meterlight.streaming.codex import Parser
from meterlight.streaming.serve import Served, serve
from meterlight.streaming.sessions import VIEW, Limits, Session, session_views
from meterlight.streaming.tail import OPEN, TASK, Index, TailReader

SPENT = ("session_id", "project", "model", "is_sub", "tok_in", "tok_out", "tok_cr", "ts")


def meta(session, cwd, parent=""):
    return {"type": "session_meta", "payload": {"session_id": session, "cwd": cwd, "parent_thread_id": parent}}


def totals(i, c, o, at="2024-01-02T03:04:05Z"):
    return {"timestamp": at, "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "total_tokens": i + o}}}}


def model(name):
    return {"type": "event_msg", "payload": {"type": "thread_settings_applied", "thread_settings": {"model": name}}}


def line(x):
    return ((x if isinstance(x, str) else json.dumps(x)) + "\n").encode()


def append(path, *rows, tail=b""):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("ab") as f:
        f.write(b"".join(map(line, rows)) + tail)


def run_once(df, checkpoint, sink):
    df.writeStream.option("checkpointLocation", str(checkpoint)).trigger(once=True).foreachBatch(sink).start().awaitTermination()


def test_codex_on_a_stream_is_the_batch(spark, tmp_path):
    """Across restarts, half lines, a file that is cut, and one that is replaced by a shorter one without a reading at first."""
    root, whole = tmp_path / "in", tmp_path / "whole"
    a, b, c = (root / "2024" / f"rollout-{x}.jsonl" for x in "abc")
    out: list[tuple] = []

    def run():
        with live.state_store(spark):
            run_once(live.live_events(spark, [jsonl.Source("codex", "y", str(root))]), tmp_path / "cp", lambda rows, _: out.extend(rows.select(*SPENT).collect()))

    first = [meta("a", "/Users/me/src.x"), totals(1000, 400, 100), model("gpt-x")]
    append(a, *first, tail=line(totals(3000, 1400, 300))[:20])
    append(b, meta("b", "/w", parent="a"), {"type": "turn_context"}, totals(10, 0, 1), totals(10, 0, 1))
    append(c, meta("c", "/c"), model("old"), totals(500, 0, 50), "x" * 400)
    lives = {"a": [*first, totals(3000, 1400, 300), totals(3000, 1400, 300), totals(10, 0, 1), totals(60, 50, 11)], "b": [meta("b", "/w", parent="a"), totals(10, 0, 1), totals(40, 30, 2)]}
    lives["c1"], lives["c2"] = [meta("c", "/c"), model("old"), totals(500, 0, 50)], ["{", "y" * 300, totals(70, 0, 7)]
    run()
    append(a, tail=line(totals(3000, 1400, 300))[20:])
    append(b, totals(40, 30, 2))
    c.write_bytes(b"")
    append(c, "{", "y" * 300)  # its first line says nothing, yet what was known is dropped
    run()
    run()
    append(a, totals(3000, 1400, 300), "{", totals(10, 0, 1), totals(60, 50, 11))
    append(c, totals(70, 0, 7))
    run()
    for name, rows in lives.items():
        append(whole / f"rollout-{name}.jsonl", *rows)
    want = jsonl.events(spark, [jsonl.Source("codex", "y", str(whole))]).select(*SPENT).collect()
    assert sorted(out, key=repr) == sorted(want, key=repr) and len(out) == 7
    assert {(r.session_id, r.model) for r in out} >= {(None, "gpt-5.6-sol"), ("a", "gpt-x"), ("b", "codex-auto-review"), ("c", "old")}


def test_parser_state():
    p = Parser()
    assert p.step(0, ("s", "/c", None), None, None) is None
    assert p.step(9, None, None, (5, 2, 1, 6)) == (5, 2, 1)
    assert p.step(20, None, "m", None) is None and p.step(30, None, None, (5, 2, 1, 6)) is None
    assert p.step(40, None, None, (1, 1, 1, 2)) is None and p.step(50, None, None, (4, 1, 1, 5)) == (3, 0, 0)
    assert (p.declared, p.id) == ("m", "s")
    assert p.step(0, None, None, (7, 0, 0, 7)) == (7, 0, 0) and (p.declared, p.id) == (None, None)


def test_index_opens_only_what_changed(tmp_path, monkeypatch):
    monkeypatch.setattr("meterlight.streaming.tail.TICK", -1.0)
    root = tmp_path / "in"
    for k in range(5):
        append(root / f"p{k}" / "s.jsonl", {"k": k}, tail=b"half")
    (root / "p0" / "s.txt").write_text("no\n")
    index = Index(pyarrow.fs.LocalFileSystem(), str(root), "*.jsonl")
    assert set(index.refresh().values()) == {9} and (index.opened, index.listings) == (5, 6)
    again = index.refresh()
    assert (index.opened, index.listings) == (5, 6) and len(again) == 5
    append(root / "p1" / "s.jsonl", "more")
    assert index.refresh()[str(root / "p1" / "s.jsonl")] == 18 and (index.opened, index.listings) == (6, 6)
    append(root / "p1" / "deep" / "er" / "t.jsonl", "x")
    (root / "p2" / "s.jsonl").unlink()
    found = index.refresh()
    assert index.opened == 7 and str(root / "p2" / "s.jsonl") not in found and found[str(root / "p1" / "deep" / "er" / "t.jsonl")] == 2
    (root / "p3" / "s.jsonl").write_bytes(b"ab\n")
    assert index.refresh()[str(root / "p3" / "s.jsonl")] == 3
    (root / "p3" / "s.jsonl").unlink()
    (root / "p3").rmdir()
    assert len(index.refresh()) == 4


def test_pieces_of_a_range(spark, tmp_path, monkeypatch):
    path = tmp_path / "a b%.jsonl"
    rows = [f"line {k} " + "é" * (k % 37) for k in range(500)] + [""] * 3
    path.write_bytes("".join(r + "\n" for r in rows).encode() + b"no newline")
    files = listed(spark, str(tmp_path), "*.jsonl")
    known = spark.createDataFrame([], "path string, size long, end long")
    ranges = with_ends(changed(files, known)).withColumn("vendor", F.lit("v"))
    size = path.stat().st_size
    (r,) = ranges.collect()
    assert (r.start, r.end, r.size) == (0, size - 10, size) and r.path.endswith("/a b%.jsonl")
    for piece in (7, 100, 1 << 20):
        monkeypatch.setattr("meterlight.sources.growing.PIECE", piece)
        got = read_ranges(ranges, ["path", "vendor"]).orderBy("start").collect()
        assert [x.value for x in got] == rows and got[1].start == len(rows[0].encode()) + 1 and {x.vendor for x in got} == {"v"}
    # what is known of a file isn't read again, and one that got shorter is
    old = ranges.select("path", (F.col("size") - 5).alias("size"), (F.col("end") - 3).alias("end"))
    assert [x.value for x in read_ranges(with_ends(changed(files, old)), []).collect()] == ["", "", ""]
    assert changed(files, ranges.select("path", "size", "end")).count() == 0
    shorter = ranges.select("path", (F.col("size") + 1).alias("size"), (F.col("size") + 1).alias("end"))
    assert [x.start for x in changed(files, shorter).collect()] == [0]


def test_a_file_that_cannot_be_opened(spark, tmp_path):
    append(tmp_path / "x.jsonl", "a")
    rows = listed(spark, str(tmp_path), "*.jsonl").withColumn("start", F.lit(0).cast("long")).collect()
    gone = spark.createDataFrame([(rows[0].uri + ".gone", 0, 2)], "uri string, start long, size long")
    assert with_ends(gone).first().end is None
    assert read_ranges(with_ends(gone), []).count() == 0


def test_lines_are_bounded(tmp_path):
    path = tmp_path / "x"
    path.write_bytes(b"one\ntwo\n" + b"x" * (3 << 20) + b"\nfour\n")
    with pyarrow.fs.LocalFileSystem().open_input_file(str(path)) as f:
        size = path.stat().st_size
        assert [(a, x) for a, x in split_lines(f, 0, size, 1 << 20)] == [(0, b"one"), (4, b"two")]
        assert [len(x) for _, x in split_lines(f, 0, size)] == [3, 3, 3 << 20, 4]
        assert [a for a, _ in split_lines(f, 4, 8)] == [4]
        assert last_line_end(f, 0, size) == size and last_line_end(f, 8, size - 6, chunk=100) == 8
        assert line_start(f, 1, size) == 4 and line_start(f, 4, size) == 4 and line_start(f, 9, size) == size - 5 and line_start(f, size - 2, size) == size


LIMITS = Limits(recent=300, active=1800, forget=6 * 3600, turns=2, context_pct=0.8, cache_usd=1.0)


def shown(s, now):
    return dict(zip([c.split()[0] for c in VIEW.split(", ")], s.view("k", now, LIMITS), strict=True))


def test_session_by_the_clock():
    s = Session()
    s.add(1000.0, "1", "", "sub-model", True, 1.0, 0.0, 999_999, LIMITS)
    s.add(1100.0, "2", "p", "m1", False, 2.0, 0.5, 100_000, LIMITS)
    s.add(1050.0, "3", "p", "m0", False, 4.0, 0.2, 150_000, LIMITS)
    v = shown(s, 1100.0)
    assert (v["model"], v["context"], v["turns"], v["subs"], v["usd"], v["usd_5m"], v["age"], v["warnings"], v["notify"]) == ("m1", 100_000, 2, 1, 7.0, 7.0, 100, [], [])
    assert s.due(1100.0, LIMITS) == 1300.0 and shown(s, 1301.0)["usd_5m"] == 6.0
    s.add(1200.0, "4", "p", "m1", False, 0.0, 0.6, 170_000, LIMITS)
    v = shown(s, 1200.0)
    assert v["warnings"] == ["turns", "context", "cache"] and v["notify"] == ["context", "cache"]
    assert shown(s, 1201.0)["notify"] == []  # told once
    assert shown(s, 1200.0 + 301)["warnings"] == ["turns", "context"]
    assert s.due(1600.0, LIMITS) == 3000.0 and shown(s, 3000.0)["active"]
    v = shown(s, 3001.0)
    assert not v["active"] and v["warnings"] == v["notify"] == []
    s.add(3100.0, "5", "p", "m1", False, 0.0, 0.0, 170_000, LIMITS)
    assert shown(s, 3100.0)["notify"] == ["context"]  # it came back: news again
    assert not s.over(3100.0 + 6 * 3600, LIMITS) and s.over(3101.0 + 6 * 3600, LIMITS)
    s.add(3200.0, "6", "p", "m2", False, 0.0, 0.0, 210_000, LIMITS)
    v = shown(s, 3200.0)
    assert (v["window"], v["pct"], v["warnings"]) == (1_000_000, 0.21, ["turns"])


EVENTS = "ord long, ts timestamp, session_id string, project string, source string, vendor string, model string, message_id string, request_id string, is_sub boolean, tok_in long, tok_out long, tok_cw long, tok_cr long, costed boolean, cost_usd decimal(18,9), coverage_only boolean"


def event(n, ts, session="s1", message="", tok=1000, sub=False, only=False, costed=None):
    message = message or f"m{n}"
    return (n, ts, session, "p", "a/x", "a", "claude-opus-4-7", message, "r", sub, tok, 10, 100, 0, costed is not None, None if costed is None else Decimal(costed), only)


def test_timers_on_a_stream(spark, tmp_path):
    """A session is shown, stops being active and is forgotten without any further row; when it comes back its warning is news again."""
    folder, out = tmp_path / "e", []
    limits = Limits(recent=1, active=3, forget=600, context_pct=0.5)

    def put(n):
        now = dt.datetime.now(dt.UTC)
        spark.createDataFrame([event(n, now, tok=150_000)], EVENTS).coalesce(1).write.mode("append").parquet(str(folder))

    put(1)
    rows = spark.readStream.schema(EVENTS).parquet(str(folder))
    with live.state_store(spark):
        views = session_views(live.deduped(rows), limits)
        query = views.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").foreachBatch(lambda b, _: out.extend(b.collect())).start()
    try:

        def wait(until, seconds=60):
            end = time.time() + seconds
            while time.time() < end and not (out and until(out[-1])):
                assert query.isActive, query.exception()
                time.sleep(0.2)
            return out and until(out[-1])

        assert wait(lambda r: not r.active)
        n = len(out)
        put(2)
        assert wait(lambda r: r.turns == 2 and not r.active)
    finally:
        query.stop()
    told = [r.notify for r in out if r.notify]
    assert [r.active for r in out[n:]][-1:] == [False] and all(t == ["context"] for t in told)
    # a batch that starts late may find the session idle at once; where it was seen active, it was told
    assert len(told) == sum(any(r.active for r in part) for part in (out[:n], out[n:]))


def test_one_stream_for_cells_and_sessions(spark, tmp_path):
    folder, at = tmp_path / "e", str(tmp_path / "served")
    base = dt.datetime(2024, 1, 2, 12)
    first = [event(1, base), event(2, base, message="m1"), event(3, base, only=True, message="cov"), event(4, base + dt.timedelta(seconds=60), sub=True), event(5, base, session="s2", costed="1.5")]
    later = [event(6, base + dt.timedelta(minutes=7), tok=5000), event(7, base, message="m1"), event(8, base - dt.timedelta(days=1)), event(9, base + dt.timedelta(minutes=7), session="s3")]
    for k, rows in enumerate([first[:2], first[2:]]):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
    stream = live.deduped(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder)))
    served = Served(spark, at)
    seen = []
    plain = served.add
    served.add = lambda batch, epoch: (plain(batch, epoch), seen.append((served.cells(), served.sessions(base))))
    assert served.cells() is None
    serve(stream, served, str(tmp_path / "c"), live=False)
    assert len(seen) == 2 and all(c is None and s is None for c, s in seen)  # no total of half the history was shown
    now = base + dt.timedelta(minutes=8)

    def equal(rows):
        events = spark.createDataFrame(rows, EVENTS)
        once = U.dedupe(events).where("not coverage_only")
        want = U.cells(once)
        got = served.cells()
        assert sorted(got.select(want.columns).collect()) == sorted(want.collect())
        live_now = R.active_sessions(once.withColumn("ts", F.col("ts").cast("timestamp_ntz")), now).collect()
        mine = {r.session_id: r for r in served.sessions(now).collect()}
        assert {r.session_id: (r.turns, r.usd, r.usd_5m, r.context) for r in live_now} == {k: (r.turns, r.usd, r.usd_5m, r.context) for k, r in mine.items()}
        return mine

    assert set(equal(first)) == {"s1", "s2"}
    spark.createDataFrame(later, EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
    query = serve(stream, served, str(tmp_path / "c"))
    end = time.time() + 60
    while len(seen) < 3 and time.time() < end:
        time.sleep(0.2)
    query.processAllAvailable()
    query.stop()
    assert seen[-1][0] is not None
    mine = equal(first + later)
    assert mine["s1"].subs == 1 and mine["s1"].age == 24 * 3600 + 7 * 60
    before = served.store.manifest()
    plain(spark.createDataFrame(later, EVENTS), before["epoch"])  # repeated after a failure
    assert served.store.manifest() == before


def test_parts_are_summed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("meterlight.streaming.serve.PARTS", 2)
    served = Served(spark, str(tmp_path / "s"))
    base = dt.datetime(2024, 1, 2, 12)
    rows = [event(k, base + dt.timedelta(minutes=k)) for k in range(5)]
    for k, r in enumerate(rows):
        served.add(spark.createDataFrame([r], EVENTS), k)
    served.publish()
    assert {len(v) for v in served.published["tables"].values()} == {1}
    want = U.cells(spark.createDataFrame(rows, EVENTS))
    assert served.cells().select(want.columns).collect() == want.collect()
    (one,) = served.sessions(base + dt.timedelta(minutes=5)).collect()
    assert (one.turns, one.usd_5m) == (5, one.usd)


def test_sums_of_costs_are_exact(spark, tmp_path):
    """A long session's costs, the largest first and last: doubles would lose parts of those that are added to it."""
    served = Served(spark, str(tmp_path / "s"))
    base = dt.datetime(2024, 1, 2, 12)
    small = [event(k, base, costed="0.0001") for k in range(1, 1001)]
    for k, rows in enumerate([[event(0, base, costed="100000000"), *small], [*small, event(1001, base, costed="100000000")]]):
        served.add(spark.createDataFrame(rows, EVENTS).coalesce(1), k)
    served.publish()
    (one,) = served.sessions(base).collect()
    assert (one.turns, one.usd, one.usd_5m, one.cache_5m) == (2002, 200000000.2, 200000000.2, 0.0)


def test_a_checkpoint_ahead_of_its_store(spark, tmp_path):
    """What earlier batches added is gone, or of another version: nothing is served without it."""
    served = Served(spark, str(tmp_path / "s"))
    with pytest.raises(RuntimeError, match="new checkpoint"):
        served.add(spark.createDataFrame([event(1, dt.datetime(2024, 1, 2))], EVENTS), 1)
    assert served.store.manifest() is None


def said(n, mid):
    keys = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
    return {"type": "assistant", "timestamp": "2024-01-02T03:04:05Z", "sessionId": "s", "requestId": "r", "message": {"id": mid, "model": "claude-opus-4-7", "usage": dict.fromkeys(keys, n)}}


def turn(prompt):
    u = {"inputTokens": 100, "outputTokens": 5, "cachedReadTokens": 40, "costUsdTicks": 2e9}
    return {"timestamp": 1704164645, "params": {"sessionId": "g", "update": {"sessionUpdate": "turn_completed", "prompt_id": prompt, "usage": u}}}


def test_three_vendors_live(spark, tmp_path):
    """Files of all vendors grow under one stream, with repeats; what is served is what the batch makes of the whole files."""
    a, c, g = (tmp_path / x for x in "acg")
    append(a / "p" / "u.jsonl", said(1, "m1"), said(2, "m2"), tail=line(said(3, "m3"))[:40])
    append(c / "rollout-1.jsonl", meta("c", "/w"), totals(100, 40, 10))
    append(g / "%2Fw" / "s" / "updates.jsonl", turn("t1"))
    sources = [jsonl.Source("claude", "x", str(a)), jsonl.Source("codex", "y", str(c)), jsonl.Source("grok", "z", str(g))]
    served = Served(spark, str(tmp_path / "served"))

    def follow():
        serve(live.live_deduped(spark, sources), served, str(tmp_path / "cp"), history={"once": True}, live=False)

    def batch():
        return U.cells(U.dedupe(jsonl.events(spark, sources)).where("not coverage_only"))

    def table(df):
        return sorted(map(tuple, df.select(batch().columns).collect()), key=repr)

    follow()
    assert table(served.cells()) == table(batch())
    append(a / "p" / "u.jsonl", said(1, "m1"), tail=b"")
    append(a / "p" / "v.jsonl", said(9, "m2"), said(4, "m4"))
    append(c / "rollout-1.jsonl", model("gpt-x"), totals(100, 40, 10), totals(250, 50, 12))
    append(g / "%2Fw" / "s" / "updates.jsonl", turn("t1"), turn("t2"))
    follow()
    assert table(served.cells()) == table(batch()) and served.cells().count() == 4
    sessions = {r.session_id: r.turns for r in served.sessions(dt.datetime(2024, 1, 2, 3, 10)).collect()}
    assert sessions == {"s": 3, "c": 2, "g": 2}


def test_small_files_share_a_task(tmp_path):
    """Tasks grow with bytes, not with files; a range that is large has its own, and each line comes once with its own file."""
    reader = TailReader({"path": str(tmp_path)})
    many = {f"/f{n:05}": 10 for n in range(5000)} | {"/large": 3 * TASK}
    tasks = reader.partitions({"/f00007": 10, "/f00008": 99}, many)
    assert len(tasks) <= 5000 * (OPEN + 10) // TASK + 3
    got = [(r.path, r.start, r.end) for t in tasks for r in (t, *t.others)]
    assert sorted(got) == sorted((p, 0, n) for p, n in many.items() if p != "/f00007")
    assert [t.others for t in tasks if t.path == "/large"] == [[]]
    for name, text in (("a", b"1\n2\n"), ("b", b"3\n"), ("c", b"")):
        (tmp_path / name).write_bytes(text)
    (own,) = reader.partitions({}, {str(tmp_path / n): k for n, k in (("a", 4), ("b", 2), ("c", 0))})
    rows = [r for b in reader.read(own) for r in b.to_pylist()]
    assert [(r["path"][-1], r["start"], r["value"]) for r in rows] == [("a", 0, "1"), ("a", 2, "2"), ("b", 0, "3")]
    (none,) = reader.partitions({"/f00007": 10}, {"/f00007": 10})
    assert list(reader.read(none)) == []


def test_first_by_order_whatever_task_reads_it(spark, tmp_path):
    """Of repeats in one batch that lie in different files and tasks, the first by ``ord`` stays; a later batch repeats none."""
    rows = [(n, f"m{n % 40}", "r", n) for n in range(400)] + [(n, None, "r", n) for n in range(400, 410)]
    schema = "ord long, message_id string, request_id string, tok_in long"
    spark.createDataFrame(rows[::-1], schema).repartition(13).write.parquet(str(tmp_path / "in"))
    out: list[tuple] = []
    stream = live.deduped(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))

    def follow():
        with live.state_store(spark):
            run = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
            run.foreachBatch(lambda batch, _: out.extend(tuple(r) for r in batch.collect())).start().awaitTermination()

    follow()
    assert sorted(out) == [r for r in rows if r[0] < 40 or r[0] >= 400]
    spark.createDataFrame([(-1, "m3", "r", 0), (500, "m40", "r", 1)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    follow()
    assert sorted(out)[-1] == (500, "m40", "r", 1) and len(out) == 51


def test_many_files_are_opened_by_several_tasks(spark, tmp_path):
    """In folders below one folder too: listed, opened and read, with each line at its own file, at any depth."""
    for n in range(60):
        f = tmp_path / "one" / f"s{n}" / ("sub" if n % 3 else ".") / f"{n}.jsonl"
        append(f, f"a{n}", f"b{n}", tail=b"half")
    append(tmp_path / "top.jsonl", "a99")
    append(tmp_path / "one" / "near.jsonl", "a98")
    files = listed(spark, str(tmp_path), "*.jsonl")
    assert files.count() == 62
    ends = with_ends(files.withColumn("start", F.lit(0).cast("long")).coalesce(1))
    assert ends.select(F.spark_partition_id()).distinct().count() > 1
    got = read_ranges(ends, ["path"]).collect()
    names = {r.value: r.path.rsplit("/", 1)[1] for r in got}
    assert len(got) == 122 and all(names[f"{c}{n}"] == f"{n}.jsonl" for n in range(60) for c in "ab")
    assert (names["a99"], names["a98"]) == ("top.jsonl", "near.jsonl")
