"""Sessions: what a transcript's turns, tool calls and prompts come to, and the findings made of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlight.functions.text import fixed, joined_cycle, truncated
from meterlight.operators.usage import dedupe, usd
from meterlight.plans.pricing import PriceTable, context_window, cost, priced


@dataclass(frozen=True)
class Thresholds:
    repeat_tool: int = 3
    loop_min: int = 3
    read_dup: int = 2
    context_pct: float = 80.0
    big_context: int = 50_000
    tiny_output: int = 100
    sprawl_prompts: int = 60
    sprawl_hours: float = 4.0
    routing_tokens: int = 20_000
    routing_tools: int = 5
    skills: int = 3
    abuse_rows: int = 8


DEFAULT = Thresholds()
#: The longest cycle of calls that counts as a loop's window.
LOOP_WINDOW = 4


def turns(events: DataFrame, table: PriceTable | None = None) -> DataFrame:
    """Deduplicated turns with their cost, and the cost of their new tokens alone."""
    return priced(dedupe(events), table).withColumn("usd", cost()).withColumn("new_usd", cost(cached=False))


def totals(events: DataFrame) -> DataFrame:
    """Token sums, turns, and the largest context that a turn had."""
    context = F.col("tok_in") + F.col("tok_cw") + F.col("tok_cr")
    return dedupe(events).groupBy("session_id").agg(
        *(F.sum(t).alias(t) for t in ("tok_in", "tok_out", "tok_cw", "tok_cr")), F.max(context).alias("peak_context"), F.count("*").alias("turns")
    )


def bounds(events: DataFrame) -> DataFrame:
    """From the first to the last line, and the project of the first main line."""
    main = F.when(~F.col("is_sub"), F.col("ord"))
    return events.groupBy("session_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.min_by("project", main).alias("project"))


def mode_counts(prompts: DataFrame) -> DataFrame:
    return prompts.groupBy("session_id", "mode").agg(F.count("*").alias("turns"))


def mode_changes(prompts: DataFrame) -> DataFrame:
    """Each prompt whose mode isn't that of the one before; the first comes from ''."""
    w = W.partitionBy("session_id").orderBy("ord")
    return prompts.withColumn("from", F.coalesce(F.lag("mode").over(w), F.lit(""))).where("from <> mode").select("session_id", "ord", "from", F.col("mode").alias("to"))


def mode_chain(prompts: DataFrame) -> DataFrame:
    """The modes of a session in order, as a → b; (!) marks the mode that asks nothing."""
    name = F.concat("to", F.when(F.col("to") == "bypassPermissions", "(!)").otherwise(""))
    rows = mode_changes(prompts).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ord", name.alias("name")))).alias("c"))
    return rows.select("session_id", F.array_join(F.col("c.name"), " → ").alias("chain"))


# Tags that begin text which nobody typed.
INJECTED = (
    "<task-notification>", "<command-name>", "<command-message>", "<command-args>",
    "<local-command-stdout>", "<local-command-stderr>", "<system-reminder>", "<user-prompt-submit-hook>",
)


def prose(text: Column) -> Column:
    """What a person typed: reminders cut out, and null if nothing is left or it begins with an injected tag."""
    left = F.trim(F.regexp_replace(text, r"(?s)<system-reminder>.*?(</system-reminder>|\z)", ""))
    tagged = F.lit(False)
    for tag in INJECTED:
        tagged = tagged | left.startswith(tag)
    return F.when((left != "") & ~tagged, left)


def matched_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with the error state of the last result that comes after them; calls without one count as fine."""
    own = calls.where("id <> ''").alias("c").join(results.alias("r"), (F.col("c.session_id") == F.col("r.session_id")) & (F.col("c.id") == F.col("r.id")) & (F.col("r.ord") > F.col("c.ord")))
    last = own.groupBy(F.col("c.session_id").alias("session_id"), F.col("c.ord").alias("ord")).agg(F.max_by("r.is_error", "r.ord").alias("is_err"))
    return calls.join(last, ["session_id", "ord"], "left").withColumn("is_err", F.coalesce("is_err", F.lit(False)))


def scorecard(calls: DataFrame) -> DataFrame:
    """Calls and failures by tool."""
    out = calls.groupBy("session_id", "name").agg(F.count("*").alias("calls"), F.count_if("is_err").alias("failed"))
    return out.withColumn("fail_pct", F.round(100.0 * F.col("failed") / F.col("calls"), 8))


def duplicate_reads(calls: DataFrame, least: int = 2) -> DataFrame:
    return calls.where("name = 'Read' and target <> ''").groupBy("session_id", "target").agg(F.count("*").alias("reads")).where(F.col("reads") >= least)


def timeline(calls: DataFrame, changes: DataFrame, turns: DataFrame) -> DataFrame:
    """Calls, mode changes and turns of a session by time; at the same time in this order, and then as they were read."""
    kinds = [
        df.select("session_id", "ts", F.lit(k).alias("kind"), F.col("ord"), what.cast("string").alias("what"))
        for k, (df, what) in enumerate(((calls, F.concat_ws(" ", "name", "target")), (changes, F.concat_ws(" → ", "from", "to")), (turns, F.col("model"))))
    ]
    rows = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return rows.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy("ts", "kind", "ord")))


# Findings: session_id, category, count, usd.


def finding(rows: DataFrame, category: str, count: Column, dollars: Column | None = None, detail: Column | None = None) -> DataFrame:
    value = F.lit(0.0) if dollars is None else usd(dollars)
    return rows.select("session_id", F.lit(category).alias("category"), count.cast("long").alias("count"), value.cast("double").alias("usd"), *([] if detail is None else [detail.alias("detail")]))


def waste_failed(calls: DataFrame, turns: DataFrame) -> DataFrame:
    """Failed calls, each at the session's mean cost of new tokens in a turn."""
    failed = calls.where("is_err").groupBy("session_id").agg(F.count("*").alias("n"))
    mean = turns.groupBy("session_id").agg(F.avg("new_usd").alias("mean"))
    return finding(failed.join(mean, "session_id", "left"), "waste_failed", F.col("n"), F.coalesce("mean", F.lit(0.0)) * F.col("n"))


def waste_reads(calls: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    rows = duplicate_reads(calls, th.read_dup).groupBy("session_id").agg(F.sum(F.col("reads") - 1).alias("extra"), F.count("*").alias("files"))
    return finding(rows, "waste_reads", F.col("extra"))


def waste_big_context(turns: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    rows = turns.where((F.col("tok_in") + F.col("tok_cw") >= th.big_context) & (F.col("tok_out") <= th.tiny_output))
    rows = rows.groupBy("session_id").agg(F.count("*").alias("n"), F.sum("new_usd").alias("usd"))
    return finding(rows, "waste_context", F.col("n"), F.col("usd"))


def abuse(calls: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """The most repeated calls of each session, and a row for the rest: session_id, place, name, target, count (of the rest: how many), and how many calls that is."""
    return _abused(calls.groupBy("session_id", "name", "target").agg(F.count("*").alias("n")), th)


def _abused(by_call: DataFrame, th: Thresholds) -> DataFrame:
    rows = by_call.where((F.col("target") != "") & (F.col("n") >= th.repeat_tool)).select("session_id", "name", "target", F.col("n").alias("count"))
    w = W.partitionBy("session_id").orderBy(F.desc("count"), F.concat("name", "target"), "name")
    rows = rows.withColumn("place", F.row_number().over(w)).withColumn("calls", F.col("count"))
    shown = rows.where(F.col("place") <= th.abuse_rows)
    rest = rows.where(F.col("place") > th.abuse_rows).groupBy("session_id").agg(F.count("*").alias("count"), F.sum("calls").alias("calls"))
    rest = rest.select("session_id", F.lit("").alias("name"), F.lit("").alias("target"), "count", F.lit(th.abuse_rows + 1).alias("place"), "calls")
    return shown.unionByName(rest)


def skill_overload(calls: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    rows = calls.where("name = 'Skill' and target <> ''").groupBy("session_id").agg(F.count_distinct("target").alias("n")).where(F.col("n") > th.skills)
    return finding(rows, "skill", F.col("n"))


def loops(calls: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """The contiguous cycle of 1 to 4 calls that covers most, for each session's main and sub stream.

    For a window w, position i repeats if the call w later is the same; a run of L such positions from i on means
    1 + L div w repetitions. Ties go to the smaller window, and then to the earlier start.
    """
    stream = ["session_id", "is_sub"]
    order = W.partitionBy(*stream).orderBy("ts", "ord")
    seq = calls.select(*stream, "ts", "ord", F.concat_ws(":", "name", "target").alias("tok")).withColumn("i", F.row_number().over(order) - 1)
    cycle = F.array("tok", *(F.lead("tok", k).over(order) for k in range(1, LOOP_WINDOW)))
    widths = range(1, LOOP_WINDOW + 1)
    rows = seq.withColumn("cycle", cycle).withColumns({f"_end{w}": F.when(~F.coalesce(F.col("tok") == F.lead("tok", w).over(order), F.lit(False)), F.col("i")) for w in widths})
    # the next position at which the run of equal calls ends: a minimum that runs from the end, as a frame that reaches to it would be read anew for each row
    later = W.partitionBy(*stream).orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({f"_stop{w}": F.min(f"_end{w}").over(later) for w in widths})
    runs = F.array(*(F.struct(F.lit(w).alias("w"), F.expr(f"cast(1 + (_stop{w} - i) div {w} as int)").alias("reps")) for w in widths))
    rows = rows.select(*stream, "i", "cycle", F.explode(F.filter(runs, lambda r: r["reps"] >= th.loop_min)).alias("a")).select(*stream, "i", "cycle", "a.w", "a.reps")
    best = F.max_by(F.struct("reps", "w", "i", F.slice("cycle", 1, F.col("w")).alias("cycle")), F.struct((F.col("reps") * F.col("w")).alias("cover"), -F.col("w"), -F.col("i")))
    return rows.groupBy(*stream).agg(best.alias("b")).select(*stream, F.col("b.reps").alias("reps"), F.col("b.w").alias("w"), F.col("b.i").cast("int").alias("start"), F.col("b.cycle").alias("cycle"))


def dominant_model(turns: DataFrame) -> DataFrame:
    """The model with most turns; of equals the first by name."""
    n = turns.groupBy("session_id", "model").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("n"), "model"))).where("r = 1").select("session_id", "model", F.col("n").alias("turns"))


def hours_between(start: Column, end: Column) -> Column:
    """To the microsecond: cut to whole seconds, both ends could move a session over a rounded tenth of an hour, or over a threshold."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(end) - micros(start)) / 1e6 / 3600.0


def sprawl(events: DataFrame, prompts: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """Sessions of many prompts or many hours."""
    n = prompts.groupBy("session_id").agg(F.count("*").alias("prompts"))
    rows = bounds(events).join(n, "session_id", "left").withColumn("prompts", F.coalesce("prompts", F.lit(0)))
    hours = hours_between(F.col("start"), F.col("end"))
    return finding(rows.where((F.col("prompts") >= th.sprawl_prompts) | (hours >= th.sprawl_hours)), "sprawl", F.col("prompts"))


def routing(events: DataFrame, calls: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """Light sessions that ran on a large model."""
    n = calls.groupBy("session_id").agg(F.count("*").alias("calls"))
    rows = totals(events).join(dominant_model(dedupe(events)).select("session_id", "model"), "session_id").join(n, "session_id", "left")
    light = (F.col("tok_in") + F.col("tok_out") < th.routing_tokens) & (F.coalesce("calls", F.lit(0)) <= th.routing_tools)
    return finding(rows.where(F.col("model").contains("opus") & light), "routing", F.lit(1))


def context_use(events: DataFrame) -> DataFrame:
    """The largest context against the window of the session's model, at most 100 percent."""
    rows = totals(events).join(dominant_model(dedupe(events)).select("session_id", "model"), "session_id")
    rows = rows.withColumn("window", context_window(F.col("model"), F.col("peak_context")))
    return rows.select("session_id", "model", "peak_context", F.col("window").cast("long").alias("window"), F.round(F.least(F.lit(100.0), 100.0 * F.col("peak_context") / F.col("window")), 8).alias("context_pct"))


def context_overload(events: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    return finding(context_use(events).where(F.col("context_pct") >= th.context_pct), "context", F.lit(1))


def first_seen(events: DataFrame) -> DataFrame:
    """All events, with ``_first``: whether ``dedupe`` keeps it. Rows without a key are parted by their place, so that they aren't one group."""
    keyed = F.col("message_id").isNotNull() & F.col("request_id").isNotNull()
    own = W.partitionBy("message_id", "request_id", F.when(~keyed, F.col("ord"))).orderBy("ord")
    return events.withColumn("_first", ~keyed | (F.row_number().over(own) == 1))


def per_session(events: DataFrame, table: PriceTable | None = None, th: Thresholds = DEFAULT) -> DataFrame:
    """Of each session, in one pass over the events: what its turns sum to, their largest context, model and price, and its bounds."""
    rows = priced(first_seen(events), table)
    first = F.col("_first")
    big = first & (F.col("tok_in") + F.col("tok_cw") >= th.big_context) & (F.col("tok_out") <= th.tiny_output)
    new = cost(cached=False)
    total = lambda c, yes: F.coalesce(F.sum(F.when(yes, c)), F.lit(0))
    by_model = rows.groupBy("session_id", "model").agg(
        F.count_if(first).alias("turns"), F.count_if(first & F.col("priced_as").isNull()).alias("unpriced"), total(F.col("tok_in"), first).alias("tok_in"), total(F.col("tok_out"), first).alias("tok_out"),
        F.max(F.when(first, F.col("tok_in") + F.col("tok_cw") + F.col("tok_cr"))).alias("peak"), total(cost(), first).alias("usd"), total(new, first).alias("new_usd"),
        F.count_if(big).alias("big"), total(new, big).alias("big_usd"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.min(F.when(~F.col("is_sub"), F.struct("ord", "project"))).alias("_main"),
    )
    sums = ("turns", "unpriced", "tok_in", "tok_out", "usd", "new_usd", "big", "big_usd")
    most = F.when(F.col("turns") > 0, F.struct(-F.col("turns"), F.col("model")))
    out = by_model.groupBy("session_id").agg(
        *(F.sum(c).alias(c) for c in sums), F.max("peak").alias("peak"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("_main").alias("_main"), F.min_by("model", most).alias("model")
    )
    return out.withColumn("project", F.col("_main.project")).drop("_main")


def session_cost(events: DataFrame, table: PriceTable | None = None) -> DataFrame:
    """What a session's priced turns cost, and how many turns have a model without a price: their cost isn't known, which isn't zero."""
    return per_session(events, table).where("turns > 0").select("session_id", usd(F.col("usd")).alias("usd"), "turns", "unpriced")


# How findings are worded.
def _worded(hours: Column) -> dict[str, Column]:
    return {
        "waste_failed": F.format_string("%d failed tool call(s) — each burns a round-trip", "failed"),
        "waste_reads": F.format_string("%d redundant Read(s) across %d file(s)", "extra", "files"),
        "waste_context": F.format_string("%d turn(s) injected big new context but produced tiny output", "big"),
        "skill": F.format_string("%d distinct skills invoked in one session", "skills"),
        "sprawl": F.format_string("long session: %d prompts over %sh — consider splitting or delegating to subagents", "prompts", fixed(hours, 1)),
        "routing": F.lit("light session ran on Opus — Sonnet/Haiku or Fast mode may suffice"),
        "context": F.format_string("peak context %s%% of %s window", fixed(F.col("context_pct"), 0), "model"),
    }


def quoted(s: Column) -> Column:
    """In double quotes, with these, backslashes, tabs and line ends escaped."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), s, F.lit('"'))


FOUND = "array<struct<category:string,count:bigint,usd:double,detail:string>>"


def _sessions_with_findings(events: DataFrame, by_call: DataFrame, prompts: DataFrame, table: PriceTable | None, th: Thresholds) -> DataFrame:
    """``per_session`` of all sessions that have events or calls, with the findings of each as a list, ``_found``, in their order."""
    dup = (F.col("name") == "Read") & (F.col("target") != "") & (F.col("n") >= th.read_dup)
    called = by_call.groupBy("session_id").agg(
        F.sum("n").alias("calls"), F.sum("failed").alias("failed"), F.coalesce(F.sum(F.when(dup, F.col("n") - 1)), F.lit(0)).alias("extra"), F.count_if(dup).alias("files"),
        F.count_if((F.col("name") == "Skill") & (F.col("target") != "")).alias("skills"),
    )
    said = prompts.groupBy("session_id").agg(F.count("*").alias("prompts"))
    rows = per_session(events, table, th).join(called, "session_id", "full_outer").join(said, "session_id", "left").na.fill(0, ["calls", "failed", "extra", "files", "skills", "prompts", "turns", "big"])
    hours = hours_between(F.col("start"), F.col("end"))
    window = context_window(F.col("model"), F.col("peak"))
    used = F.when(F.col("peak").isNotNull(), F.least(F.lit(100.0), 100.0 * F.col("peak") / window))
    rows = rows.withColumn("context_pct", F.round(used, 8))
    mean = F.when(F.col("turns") > 0, F.col("new_usd") / F.col("turns")).otherwise(0.0)
    text = _worded(hours)

    def one(category: str, yes: Column, count: Column, dollars: Column | None = None) -> Column:
        value = F.lit(0.0) if dollars is None else usd(dollars).cast("double")
        return F.when(yes, F.struct(F.lit(category).alias("category"), count.cast("long").alias("count"), value.alias("usd"), text[category].alias("detail")))

    light = (F.col("tok_in") + F.col("tok_out") < th.routing_tokens) & (F.col("calls") <= th.routing_tools)
    found = F.array(
        one("waste_failed", F.col("failed") > 0, F.col("failed"), mean * F.col("failed")), one("waste_reads", F.col("extra") > 0, F.col("extra")), one("waste_context", F.col("big") > 0, F.col("big"), F.col("big_usd")),
        one("skill", F.col("skills") > th.skills, F.col("skills")), one("sprawl", F.col("start").isNotNull() & ((F.col("prompts") >= th.sprawl_prompts) | (hours >= th.sprawl_hours)), F.col("prompts")),
        one("routing", F.col("model").contains("opus") & light, F.lit(1)), one("context", F.col("context_pct") >= th.context_pct, F.lit(1)),
    )
    return rows.withColumn("_found", F.filter(found, lambda f: f.isNotNull()).cast(FOUND))


def _by_call(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session_id", "name", "target").agg(F.count("*").alias("n"), F.count_if("is_err").alias("failed"))


def _others(by_call: DataFrame, calls: DataFrame, th: Thresholds, delivery: DataFrame | None) -> DataFrame:
    """Findings of which a session can have several, and those that come from elsewhere."""
    abused, looped = _abused(by_call, th), loops(calls, th)
    more = F.format_string("…and %d more repeated-call pattern(s) (%d calls)", "count", "calls")
    said = F.when(F.col("place") > th.abuse_rows, more).otherwise(F.format_string("%s %s called %d×", "name", quoted(truncated(F.col("target"), 60)), "count"))
    stream = F.when(F.col("is_sub"), "subagent").otherwise("main")
    out = finding(abused, "abuse", F.col("count"), detail=said)
    out = out.unionByName(finding(looped, "loop", F.col("reps"), detail=F.format_string("%s stream: cycle [%s] repeated %d×", stream, joined_cycle(F.col("cycle")), "reps")))
    return out if delivery is None else out.unionByName(delivery)


def findings(events: DataFrame, calls: DataFrame, prompts: DataFrame, table: PriceTable | None = None, th: Thresholds = DEFAULT, delivery: DataFrame | None = None) -> DataFrame:
    """``session_id, category, count, usd, detail``. ``delivery``: findings about what landed, which need commits (``rankings.delivery_findings``)."""
    by_call = _by_call(calls)
    rows = _sessions_with_findings(events, by_call, prompts, table, th)
    own = rows.select("session_id", F.explode("_found").alias("f")).select("session_id", "f.*")
    return own.unionByName(_others(by_call, calls, th, delivery))


def reports(events: DataFrame, calls: DataFrame, prompts: DataFrame, table: PriceTable | None = None, th: Thresholds = DEFAULT, delivery: DataFrame | None = None) -> DataFrame:
    """A row for each session: what it cost, what of it was waste, how many findings, and the score that both make."""
    by_call = _by_call(calls)
    rows = _sessions_with_findings(events, by_call, prompts, table, th).where("turns > 0")
    more = _others(by_call, calls, th, delivery).groupBy("session_id").agg(F.count("*").alias("_more"), F.sum("usd").alias("_more_usd"))
    rows = rows.join(more, "session_id", "left").na.fill(0, ["_more", "_more_usd"])
    waste = F.aggregate("_found", F.lit(0.0), lambda a, f: a + f["usd"]) + F.col("_more_usd")
    rows = rows.withColumn("waste_usd", waste).withColumn("findings", F.size("_found") + F.col("_more"))
    return rows.select("session_id", "project", usd(F.col("usd")).alias("usd"), usd(F.col("waste_usd")).alias("waste_usd"), "findings", usd(F.col("waste_usd") + F.col("findings")).alias("score"))


def corpus_totals(reports: DataFrame) -> DataFrame:
    """Spend and waste of all sessions; zero without any."""
    return reports.agg(usd(F.coalesce(F.sum("usd"), F.lit(0.0))).alias("total_usd"), usd(F.coalesce(F.sum("waste_usd"), F.lit(0.0))).alias("total_waste_usd"))


def corpus(reports: DataFrame) -> DataFrame:
    """Sessions, spend, waste and findings by project."""
    return reports.groupBy("project").agg(F.count("*").alias("sessions"), usd(F.sum("usd")).alias("usd"), usd(F.sum("waste_usd")).alias("waste_usd"), F.sum("findings").alias("findings"))
