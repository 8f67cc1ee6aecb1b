"""The registered queries of the usage engine: each operator on the benchmark tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlight.functions import text as T
from meterlight.operators import exports as E
from meterlight.operators import rankings as K
from meterlight.operators import reports as R
from meterlight.operators import sessions as S
from meterlight.operators import usage as U
from meterlight.plans.pricing import RATES, TOKENS, component, context_window, priced, tier
from meterlight.plans.work import work_folder
from meterlight.sources import jsonl
from meterlight.sources import repositories as G
from meterlight.sources import tables as A
from meterlight.streaming import live

AS_OF = dt.date(2024, 1, 24)
NOW = dt.datetime(2024, 1, 24, 12)
DAILY_LIMIT, WEEKLY_LIMIT = 5000.0, 20000.0

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return U.cells(A.usage_events(spark, d))


def _scope(spark: SparkSession, d: str, where) -> DataFrame:
    return _cells(spark, d).where(where)


SERIES = ["source", "vendor", "model"]


@query
def full_snapshot_flagship(spark, d):
    """Day, week and month of each series in one pass over the cells."""
    cells = _cells(spark, d)
    scopes = F.array(F.when(U.day_of(AS_OF), "day"), F.when(U.week_of(AS_OF), "week"), F.when(U.month_of(AS_OF), "month"))
    rows = cells.withColumn("scope", F.explode(F.filter(scopes, lambda s: s.isNotNull())))
    return U.priced_sums(rows, ["scope", *SERIES])


@query
def dedupe_first_seen(spark, d):
    return U.dedupe(A.usage_events(spark, d)).select("ord", "session_id", "model", "is_sub", "tok_in")


@query
def dupes_count(spark, d):
    return U.dupes(A.usage_events(spark, d))


@query
def usage_cells(spark, d):
    return _cells(spark, d).select(*U.CELL, *TOKENS, U.usd(F.col("costed_usd")).alias("costed_usd"), "events")


@query
def unknown_models(spark, d):
    return U.unknown(A.usage_events(spark, d))


@query
def coverage_month(spark, d):
    return U.coverage(U.dedupe(A.usage_events(spark, d)).where(F.trunc("ts", "month") == F.lit(AS_OF.replace(day=1))), ["vendor"])


@query
def coverage_daily(spark, d):
    return U.coverage(U.dedupe(A.usage_events(spark, d)), ["day", "vendor"])


@query
def snapshot_day_series(spark, d):
    return U.priced_sums(_scope(spark, d, U.day_of(AS_OF)), SERIES)


@query
def snapshot_week_series(spark, d):
    return U.priced_sums(_scope(spark, d, U.week_of(AS_OF)), SERIES)


@query
def snapshot_month_series(spark, d):
    return U.priced_sums(_scope(spark, d, U.month_of(AS_OF)), SERIES)


@query
def project_main_sub_day(spark, d):
    return U.main_sub(_scope(spark, d, U.day_of(AS_OF)), ["project"])


@query
def project_main_sub_month(spark, d):
    return U.main_sub(_scope(spark, d, U.month_of(AS_OF)), ["project"])


@query
def daily_30(spark, d):
    return U.daily(_cells(spark, d), AS_OF)


@query
def daily_by_model(spark, d):
    return U.priced_sums(_cells(spark, d), ["day", "model"]).select("day", "model", "usd", "tokens")


@query
def hourly_by_model(spark, d):
    """Of the last 30 days."""
    rows = U.hourly(A.usage_events(spark, d), [])
    rows = rows.where((F.col("day") > F.lit(AS_OF - dt.timedelta(days=30))) & (F.col("day") <= F.lit(AS_OF)))
    return U.priced_sums(rows, ["hour", "model"]).select("hour", "model", "usd", "tokens")


@query
def today_hourly(spark, d):
    """All 24 hours of the day."""
    rows = U.priced_sums(U.hourly(A.usage_events(spark, d), []).where(U.day_of(AS_OF)), ["hour"])
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(rows, "hour", "left").select("hour", F.coalesce("usd", F.lit(0.0)).alias("usd"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


@query
def project_daily(spark, d):
    return U.priced_sums(_cells(spark, d), ["project", "day"]).select("project", "day", "usd", "tokens")


def _group(mode: str) -> Query:
    def run(spark, d):
        return U.regrouped(_scope(spark, d, U.month_of(AS_OF))).where(F.col("mode") == mode).select("name", "usd", "tokens")

    return run


for _mode in ("model", "vendor", "source", "total"):
    QUERIES[f"group_{_mode}"] = _group(_mode)


@query
def grouping_sets_all(spark, d):
    return U.regrouped(_scope(spark, d, U.month_of(AS_OF)))


@query
def group_coverage(spark, d):
    """The worst coverage of a model's vendors, in the model grouping."""
    cover = U.coverage(U.dedupe(A.usage_events(spark, d)), ["vendor"])
    series = _scope(spark, d, U.month_of(AS_OF)).select("model", "vendor").distinct()
    rows = series.join(cover, "vendor", "left")
    return rows.groupBy("model").agg(F.coalesce(F.min("fraction"), F.lit(1.0)).alias("fraction"))


@query
def series_share(spark, d):
    return U.with_share(U.priced_sums(_scope(spark, d, U.month_of(AS_OF)), SERIES).select(*SERIES, "usd"))


@query
def breakdown_topk(spark, d):
    rows = U.priced_sums(_scope(spark, d, U.month_of(AS_OF)), ["project"]).select(F.col("project").alias("name"), "usd")
    return U.top_k(rows, 5)


@query
def palette_order(spark, d):
    cells = _cells(spark, d)
    return U.palette(U.priced_sums(cells.where(U.week_of(AS_OF)), ["model"]).select("model", "usd").where("usd > 0"), cells)


@query
def sparkline_levels(spark, d):
    return U.sparkline(U.daily(_cells(spark, d), AS_OF)).select("day", "level")


@query
def price_resolution(spark, d):
    rows = A.usage_events(spark, d).select(F.concat("model", F.when(F.col("ord") % 2 == 0, "[1m]").otherwise("")).alias("model")).distinct()
    return priced(rows).select("model", F.coalesce("priced_as", F.lit("")).alias("priced_as"), *(F.coalesce(r, F.lit(0.0)).alias(r) for r in RATES))


@query
def cost_components(spark, d):
    sums = _cells(spark, d).groupBy("model").agg(*(F.sum(f"p_{t}").alias(t) for t in TOKENS))
    return priced(sums).select("model", *(U.usd(component(t, r)).alias(f"{t[4:]}_usd") for t, r in zip(TOKENS, RATES, strict=True)))


# Ingest.


@query
def parse_usage_json(spark, d):
    """Transcript lines made of events, and read back by the parser."""
    e = A.usage_events(spark, d)
    usage = F.struct(F.col("tok_in").alias("input_tokens"), F.col("tok_out").alias("output_tokens"), F.col("tok_cw").alias("cache_creation_input_tokens"), F.col("tok_cr").alias("cache_read_input_tokens"))
    message = F.struct(F.col("message_id").cast("string").alias("id"), F.col("model"), usage.alias("usage"))
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("session_id").cast("string").alias("sessionId"), F.col("request_id").cast("string").alias("requestId"), message.alias("message")))
    path = F.concat(F.lit("/root/x/"), F.col("project"), F.when(F.col("is_sub"), "/s/subagents/agent-a.jsonl").otherwise("/s.jsonl"))
    rows = e.select("ord", line.alias("value"), path.alias("path"), F.lit("claude").alias("vendor"), F.lit("claude/x").alias("source"))
    return jsonl.parse_claude(rows, "/root/x").select("ord", "project", "model", "is_sub", *TOKENS)


@query
def codex_deltas(spark, d):
    return jsonl.deltas(A.readings(spark, d), "path", ["total_in", "total_out"], "total_in").select("path", "ord", "d_total_in", "d_total_out")


@query
def codex_model_in_effect(spark, d):
    w = W.partitionBy("path").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    return A.readings(spark, d).select("path", "ord", F.coalesce(F.last("declared", True).over(w), F.lit(jsonl.FALLBACK[0])).alias("model"))


@query
def token_normalise(spark, d):
    """Cached tokens apart from the input that reports them."""
    e = A.usage_events(spark, d)
    return e.select("ord", F.greatest(F.col("tok_in") - F.col("tok_cr"), F.lit(0)).alias("tok_in"), F.col("tok_cr"), F.lit(0).cast("long").alias("tok_cw"))


@query
def ticks_to_usd(spark, d):
    ticks = A.table(spark, d, "events").select("event_id", F.floor(F.col("value") * 1_000_000).alias("ticks"))
    return ticks.select("event_id", F.round(F.col("ticks") / F.lit(1e9), 9).alias("usd"))


@query
def civil_day_hour(spark, d):
    return A.usage_events(spark, d).select("ord", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"))


# Sessions.


@query
def session_tokens_peak(spark, d):
    return S.totals(A.usage_events(spark, d))


@query
def session_bounds(spark, d):
    return S.bounds(A.usage_events(spark, d)).na.fill("")


@query
def session_modes(spark, d):
    return S.mode_counts(A.prompts(spark, d))


@query
def mode_transitions(spark, d):
    return S.mode_changes(A.prompts(spark, d))


@query
def mode_chains(spark, d):
    return S.mode_chain(A.prompts(spark, d))


@query
def prompt_filter(spark, d):
    """User turns as prose, some with reminders or tags put in."""
    tagged = F.when(F.col("ord") % 4 == 1, F.concat(F.lit("<system-reminder>x\ny</system-reminder>"), "text")).when(F.col("ord") % 4 == 2, F.concat(F.lit("<command-name>"), "text")).otherwise(F.concat("text", F.lit("<system-reminder>open")))
    rows = A.prompts(spark, d).select("session_id", "ord", S.prose(tagged).alias("prompt"))
    return rows.where("prompt is not null").select("session_id", "ord", F.length("prompt").alias("chars"), F.md5("prompt").alias("md5"))


@query
def tool_result_match(spark, d):
    calls = A.tool_calls(spark, d).select("session_id", "ord", F.concat(F.lit("t"), (F.col("ord") % 50).cast("string")).alias("id"), "name").where("ord % 2 = 0")
    results = A.tool_calls(spark, d).where("ord % 2 = 1").select("session_id", "ord", F.concat(F.lit("t"), (F.col("ord") % 50 - 1).cast("string")).alias("id"), F.col("is_err").alias("is_error"))
    return S.matched_calls(calls, results).select("session_id", "ord", "is_err")


@query
def scorecard_tools(spark, d):
    return S.scorecard(A.tool_calls(spark, d))


@query
def duplicate_reads(spark, d):
    return S.duplicate_reads(A.tool_calls(spark, d))


@query
def timeline(spark, d):
    calls, turns = A.tool_calls(spark, d), A.usage_events(spark, d)
    changes = A.tool_calls(spark, d).where("ord % 10 = 0").select("session_id", "ts", "ord", F.lit("plan").alias("from"), F.lit("auto").alias("to"))
    return S.timeline(calls, changes, turns).select("session_id", "place", "kind", "ord", "what")


@query
def context_windows(spark, d):
    return S.context_use(A.usage_events(spark, d))


# Findings.


@query
def waste_failed(spark, d):
    return S.waste_failed(A.tool_calls(spark, d), S.turns(A.usage_events(spark, d)))


@query
def waste_reads(spark, d):
    return S.waste_reads(A.tool_calls(spark, d))


LOOSE = S.Thresholds(tiny_output=6000)


@query
def waste_bigctx(spark, d):
    return S.waste_big_context(S.turns(A.usage_events(spark, d)), LOOSE)


@query
def abuse_top8(spark, d):
    return S.abuse(A.tool_calls(spark, d)).select("session_id", "place", "name", "target", "count")


@query
def skill_overload(spark, d):
    return S.skill_overload(A.tool_calls(spark, d))


@query
def loops_best(spark, d):
    return S.loops(A.tool_calls(spark, d)).select("session_id", "is_sub", "reps", "w", "start")


@query
def sprawl(spark, d):
    return S.sprawl(A.usage_events(spark, d), A.prompts(spark, d))


HEAVY = S.Thresholds(routing_tokens=1 << 40, routing_tools=1 << 20)


@query
def routing(spark, d):
    return S.routing(A.usage_events(spark, d), A.tool_calls(spark, d), HEAVY)


@query
def context_overload(spark, d):
    return S.context_overload(A.usage_events(spark, d), S.Thresholds(context_pct=60.0))


@query
def dominant_model(spark, d):
    return S.dominant_model(U.dedupe(A.usage_events(spark, d)))


def _reports(spark, d):
    return S.reports(A.usage_events(spark, d), A.tool_calls(spark, d), A.prompts(spark, d))


@query
def session_scores(spark, d):
    return _reports(spark, d).select("session_id", "findings", "score", "usd")


@query
def corpus_projects(spark, d):
    return S.corpus(_reports(spark, d))


@query
def corpus_worst(spark, d):
    order = [F.desc("score"), F.desc("usd"), "session_id"]
    rows = _reports(spark, d).orderBy(*order).limit(15)
    return rows.withColumn("place", F.row_number().over(W.orderBy(*order))).select("place", "session_id", "score")


@query
def corpus_totals(spark, d):
    return S.corpus_totals(_reports(spark, d))


@query
def session_cost_unpriced(spark, d):
    return S.session_cost(A.usage_events(spark, d))


# Reports.


@query
def safety_rows(spark, d):
    return R.safety(A.prompts(spark, d))


@query
def safety_summary(spark, d):
    return R.safety_summary(A.prompts(spark, d))


@query
def container_heuristic(spark, d):
    return A.prompts(spark, d).select("cwd").distinct().withColumn("container", R.container_likely(F.col("cwd")))


def _phases(*keys: str) -> Query:
    return lambda spark, d: R.by(R.agent_costs(A.agents(spark, d)), *keys)


for _name, _keys in {"phase": ["phase"], "lang": ["lang"], "key": ["phase", "lang", "tier"], "project": ["project"], "project_phase": ["project", "phase"], "depth": ["depth"]}.items():
    QUERIES[f"phases_by_{_name}"] = _phases(*_keys)


@query
def phases_main(spark, d):
    return R.main_costs(U.dedupe(A.usage_events(spark, d)))


@query
def lang_vote(spark, d):
    return R.language_votes(A.agents(spark, d), A.agents(spark, d))


@query
def classify_phase(spark, d):
    return A.agents(spark, d).select("agent_id", R.phase(F.col("description")).alias("phase"))


@query
def model_tier(spark, d):
    return A.agents(spark, d).select("agent_id", tier(F.col("model")).alias("tier"), context_window(F.col("model"), F.col("tok_in")).cast("long").alias("window"))


def _returns(kind: str) -> Query:
    def run(spark, d):
        costs = U.priced_sums(_cells(spark, d), ["project", "day"])
        repo = F.regexp_extract("project", r"(\d+)$", 1).cast("bigint")
        return R.returns(costs.select(repo.alias("repo"), "day", "usd", "tokens"), A.commits(spark, d), kind)

    return run


for _kind in ("day", "week", "month"):
    QUERIES[f"roi_{_kind}"] = _returns(_kind)


@query
def budget_status(spark, d):
    return R.budget_status(U.daily(_cells(spark, d), AS_OF), AS_OF, DAILY_LIMIT, WEEKLY_LIMIT)


@query
def plan_latest(spark, d):
    return R.latest_plans(A.plan_readings(spark, d), NOW)


@query
def gauge_rows(spark, d):
    return R.gauges(R.latest_plans(A.plan_readings(spark, d), NOW))


@query
def worst_pct(spark, d):
    return R.worst(R.latest_plans(A.plan_readings(spark, d), NOW))


# Live.


@query
def active_sessions(spark, d):
    return R.active_sessions(A.usage_events(spark, d), NOW, idle_minutes=24 * 60)


@query
def session_warnings(spark, d):
    return R.warnings(R.active_sessions(A.usage_events(spark, d), NOW, idle_minutes=24 * 60), context_pct=0.1, cache_usd=0.01)


@query
def notify_new(spark, d):
    live = lambda now: R.warnings(R.active_sessions(A.usage_events(spark, d), now, idle_minutes=24 * 60), context_pct=0.1, cache_usd=0.01)
    return R.to_notify(live(NOW), live(NOW - dt.timedelta(hours=6)))


@query
def stream_equals_batch(spark, d):
    """Cells of the events as a stream, read in one go."""
    schema = A.table(spark, d, "events").schema
    events = A.usage_rows(spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet"))
    out = work_folder(spark)
    run = live.live_cells(events).writeStream.outputMode("complete").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    run.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/cells")).start().awaitTermination()
    return spark.read.parquet(f"{out}/cells").select(*U.CELL, *TOKENS, U.usd(F.col("costed_usd")).alias("costed_usd"), "events")


# Formats.


@query
def fmt_usd(spark, d):
    return A.table(spark, d, "events").select("event_id", T.fmt_usd(F.floor(F.col("value") * 1000).cast("double") / F.lit(8.0)).alias("usd"))


@query
def fmt_tokens(spark, d):
    n = F.pow(F.lit(10), F.col("event_id") % 11).cast("bigint") * 4
    return A.table(spark, d, "events").select("event_id", T.fmt_tokens(n).alias("tokens"), T.fmt_tokens_short(n).alias("short"))


@query
def bucket_labels(spark, d):
    days = A.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", *(R.bucket(F.col("day"), k).alias(f"by_{k}") for k in ("day", "week", "month")))


@query
def short_names(spark, d):
    """Projects and models as the views shorten them."""
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, "-").otherwise(""), F.concat_ws("-", F.lit("Users"), F.lit("x"), F.when(F.col("c_custkey") % 3 > 0, "src"), F.lit(""), (F.col("c_custkey") % 7).cast("string"), F.when(F.col("c_custkey") % 5 == 0, "a/b")))
    model = F.concat(F.element_at(F.array(*map(F.lit, ("claude-opus-4", "sonnet", "haiku-x", "grok"))), (F.col("c_custkey") % 4 + 1).cast("int")), F.lit("é"))
    short = (T.short_project(name).alias("key"), T.short_project_tail(name).alias("tail"), T.short_project_name(name).alias("name"), T.short_model(model).alias("model"), T.short_model_tag(model).alias("tag"))
    return A.table(spark, d, "customer").select("c_custkey", *short, T.trimmed_right(F.col("c_name"), 9).alias("cut"))


@query
def short_project(spark, d):
    return A.table(spark, d, "customer").select("c_custkey", T.short_project(F.concat(F.lit("-Users-x-src-"), F.concat_ws("-", (F.col("c_custkey") % 7).cast("string"), "c_name"))).alias("short"))


# Orders and limits of reports, and delivery.


@query
def waste_projects(spark, d):
    return K.projects_by_waste(S.corpus(_reports(spark, d))).select("place", "project", "waste_usd")


@query
def safety_order(spark, d):
    return K.safety_order(R.safety(A.prompts(spark, d))).select("place", "project", "bypass_pct", "turns")


@query
def phase_order(spark, d):
    return K.in_display_order(_phases("phase")(spark, d), "phase", K.PHASE_ORDER)


@query
def language_order(spark, d):
    return K.in_display_order(_phases("lang")(spark, d), "lang", K.LANGUAGE_ORDER)


@query
def phase_keys_top25(spark, d):
    return K.phase_keys(_phases("phase", "lang", "tier")(spark, d))


@query
def roi_repositories(spark, d):
    return K.repositories(QUERIES["roi_week"](spark, d))


@query
def top_tools(spark, d):
    return K.top_tools(A.tool_calls(spark, d))


@query
def top_reads(spark, d):
    return K.top_reads(A.tool_calls(spark, d))


@query
def active_top8(spark, d):
    return K.active_by_cost(QUERIES["active_sessions"](spark, d)).select("place", "session_id", "usd_5m")


@query
def flagged_top10(spark, d):
    return K.flagged(_reports(spark, d)).select("place", "session_id", "score", "findings")


@query
def session_prefix(spark, d):
    return K.of_session(U.dedupe(A.usage_events(spark, d)), "1").groupBy("session_id").agg(F.count("*").alias("turns"))


#: Of the repositories that are known, those whose number this divides have no commits.
BARE = 4
DELIVERY_USD = 2.0


def _delivered(spark: SparkSession, d: str) -> DataFrame:
    rows = S.per_session(A.usage_events(spark, d)).where("turns > 0").select("session_id", U.usd(F.col("usd")).alias("usd"), "start", "end")
    rows = rows.withColumn("repo", F.col("session_id") % 40).withColumn("has_pr", F.col("session_id") % 7 == 0)
    commits = A.commits(spark, d)
    return K.delivered(rows, commits.where(F.col("repo") % BARE != 0), commits.select("repo"))


@query
def delivery_window(spark, d):
    return _delivered(spark, d).select("session_id", "repo", "usd", "commits")


def _landed(spark: SparkSession, d: str) -> DataFrame:
    return K.delivery_findings(_delivered(spark, d), DELIVERY_USD)


@query
def delivery_flag(spark, d):
    """Costly sessions that are known to have landed nothing."""
    return _landed(spark, d)


@query
def delivery_scores(spark, d):
    """Session scores with the delivery finding among the others."""
    return S.reports(A.usage_events(spark, d), A.tool_calls(spark, d), A.prompts(spark, d), delivery=_landed(spark, d)).select("session_id", "findings", "score")


@query
def finding_rows(spark, d):
    return E.finding_rows(A.usage_events(spark, d), A.tool_calls(spark, d), A.prompts(spark, d), delivery=_landed(spark, d))


@query
def project_prompts(spark, d):
    said = A.prompts(spark, d).select("session_id", "ord", "text")
    return K.project_prompts(said, _reports(spark, d)).select("project", "place", "session_id", "ord", F.md5("text").alias("md5"))


@query
def costliest_agents(spark, d):
    return K.costliest(R.agent_costs(A.agents(spark, d)), "agent_id").select("place", "agent_id", "phase", "lang", "tier", U.usd(F.col("usd")).alias("usd"))


# Main sessions by project and tier, the summary of a run, and a plan's billing line.


def _main_cells(spark: SparkSession, d: str) -> DataFrame:
    return R.main_cells(U.dedupe(A.usage_events(spark, d)))


@query
def main_by_project(spark, d):
    return R.main_by_project(_main_cells(spark, d))


@query
def main_by_project_tier(spark, d):
    return R.main_by_project_tier(_main_cells(spark, d))


@query
def session_tiers_top20(spark, d):
    return R.session_tiers(_main_cells(spark, d)).select("place", "project", "session_id", "usd", "responses", "tier", "tier_usd")


@query
def series_ranked(spark, d):
    return U.ranked_share(U.priced_sums(_scope(spark, d, U.month_of(AS_OF)), SERIES)).select("place", *SERIES, "usd", "share")


def _period(kind: str) -> Query:
    def run(spark, d):
        covered = U.coverage(U.dedupe(A.usage_events(spark, d)), ["day", "vendor"])
        return U.period(_cells(spark, d), covered, kind, AS_OF)

    return run


for _kind in U.PERIODS:
    QUERIES[f"period_{_kind}"] = _period(_kind)


@query
def once_summary(spark, d):
    return U.once(A.usage_events(spark, d), AS_OF)


@query
def billing_latest(spark, d):
    """Log lines made of events: a third are billing lines, a third only mention them."""
    e = A.table(spark, d, "events")
    end = F.date_format(F.col("ts") + F.expr("interval 7 days"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    msg = F.when(F.col("event_id") % 3 == 0, jsonl.BILLING).otherwise("other")
    ctx = F.struct(F.struct(F.col("value").alias("creditUsagePercent"), F.struct(end.alias("end")).alias("currentPeriod")).alias("config"), F.col("event_type").alias("subscriptionTier"))
    about = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("no "), F.lit(jsonl.BILLING)))
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), msg.alias("msg"), about.alias("about"), ctx.alias("ctx")))
    found = jsonl.latest_billing(jsonl.billing_lines(e.select(F.col("event_id").alias("ord"), line.alias("value"))), NOW)
    return found.select("vendor", "label", "pct", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("observed", "resets_at")), "stale", "plan")


# Repositories of projects: of each project's first directory, the nearest folder above it that is a work tree's root.


SINCE = dt.datetime(2024, 1, 8, 15)


def _project_days(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Spend by project and day, and the roots of two thirds of the projects."""
    cwd = F.concat(F.lit("/home/me/"), F.col("project"), F.when(F.col("ord") % 2 == 0, "/src/deep").otherwise("/doc/"))
    days = G.project_days(A.usage_events(spark, d).withColumn("cwd", F.when(F.col("ord") % 5 != 0, cwd)))
    number = F.regexp_extract("project", r"(\d+)$", 1).cast("bigint")
    known = days.select("project").distinct().select(F.concat(F.lit("/home/me/"), "project").alias("folder"), (number % 3 != 0).alias("is_root"), F.lit("").alias("email"))
    return days, G.resolved(days.select("cwd"), known)


@query
def roi_projects(spark, d):
    """From the day of ``SINCE`` on."""
    days, roots = _project_days(spark, d)
    commits = A.commits(spark, d).withColumn("repo", F.concat(F.lit("/home/me/proj-"), F.col("repo").cast("string")))
    commits = commits.where(F.col("day") >= F.lit(SINCE.date()))
    return R.returns(G.repository_days(days, roots, SINCE), commits.join(roots.select(F.col("root").alias("repo")).distinct(), "repo", "left_semi"), "week")


@query
def roi_skipped(spark, d):
    return G.skipped(*_project_days(spark, d), SINCE)
