"""Reports beside the usage snapshot: safety, phases, returns on spend, budgets, plan gauges and live sessions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlight.operators.usage import dedupe, usd, week_of
from meterlight.plans.pricing import PriceTable, component, cost, priced, tier
from meterlight.sources.tables import MODES

BYPASS = "bypassPermissions"


def container_likely(cwd: Column, home: str = "/Users/jane") -> Column:
    """Whether a working directory looks like a container's: not empty, not beside the home directory, and not a temporary one."""
    parent = home.rsplit("/", 1)[0]
    host = (cwd == home) | cwd.startswith(f"{parent}/")
    for p in ("/tmp", "/private", "/var/folders"):
        host = host | (cwd == p) | cwd.startswith(f"{p}/")
    return (cwd != "") & ~host


def prompts_since(prompts: DataFrame, since: dt.datetime | None) -> DataFrame:
    """Prompts from a time on; one without a time is before any. Sessions without prompts left are dropped by what counts them."""
    return prompts if since is None else prompts.where(F.col("ts") >= F.lit(since))


def safety_sessions(prompts: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("mode") == m).alias(m) for m in MODES]
    return prompts.where("mode <> ''").groupBy("session_id").agg(
        F.min_by("project", "ord").alias("project"), F.coalesce(F.min_by(F.when(F.col("cwd") != "", F.col("cwd")), F.when(F.col("cwd") != "", F.col("ord"))), F.lit("")).alias("cwd"),
        F.min_by("entrypoint", "ord").alias("entrypoint"), F.count("*").alias("turns"), *counts,
    ).withColumn("container", container_likely(F.col("cwd")))


def safety(prompts: DataFrame, since: dt.datetime | None = None) -> DataFrame:
    rows = safety_sessions(prompts_since(prompts, since)).groupBy("project").agg(
        F.sum("turns").alias("turns"), F.count("*").alias("sessions"), *(F.sum(m).alias(m) for m in MODES),
        F.count_if("container").alias("container_sessions"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("entrypoint") != "", F.col("entrypoint")))), ",").alias("entrypoints"),
    )
    return rows.withColumn("bypass_pct", F.round(100.0 * F.col(BYPASS) / F.col("turns"), 8))


def safety_summary(prompts: DataFrame, since: dt.datetime | None = None) -> DataFrame:
    s = safety_sessions(prompts_since(prompts, since))
    by_project = s.groupBy("project").agg(F.sum(BYPASS).alias("b"), F.sum("turns").alias("t"), F.count_if(F.col("container") & (F.col(BYPASS) > 0)).alias("c"))
    out = by_project.agg(F.sum("t").alias("turns"), F.sum("b").alias("bypass_turns"), F.count_if(F.col("b") > 0).alias("bypass_projects"), F.sum("c").alias("container_sessions"))
    return out.withColumn("bypass_pct", F.round(F.when(F.col("turns") > 0, 100.0 * F.col("bypass_turns") / F.col("turns")).otherwise(0.0), 8))


# What a subagent is for by its description, the first rule that fits; and languages by commands and by endings of files.
PHASES = (
    ("writing", r"(edit\s+(ca|es|ch)|expand\s+ch|thin\s+(tics|ch)|gloss[- ]cut|voice\s+line[- ]edit|tic[- ]sweep|close[- ]read|betterment\s+sweep|aggressive\s+gloss|book[- ]wide|translate\s+chapters|ebook)"),
    ("review", r"(review|audit|quality|code[- ]?review|security|silent[- ]failure|hunt|harden|sec\s+task|compliance|policy.?correct|hardening|deep\s+audit|best\s+practices)"),
    ("research", r"(research|explore|analyz|investigat|find|mine|map|trace|scope|survey|fetch|inventory|extract|deep\s+dive|gather|dig|triage)"),
    ("build", r"(implement|build|fix|add|create|update|write|phase\s+[a-h]|batch\s+\d|wave\s+\d|task\s+\d|migrate|refactor|wir(e|ing)|port|scaffold|restore|redesign|rename|replace|convert|generate|translate|expand|draft|author|allowlist|complete|integrate|align|reconcil)"),
    ("plan", r"(spec|plan|design|arch|blueprint)"),
    ("test", r"(test|verify|smoke|e2e)"),
)
COMMAND_LANGUAGES = (
    ("rust", r"(cargo|rustc)"), ("go", r"go\s+(test|build|run|vet|fmt|mod)"), ("python", r"(pytest|python3?|pip|uv|poetry)"), ("typescript", r"(tsc|vitest|jest)"),
    ("javascript", r"(npm|npx|yarn|pnpm|bun|node)"), ("ruby", r"(rspec|ruby|bundle)"), ("java", r"(mvn|gradle|javac)"), ("csharp", r"(dotnet|csc)"),
    ("swift", r"(swift\s+test|xcodebuild)"), ("terraform", r"(terraform|tofu)"),
)
FILE_LANGUAGES = {
    ".go": "go", ".rs": "rust", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript",
    ".jsx": "javascript", ".rb": "ruby", ".java": "java", ".cs": "csharp", ".swift": "swift", ".tf": "terraform",
}


def _whole(pattern: str) -> str:
    """The pattern between ASCII word boundaries, which Java's own aren't."""
    return rf"(?<![0-9A-Za-z_]){pattern}(?![0-9A-Za-z_])"


def phase(description: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(PHASES):
        out = F.when(description.rlike("(?i)" + _whole(pattern)), name).otherwise(out)
    return out


def command_language(command: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(COMMAND_LANGUAGES):
        out = F.when(command.rlike(_whole(pattern)), name).otherwise(out)
    return out


def file_language(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    out = F.lit(None).cast("string")
    for end, name in FILE_LANGUAGES.items():
        out = F.when(ending == end, name).otherwise(out)
    return out


def language_votes(commands: DataFrame, files: DataFrame, key: str = "agent_id") -> DataFrame:
    """The language with most votes, two for a command and one for a file; of equals the first by name."""
    votes = commands.select(key, command_language(F.col("command")).alias("lang"), F.lit(2).alias("v")).unionByName(files.select(key, file_language(F.col("path")).alias("lang"), F.lit(1).alias("v")))
    sums = votes.where("lang is not null").groupBy(key, "lang").agg(F.sum("v").alias("votes"))
    return sums.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("votes"), "lang"))).where("r = 1").select(key, "lang", "votes")


def agent_costs(agents: DataFrame, table: PriceTable | None = None) -> DataFrame:
    """Subagents with phase, language, tier and cost; those that cost nothing are left out."""
    rows = priced(agents, table).withColumn("usd", cost()).where("usd <> 0")
    rows = rows.join(language_votes(agents, agents).drop("votes"), "agent_id", "left")
    return rows.select("agent_id", "project", "depth", phase(F.col("description")).alias("phase"), F.coalesce("lang", F.lit("unknown")).alias("lang"), tier(F.col("model")).alias("tier"), "usd")


def agents_of(subagents: DataFrame, events: DataFrame, calls: DataFrame, table: PriceTable | None = None) -> DataFrame:
    """As ``agent_costs``, from what transcripts say: a subagent's turns are those of the file with its stem, and its tier is that of the first turn counted.

    ``subagents`` has ``stem, description, depth``; ``events`` and ``calls`` have the ``path`` that they were read from.
    """
    stem = F.regexp_replace("path", r"\.jsonl\z", "")
    turns = priced(dedupe(events.where("is_sub")), table).select(stem.alias("stem"), "project", "ord", tier(F.col("model")).alias("tier"), cost().alias("usd"))
    sums = turns.groupBy("stem", "project").agg(usd(F.sum("usd")).alias("usd"), F.min_by("tier", "ord").alias("tier")).where("usd <> 0")
    own = calls.where("is_sub").select(stem.alias("stem"), "name", "command", "file_path")
    commands = own.where("name = 'Bash' and command <> ''").select("stem", "command")
    files = own.where("name in ('Write', 'Edit', 'NotebookEdit') and file_path <> ''").select("stem", F.col("file_path").alias("path"))
    rows = subagents.join(sums, "stem").join(language_votes(commands, files, "stem").drop("votes"), "stem", "left")
    return rows.select(F.col("stem").alias("agent_id"), "project", "depth", phase(F.col("description")).alias("phase"), F.coalesce("lang", F.lit("unknown")).alias("lang"), "tier", "usd")


def by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(usd(F.sum("usd")).alias("usd"), F.count("*").alias("count"))


def main_cells(events: DataFrame, table: PriceTable | None = None) -> DataFrame:
    """Main sessions' cost by project, session and tier, of deduplicated events. Sessions that cost nothing are left out, whole."""
    rows = priced(events.where("not is_sub"), table)
    sums = rows.groupBy("project", "session_id", tier(F.col("model")).alias("tier")).agg(F.sum(cost()).alias("usd"), F.count("*").alias("responses"))
    return sums.withColumn("_all", F.sum("usd").over(W.partitionBy("project", "session_id"))).where("_all <> 0").drop("_all")


def main_by_project(cells: DataFrame) -> DataFrame:
    """Of ``main_cells``: cost and sessions."""
    return cells.groupBy("project").agg(usd(F.sum("usd")).alias("usd"), F.count_distinct("session_id").alias("sessions"))


def main_by_project_tier(cells: DataFrame) -> DataFrame:
    return cells.groupBy("project", "tier").agg(usd(F.sum("usd")).alias("usd"))


def session_tiers(cells: DataFrame, most: int = 20) -> DataFrame:
    """The costliest sessions of ``main_cells``, with what each tier costs in them."""
    per = cells.groupBy("project", "session_id").agg(usd(F.sum("usd")).alias("usd"), F.sum("responses").alias("responses"))
    order = [F.desc("usd"), "session_id", "project"]
    top = per.orderBy(*order).limit(most).withColumn("place", F.row_number().over(W.orderBy(*order)))
    return top.join(cells.select("project", "session_id", "tier", usd(F.col("usd")).alias("tier_usd")), ["project", "session_id"])


def main_costs(events: DataFrame, table: PriceTable | None = None) -> DataFrame:
    """Main sessions' cost by component, their responses and span."""
    rows = priced(events.where("not is_sub"), table)
    names = (("in_usd", "tok_in", "rate_in"), ("out_usd", "tok_out", "rate_out"), ("cw_usd", "tok_cw", "rate_cw"), ("cr_usd", "tok_cr", "rate_cr"))
    return rows.groupBy("session_id").agg(*(usd(F.sum(component(t, r))).alias(n) for n, t, r in names), usd(F.sum(cost())).alias("usd"), F.count("*").alias("responses"), F.min("ts").alias("start"), F.max("ts").alias("end")).where("usd <> 0")


def bucket(day: Column, kind: str) -> Column:
    """A day's label, its ISO week's or its month's."""
    if kind == "day":
        return F.date_format(day, "yyyy-MM-dd")
    if kind == "month":
        return F.date_format(day, "yyyy-MM")
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))


def returns(costs: DataFrame, commits: DataFrame, kind: str = "week") -> DataFrame:
    """Spend (repo, day, usd, tokens) against commits (repo, day, mine, added, deleted), each summed by bucket before they meet."""
    spent = costs.groupBy("repo", bucket(F.col("day"), kind).alias("bucket")).agg(F.sum("usd").alias("usd"), F.sum("tokens").alias("tokens"))
    lines = F.col("added") + F.col("deleted")
    done = commits.groupBy("repo", bucket(F.col("day"), kind).alias("bucket")).agg(
        F.count("*").alias("commits"), F.count_if("mine").alias("my_commits"), F.sum(lines).alias("lines"), F.sum(F.when(F.col("mine"), lines).otherwise(0)).alias("my_lines")
    )
    rows = spent.join(done, ["repo", "bucket"], "full_outer").na.fill(0)
    ratio = lambda n: F.round(F.when(F.col(n) > 0, F.col("usd") / F.col(n)).otherwise(0.0), 8)
    return rows.select("repo", "bucket", usd(F.col("usd")).alias("usd"), "tokens", "commits", "my_commits", "lines", "my_lines", ratio("my_commits").alias("usd_per_commit"), ratio("my_lines").alias("usd_per_line"))


def budget_status(daily: DataFrame, as_of: dt.date, daily_limit: float, weekly_limit: float, warn_pct: float = 80.0) -> DataFrame:
    """Spend of the day and of the ISO week against their limits: unset, ok, warn or over, and when the window ends."""
    warn = warn_pct if warn_pct > 0 else 80.0
    monday = as_of - dt.timedelta(days=as_of.weekday())
    sums = daily.agg(F.coalesce(F.sum(F.when(F.col("day") == F.lit(as_of), F.col("usd"))), F.lit(0.0)).alias("day"), F.coalesce(F.sum(F.when(week_of(as_of), F.col("usd"))), F.lit(0.0)).alias("week"))
    ends = {"day": as_of + dt.timedelta(days=1), "week": monday + dt.timedelta(days=7)}
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit(w).alias("window"), F.col(w).alias("spent"), F.lit(float(limit)).alias("limit_usd"), F.lit(ends[w]).alias("resets_on")) for w, limit in (("day", daily_limit), ("week", weekly_limit))))).alias("r")).select("r.*")
    pct = F.when(F.col("limit_usd") > 0, 100.0 * F.col("spent") / F.col("limit_usd")).otherwise(0.0)
    state = F.when(F.col("limit_usd") <= 0, "unset").when(pct >= 100, "over").when(pct >= warn, "warn").otherwise("ok")
    return rows.select("window", usd(F.col("spent")).alias("spent"), "limit_usd", F.round(pct, 8).alias("pct"), state.alias("state"), "resets_on")


def window_label(minutes: Column) -> Column:
    return F.when(minutes < 1440, F.concat(F.expr("cast(window_minutes div 60 as string)"), F.lit("h"))).when(minutes == 1440, "24h").otherwise(F.concat(F.expr("cast(window_minutes div 1440 as string)"), F.lit("d")))


def latest_plans(readings: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The last reading of each vendor's window; of readings at one time the first read. Stale if its window has ended."""
    w = W.partitionBy("vendor", "window_minutes").orderBy(F.desc("observed"), "ord")
    rows = readings.where("window_minutes > 0").withColumn("r", F.row_number().over(w)).where("r = 1")
    return rows.select("vendor", "window_minutes", window_label(F.col("window_minutes")).alias("label"), "pct", "observed", "resets_at", (F.col("resets_at") < F.lit(as_of).cast("timestamp_ntz")).alias("stale"))


VENDORS = ("claude", "codex", "grok")


def gauges(plans: DataFrame, vendors: tuple[str, ...] = VENDORS) -> DataFrame:
    """Gauges in display order: short windows first, then vendors in their order, then shorter windows; with cells of ten and a tint."""
    place = F.array_position(F.array(*map(F.lit, vendors)), F.col("vendor")).cast("int")
    band = F.when(F.col("label").endswith("h"), 0).otherwise(1)
    tint = F.when(F.col("stale"), "stale").when(F.col("pct") >= 100, "over").when(F.col("pct") >= 80, "warn").otherwise("ok")
    filled = F.least(F.lit(10), F.greatest(F.lit(0), F.floor(F.col("pct") / 10 + 0.5))).cast("int")
    rows = plans.where(F.col("vendor").isin(*vendors)).select("vendor", "label", F.round("pct", 8).alias("pct"), band.alias("band"), filled.alias("cells"), tint.alias("tint"), place.alias("_p"), "window_minutes")
    return rows.withColumn("place", F.row_number().over(W.orderBy("band", "_p", "window_minutes"))).drop("_p", "window_minutes")


def worst(plans: DataFrame, vendors: tuple[str, ...] = VENDORS) -> DataFrame:
    """The fullest window that isn't stale, of the vendors that ``gauges`` shows."""
    return plans.where(~F.col("stale") & F.col("vendor").isin(*vendors)).agg(F.coalesce(F.max("pct"), F.lit(0.0)).alias("worst_pct"))


def active_sessions(events: DataFrame, as_of: dt.datetime, idle_minutes: int = 30, table: PriceTable | None = None) -> DataFrame:
    """Sessions heard of in the last ``idle_minutes``: turns of the main side, spend in all and in five minutes, cost of writing the cache, and the context of the last main turn."""
    now = F.lit(as_of).cast("timestamp_ntz")
    rows = priced(events.where(F.col("ts") <= now), table)
    paid = F.when(F.col("costed"), F.col("cost_usd").cast("double")).otherwise(cost())
    context = F.col("tok_in") + F.col("tok_cw") + F.col("tok_cr")
    main = ~F.col("is_sub")
    out = rows.groupBy("session_id").agg(
        F.count_if(main).alias("turns"), usd(F.sum(paid)).alias("usd"), usd(F.coalesce(F.sum(F.when(F.col("ts") >= now - F.expr("interval 5 minutes"), paid)), F.lit(0.0))).alias("usd_5m"),
        usd(F.coalesce(F.sum(F.when(F.col("costed"), 0.0).otherwise(component("tok_cw", "rate_cw"))), F.lit(0.0))).alias("cache_usd"),
        F.coalesce(F.max_by(F.when(main, context), F.when(main, F.struct("ts", "ord"))), F.lit(0)).alias("context"), F.coalesce(F.max(F.when(main, context)), F.lit(0)).alias("peak"), F.max("ts").alias("last"),
    )
    return out.where(F.col("last") >= now - F.make_dt_interval(mins=F.lit(idle_minutes)))


def warnings(active: DataFrame, context_pct: float = 0.8, cost_5m: float = 5.0, cache_usd: float = 1.0) -> DataFrame:
    """What of a live session is above its threshold; on it isn't."""
    share = F.least(F.lit(1.0), F.col("context") / F.when(F.col("peak") > 200_000, 1_000_000).otherwise(200_000))
    return active.select("session_id", (share > context_pct).alias("context_high"), (F.col("usd_5m") > cost_5m).alias("cost_high"), (F.col("cache_usd") > cache_usd).alias("cache_high"))


def to_notify(now: DataFrame, before: DataFrame) -> DataFrame:
    """Session and condition of warnings that weren't on before. Only context and cache notify."""
    on = now.select("session_id", F.explode(F.filter(F.array(F.when(F.col("context_high"), "context"), F.when(F.col("cache_high"), "cache")), lambda c: c.isNotNull())).alias("condition"))
    old = before.select("session_id", F.explode(F.filter(F.array(F.when(F.col("context_high"), "context"), F.when(F.col("cache_high"), "cache")), lambda c: c.isNotNull())).alias("condition"))
    return on.join(old, ["session_id", "condition"], "left_anti")
