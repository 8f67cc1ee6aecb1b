"""The usage model's relations, derived from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MODES = ("default", "acceptEdits", "plan", "auto", "dontAsk", "bypassPermissions")
VERBS = ("edit ch 3", "review", "research", "implement", "spec", "verify", "tidy", "hunt")
COMMANDS = ("cargo test", "go build ./...", "pytest -q", "npx vitest", "npm install", "bundle exec rspec", "gradle build", "dotnet test", "swift test", "terraform plan", "ls -la")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def _case(of: Column, cases: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for value, result in cases.items():
        out = F.when(of == value, result).otherwise(out)
    return out


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_rows(table(spark, sf_dir, "events"))


def usage_rows(events: DataFrame) -> DataFrame:
    """One row for each usage event: when, who, what model, four token counts, vendor-reported cost, and the key to tell repeats by."""
    kind, user, n = F.col("event_type"), F.col("user_id"), F.col("event_id")
    vendor = _case(kind, {"purchase": "grok", "signup": "codex"}, "claude")
    model = _case(kind, {"view": "claude-opus-4-7", "click": "claude-sonnet-4-6", "signup": "codex-auto-review", "purchase": "grok-4.6-build"}, "mystery-model")
    return events.select(
        n.alias("ord"), F.col("ts").cast("timestamp_ntz").alias("ts"), user.alias("session_id"), F.concat(F.lit("proj-"), (user % 12).cast("string")).alias("project"),
        vendor.alias("vendor"), F.concat(vendor, F.when(user % 2 == 0, "/work").otherwise("/personal")).alias("source"), model.alias("model"), (user % 3 == 0).alias("is_sub"),
        (_k() * 1000).alias("tok_in"), (_k() * 100).alias("tok_out"), (n % 7 * 500).alias("tok_cw"), (n % 11 * 2000).alias("tok_cr"),
        (vendor == "grok").alias("costed"), F.col("value").cast("decimal(18,4)").alias("cost_usd"),
        (n - F.when(n % 5 == 4, 1).otherwise(0)).alias("message_id"), F.when(n % 13 != 0, F.lit(1)).alias("request_id"), (n % 4 != 0).alias("has_usage"),
    )


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _case(F.col("event_type"), {"view": "Read", "click": "Edit", "signup": "Skill", "purchase": "Write"}, "Bash")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("ord"), name.alias("name"),
        F.concat(F.lit("/f"), (_k() % 10).cast("string")).alias("target"), (F.col("event_type") == "error").alias("is_err"), (F.col("event_id") % 4 == 0).alias("is_sub"),
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    modes = F.array(*map(F.lit, MODES))
    cwd = F.element_at(F.array(*map(F.lit, ("/Users/jane/src", "/workspace", "/tmp/x", ""))), (c % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select(
        c.alias("session_id"), F.col("turn").alias("ord"), F.element_at(modes, ((c + F.col("turn")) % 6 + 1).cast("int")).alias("mode"), cwd.alias("cwd"),
        F.when(c % 2 == 0, "cli").otherwise("sdk").alias("entrypoint"), F.concat(F.lit("proj-"), (c % 9).cast("string")).alias("project"), F.col("text"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counters that restart, and now and then repeat."""
    w = W.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type"), (F.sum(_k()).over(w) % 2000).alias("raw"))
    total = F.when((F.col("event_id") % 7 == 0) & F.lag("raw").over(w).isNotNull(), F.lag("raw").over(w)).otherwise(F.col("raw"))
    declared = F.when(F.col("event_type") == "signup", F.concat(F.lit("model-"), (F.col("event_id") % 3).cast("string")))
    return rows.select(F.col("user_id").alias("path"), F.col("event_id").alias("ord"), total.alias("total_in"), (total * 2).alias("total_out"), declared.alias("declared"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 20).alias("repo"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")).alias("day"),
        F.timestamp_add("SECOND", (k * 37 % 86400).cast("int"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")).cast("timestamp_ntz")).alias("at"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("mine"), (k % 97).alias("added"), (k % 41).alias("deleted"),
    )


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subagents, with what they were told, a command that they ran, a file that they edited, tokens and the model."""
    k = F.col("p_partkey")
    at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        k.alias("agent_id"), F.concat(at(VERBS, k), F.lit(" "), F.col("p_name")).alias("description"), at(COMMANDS, F.col("p_size")).alias("command"),
        F.concat(F.lit("/src/a."), at(("go", "rs", "py", "ts", "md"), k)).alias("path"), at(("claude-opus-4-7", "claude-sonnet-4-6", "claude-haiku-4-5", "fable", "mystery"), k).alias("model"),
        F.concat(F.lit("proj-"), (k % 7).cast("string")).alias("project"), (k % 3).alias("depth"), (k % 50 * 1000).alias("tok_in"), (k % 20 * 100).alias("tok_out"),
        (k % 5 * 10).alias("tok_cw"), (k % 9 * 500).alias("tok_cr"),
    )


def plan_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.when(F.col("user_id") % 2 == 0, 300).otherwise(10080)
    ts = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 3 == 0, "codex").otherwise("grok").alias("vendor"), minutes.alias("window_minutes"), F.col("value").alias("pct"),
        ts.alias("observed"), (ts + F.make_dt_interval(mins=minutes)).alias("resets_at"), F.col("event_id").alias("ord"),
    )
