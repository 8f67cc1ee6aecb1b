"""Orders and limits of reports, delivery of sessions, and small rules of what is shown."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlight.functions.text import fmt_tokens_short
from meterlight.functions.text import fixed
from meterlight.operators.sessions import duplicate_reads, finding
from meterlight.operators.usage import usd

# Display orders; what isn't in them comes after, by name.
PHASE_ORDER = ("build", "review", "research", "test", "plan", "writing", "other", "orchestration")
LANGUAGE_ORDER = ("go", "rust", "python", "typescript", "javascript", "ruby", "java", "csharp", "swift", "terraform", "unknown")


def placed(rows: DataFrame, order: list[Column | str], by: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """``rows`` with ``place``, from 1, in the order, for each key; at most ``most`` of each.

    Without a key only reports may be placed (projects, repositories, phases); then one task sorts what is left of them.
    """
    if not by and most is not None:
        rows = rows.orderBy(*order).limit(most)
    out = rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return out.where(F.col("place") <= most) if by and most is not None else out


def projects_by_waste(corpus: DataFrame) -> DataFrame:
    return placed(corpus, [F.desc("waste_usd"), "project"])


def safety_order(safety: DataFrame) -> DataFrame:
    return placed(safety, [F.desc("bypass_pct"), F.desc("turns"), "project"])


def in_display_order(rows: DataFrame, column: str, order: tuple[str, ...]) -> DataFrame:
    """Rows in a fixed order of the column's values, others after them by name."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return placed(rows, [F.when(at > 0, at).otherwise(len(order) + 1), column])


def phase_keys(rows: DataFrame, most: int = 25) -> DataFrame:
    """The costliest of phase, language and tier."""
    return placed(rows, [F.desc("usd"), "phase", "lang", "tier"], most=most)


def costliest(rows: DataFrame, key: str, most: int = 20) -> DataFrame:
    """The costliest subagents, or sessions."""
    return placed(rows, [F.desc("usd"), key], most=most)


def repositories(returns: DataFrame) -> DataFrame:
    """Repositories by what was spent on them in all buckets."""
    sums = returns.groupBy("repo").agg(usd(F.sum("usd")).alias("usd"), F.sum("my_commits").alias("my_commits"), F.sum("my_lines").alias("my_lines"))
    return placed(sums, [F.desc("usd"), "repo"])


def _shown(rows: DataFrame, order: list[Column | str], name: str, count: str, most: int) -> DataFrame:
    """The first ``most`` of each session, and ``more``: how many are left out."""
    rows = placed(rows.select("session_id", F.col(name).alias("name"), F.col(count).alias("count")), order, ("session_id",))
    rows = rows.withColumn("more", F.greatest(F.lit(0), F.count("*").over(W.partitionBy("session_id")) - most))
    return rows.where(F.col("place") <= most)


def top_tools(calls: DataFrame, most: int = 8) -> DataFrame:
    rows = calls.groupBy("session_id", "name").agg(F.count("*").alias("count"))
    return _shown(rows, [F.desc("count"), "name"], "name", "count", most)


def top_reads(calls: DataFrame, most: int = 5) -> DataFrame:
    return _shown(duplicate_reads(calls), [F.desc("count"), "name"], "target", "reads", most)


def active_by_cost(active: DataFrame, most: int | None = 8) -> DataFrame:
    return placed(active, [F.desc("usd_5m"), "session_id"], most=most)


def flagged(reports: DataFrame, most: int = 10) -> DataFrame:
    """The worst sessions with a finding."""
    return placed(reports.where("findings > 0"), [F.desc("score"), F.desc("usd"), "session_id"], most=most)


def of_session(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows of the sessions whose id begins with the prefix."""
    return rows.where(F.col("session_id").cast("string").startswith(prefix))


def newest(files: DataFrame, as_of: dt.datetime, most: int = 50, days: int = 8) -> DataFrame:
    """The last changed of ``path, mtime``, of the last days."""
    return placed(files.where(F.col("mtime") >= F.lit(as_of - dt.timedelta(days=days))), [F.desc("mtime"), "path"], most=most)


# Delivery.


def delivered(sessions: DataFrame, commits: DataFrame, repos: DataFrame) -> DataFrame:
    """``sessions`` (session_id, repo, start, end and more) with ``commits``: how many landed from the start to a minute after the end.

    Null says that it isn't known: the session has no start or repository, or none of ``repos`` is it. That isn't zero.
    Commits are counted, not paired with sessions: a session's are those up to its end less those before its start. Both are read
    off a running count by repository and day, so that a busy repository isn't one group, with what the days before came to.
    """
    upto = F.col("end") + F.expr("interval 1 minute")
    bound = lambda at, kind, sign: F.struct(at.alias("at"), F.lit(kind).alias("kind"), F.lit(sign).alias("sign"))
    bounds = sessions.where("repo is not null").where(upto >= F.col("start")).select("session_id", "repo", F.explode(F.array(bound(F.col("start"), 0, -1), bound(upto, 2, 1))).alias("b"))
    bounds = bounds.select("session_id", "repo", "b.*", F.lit(0).cast("long").alias("n"))
    made = commits.where("repo is not null and at is not null").groupBy("repo", "at").agg(F.count("*").alias("n"))
    # at the same time a start stands before the commits, an end after them
    rows = bounds.unionByName(made.withColumn("kind", F.lit(1)), allowMissingColumns=True).withColumn("day", F.to_date("at"))
    earlier = W.partitionBy("repo").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    days = rows.groupBy("repo", "day").agg(F.sum("n").alias("n")).select("repo", "day", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = W.partitionBy("repo", "day").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = rows.withColumn("_upto", F.sum("n").over(within)).where("sign is not null").join(days, ["repo", "day"])
    met = counted.groupBy("session_id").agg(F.sum(F.col("sign") * (F.col("before") + F.col("_upto"))).alias("n"))
    known = repos.select("repo").distinct().withColumn("known", F.lit(True))
    rows = sessions.join(known, "repo", "left").join(met, "session_id", "left")
    sure = F.col("known") & F.col("start").isNotNull()
    return rows.withColumn("commits", F.when(sure, F.coalesce("n", F.lit(0)).cast("long"))).drop("n", "known")


def delivery_findings(rows: DataFrame, least_usd: float = 20.0) -> DataFrame:
    """Costly sessions of ``delivered`` that have no link to a request (``has_pr``) and surely no commit: one finding that costs nothing."""
    detail = F.concat(F.lit("$"), fixed(F.col("usd"), 2), F.lit(" session with no commit and no PR — did the work land?"))
    return finding(rows.where((F.col("usd") >= least_usd) & ~F.col("has_pr") & (F.col("commits") == 0)), "delivery", F.lit(1), detail=detail)


def project_prompts(prompts: DataFrame, reports: DataFrame, most: int = 80) -> DataFrame:
    """What was typed in a project's sessions, at most ``most`` texts each: the worst session's first, in their order."""
    order = [F.desc("score"), F.desc("usd"), F.col("session_id"), F.col("ord")]
    rows = prompts.where("text is not null").select("session_id", "ord", "text").join(reports.select("session_id", "project", "score", "usd"), "session_id")
    return placed(rows, order, ("project",), most).select("project", "place", "session_id", "ord", "text")


def with_delivery(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """Session reports that count the delivery finding, in number and score."""
    n = findings.groupBy("session_id").agg(F.count("*").alias("more"))
    rows = reports.join(n, "session_id", "left").withColumn("more", F.coalesce("more", F.lit(0)))
    return rows.withColumn("findings", F.col("findings") + F.col("more")).withColumn("score", F.round(F.col("score") + F.col("more"), 8)).drop("more")


# Windows, owners, texts.


def bucket_kind(name: str) -> str:
    """day or month; anything else is a week."""
    return name if name in ("day", "month") else "week"


def report_since(now: dt.datetime, days: int) -> dt.datetime:
    """The cutoff of a report; 90 days unless some are asked for."""
    return now - dt.timedelta(days=days if days > 0 else 90)


def clamped(costs: DataFrame, since: dt.datetime) -> DataFrame:
    """Costs from the midnight on before ``since``."""
    return costs.where(F.col("day") >= F.lit(since.date()))


def owners(paths: DataFrame, sources: DataFrame) -> DataFrame:
    """``paths`` (path) with the ``id`` of the source whose root (``sources``: id, root) holds it; of several the longest root, of none null.

    A path has few prefixes, so paths meet roots by equality on them.
    """
    roots = sources.select(F.regexp_replace("root", "/+$", "").alias("_root"), "id")
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    found = paths.select("path").distinct().withColumn("_root", F.explode(prefixes)).join(roots, "_root").groupBy("path").agg(F.max_by("id", F.length("_root")).alias("id"))
    return paths.join(found, "path", "left")


def line_ratio_text(value: Column) -> Column:
    return F.when(value > 0, F.format_string("$%.4f", value.cast("double"))).otherwise("—")


def token_ratio_text(value: Column) -> Column:
    return F.when(value > 0, fmt_tokens_short(F.floor(value).cast("long"))).otherwise("—")


def coverage_suffix(covered: Column, events: Column) -> Column:
    """`` ~NN%`` behind a figure that not all events are in; else nothing."""
    return F.when(covered < events, F.format_string(" ~%.0f%%", 100.0 * covered / events)).otherwise("")


def footer(pricing: str, unpriced: int, parse_errors: int) -> list[str]:
    return [*([pricing] if pricing else []), *([f"⚠ {unpriced} events with unpriced models"] if unpriced > 0 else []), *([f"⚠ {parse_errors} parse errors"] if parse_errors > 0 else [])]


def first_object(text: str) -> str | None:
    """The first balanced ``{…}``; braces in strings don't count."""
    start = text.find("{")
    depth, quoted, escaped = 0, False, False
    for at in range(start, len(text) if start >= 0 else start):
        c = text[at]
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : at + 1]
    return None


def reply_json(reply: Column) -> Column:
    """``first_object`` of each reply; null if there is none."""

    @F.arrow_udf("string")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if t is None else first_object(t) for t in batch.to_pylist()], pa.string())

    return found(reply)
