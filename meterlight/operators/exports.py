"""Tables as they are handed on: rows for CSV files, digests of sessions as JSON, and the segments of a bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlight.functions.text import cells_of_ten, fixed, ratio_text, truncated
from meterlight.operators.reports import bucket, safety
from meterlight.operators.sessions import findings, reports
from meterlight.plans.pricing import PriceTable


def two_digits(v: Column) -> Column:
    return F.format_string("%.2f", v)


def four_digits(v: Column) -> Column:
    return fixed(v, 4)


def report_rows(costs: DataFrame, commits: DataFrame, kind: str = "week") -> DataFrame:
    """Spend against commits by repository and bucket, ready for CSV. Ratios go by one's own commits and lines; a ratio without a divisor is empty."""
    label = bucket(F.col("day"), kind).alias("bucket")
    spent = costs.groupBy("repo", label).agg(F.sum("usd").alias("usd"), F.sum("tokens").alias("tokens"))
    own = lambda c: F.sum(F.when(F.col("mine"), F.col(c)).otherwise(0))
    done = commits.groupBy("repo", label).agg(
        F.count_if("mine").alias("commits_mine"), F.count("*").alias("commits_all"), own("added").alias("added"), own("deleted").alias("deleted"), own("files").alias("files")
    )
    rows = spent.join(done, ["repo", "bucket"], "full_outer").na.fill(0)
    changed = F.col("added") + F.col("deleted")
    per = lambda v, n: ratio_text(F.when(n > 0, F.col(v) / n).otherwise(0.0))
    return rows.select(
        "repo", "bucket", two_digits(F.col("usd")).alias("usd"), "commits_mine", "commits_all", "added", "deleted", "files", per("usd", F.col("commits_mine")).alias("usd_per_commit"), per("usd", changed).alias("usd_per_line"),
        "tokens", per("tokens", F.col("commits_mine")).alias("tokens_per_commit"), per("tokens", changed).alias("tokens_per_line"),
    )


def safety_rows(prompts: DataFrame) -> DataFrame:
    """Turns by project and mode, ready for CSV."""
    return safety(prompts).select(
        "project", "turns", "sessions", "default", F.col("acceptEdits").alias("accept_edits"), "plan", "auto", F.col("dontAsk").alias("dont_ask"), F.col("bypassPermissions").alias("bypass"),
        F.format_string("%.1f", "bypass_pct").alias("bypass_pct"), "container_sessions", F.replace(F.col("entrypoints"), F.lit(","), F.lit(" ")).alias("entrypoints"),
    )


def finding_rows(events: DataFrame, calls: DataFrame, prompts: DataFrame, table: PriceTable | None = None, delivery: DataFrame | None = None) -> DataFrame:
    """A row for each finding, and one without a finding for each session that has none, ready for CSV: money with four digits."""
    found = findings(events, calls, prompts, table, delivery=delivery)
    kind = F.split("category", "_")[0]
    found = found.select("session_id", kind.alias("category"), "detail", F.col("count").cast("string").alias("count"), four_digits(F.col("usd")).alias("finding_usd"))
    rows = reports(events, calls, prompts, table, delivery=delivery).join(found, "session_id", "left")
    texts = (F.coalesce(c, F.lit("")).alias(c) for c in ("category", "detail", "count", "finding_usd"))
    return rows.select(F.col("session_id").cast("string").alias("session"), "project", four_digits(F.col("usd")).alias("usd"), four_digits(F.col("waste_usd")).alias("waste_usd"), *texts)


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header; files as the rows are dealt."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def _first(rows: DataFrame, most: int, name: str, *order: str) -> DataFrame:
    """The first ``most`` of each session in ``name``, and how many more there are."""
    placed = rows.withColumn("_n", F.row_number().over(W.partitionBy("session_id").orderBy(*order)))
    held = F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", "item"))))
    out = placed.groupBy("session_id").agg(held.alias("_l"), F.greatest(F.count("*") - most, F.lit(0)).alias(f"dropped_{name}"))
    return out.select("session_id", F.col("_l.item").alias(name), f"dropped_{name}")


def digests(overview: DataFrame, prompts: DataFrame, calls: DataFrame, reports: DataFrame, most_prompts: int = 40, most_tools: int = 120, most_chars: int = 280) -> DataFrame:
    """``session_id, json``: a session in short, with its first prompts and calls, what was left out counted. A list is at most as long as its parameter."""
    said = _first(prompts.where("text is not null").select("session_id", "ord", truncated(F.col("text"), most_chars).alias("item")), most_prompts, "prompts", "ord")
    tool = F.struct("name", truncated(F.col("target"), most_chars).alias("target"), F.col("is_err").alias("err"), F.col("is_sub").alias("sub"))
    used = _first(calls.select("session_id", "ts", "ord", tool.alias("item")), most_tools, "tools", "ts", "ord")
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    metrics = reports.select("session_id", F.struct("usd", "waste_usd", "findings", "score").alias("metrics"))
    rows = overview.select("session_id", "project", "cwd", at("start"), at("end")).join(said, "session_id", "left").join(used, "session_id", "left").join(metrics, "session_id", "left")
    return rows.select("session_id", F.to_json(F.struct(*rows.columns)).alias("json"))


def segments(rows: DataFrame, limit_usd: float, key: str, order: str, value: str = "usd") -> DataFrame:
    """``cells`` of ten for each segment of a key's bar: the rounded running sum less the one before, so that they sum to what the whole bar has."""
    w = W.partitionBy(key).orderBy(order)
    filled = lambda v: cells_of_ten(100.0 * v / F.lit(limit_usd)) if limit_usd > 0 else F.lit(0)
    upto = F.sum(value).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("_upto", F.least(filled(upto), filled(F.sum(value).over(W.partitionBy(key)))))
    return rows.withColumn("cells", F.col("_upto") - F.coalesce(F.lag("_upto").over(w), F.lit(0))).drop("_upto")
