"""From usage events to what was spent: repeats dropped, cells summed, cells priced, and regrouped in all the ways asked for."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlight.plans.pricing import TOKENS, PriceTable, cost, priced

CELL = ("day", "project", "source", "vendor", "model", "is_sub")


def usd(c: Column) -> Column:
    return F.round(c, 8)


def dedupe(events: DataFrame) -> DataFrame:
    """Of rows with the same message and request, the first by ``ord``; rows that lack either stay."""
    keyed = events.where("message_id is not null and request_id is not null")
    first = keyed.withColumn("_n", F.row_number().over(W.partitionBy("message_id", "request_id").orderBy("ord"))).where("_n = 1").drop("_n")
    return first.unionByName(events.where("message_id is null or request_id is null"))


def dupes(events: DataFrame) -> DataFrame:
    keyed = events.where("message_id is not null and request_id is not null").groupBy("message_id", "request_id").agg(F.count("*").alias("n"))
    return keyed.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("dupes"))


def summed(rows: DataFrame, keys: list[str], money: str = "double") -> DataFrame:
    """Token sums, vendors' own costs and rows by ``keys``; tokens of rows with a cost of their own are apart from those to price."""
    costed = F.col("costed")
    sums = [F.sum(t).alias(t) for t in TOKENS]
    sums += [F.sum(F.when(costed, 0).otherwise(F.col(t))).alias(f"p_{t}") for t in TOKENS]
    sums.append(F.coalesce(F.sum(F.when(costed, F.col("cost_usd"))), F.lit(0)).cast(money).alias("costed_usd"))
    return rows.groupBy(*keys).agg(*sums, F.count("*").alias("events"))


def cells(events: DataFrame) -> DataFrame:
    """Sums by day, project, source, vendor, model and side."""
    return summed(dedupe(events).withColumn("day", F.to_date("ts")), list(CELL))


def priced_sums(cells: DataFrame, keys: list[str], table: PriceTable | None = None) -> DataFrame:
    """``keys, usd, tokens`` and the four token sums: summed by the keys and model first, priced then, and folded to the keys."""
    by = list(dict.fromkeys([*keys, "model"]))
    sums = cells.groupBy(*by).agg(*(F.sum(c).alias(c) for c in (*TOKENS, *(f"p_{t}" for t in TOKENS), "costed_usd")))
    to_price = sums.select(*by, *(F.col(t).alias(f"all_{t}") for t in TOKENS), *(F.col(f"p_{t}").alias(t) for t in TOKENS), "costed_usd")
    paid = priced(to_price, table).withColumn("usd", cost() + F.col("costed_usd"))
    every = F.col("all_tok_in") + F.col("all_tok_out") + F.col("all_tok_cw") + F.col("all_tok_cr")
    return paid.groupBy(*keys).agg(usd(F.sum("usd")).alias("usd"), F.sum(every).alias("tokens"), *(F.sum(f"all_{t}").alias(t) for t in TOKENS))


def month_of(as_of: dt.date) -> Column:
    """The calendar month of ``as_of``, days after it too."""
    return F.trunc("day", "month") == F.lit(as_of.replace(day=1))


def week_of(as_of: dt.date) -> Column:
    monday = as_of - dt.timedelta(days=as_of.weekday())
    return (F.col("day") >= F.lit(monday)) & (F.col("day") < F.lit(monday + dt.timedelta(days=7)))


def day_of(as_of: dt.date) -> Column:
    return F.col("day") == F.lit(as_of)


def unknown(events: DataFrame, table: PriceTable | None = None) -> DataFrame:
    """Distinct responses whose model has no price; those with a cost of their own don't count."""
    rows = priced(dedupe(events).where("not costed"), table).where("priced_as is null")
    key = F.coalesce(F.col("message_id").cast("string"), F.concat_ws(":", "model", F.col("ts").cast("string")))
    return rows.agg(F.count_distinct(key).alias("unknown"))


def coverage(events: DataFrame, keys: list[str]) -> DataFrame:
    """Of turns that should report usage, how many do. Rows of vendors that report a cost are such turns."""
    rows = events.where("costed").withColumn("day", F.to_date("ts"))
    out = rows.groupBy(*keys).agg(F.count("*").alias("turns"), F.count_if("has_usage").alias("with_usage"))
    fraction = F.when(F.col("turns") == 0, 1.0).otherwise(F.col("with_usage") / F.col("turns"))
    return out.withColumn("fraction", F.round(fraction, 8)).withColumn("partial", fraction < 0.95)


PERIODS = {"day": day_of, "week": week_of, "month": month_of}


def period(cells: DataFrame, covered: DataFrame, kind: str, as_of: dt.date, table: PriceTable | None = None) -> DataFrame:
    """Series of a day, a week or a month, each with the coverage of its vendor in the same days: null where nothing there says whether it reports usage.

    ``covered``: ``day, vendor, turns, with_usage``.
    """
    inside = PERIODS[kind](as_of)
    share = covered.where(inside).groupBy("vendor").agg(F.sum("turns").alias("turns"), F.sum("with_usage").alias("with_usage"))
    fraction = F.round(F.when(F.col("turns") == 0, 1.0).otherwise(F.col("with_usage") / F.col("turns")), 8)
    series = priced_sums(cells.where(inside), ["source", "vendor", "model"], table)
    return series.join(share.select("vendor", fraction.alias("coverage")), "vendor", "left").select("source", "vendor", "model", "usd", "tokens", "coverage")


def calendar(df: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """The last ``days`` days, one row each."""
    spark = df.sparkSession
    return spark.range(days).select(F.date_sub(F.lit(as_of), (F.lit(days - 1) - F.col("id")).cast("int")).alias("day"))


def daily(cells: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    sums = priced_sums(cells, ["day"])
    none = lambda c: F.coalesce(c, F.lit(0))
    return calendar(cells, as_of, days).join(sums, "day", "left").select("day", none("usd").cast("double").alias("usd"), none("tokens").cast("long").alias("tokens"))


def hourly(events: DataFrame, keys: list[str]) -> DataFrame:
    """Spend by hour of day and ``keys``; cells with the hour in place of the project."""
    costed = F.col("costed")
    rows = dedupe(events).withColumn("day", F.to_date("ts")).withColumn("hour", F.hour("ts"))
    sums = [F.sum(t).alias(t) for t in TOKENS] + [F.sum(F.when(costed, 0).otherwise(F.col(t))).alias(f"p_{t}") for t in TOKENS]
    out = rows.groupBy("day", "hour", *keys, "vendor", "model").agg(*sums, F.coalesce(F.sum(F.when(costed, F.col("cost_usd"))), F.lit(0)).cast("double").alias("costed_usd"))
    return out


def main_sub(cells: DataFrame, keys: list[str]) -> DataFrame:
    """USD and tokens of main sessions and of subagents side by side."""
    sums = priced_sums(cells, [*keys, "is_sub"])
    side = lambda c, sub: F.sum(F.when(F.col("is_sub") == sub, F.col(c)).otherwise(0))
    return sums.groupBy(*keys).agg(
        usd(side("usd", False)).alias("main_usd"), usd(side("usd", True)).alias("sub_usd"), side("tokens", False).alias("main_tokens"), side("tokens", True).alias("sub_tokens")
    )


def regrouped(cells: DataFrame) -> DataFrame:
    """All four groupings at once: by model, by vendor, by source, and in total."""
    sums = priced_sums(cells, ["model", "vendor", "source"])
    rows = sums.select("usd", "tokens", F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), c.alias("name")) for m, c in (("model", F.col("model")), ("vendor", F.col("vendor")), ("source", F.col("source")), ("total", F.lit("total")))))).alias("g"))
    return rows.groupBy("g.mode", "g.name").agg(usd(F.sum("usd")).alias("usd"), F.sum("tokens").alias("tokens"))


def with_share(rows: DataFrame, value: str = "usd") -> DataFrame:
    """Adds each row's share of the total. The rows are a report's series, not events."""
    total = rows.agg(F.sum(value).alias("_total"))
    return rows.join(total, how="cross").withColumn("share", F.round(F.when(F.col("_total") == 0, 0.0).otherwise(F.col(value) / F.col("_total")), 8)).drop("_total")


def ranked_share(rows: DataFrame, value: str = "usd", name: tuple[str, ...] = ("source", "vendor", "model")) -> DataFrame:
    """``with_share``, with each row's place: the largest first, of equals by name."""
    return with_share(rows, value).withColumn("place", F.row_number().over(W.orderBy(F.desc(value), *name)))


def once(events: DataFrame, as_of: dt.date, table: PriceTable | None = None) -> DataFrame:
    """The summary of a run: ``section, place, name`` with spend and tokens. Today and the month, the month by model and by project (with the sides of main sessions and subagents), and how many repeats and unknown responses there were.

    Models and projects stand by spend, of equals by name.
    """
    month = cells(events).where(month_of(as_of))
    none = {"usd": 0.0, **dict.fromkeys(TOKENS, 0), "main_usd": 0.0, "sub_usd": 0.0, "count": 0}

    def rows(df: DataFrame, section: str, place: Column, name: Column) -> DataFrame:
        kinds = {c: "double" if c.endswith("usd") else "long" for c in none}
        held = (F.coalesce(F.col(c), F.lit(v)).cast(kinds[c]).alias(c) if c in df.columns else F.lit(v).cast(kinds[c]).alias(c) for c, v in none.items())
        return df.select(F.lit(section).alias("section"), place.cast("int").alias("place"), name.alias("name"), *held)

    # over a report's models and projects
    first = lambda order: F.row_number().over(W.orderBy(*order))
    models = priced_sums(month, ["model"], table)
    projects = main_sub(month, ["project"]).withColumn("usd", usd(F.col("main_usd") + F.col("sub_usd")))
    today = priced_sums(month.where(day_of(as_of)), ["vendor"], table).agg(F.sum("usd").alias("usd"), *(F.sum(t).alias(t) for t in TOKENS))
    all_month = models.agg(F.sum("usd").alias("usd"), *(F.sum(t).alias(t) for t in TOKENS))
    out = rows(today.withColumn("usd", usd(F.col("usd"))), "total", F.lit(1), F.lit("Today")).unionByName(rows(all_month.withColumn("usd", usd(F.col("usd"))), "total", F.lit(2), F.lit("Month")))
    out = out.unionByName(rows(models, "model", first([F.desc("usd"), "model"]), F.col("model"))).unionByName(rows(projects, "project", first([F.desc("usd"), "project"]), F.col("project")))
    counts = dupes(events).withColumnRenamed("dupes", "count"), unknown(events, table).withColumnRenamed("unknown", "count")
    return out.unionByName(rows(counts[0], "count", F.lit(1), F.lit("dupes"))).unionByName(rows(counts[1], "count", F.lit(2), F.lit("unknown_model_events")))


def top_k(rows: DataFrame, k: int, value: str = "usd", name: str = "name") -> DataFrame:
    """The k largest positive values, and how many more there are."""
    some = rows.where(F.col(value) > 0)
    order = W.orderBy(F.desc(value), name)
    ranked = some.orderBy(F.desc(value), name).limit(max(0, k)).withColumn("rank", F.row_number().over(order))
    more = some.agg(F.greatest(F.count("*") - F.lit(max(0, k)), F.lit(0)).alias("overflow"))
    return ranked.join(more, how="cross").select(name, value, "rank", "overflow")


def palette(month: DataFrame, window: DataFrame) -> DataFrame:
    """Models in the order that they get colours: the month's by spend, then others of the window by name."""
    ranked = month.withColumn("place", F.row_number().over(W.orderBy(F.desc("usd"), "model")))
    extra = window.select("model").distinct().join(month.select("model"), "model", "left_anti")
    n = month.agg(F.count("*").alias("n"))
    extra = extra.join(n, how="cross").withColumn("place", F.col("n") + F.row_number().over(W.orderBy("model")))
    return ranked.select("model", F.col("place").cast("int").alias("place")).unionByName(extra.select("model", F.col("place").cast("int").alias("place")))


def sparkline(rows: DataFrame, value: str = "usd") -> DataFrame:
    """Levels 0 to 8 against the largest value."""
    top = rows.agg(F.greatest(F.max(value), F.lit(0.0001)).alias("_top"))
    level = F.least(F.lit(8), F.greatest(F.lit(0), F.floor(F.col(value) / F.col("_top") * 8)))
    return rows.join(top, how="cross").withColumn("level", level.cast("int")).drop("_top")
