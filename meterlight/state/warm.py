"""Usage cells that are kept between runs, so that the next run reads only what files have grown by.

Kept are the cells, the hours of the last 30 days, coverage, the keys that repeats are told by, each file's size and the end of
what was read of it, and what was in effect at that place for files whose lines build on earlier ones.
"""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlight.operators.usage import CELL, summed
from meterlight.plans.pricing import TOKENS, PriceTable, priced
from meterlight.sources.growing import changed, listed, read_ranges, with_ends
from meterlight.sources.jsonl import COUNTERS, EVENT, META, NAMES, Source, checked, codex_readings, codex_steps, parse_claude, parse_grok, reachable
from meterlight.state.store import Store

VERSION = 1
#: Days of a scan without a store, from now; days that hours are kept; parts that keys are split to, and are written in before they become one.
SCAN_DAYS, HOUR_DAYS, BUCKETS, KEY_PARTS = 35, 30, 64, 16
SUMS = [*TOKENS, *(f"p_{t}" for t in TOKENS), "costed_usd", "events"]
_SUMS = ", ".join(f"{c} decimal(38,9)" if c == "costed_usd" else f"{c} long" for c in SUMS)
CELLS = f"day date, project string, source string, vendor string, model string, is_sub boolean, {_SUMS}"
HOUR = ("day", "hour", "vendor", "model")
HOURS = f"day date, hour int, vendor string, model string, {_SUMS}"
COVERAGE = "day date, vendor string, turns long, with_usage long"
FILES = "path string, source string, size long, end long"
PARSERS = f"path string, meta {META}, declared string, input long, cached_input long, output long, total long"
KEYS = "message_id string, request_id string, bucket int"
UNKNOWN = "model string, message string"


def scan_cutoff(now: dt.datetime, days: int = SCAN_DAYS) -> dt.datetime:
    """Files not changed since then aren't read: the start of the month, or ``days`` ago if that is earlier."""
    return min(now.replace(day=1, hour=0, minute=0, second=0, microsecond=0), now - dt.timedelta(days=days))


@dataclass(frozen=True)
class Kept:
    """One generation of the store, as tables."""

    store: Store
    manifest: dict

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.store.table(self.manifest, name, schema)

    def cells(self) -> DataFrame:
        """As ``usage.cells`` has them of all events."""
        return self._table("cells", CELLS).withColumn("costed_usd", F.col("costed_usd").cast("double"))

    def hours(self, now: dt.datetime) -> DataFrame:
        """Spend by hour of the last 30 days."""
        return _recent(self._table("hours", HOURS), now).withColumn("costed_usd", F.col("costed_usd").cast("double"))

    def coverage(self) -> DataFrame:
        return self._table("coverage", COVERAGE)

    def files(self) -> DataFrame:
        return self._table("files", FILES)

    def unknown(self) -> DataFrame:
        """Responses whose model had no price when they were read."""
        return self._table("unknown", UNKNOWN)

    @property
    def dupes(self) -> int:
        return self.manifest["dupes"]


def kept(spark: SparkSession, at: str) -> Kept | None:
    """What the last run has left, without a look at any file; none of another version."""
    store = Store(spark, at, VERSION)
    manifest = store.manifest()
    return Kept(store, manifest) if manifest else None


def _recent(hours: DataFrame, now: dt.datetime) -> DataFrame:
    return hours.where(F.col("day") > F.lit(now.date() - dt.timedelta(days=HOUR_DAYS)))


def _merged(old: DataFrame, new: DataFrame, keys: tuple[str, ...], sums: list[str]) -> DataFrame:
    return old.unionByName(new).groupBy(*keys).agg(*(F.sum(c).cast(old.schema[c].dataType).alias(c) for c in sums))


def refresh(spark: SparkSession, sources: list[Source], at: str, now: dt.datetime, table: PriceTable | None = None, cold: bool = False) -> Kept:
    """Brings the store at ``at`` up to date with the files of ``sources`` and gives its new generation.

    Without a store of this version, or with ``cold``, everything that ``scan_cutoff`` leaves is read; else only what files
    have grown by. A source that is new to the store is read whole; one that is gone adds nothing more, and what it added
    stays. A file that is shorter than it was is read again from its start: what its keys tell as repeats doesn't count
    twice. Where no file has changed the generation stays. A file that can't be opened is left as it is for the
    next run, and a root that isn't there has no files. Without sources or files all tables are empty.
    """
    store = Store(spark, at, VERSION)
    old = None if cold else store.manifest()
    generation = store.begin()

    def written(name: str, rows: DataFrame, by: str | None = None) -> DataFrame:
        return spark.read.parquet(f"{store.at}/{store.write(generation, name, rows, by)}")

    files = store.table(old, "files", FILES)
    parsers = store.table(old, "parsers", PARSERS)
    sources, warnings = reachable(spark, checked(sources))
    listing = spark.createDataFrame([], "uri string, path string, size long, mtime timestamp, source string, vendor string")
    for s in sources:
        listing = listing.unionByName(listed(spark, s.root, NAMES[s.vendor]).withColumns({"source": F.lit(s.id), "vendor": F.lit(s.vendor)}))
    listing = listing.where(F.col("mtime") >= F.lit(scan_cutoff(now)))
    found = changed(listing, files)
    # lines count from `start`; where lines build on earlier ones and nothing is known of those, these are read again
    known = parsers.select("path", F.lit(True).alias("_known"))
    found = found.join(known, "path", "left").withColumn("count_from", F.col("start"))
    again = (F.col("vendor") == "codex") & F.col("_known").isNull()
    found = written("_found", with_ends(found.withColumn("start", F.when(again, 0).otherwise(F.col("start")).cast("long")).drop("_known")))

    read = found.agg(F.sum(F.col("end") - F.col("start")).alias("bytes"), F.count_if(F.col("end") > F.col("start")).alias("files"), F.count("*").alias("rows")).first()
    if old is not None and not read["rows"]:
        store.drop(generation)
        return Kept(store, old | {"read_bytes": 0, "read_files": 0})

    events = None
    readings = []
    for k, s in enumerate(sources):
        rows = read_ranges(found.where(F.col("source") == s.id), ["path", "count_from"])
        new = (F.col("start") >= F.col("count_from")).cast("int")
        rows = rows.select("path", "value", F.struct(F.split("path", "/").alias("parts"), new.alias("new"), F.col("start").alias("row")).alias("ord"), F.lit(s.vendor).alias("vendor"), F.lit(s.id).alias("source"))
        if s.vendor == "codex":
            own = written(f"_readings-{k}", codex_readings(rows))
            at_start = F.struct(F.split("path", "/").alias("parts"), F.lit(0).alias("new"), F.lit(-1).cast("long").alias("row"))
            before = parsers.join(found.where("start > 0").select("path", F.lit(s.vendor).alias("vendor"), "source").where(F.col("source") == s.id), "path")
            before = before.select("path", at_start.alias("ord"), "vendor", "source", "meta", "declared", F.lit(None).cast("string").alias("time"), *COUNTERS, "total")
            readings.append(own.unionByName(before))
            parsed = codex_steps(own, before).where("ord.new = 1")
        else:
            parsed = parse_claude(rows, s.root) if s.vendor == "claude" else parse_grok(rows, s.root)
        parsed = parsed.select(*EVENT).withColumn("ord", F.struct(F.lit(k).alias("source"), F.col("ord").alias("at")))
        events = parsed if events is None else events.unionByName(parsed)
    if events is None:
        events = spark.createDataFrame([], "ord int, ts timestamp, session_id string, cwd string, project string, vendor string, source string, model string, message_id string, request_id string, is_sub boolean, " + "tok_in long, tok_out long, tok_cw long, tok_cr long, costed boolean, cost_usd decimal(18,9), has_usage boolean, coverage_only boolean")
    keyed = F.col("message_id").isNotNull() & F.col("request_id").isNotNull()
    bucket = F.when(keyed, F.pmod(F.xxhash64("message_id", "request_id"), F.lit(BUCKETS)).cast("int"))
    events = written("_events", events.withColumn("bucket", bucket))

    # only the parts of the keys that new events fall into are read
    held = [r.bucket for r in events.select("bucket").where("bucket is not null").distinct().collect()]
    seen = store.table(old, "keys", KEYS).where(F.col("bucket").isin(held)).withColumn("_seen", F.lit(True))
    first = W.partitionBy("bucket", "message_id", "request_id").orderBy("ord")
    told = events.where(keyed).withColumn("_n", F.row_number().over(first)).join(seen, ["bucket", "message_id", "request_id"], "left")
    told = told.withColumn("fresh", (F.col("_n") == 1) & F.col("_seen").isNull()).drop("_n", "_seen")
    told = written("_told", told.unionByName(events.where(~keyed).withColumn("fresh", F.lit(True))))
    fresh = told.where("fresh").withColumn("day", F.to_date("ts"))
    spent = fresh.where("not coverage_only")

    money = "decimal(38,9)"
    cells = _merged(store.table(old, "cells", CELLS), summed(spent, list(CELL), money), CELL, SUMS)
    hours = _merged(store.table(old, "hours", HOURS), summed(spent.withColumn("hour", F.hour("ts")), list(HOUR), money), HOUR, SUMS)
    covered = fresh.where("coverage_only").groupBy("day", "vendor").agg(F.count("*").alias("turns"), F.count_if("has_usage").alias("with_usage"))
    covered = _merged(store.table(old, "coverage", COVERAGE), covered, ("day", "vendor"), ["turns", "with_usage"])
    message = F.coalesce("message_id", F.concat_ws(":", "model", F.col("ts").cast("string")))
    unknown = priced(spent.where("not costed"), table).where("priced_as is null").select("model", message.alias("message"))
    unknown = store.table(old, "unknown", UNKNOWN).unionByName(unknown).distinct()
    seen_files = found.where("end is not null").select("path", "source", "size", "end")
    files = files.join(seen_files.select("path"), "path", "left_anti").unionByName(seen_files)
    parts = (old or {}).get("tables", {}).get("keys", [])
    new_keys = told.where(F.col("fresh") & keyed).select("message_id", "request_id", "bucket")
    if len(parts) >= KEY_PARTS:
        new_keys, parts = store.table(old, "keys", KEYS).unionByName(new_keys), []
    todo = {"cells": cells, "hours": _recent(hours, now), "coverage": covered, "unknown": unknown, "files": files, "parsers": _in_effect(parsers, readings), "keys": new_keys.repartition("bucket")}
    with ThreadPoolExecutor(len(todo)) as pool:  # small tables, so that most of their time is waiting
        tables = dict(zip(todo, pool.map(lambda t: [store.write(generation, t[0], t[1], "bucket" if t[0] == "keys" else None)], todo.items()), strict=True))
    tables["keys"] = [*parts, *tables["keys"]]

    dupes = (old or {}).get("dupes", 0) + told.where("not fresh").count()
    manifest = {"tables": tables, "dupes": dupes, "written_at": now.isoformat(), "sources": {s.id: s.root for s in sources}, "warnings": warnings, "read_bytes": read["bytes"] or 0, "read_files": read["files"]}
    store.commit(generation, manifest)
    return Kept(store, manifest)


def _in_effect(parsers: DataFrame, readings: list[DataFrame]) -> DataFrame:
    """What the next lines of each file build on."""
    for rows in readings:
        last = lambda c, there: F.max_by(c, F.when(F.col(there).isNotNull(), F.col("ord"))).alias(there)
        totals = F.struct(*COUNTERS, "total")
        new = rows.groupBy("path").agg(last("meta", "meta"), last("declared", "declared"), F.max_by(totals, F.when(F.col("total").isNotNull(), F.col("ord"))).alias("t"))
        new = new.select("path", "meta", "declared", *(F.col(f"t.{c}").alias(c) for c in (*COUNTERS, "total")))
        parsers = parsers.join(new.select("path"), "path", "left_anti").unionByName(new)
    return parsers
