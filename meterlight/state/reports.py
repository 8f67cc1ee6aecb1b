"""Session reports that are kept between runs: only sessions whose files, prices or thresholds changed are made again."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.functions.text import digest_hash
from meterlight.operators import sessions as S
from meterlight.plans.pricing import PriceTable
from meterlight.sources import transcripts as T
from meterlight.sources.growing import listed, read_ranges
from meterlight.sources.jsonl import LONGEST, NAMES, Source
from meterlight.state.store import Store

VERSION = 1
REPORT = "session_id string, project string, usd double, waste_usd double, findings long, score double"
ROWS = f"{REPORT}, fingerprint string"


def settings_hash(table: PriceTable | None = None, th: S.Thresholds = S.DEFAULT) -> str:
    """Of all that a report depends on besides its files."""
    return hashlib.sha256(repr((table or PriceTable.default(), th)).encode()).hexdigest()


def fingerprints(files: DataFrame, root: str, settings: str) -> DataFrame:
    """``session_id, project, fingerprint`` of listed files: of a session's files, by name, size and time of change, and of the settings."""
    at = T.session_of(F.col("path"), root)
    rows = files.withColumn("_at", at).where("size(_at) = 2")
    one = F.struct("path", "size", "mtime")
    rows = rows.groupBy(F.col("_at")[1].alias("session_id"), F.col("_at")[0].alias("project")).agg(F.sort_array(F.collect_list(one)).alias("_files"))
    each = F.transform("_files", lambda f: F.concat_ws(":", f["path"], f["size"].cast("string"), F.unix_micros(f["mtime"]).cast("string")))
    return rows.select("session_id", "project", digest_hash(F.lit(settings), F.array_join(each, "|")).alias("fingerprint"))


def made(rows: DataFrame, written, table: PriceTable | None = None, th: S.Thresholds = S.DEFAULT) -> DataFrame:
    """Reports of session lines. What is made of the lines goes through ``written`` (name, rows), a work table, as each is used many times."""
    events = written("_events", T.session_events(rows))
    calls = written("_calls", S.matched_calls(T.tool_calls(rows), T.tool_results(rows)))
    prompts = written("_prompts", T.prompts(rows))
    return S.reports(events, calls, prompts, table, th)


def cached_reports(spark: SparkSession, source: Source, at: str, table: PriceTable | None = None, th: S.Thresholds = S.DEFAULT, refresh: bool = False) -> DataFrame:
    """A report for each session of the source, from the store at ``at`` where nothing it depends on has changed.

    Sessions that are new or changed are read whole, all of them in one job; sessions that are gone are dropped from the
    store. ``refresh`` makes all again. Without sessions the result is empty.
    """
    store = Store(spark, at, VERSION)
    old = None if refresh else store.manifest()
    generation = store.begin()

    def written(name: str, rows: DataFrame) -> DataFrame:
        return spark.read.schema(rows.schema).parquet(f"{store.at}/{store.write(generation, name, rows)}")

    files = listed(spark, source.root, NAMES[source.vendor])
    now = fingerprints(files, source.root, settings_hash(table, th))
    key = ["session_id", "project"]
    before = store.table(old, "reports", ROWS)
    met = now.withColumn("_now", F.lit(True)).join(before.select(*key, "fingerprint", F.lit(True).alias("_old")), [*key, "fingerprint"], "full_outer")
    n = met.agg(F.count_if(F.col("_old").isNull()).alias("new"), F.count_if(F.col("_now").isNull()).alias("gone")).first()
    if n["new"] or n["gone"] or old is None:
        files, now = written("_files", files), written("_now", now)
        changed = now.join(before, [*key, "fingerprint"], "left_anti")
        parts = files.withColumn("_at", T.session_of(F.col("path"), source.root)).where("size(_at) = 2").withColumns({"session_id": F.col("_at")[1], "project": F.col("_at")[0]})
        parts = parts.join(changed, key, "left_semi").withColumn("start", F.lit(0).cast("long")).withColumn("end", F.col("size"))
        lines = read_ranges(parts, ["path"], LONGEST)
        order = F.struct(F.split("path", "/").alias("parts"), F.lit(0).cast("long").alias("block"), F.col("start").alias("row"))
        lines = lines.where(F.trim("value") != "").select("path", "value", order.alias("ord"), F.lit(source.vendor).alias("vendor"), F.lit(source.id).alias("source"))
        new = made(T.lines_of_sessions(lines, source.root), written, table, th).join(changed, key)
        columns = [c.split()[0] for c in ROWS.split(", ")]
        same = before.join(now, [*key, "fingerprint"], "left_semi")
        part = store.write(generation, "reports", same.select(*columns).unionByName(new.select(*columns)))
        store.commit(generation, {"tables": {"reports": [part]}, "made": changed.count()})
    return store.table(store.manifest(), "reports", ROWS).drop("fingerprint")
