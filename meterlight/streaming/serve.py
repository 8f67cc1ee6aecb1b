"""One stream of usage events for several consumers: cells and live sessions, kept as sums of what batches add, and shown only once history is read."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterlight.operators.usage import CELL, summed, usd
from meterlight.plans.pricing import PriceTable
from meterlight.state.store import Store
from meterlight.state.warm import CELLS, SUMS
from meterlight.streaming.live import state_store
from meterlight.streaming.sessions import Limits, turns

VERSION = 2
#: Parts of a table before they are summed to one, and generations that stay for their readers.
PARTS, KEEP = 32, 20
#: Costs as they are added up: sums of doubles go by which task or batch comes first, in the eighth digit of long sessions.
MONEY = "decimal(38,12)"
SESSIONS = f"session_id string, project string, first double, last double, turns long, subs long, usd {MONEY}, main struct<at:double,ord:string,model:string,context:long>, peak long"
RECENT = f"session_id string, at double, usd {MONEY}, cache {MONEY}"


def part_cells(batch: DataFrame) -> DataFrame:
    return summed(batch.where("not coverage_only").withColumn("day", F.to_date("ts")), list(CELL), "decimal(38,9)")


def merged_cells(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*CELL).agg(*(F.sum(c).cast(parts.schema[c].dataType).alias(c) for c in SUMS))


def _turns(batch: DataFrame, table: PriceTable | None) -> DataFrame:
    return turns(batch, table).withColumns({c: F.col(c).cast(MONEY) for c in ("usd", "cache")})


def _sessions(rows: DataFrame, n: Callable[[str], Column], main: Column) -> DataFrame:
    return rows.groupBy("session_id").agg(
        F.max(F.when(F.col("project") != "", F.col("project"))).alias("project"), F.min("first").alias("first"), F.max("last").alias("last"), n("turns").alias("turns"), n("subs").alias("subs"),
        F.sum("usd").alias("usd"), F.max(main).alias("main"), F.max("peak").alias("peak"),
    )


def part_sessions(batch: DataFrame, table: PriceTable | None = None) -> DataFrame:
    """What a batch's turns add to their sessions: sums, bounds, the latest main turn and the largest context."""
    rows = _turns(batch, table)
    own = ~F.col("is_sub")
    one = rows.select(
        "session_id", "project", F.col("at").alias("first"), F.col("at").alias("last"), own.cast("long").alias("turns"), F.col("is_sub").cast("long").alias("subs"), "usd",
        F.when(own, F.struct("at", "ord", "model", "context")).alias("main"), F.when(own, F.col("context")).alias("peak"),
    )
    return _sessions(one, F.sum, F.col("main"))


def merged_sessions(parts: DataFrame) -> DataFrame:
    return _sessions(parts, F.sum, F.col("main"))


def part_recent(batch: DataFrame, table: PriceTable | None = None) -> DataFrame:
    return _turns(batch, table).groupBy("session_id", "at").agg(F.sum("usd").alias("usd"), F.sum("cache").alias("cache"))


class Served:
    """Tables that batches of one deduplicated stream add to. A batch that is repeated after a failure adds nothing.

    A table is the sum of its parts: one a batch, summed to one part now and then. What counts is what the manifest names,
    so all tables move on together. While history is read nothing is shown: ``published`` is null until ``publish``.
    """

    def __init__(self, spark: SparkSession, at: str, table: PriceTable | None = None, limits: Limits = Limits()):
        self.spark, self.prices, self.limits = spark, table, limits
        self.store = Store(spark, at, VERSION, KEEP)

    def _tables(self) -> dict[str, tuple]:
        """Name: schema, what a batch adds, and how parts are summed."""
        return {
            "cells": (CELLS, part_cells, merged_cells),
            "sessions": (SESSIONS, lambda b: part_sessions(b, self.prices), merged_sessions),
            "recent": (RECENT, lambda b: part_recent(b, self.prices), self._late),
        }

    def _late(self, parts: DataFrame) -> DataFrame:
        """Costs that can still be recent: of the last minutes of their session."""
        last = parts.groupBy("session_id").agg(F.max("at").alias("_last"))
        rows = parts.groupBy("session_id", "at").agg(F.sum("usd").alias("usd"), F.sum("cache").alias("cache"))
        return rows.join(last, "session_id").where(F.col("at") >= F.col("_last") - self.limits.recent).drop("_last")

    def add(self, batch: DataFrame, epoch: int) -> None:
        """A sink of ``foreachBatch``."""
        old = self.store.manifest()
        if old and old["epoch"] >= epoch:
            return
        if not old and epoch:
            raise RuntimeError(f"{self.store.at} has nothing of the batches before {epoch}: start with a new checkpoint")
        batch.persist()
        generation = self.store.begin()
        tables = {}
        for name, (schema, part, merged) in self._tables().items():
            parts = (old or {}).get("tables", {}).get(name, [])
            new = part(batch)
            if len(parts) >= PARTS:
                new, parts = merged(self.store.table(old, name, schema).unionByName(new)), []
            tables[name] = [*parts, self.store.write(generation, name, new)]
        batch.unpersist()
        self.store.commit(generation, {"tables": tables, "epoch": epoch, "published": bool(old and old["published"])})

    def publish(self) -> None:
        """History is read: from now on what is there is shown."""
        old = self.store.manifest()
        if not (old and old["published"]):
            self.store.commit(self.store.begin(), (old or {"tables": {}, "epoch": -1}) | {"published": True})

    @property
    def published(self) -> dict | None:
        found = self.store.manifest()
        return found if found and found["published"] else None

    def _shown(self, name: str) -> DataFrame | None:
        found = self.published
        schema, _, merged = self._tables()[name]
        return merged(self.store.table(found, name, schema)) if found else None

    def cells(self) -> DataFrame | None:
        """As the batch has them; null while history is read."""
        rows = self._shown("cells")
        return None if rows is None else rows.withColumn("costed_usd", F.col("costed_usd").cast("double"))

    def sessions(self, now: dt.datetime) -> DataFrame | None:
        """Sessions heard of in the last half hour before ``now``, with what is recent and how full their context is; null while history is read."""
        rows, recent = self._shown("sessions"), self._shown("recent")
        if rows is None:
            return None
        at = F.unix_micros(F.lit(now).cast("timestamp")) / 1e6
        late = recent.where(F.col("at") >= at - self.limits.recent).groupBy("session_id").agg(F.sum("usd").alias("usd_5m"), F.sum("cache").alias("cache_5m"))
        rows = rows.where(F.col("last") >= at - self.limits.active).join(late, "session_id", "left")
        window = F.when(F.col("peak") > 200_000, 1_000_000).otherwise(200_000)
        context = F.coalesce("main.context", F.lit(0))
        paid = lambda c: usd(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
        return rows.select(
            "session_id", "project", F.col("main.model").alias("model"), usd(F.col("usd").cast("double")).alias("usd"), paid("usd_5m").alias("usd_5m"), paid("cache_5m").alias("cache_5m"), context.alias("context"),
            F.round(F.least(F.lit(1.0), context / F.coalesce(window, F.lit(200_000))), 8).alias("pct"), "turns", "subs", F.floor(F.round((F.col("last") - F.col("first")) * 1e6) / 1e6).alias("age"),
        )


def serve(rows: DataFrame, served: Served, checkpoint: str, interval: str = "250 milliseconds", history: dict | None = None, live: bool = True) -> StreamingQuery | None:
    """Reads history to its end, publishes, and then follows the stream, at most a batch an ``interval``, from the same checkpoint.

    ``rows`` has no repeats (``live.deduped``, ``live.live_deduped``), so that they are dropped once for all consumers.
    ``history``: the trigger of the first run; one for files that grow is ``{"once": True}``. Without ``live`` it ends there.
    """

    def writer():
        return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(served.add)

    with state_store(rows.sparkSession):
        writer().trigger(**(history or {"availableNow": True})).start().awaitTermination()
        served.publish()
        return writer().trigger(processingTime=interval).start() if live else None
