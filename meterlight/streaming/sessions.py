"""Live sessions with timers: what each has spent, how full its context is, which warnings are on, and which of them are news."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import IntegralType

from meterlight.plans.pricing import PriceTable, component, cost, priced


@dataclass(frozen=True)
class Limits:
    """Seconds that costs are recent, that a session counts as active, and after which it is forgotten; and what is worth a warning."""

    recent: float = 300
    active: float = 1800
    forget: float = 6 * 3600
    turns: int = 200
    context_pct: float = 0.8
    cache_usd: float = 1.0


#: Of the warnings, those that are told; the others are shown only.
TOLD = ("context", "cache")
VIEW = (
    "session_id string, project string, model string, usd double, usd_5m double, cache_5m double, context long, window long, pct double, turns long, subs long, age long, "
    "active boolean, warnings array<string>, notify array<string>, at double"
)


@dataclass
class Session:
    """Times are seconds."""

    project: str = ""
    model: str = ""
    first: float = 0.0
    last: float = 0.0
    turns: int = 0
    subs: int = 0
    usd: float = 0.0
    main_at: tuple = ()
    context: int = 0
    peak: int = 0
    recent: list = field(default_factory=list)
    told: list = field(default_factory=list)
    timer: int = 0

    def add(self, at: float, ord_: str, project: str, model: str, is_sub: bool, usd: float, cache: float, context: int, limits: Limits) -> None:
        """One turn. The context is that of the main turn with the latest time, whatever order turns come in; of equal times, of the later in order."""
        new = not (self.turns or self.subs)
        self.project = self.project or project
        self.model = self.model or model
        self.first, self.last = (at, at) if new else (min(self.first, at), max(self.last, at))
        self.usd += usd
        self.recent = [x for x in [*self.recent, (at, usd, cache)] if x[0] >= self.last - limits.recent]
        if is_sub:
            self.subs += 1
            return
        self.turns += 1
        self.peak = max(self.peak, context)
        if (at, ord_) >= tuple(self.main_at):
            self.main_at, self.model, self.context = (at, ord_), model, context

    def view(self, key: str, now: float, limits: Limits) -> tuple:
        """The session as of ``now``. A warning of ``TOLD`` is news once, until the session is no longer active."""
        now_active = now - self.last <= limits.active
        late = [x for x in self.recent if x[0] >= now - limits.recent]
        usd_5m, cache_5m = sum(x[1] for x in late), sum(x[2] for x in late)
        window = 1_000_000 if self.peak > 200_000 else 200_000
        pct = min(1.0, self.context / window)
        on = [n for n, yes in (("turns", self.turns > limits.turns), ("context", pct > limits.context_pct), ("cache", cache_5m > limits.cache_usd)) if now_active and yes]
        news = [n for n in on if n in TOLD and n not in self.told]
        self.told = [*self.told, *news] if now_active else []
        return key, self.project, self.model, self.usd, usd_5m, cache_5m, self.context, window, pct, self.turns, self.subs, int(self.last - self.first), now_active, on, news, now

    def due(self, now: float, limits: Limits) -> float:
        """When the clock alone changes the view next: a cost is no longer recent, the session no longer active, or forgotten."""
        marks = [x[0] + limits.recent for x in self.recent] + [self.last + limits.active, self.last + limits.forget]
        return min((m for m in marks if m >= now), default=now)

    def over(self, now: float, limits: Limits) -> bool:
        return now - self.last > limits.forget


class Tracker(StatefulProcessor):
    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "json string")

    def _held(self) -> Session:
        return Session(**json.loads(self.state.get()[0])) if self.state.exists() else Session()

    def _shown(self, key: str, s: Session, now: float) -> Iterator[pd.DataFrame]:
        """Keeps the session, sets its timer, and shows it; forgets it instead when it is over."""
        if s.timer:
            self.handle.deleteTimer(s.timer)
        row = s.view(key, now, self.limits)
        if s.over(now, self.limits):
            self.state.clear()
        else:
            s.timer = int(max(s.due(now, self.limits), now) * 1000) + 1
            self.handle.registerTimer(s.timer)
            self.state.update((json.dumps(asdict(s)),))
        yield pd.DataFrame([row], columns=[c.split()[0] for c in VIEW.split(", ")])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, s = timerValues.getCurrentProcessingTimeInMs() / 1000, self._held()
        for frame in rows:
            for r in frame.itertuples():
                s.add(r.at, r.ord, r.project or "", r.model or "", bool(r.is_sub), float(r.usd), float(r.cache), int(r.context), self.limits)
        yield from self._shown(key[0], s, now)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            s = self._held()
            s.timer = 0
            yield from self._shown(key[0], s, timerValues.getCurrentProcessingTimeInMs() / 1000)


def turns(events: DataFrame, table: PriceTable | None = None) -> DataFrame:
    """What the tracker takes of deduplicated events: turns with their cost and that of writing the cache. Rows that only say whether a turn reported its usage are none."""
    rows = priced(events.where("not coverage_only"), table)
    paid = F.when(F.col("costed"), F.col("cost_usd").cast("double")).otherwise(cost())
    cache = F.when(F.col("costed"), 0.0).otherwise(component("tok_cw", "rate_cw"))
    context = F.col("tok_in") + F.col("tok_cw") + F.col("tok_cr")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    # as text, which sorts as it did
    order = F.lpad(F.col("ord").cast("string"), 20, "0") if isinstance(rows.schema["ord"].dataType, IntegralType) else F.col("ord").cast("string")
    return rows.where("ts is not null").select(F.col("session_id").cast("string").alias("session_id"), at.alias("at"), order.alias("ord"), "project", "model", "is_sub", paid.alias("usd"), cache.alias("cache"), context.alias("context"))


def session_views(events: DataFrame, limits: Limits = Limits(), table: PriceTable | None = None) -> DataFrame:
    """A row for each session that a batch or a timer touches, of a stream of deduplicated events.

    Timers go by the clock of the machine: costs stop being recent, a session stops being active, which makes its warnings
    news again when it comes back, and is forgotten at last. Needs the RocksDB state store, and a query that keeps running.
    """
    return turns(events, table).groupBy("session_id").transformWithStateInPandas(Tracker(limits), VIEW, "update", "ProcessingTime")
