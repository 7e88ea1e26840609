"""Bursts in a stream, one alert each: keyed state with timers.

The state of a group holds its events of the last ``seconds`` before the watermark and
later, the burst that is open there, and what was told of bursts that may still change.
Each batch tells the bursts that are new or have changed, and takes back those whose
first event a late arrival has moved, so that what was told equals bursts_exact() over
all events that have come so far. A timer at the watermark closes a burst once no event
can join it, and forgets its events: state is bounded by the delay, not by the burst.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from finlake import domain

from .rules import GROUP

SECONDS = 60 * domain.BURST_MINUTES
#: What is told of a burst: it may change, it is final, it does not exist.
OPEN, CLOSED, WITHDRAWN = "open", "closed", "withdrawn"
_STATE = (
    "at array<bigint>, id array<string>, amount array<double>, since bigint, events bigint, total double, until bigint, cover int,"
    " told_since array<bigint>, told_events array<bigint>, told_until array<bigint>"
)


@dataclass
class Burst:
    since: int
    events: int = 0
    total: float = 0.0
    until: int = 0

    def add(self, at: int, amount: float) -> Burst:
        return Burst(self.since, self.events + 1, self.total + amount, at)


@dataclass
class Group:
    """One group's events, times in microseconds; see bursts_exact() for what a burst is."""

    seconds: float = SECONDS
    least: int = domain.BURST_COUNT
    events: list[tuple[int, str, float]] = field(default_factory=list)
    #: The burst of events that are forgotten, and how many events from the first held on belong to it.
    open: Burst | None = None
    cover: int = 0
    told: dict[int, tuple[int, int]] = field(default_factory=dict)

    @property
    def span(self) -> int:
        return round(self.seconds * 1_000_000)

    def add(self, rows: Iterator[tuple[int, str, float]], watermark: int) -> None:
        """Events behind the watermark and repeats are left out."""
        have = {e[1] for e in self.events}
        for row in rows:
            if row[0] > watermark and row[1] not in have:
                have.add(row[1])
                insort(self.events, row)

    def _begins(self, i: int) -> bool:
        last = i + self.least - 1
        return last < len(self.events) and self.events[last][0] - self.events[i][0] <= self.span

    def _walk(self, upto: int) -> Iterator[tuple[Burst | None, Burst | None, int]]:
        """(burst that ended before the event, burst that holds it, events that still belong to it), event by event."""
        burst, cover = self.open, self.cover
        for i in range(upto):
            at, _, amount = self.events[i]
            begins, ended = self._begins(i), None
            if not cover and burst is not None:
                ended, burst = burst, None
            if begins or cover:
                burst = (burst or Burst(at)).add(at, amount)
            cover = max(cover - 1, 0, self.least - 1 if begins else 0)
            yield ended, burst, cover

    def bursts(self) -> list[Burst]:
        """All bursts that hold an event here, as far as they are known."""
        out, burst = [], self.open
        for ended, burst, _ in self._walk(len(self.events)):
            out += [ended] if ended else []
        return out + ([burst] if burst else [])

    def settle(self, watermark: int) -> list[tuple[Burst, str]]:
        """What is to be told now that the watermark is there; events that no later one
        can stand beside are forgotten."""
        now = {b.since: b for b in self.bursts()}
        out = [(Burst(s), WITHDRAWN) for s in self.told if s not in now]
        final = sum(1 for e in self.events if e[0] + self.span <= watermark)
        steps = list(self._walk(final))
        closed = {e.since for e, _, _ in steps if e}
        if steps:
            _, self.open, self.cover = steps[-1]
            if self.open and not self.cover:
                closed.add(self.open.since)
                self.open = None
            del self.events[:final]
        for since, b in now.items():
            if since in closed:
                out.append((b, CLOSED))
            elif self.told.get(since) != (b.events, b.until):
                out.append((b, OPEN))
        self.told = {s: (b.events, b.until) for s, b in now.items() if s not in closed}
        return out

    def due(self) -> int | None:
        """The watermark, in milliseconds, at which an event here can be forgotten."""
        return -(-(self.events[0][0] + self.span) // 1000) if self.events else None


class BurstProcessor(StatefulProcessor):
    def __init__(self, by: tuple[str, ...], seconds: float, least: int):
        self.by, self.seconds, self.least = by, seconds, least

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("group", _STATE)

    def _load(self) -> Group:
        out = Group(self.seconds, self.least)
        if self.state.exists():
            at, id_, amount, since, events, total, until, cover, *told = self.state.get()
            out.events = list(zip(at, id_, amount))
            out.open = Burst(since, events, total, until) if events else None
            out.cover, out.told = cover, {s: (n, u) for s, n, u in zip(*told)}
        return out

    def _save(self, group: Group) -> None:
        if not group.events:  # whatever was told is closed by then
            self.state.clear()
            return
        b = group.open or Burst(0)
        told = [(s, n, u) for s, (n, u) in group.told.items()]
        self.state.update((*[[e[k] for e in group.events] for k in range(3)], b.since, b.events, b.total, b.until, group.cover, *[[t[k] for t in told] for k in range(3)]))

    def _settled(self, key, group: Group, watermark: int) -> Iterator[pd.DataFrame]:
        told = group.settle(watermark)
        self._save(group)
        if group.events:
            self.handle.registerTimer(max(group.due(), watermark // 1000 + 1))
        if told:
            rows = [(*key, b.since, b.events, b.total, b.until, how) for b, how in told]
            yield pd.DataFrame(rows, columns=[*self.by, "_since", "events", "total", "_until", "told"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        group, watermark = self._load(), timerValues.getCurrentWatermarkInMs() * 1000
        for part in rows:
            group.add(zip(*[part.iloc[:, k].tolist() for k in (-3, -2, -1)]), watermark)  # by place: names are not kept as they are
        yield from self._settled(key, group, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settled(key, self._load(), timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def stream_bursts(
    rows: DataFrame, delay: str | None, seconds: float = SECONDS, least: int = domain.BURST_COUNT, by: tuple[str, ...] = GROUP, time: str = "timestamp", amount: str = "amount_eur",
    id_col: str = "transaction_id",
) -> DataFrame:
    """rows: a stream of events. by, since, held (events, total, until), told: a row when a
    burst opens, changes, closes or is withdrawn. Events later than ``delay`` are left out,
    and an id counts once within it; without one, rows has a watermark already. Needs the RocksDB state store, and a least of two."""
    if least < 2:
        raise ValueError("a burst has two events at least")
    c = F.col
    rows = rows.withWatermark(time, delay) if delay else rows
    events = rows.select(*by, time, F.unix_micros(time).alias("_at"), c(id_col).cast("string").alias("_id"), c(amount).cast("double").alias("_amount"))
    keys = [f"{f.name} {f.dataType.simpleString()}" for f in events.select(*by).schema]
    told = events.groupBy(*by).transformWithStateInPandas(
        BurstProcessor(by, seconds, least), f"{', '.join(keys)}, _since bigint, events bigint, total double, _until bigint, told string", "Append", "EventTime",
    )
    at = F.timestamp_micros
    return told.select(*by, at("_since").alias("since"), F.struct("events", "total", at("_until").alias("until")).alias("held"), "told")
