"""Where streams keep their state, and what is told of them while they run."""

from __future__ import annotations

import re
import threading
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from finlake.sources.store import TableStore

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def use_rocksdb(spark: SparkSession) -> None:
    """State of queries that start from now on is kept on disk, with what changed a batch
    in the checkpoint, so that days of transaction ids need not fit in memory. A query
    that has started with another store goes on with that."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


def state_size(query: StreamingQuery) -> dict[str, int]:
    """Rows and bytes of a query's state, by its last progress; rows dropped as too late."""
    operators = (query.lastProgress or {}).get("stateOperators", [])
    names = {"rows": "numRowsTotal", "bytes": "memoryUsedBytes", "late": "numRowsDroppedByWatermark"}
    return {k: sum(int(o.get(v) or 0) for o in operators) for k, v in names.items()}


EVENTS_DDL = "query string, run_id string, kind string, batch bigint, at timestamp, rows bigint, behind bigint, state_rows bigint, state_bytes bigint, late bigint, detail string"


def behind(sources: list[dict]) -> int | None:
    """Messages or files that sources say still wait; None if none says so."""
    found = [float(m[k]) for m in (dict(s.get("metrics") or {}) for s in sources) for k in ("maxOffsetsBehindLatest", "numFilesOutstanding") if k in m]
    return round(sum(found)) if found else None


def cause(text: str | None) -> str | None:
    """The line of an exception's text that names the error in the user's code, with its beginning."""
    lines = [x.strip() for x in (text or "").splitlines() if x.strip()]
    named = [x for x in lines if re.match(r"[\w.]*(Error|Exception)\b.*: ", x) and not x.startswith("py4j.")]
    return " / ".join(dict.fromkeys([*(named[:1]), *(lines[:1])]))[:500] or None


class Watch(StreamingQueryListener):
    """Progress, lag and ends of the session's queries, as they are told by the engine.

    Events are held until write() puts them in the ops.stream_events table, as a listener must not
    start jobs itself. The first failure of a query is kept by name, and wakes whoever
    waits in supervise().
    """

    def __init__(self, names: set[str] | None = None):
        self.names, self.known, self.rows = names, {}, []
        self.failed: dict[str, str] = {}
        self.ended: set[str] = set()
        self.changed = threading.Condition()

    def _add(self, query: str | None, run: str, kind: str, batch=None, rows=None, lag=None, size=(None, None, None), detail=None) -> None:
        self.rows.append((query, run, kind, batch, datetime.now(timezone.utc).replace(tzinfo=None), rows, lag, *size, detail))

    def onQueryStarted(self, event) -> None:
        with self.changed:
            self.known[str(event.runId)] = event.name
            if self.names is None or event.name in self.names:
                self._add(event.name, str(event.runId), "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.names is not None and p.name not in self.names:
            return
        size = [sum(getattr(o, k) or 0 for o in p.stateOperators) for k in ("numRowsTotal", "memoryUsedBytes", "numRowsDroppedByWatermark")]
        with self.changed:
            self._add(p.name, str(p.runId), "progress", p.batchId, p.numInputRows, behind([{"metrics": s.metrics} for s in p.sources]), size)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        with self.changed:
            name = self.known.get(run)
            if self.names is None or name in self.names:
                self._add(name, run, "failed" if event.exception else "ended", detail=cause(event.exception))
                if event.exception:
                    self.failed.setdefault(name or run, cause(event.exception))
                self.ended.add(run)
            self.changed.notify_all()

    def write(self, store: TableStore) -> int:
        """Append what was told since the last call; how many rows."""
        with self.changed:
            rows, self.rows = self.rows, []
        if rows:
            store.append("ops", "stream_events", store.spark.createDataFrame(rows, EVENTS_DDL))
        return len(rows)


def watched(queries: list[StreamingQuery], watch: Watch, once: bool, store: TableStore | None = None, every: float = 20.0, most: float | None = None) -> list[str]:
    """Wait until all have ended (once), or one has, or one has failed; then stop the
    others. A failure ends the wait whichever query it is. Returns what failed, by name;
    what was told goes to the store every so many seconds, and in the end."""
    runs, waited = {str(q.runId) for q in queries}, 0.0
    for q in queries:
        watch.known.setdefault(str(q.runId), q.name)
    while True:
        with watch.changed:
            over = {str(q.runId) for q in queries if not q.isActive}
            done = watch.failed or (over == runs if once else bool(over))
            if not done:
                watch.changed.wait(min(every, 1.0))
        waited += min(every, 1.0)
        if store is not None and waited >= every:
            watch.write(store)
            most, waited = (most - waited if most is not None else None), 0.0
        if done or (most is not None and most <= 0):
            break
    errors = dict(watch.failed)
    for q in queries:
        if q.isActive:
            q.stop()
        elif q.exception() is not None:
            errors.setdefault(q.name, cause(str(q.exception())))
    if store is not None:
        watch.write(store)
    return [f"{name}: {what}" for name, what in errors.items()]
