"""Landing files to raw tables: validate, quarantine, type, deduplicate, insert new keys."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from finlake.operators import core, quality
from finlake.sources import landing
from finlake.sources.specs import ORDER, REJECTS_DDL, SOURCE_FILE, SPECS, DatasetSpec
from finlake.sources.store import FOLDER_BYTES, TableStore

log = logging.getLogger(__name__)
#: Bytes of text that a byte of a table takes, about.
FACTOR = 5


@dataclass
class Outcome:
    dataset: str
    files: int = 0
    rows: int = 0
    rejected: int = 0
    inserted: int = 0
    archived: int = 0
    error: str = ""
    reasons: dict = field(default_factory=dict)


def grain(store: TableStore, spec: DatasetSpec, files: list) -> list[str]:
    """The partitioning of a dataset's table: by day if the files that it starts from hold
    enough for a folder a country and day. Text takes about FACTOR times the bytes."""
    by = list(spec.partitioning)
    if len(by) > 1 and not store.exists("raw", spec.table):
        days = {(landing.country_of(f.path), landing.day_of(f.path)) for f in files}
        return by if sum(f.bytes for f in files) >= FACTOR * FOLDER_BYTES * len(days) else by[:1]
    return by


def load(spark: SparkSession, store: TableStore, name: str, files: list, chunk: int) -> Outcome:
    """One dataset, a bounded number of files a pass. A pass reads its files once, and
    counts while it writes; those that hold broken rows are read again for these, after
    the good rows are in, so that a pass that stops midway repeats to the same."""
    spec, out = SPECS[name], Outcome(name, len(files))
    by, bad = grain(store, spec, files), F.col(quality.REASON).isNotNull()
    for part in landing.chunks(files, chunk):
        seen = Observation()
        rows = landing.scan(spark, spec, [f.path for f in part]).withColumn(quality.REASON, quality.rejection_reason(spec))
        counted = rows.observe(seen, F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.collect_set(F.when(bad, F.col(SOURCE_FILE))).alias("files"))  # a chunk's files at most
        good = quality.typed(counted.where(~bad), spec)
        good = core.deduplicate(good, spec.key, [SOURCE_FILE, spec.key])
        if spec.event_time:
            good = good.withColumn("event_day", F.to_date(spec.event_time))
        out.inserted += store.merge("raw", spec.table, good, [spec.key, "country_code"], by, "insert_only", unique=True)["added"]
        found = core.figures(seen)
        out.rows += found.get("n", 0)
        out.rejected += found.get("bad", 0)
        if found.get("bad"):
            again = landing.scan(spark, spec, [unquote(f) for f in found["files"]]).withColumn(quality.REASON, quality.rejection_reason(spec)).where(bad)
            done = store.append("raw", "ingestion_rejects", quality.rejects(again, spec), ["dataset"])
            new = store.added("raw", "ingestion_rejects", done).groupBy("reject_reason").count().collect()  # a row a reason
            for r in new:
                out.reasons[r[0]] = out.reasons.get(r[0], 0) + r[1]
    return out


def run(
    spark: SparkSession, store: TableStore, root: str, datasets=None, countries=None, chunk: int = landing.CHUNK, archive_to: str | None = None,
    archive_after: float = landing.GRACE_MINUTES,
) -> list[Outcome]:
    """All datasets, referentials first; one that fails does not stop the others."""
    found = landing.discover(spark, root, datasets, countries)
    store.create("raw", "ingestion_rejects", REJECTS_DDL, ["dataset"])
    out = []
    for name in ORDER:
        if name not in found:
            continue
        try:
            got = load(spark, store, name, found[name], chunk)
            if archive_to and not SPECS[name].is_referential:
                got.archived, _ = landing.archive(spark, landing.aged(found[name], archive_after), root, archive_to)
        except Exception as e:
            log.exception("ingest of %s failed", name)
            got = Outcome(name, len(found[name]), error=str(e)[:500])
        out.append(got)
    return out


def bronze_views(store: TableStore) -> list[str]:
    """bronze_<table> views over the raw tables."""
    names = [s.table for s in SPECS.values() if store.exists("raw", s.table)]
    for n in names:
        store.view("raw", n, f"bronze_{n}")
    return names
