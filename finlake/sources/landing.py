"""Landing area: discovery, routing by path, grace period, archiving, text scan."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finlake import domain

from .specs import CORRUPT, INGESTED, SOURCE_FILE, SPECS, DatasetSpec

CHUNK, GRACE_MINUTES = 150, 10


@dataclass(frozen=True)
class Landed:
    path: str
    dataset: str
    modified: float
    bytes: int


def dataset_of(path: str) -> str:
    """referentials/<name>.csv gives name, <country>/<dataset>/<file>.csv gives dataset;
    anything else gives an empty text."""
    parts = [p for p in path.split("/") if p]
    if len(parts) < 2 or not parts[-1].lower().endswith(".csv"):
        return ""
    if parts[-2] == "referentials":
        name = parts[-1][:-4]
        return name if name in SPECS and SPECS[name].is_referential else ""
    return parts[-2] if parts[-2] in SPECS and not SPECS[parts[-2]].is_referential and len(parts) > 2 else ""


def country_of(path: str) -> str:
    parts = [p for p in path.split("/") if p]
    return parts[-3] if len(parts) > 2 and parts[-3] in domain.COUNTRIES else ""


def day_of(path: str) -> str:
    """The day in a file's name (eight digits, or with dashes), else the name."""
    name = path.rpartition("/")[2]
    found = re.search(r"\d{4}-?\d{2}-?\d{2}", name)
    return found[0] if found else name


def topic_of(path: Column) -> Column:
    """The raw topic of a file's path, as an expression; null for referentials and strangers."""
    return domain.lookup(domain.RAW_TOPICS, F.try_element_at(F.split(path, "/"), F.lit(-2)))


def discover(spark: SparkSession, root: str, datasets: list[str] | None = None, countries: list[str] | None = None) -> dict[str, list[Landed]]:
    """CSV files below root by dataset. Countries do not restrict referentials."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, list[Landed]] = {}
    if not fs.exists(top):
        return found
    files = fs.listFiles(top, True)
    while files.hasNext():
        item = files.next()
        path = item.getPath().toString()
        name = dataset_of(path)
        if not name or (datasets and name not in datasets):
            continue
        if countries and not SPECS[name].is_referential and country_of(path) not in countries:
            continue
        found.setdefault(name, []).append(Landed(path, name, item.getModificationTime() / 1000, item.getLen()))
    return {k: sorted(v, key=lambda x: x.path) for k, v in sorted(found.items())}


def aged(files: list[Landed], minutes: float = GRACE_MINUTES, now: float | None = None) -> list[Landed]:
    """Files at least ``minutes`` old; all if minutes is not above 0."""
    now = time.time() if now is None else now
    return files if minutes <= 0 else [f for f in files if f.modified <= now - 60 * minutes]


def chunks(files: list, size: int = CHUNK) -> list[list]:
    return [files[k : k + size] for k in range(0, len(files), size)]


def archive(spark: SparkSession, files: list[Landed], root: str, target: str) -> tuple[int, int]:
    """Copy files below target and delete them; (moved, failed)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    P, moved, failed = jvm.org.apache.hadoop.fs.Path, 0, 0
    base = P(root).getFileSystem(conf).makeQualified(P(root)).toString().rstrip("/")
    for f in files:
        old = P(f.path)
        new = P(target.rstrip("/") + "/" + f.path.removeprefix(base).lstrip("/"))
        try:
            ok = jvm.org.apache.hadoop.fs.FileUtil.copy(old.getFileSystem(conf), old, new.getFileSystem(conf), new, True, conf)
        except Exception:  # one file's failure must not stop the others
            ok = False
        moved, failed = moved + bool(ok), failed + (not ok)
    return moved, failed


def scan(spark: SparkSession, spec: DatasetSpec, paths: list[str]) -> DataFrame:
    """Files as text columns with lineage; rows that do not fit are kept in CORRUPT.
    The header is checked, so that reordered columns are not read as others."""
    reader = spark.read.options(header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    return reader.schema(spec.text_schema).csv(paths).select(
        "*", F.col("_metadata.file_path").alias(SOURCE_FILE), F.current_timestamp().alias(INGESTED),
    )


def settled(spark: SparkSession, root: str, pending: str, min_age: float = 5.0, now: float | None = None) -> int:
    """Move files below ``pending`` that are at least min_age seconds old to the same place
    below root, where the stream lists them: a file that is still being written waits.
    How many were moved."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    P = jvm.org.apache.hadoop.fs.Path
    fs = P(pending).getFileSystem(conf)
    base = fs.makeQualified(P(pending)).toString().rstrip("/")
    done = 0
    for files in discover(spark, pending).values():
        for f in aged(files, min_age / 60, now):
            target = P(root.rstrip("/") + "/" + f.path.removeprefix(base).lstrip("/"))
            fs.mkdirs(target.getParent())
            done += bool(fs.rename(P(f.path), target))
    return done


def stream_events(spark: SparkSession, spec: DatasetSpec, root: str, max_files: int = 100, max_age: str = "7d") -> DataFrame:
    """A stream of (topic, kafka_key, payload) from CSV files that arrive below
    root/<country>/<dataset>/: every row as a JSON event with its lineage."""
    schema = spec.text_schema
    rows = spark.readStream.options(
        header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, maxFilesPerTrigger=max_files, maxFileAge=max_age,
    ).schema(schema).csv(f"{root}/*/{spec.name}")
    lined = rows.select(
        "*", F.col("_metadata.file_path").alias(SOURCE_FILE), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias(INGESTED),
    )
    body = F.to_json(F.struct(*spec.columns, INGESTED, SOURCE_FILE))
    return lined.select(
        topic_of(F.col(SOURCE_FILE)).alias("topic"), F.col("country_code").alias("kafka_key"), body.alias("payload"),
    ).where("topic is not null")


def file_rejects(spark: SparkSession, root: str) -> DataFrame:
    """Files below root that no rule routes, as dead letters: the envelope's columns, the
    file's bytes as base64, and the reason and the path as headers of the message."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    folder, name = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))
    referential = (folder == "referentials") & name.isin(*[f"{n}.csv" for n, s in SPECS.items() if s.is_referential])
    known = name.rlike(r"(?i)\.csv$") & (referential | topic_of(F.col("path")).isNotNull())
    reason = F.lit("chemin non reconnu")
    header = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value"))
    none = F.lit(None)
    return files.where(~F.coalesce(known, F.lit(False))).select(
        none.cast("string").alias("dataset"), none.cast("string").alias("source_topic"), none.cast("int").alias("source_partition"), none.cast("bigint").alias("source_offset"),
        F.col("modificationTime").alias("received_at"), reason.alias("rejection_reason"), F.col("path").alias("source_file"), F.lit("landing").alias("stage"),
        F.base64("content").alias("original_message"), F.array(header("reason", reason), header("path", F.col("path"))).alias("headers"),
    )


def publish_rejects(spark: SparkSession, bus, root: str, topic: str = domain.DLQ_TOPIC) -> int:
    """Send the files that no rule routes to the dead-letter topic, under the name of
    their paths and times, so that the same files again add nothing to a folder bus.
    How many there were."""
    lost = file_rejects(spark, root).persist()
    try:
        n, mark = lost.agg(F.count("*"), F.sum(F.xxhash64("source_file", "received_at").cast("decimal(20,0)"))).first()
        if n:
            bus.publish(lost.drop("headers"), topic, "source_file", f"landing-{mark}", headers=lost.select("source_file", "headers"))
        return n
    finally:
        lost.unpersist()
