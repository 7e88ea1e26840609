"""Versioned Parquet tables with atomic commits, keyed merge and a manifest.

A commit writes one folder root/<zone>/<table>/finlake_commit=<n>/ with the rows it
adds or rewrites, then a log entry root/<zone>/<table>/_log/<n>.json that names the
partition folders of the version, of this commit and earlier ones. The entry comes
last, by a rename, so a reader sees all of a commit or none. An append or an
insert-only merge writes its new rows alone; an upsert rewrites the partitions that
its source touches. A merge's source is computed once: it is written first, and the
check for repeated keys, the partitions and the merge read what was written. Rows are
dealt to writers by the partition columns, and adaptive execution splits a large
partition among several. All file work goes through Hadoop's FileSystem, so root may
be any store that Spark reads.

A folder that a commit drops stays for ``keep_hours``, so that a job which began before
the commit reads on, and so that changes() can tell what a merge has replaced: the rows
of the folders that it dropped, less those of the folders that it wrote.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from finlake.operators.core import missing

_LOCKS: dict[str, threading.RLock] = {}
_GUARD = threading.Lock()
#: Bytes from which on a folder of its own pays for a partition.
FOLDER_BYTES = 8 << 20
_COMMIT, _NULL = "finlake_commit", "__HIVE_DEFAULT_PARTITION__"


def _place():
    """The folder of a row's file, from the commit's on."""
    return F.regexp_extract("_metadata.file_path", rf"({_COMMIT}=.*)/[^/]*$", 1)


class DuplicateKeys(ValueError):
    """The source of a merge holds a key more than once."""


def _values(part: dict) -> dict[str, str | None]:
    """Partition values of a folder, as text."""
    pairs = [x.split("=", 1) for x in part["path"].split("/")[1:]]
    return {unquote(k): None if v == _NULL else unquote(v) for k, v in pairs}


class TableStore:
    def __init__(self, spark: SparkSession, root: str, keep_hours: float = 24.0):
        self.spark, self.root, self.keep_hours = spark, root.rstrip("/"), keep_hours

    # files
    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list:
        jvm, fs = self._fs()
        where = jvm.org.apache.hadoop.fs.Path(path)
        return list(fs.listStatus(where)) if fs.exists(where) else []

    def path(self, zone: str, table: str) -> str:
        return f"{self.root}/{zone}/{table}"

    def lock(self, zone: str, table: str) -> threading.RLock:
        """One writer a table, also across the threads of streaming queries."""
        with _GUARD:
            return _LOCKS.setdefault(self.path(zone, table), threading.RLock())

    # log
    def _entries(self, zone: str, table: str, last: int | None = None) -> list[dict]:
        names = sorted(i.getPath().toString() for i in self._list(f"{self.path(zone, table)}/_log") if i.getPath().getName().endswith(".json"))
        if not names:
            return []
        lines = self.spark.read.text(names[-last:] if last else names).collect()  # one line a version
        return sorted((json.loads(r.value) for r in lines), key=lambda c: c["version"])

    def history(self, zone: str, table: str) -> list[dict]:
        """Commits, oldest first: version, committed_at, operation, rows, added, files, bytes, schema, parts."""
        return self._entries(zone, table)

    def current(self, zone: str, table: str) -> dict | None:
        found = self._entries(zone, table, 1)
        return found[-1] if found else None

    def exists(self, zone: str, table: str) -> bool:
        return any(i.getPath().getName().endswith(".json") for i in self._list(f"{self.path(zone, table)}/_log"))

    def tables(self, zone: str) -> list[str]:
        return sorted(i.getPath().getName() for i in self._list(f"{self.root}/{zone}") if i.isDirectory())

    def _frame(self, zone: str, table: str, entry: dict, parts: list[dict], folder: bool = False) -> DataFrame:
        """Rows of the parts; with folder also _folder, the part that holds a row."""
        schema = StructType.fromJson(json.loads(entry["schema"]))
        if not parts:
            return self.spark.createDataFrame([], schema)
        top = self.path(zone, table)
        reader = self.spark.read.schema(StructType([*schema.fields, StructField(_COMMIT, StringType())])).option("basePath", top)
        more = [_place().alias("_folder")] if folder else []
        return reader.parquet(*[f"{top}/{p['path']}" for p in parts]).select(*[F.col(f"`{n}`") for n in schema.names], *more)

    def read(self, zone: str, table: str) -> DataFrame:
        """The current version; schema and folders come from the log."""
        now = self.current(zone, table)
        if now is None:
            raise LookupError(f"no table {zone}.{table}")
        return self._frame(zone, table, now, now["parts"])

    def added(self, zone: str, table: str, entry: dict) -> DataFrame:
        """The rows that a commit has written."""
        own = f"{_COMMIT}={entry['version']:010d}"
        return self._frame(zone, table, entry, [p for p in entry["parts"] if p["path"].partition("/")[0] == own])

    def files(self, zone: str, table: str) -> list[tuple[str, int]]:
        """(path, bytes) of the current version's data files, from listing alone."""
        now = self.current(zone, table)
        return [f for p in (now["parts"] if now else []) for f in self._data(f"{self.path(zone, table)}/{p['path']}")]

    def _data(self, folder: str) -> list[tuple[str, int]]:
        return [(i.getPath().toString(), i.getLen()) for i in self._list(folder) if i.getPath().getName().startswith("part-")]

    def _below(self, folder: str) -> list[tuple[str, int]]:
        """(path from the folder on, bytes) of all data files below it, by one recursive listing."""
        jvm, fs = self._fs()
        where = jvm.org.apache.hadoop.fs.Path(folder)
        base, out, files = fs.makeQualified(where).toString(), [], fs.listFiles(where, True)
        while files.hasNext():
            item = files.next()
            path = item.getPath().toString()
            if path.rpartition("/")[2].startswith("part-"):
                out.append((path.removeprefix(base), item.getLen()))
        return out

    def partitions(self, zone: str, table: str) -> DataFrame:
        """partition, file_count, record_count of the current version, from the log alone."""
        now, out = self.current(zone, table), {}
        for p in now["parts"]:
            name = "/".join(p["path"].split("/")[1:])
            files, rows = out.get(name, (0, 0))
            out[name] = (files + p["files"], rows + p["rows"])
        return self.spark.createDataFrame([(k, *v) for k, v in out.items()], "partition string, file_count bigint, record_count bigint")

    # commits
    def _commit(
        self, zone: str, table: str, df: DataFrame | None, by: Iterable[str], operation: str, kept: list[dict], schema: StructType | None = None, dealt: bool = False,
        note: dict | None = None, unique: list[str] | None = None,
    ) -> dict:
        """A version of the kept folders and of df's rows. Unless they are dealt to
        writers already, rows of a partition meet, and adaptive execution splits a
        large partition among several writers. note is kept with the version; unique
        names keys that what was written must hold once, else nothing is committed."""
        now = self.current(zone, table)
        version, top = (now["version"] + 1 if now else 1), self.path(zone, table)
        schema = schema or df.schema
        by, new = [c for c in by if c in schema.names], []
        if df is not None:
            name = f"{_COMMIT}={version:010d}"
            writer = (df.hint("rebalance", *by) if by and not dealt else df).write.mode("overwrite").option("compression", "zstd")
            (writer.partitionBy(*by) if by else writer).parquet(f"{top}/{name}")
            if unique:
                self._once(self.spark.read.schema(schema).option("basePath", top).parquet(f"{top}/{name}"), unique, f"{zone}.{table}")
            held: dict[str, list[int]] = {}
            for path, size in self._below(f"{top}/{name}"):
                held.setdefault(path.rpartition("/")[0], []).append(size)
            new = [{"path": f"{name}{k}", "files": len(v), "bytes": sum(v), "rows": 0} for k, v in sorted(held.items())]
            if new:
                place = _place().alias("p")
                found = self.spark.read.option("basePath", top).parquet(f"{top}/{name}").groupBy(place).agg(F.count("*").alias("n")).collect()  # a row a folder
                count = {k: r.n for r in found for k in (r.p, unquote(r.p))}
                for p in new:
                    p["rows"] = count.get(p["path"], 0)
                if sum(p["rows"] for p in new) != sum(r.n for r in found):
                    raise RuntimeError(f"{top}/{name}: rows of some folder were not counted")
                new = [p for p in new if p["rows"]]
        parts = [*kept, *new]
        total = {k: sum(p[k] for p in parts) for k in ("rows", "files", "bytes")}
        entry = {
            "version": version, "committed_at": time.time(), "operation": operation, "schema": schema.json(), "partitioned_by": by,
            "added": total["rows"] - (now["rows"] if now else 0), "note": note if note is not None else (now or {}).get("note", {}), "parts": parts,
            "dropped": sorted({p["path"].split("/")[0] for p in (now["parts"] if now else [])} - {p["path"].split("/")[0] for p in parts}),
        } | total
        jvm, fs = self._fs()
        P = jvm.org.apache.hadoop.fs.Path
        fs.mkdirs(P(f"{top}/_log"))
        draft, final = P(f"{top}/_log/.{version}.tmp"), P(f"{top}/_log/{version:010d}.json")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"another writer committed version {version} of {zone}.{table}")
        self._sweep(zone, table)
        return entry

    def _sweep(self, zone: str, table: str) -> None:
        """Delete the folders that commits older than keep_hours have dropped, then the
        log entries of these commits but for the last of them; an entry is read once."""
        jvm, fs = self._fs()
        before = (time.time() - self.keep_hours * 3600) * 1000
        entries = sorted((i.getPath().getName(), i.getModificationTime()) for i in self._list(f"{self.path(zone, table)}/_log") if i.getPath().getName().endswith(".json"))
        old = [name for name, at in entries[:-1] if at < before]
        if len(old) < 2:
            return
        top = self.path(zone, table)
        for row in self.spark.read.text([f"{top}/_log/{n}" for n in old]).collect():  # one line a version
            for folder in json.loads(row.value).get("dropped", []):
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{top}/{folder}"), True)
        for name in old[:-1]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{top}/_log/{name}"), False)

    @staticmethod
    def _once(rows: DataFrame, keys: list[str], what: str) -> None:
        if rows.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise DuplicateKeys(f"{what}: the source repeats a key of {keys}")

    def changes(self, zone: str, table: str, since: int, upto: int | None = None) -> DataFrame | None:
        """What the versions after ``since`` have changed: rows of the folders that are
        no longer there with _sign -1, and of those that are new with 1. An upsert's rows
        that stayed as they were are in both and cancel out. None if a version is no
        longer in the log, or its folders may be gone."""
        found = {e["version"]: e for e in self._entries(zone, table)}
        new = found.get(upto or max(found))
        old = found.get(since) if since else {"parts": []}
        if old is None or new is None:
            return None
        had, has = ({p["path"]: p for p in e["parts"]} for e in (old, new))
        sides = [self._shaped(self._frame(zone, table, e, [p for k, p in side.items() if k not in other]), StructType.fromJson(json.loads(new["schema"]))).withColumn("_sign", F.lit(sign))
                 for e, side, other, sign in ((old if since else new, had, has, -1), (new, has, had, 1))]
        return sides[0].unionAll(sides[1])

    def create(self, zone: str, table: str, ddl: str, by: Iterable[str] = ()) -> None:
        """An empty table, if it does not exist; new columns are added to one that does."""
        with self.lock(zone, table):
            empty = self.spark.createDataFrame([], ddl)
            if not self.exists(zone, table):
                self._commit(zone, table, None, by, "create", [], empty.schema)
            else:
                self.evolve(zone, table, empty)

    def _widened(self, entry: dict, like: DataFrame) -> tuple[StructType, list[str]]:
        schema = StructType.fromJson(json.loads(entry["schema"]))
        have = {n.lower() for n in schema.names}
        new = [f for f in like.schema if f.name.lower() not in have]
        return StructType([*schema.fields, *[StructField(f.name, f.dataType) for f in new]]), [f.name for f in new]

    def evolve(self, zone: str, table: str, like: DataFrame) -> list[str]:
        """Add columns that ``like`` has more, by names without case; a change of the log
        alone, as old files read them as null. Nothing is dropped or retyped."""
        with self.lock(zone, table):
            now = self.current(zone, table)
            schema, new = self._widened(now, like)
            if new:
                self._commit(zone, table, None, now["partitioned_by"], "evolve", now["parts"], schema)
            return new

    @staticmethod
    def _shaped(df: DataFrame, schema: StructType) -> DataFrame:
        """df with the schema's columns in order, absent ones null."""
        have = {n.lower(): n for n in df.columns}
        return df.select(
            *[(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        )

    def append(self, zone: str, table: str, df: DataFrame, by: Iterable[str] = ()) -> dict:
        """Add rows; nothing that is there is read or rewritten."""
        with self.lock(zone, table):
            now = self.current(zone, table)
            if now is None:
                return self._commit(zone, table, df, by, "append", [])
            schema, _ = self._widened(now, df)
            return self._commit(zone, table, self._shaped(df, schema), now["partitioned_by"], "append", now["parts"], schema)

    def overwrite(self, zone: str, table: str, df: DataFrame, by: Iterable[str] = (), note: dict | None = None) -> dict:
        """The table becomes df; what df reads of the table is its version before."""
        with self.lock(zone, table):
            return self._commit(zone, table, df, by, "overwrite", [], note=note)

    def merge(
        self, zone: str, table: str, source: DataFrame, keys: list[str], by: Iterable[str] = (), mode: str = "upsert", removed: str | None = None, unique: bool = False,
        note: dict | None = None,
    ) -> dict:
        """insert_only: rows of new keys; upsert: also replace rows of known keys;
        replace_partitions: the source's partitions become what the source says.
        Keys match null-safely; a key twice in the source is an error, which is not
        looked for if the source is known to be unique. With ``removed``, rows of an
        upsert in which this column is true remove their key's row. Partitions that
        cannot hold a key of the source, by those partition columns that are keys,
        are not read. insert_only adds files; an upsert adds them too, and rewrites only
        the folders in which a scan of the key columns has found a key of the source.
        A table's first rows are written where they stay; else the source is written
        once and read from there."""
        with self.lock(zone, table):
            now = self.current(zone, table)
            plain = source.drop(removed) if removed else source
            schema = self._widened(now, plain)[0] if now else plain.schema
            if now is None or not now["parts"]:
                rows = source.where(~F.col(removed)) if removed else source
                return self._commit(zone, table, self._shaped(rows, schema), now["partitioned_by"] if now else by, mode, [], schema, note=note, unique=None if unique else keys)
            kept = StructType([*schema.fields, StructField(removed, BooleanType())]) if removed else schema
            draft = f"{self.root}/_drafts/{uuid.uuid4().hex}"
            try:
                self._shaped(source, kept).write.parquet(draft)
                source = self.spark.read.schema(kept).parquet(draft)
                if not unique:
                    self._once(source, keys, f"{zone}.{table}")
                return self._merged(zone, table, source, keys, mode, now, schema, removed, note)
            finally:
                jvm, fs = self._fs()
                fs.delete(jvm.org.apache.hadoop.fs.Path(draft), True)

    def _merged(
        self, zone: str, table: str, source: DataFrame, keys: list[str], mode: str, now: dict, schema: StructType, removed: str | None = None, note: dict | None = None
    ) -> dict:
        by = now["partitioned_by"]
        prune = [b for b in by if b in keys or mode == "replace_partitions"]
        touched, others = now["parts"], []
        if prune:
            values = {tuple(r) for r in source.select(*[F.col(b).cast("string") for b in prune]).distinct().collect()}  # a row a partition
            touched = [p for p in now["parts"] if tuple(_values(p)[b] for b in prune) in values]
            others = [p for p in now["parts"] if p not in touched]
        if mode == "replace_partitions":
            return self._commit(zone, table, source, by, mode, others, schema, note=note)
        if mode == "insert_only":
            target = self._shaped(self._frame(zone, table, now, touched), schema)
            return self._commit(zone, table, missing(source, target, keys), by, mode, now["parts"], schema, note=note)
        hold = self._holders(zone, table, now, touched, source, keys)
        rewritten = [p for p in touched if p["path"] in hold]
        kept = [p for p in now["parts"] if p["path"] not in hold]
        fresh = source.where(~F.col(removed)).drop(removed) if removed else source
        if not rewritten:
            return self._commit(zone, table, fresh, by, mode, kept, schema, note=note)
        target = self._shaped(self._frame(zone, table, now, rewritten), schema)
        return self._commit(zone, table, fresh.unionByName(missing(target, source, keys)), by, mode, kept, schema, note=note)

    def _holders(self, zone: str, table: str, now: dict, parts: list[dict], source: DataFrame, keys: list[str]) -> set[str]:
        """Folders that hold a key of the source: a scan of the key columns alone."""
        if not parts:
            return set()
        probe = source.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
        held = self._frame(zone, table, now, parts, True)
        found = held.join(
            probe, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left_semi",
        ).select("_folder").distinct().collect()  # a row a folder
        return {x for r in found for x in (r[0], unquote(r[0]))} & {p["path"] for p in parts}

    def repartition(self, zone: str, table: str, by: Iterable[str]) -> dict:
        """Deal a table that has outgrown its folders anew, by other columns."""
        with self.lock(zone, table):
            return self._commit(zone, table, self.read(zone, table), by, "repartition", [])

    def fills(self, zone: str, table: str, folders: int | None = None) -> bool:
        """Whether the table's bytes fill its folders (or so many)."""
        now = self.current(zone, table)
        return bool(now and now["parts"]) and now["bytes"] >= FOLDER_BYTES * (folders or len({p["path"].partition("/")[2] for p in now["parts"]}))

    def compact(self, zone: str, table: str, target_mb: int = 32, min_files: int = 2) -> dict | None:
        """Rewrite partitions that hold at least min_files files, and more than their
        bytes need, into files of about target_mb."""
        with self.lock(zone, table):
            now = self.current(zone, table)
            files, size = {}, {}
            where = lambda p: p["path"].partition("/")[2]
            for p in now["parts"] if now else []:
                files[where(p)] = files.get(where(p), 0) + p["files"]
                size[where(p)] = size.get(where(p), 0) + p["bytes"]
            enough = {k: max(1, -(-size[k] // (target_mb << 20))) for k in files}
            small = [p for p in (now["parts"] if now else []) if files[where(p)] >= min_files and files[where(p)] > enough[where(p)]]
            if not small:
                return None
            df, by = self._frame(zone, table, now, small), now["partitioned_by"]
            if by:  # a partition goes to as many writers as it needs files
                needs = {where(p): (*(_values(p)[b] for b in by), enough[where(p)]) for p in small}
                need = self.spark.createDataFrame(list(needs.values()), ", ".join([f"_b{i} string" for i in range(len(by))] + ["_need int"]))
                same = [F.col(b).cast("string").eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)]
                salt = F.pmod(F.xxhash64(*df.columns), F.col("_need"))
                df = df.join(F.broadcast(need), same).repartition(
                    sum(n[-1] for n in needs.values()), *by, salt,
                ).select(*df.columns)  # a row a partition
            else:
                df = df.repartition(max(enough.values()))
            kept = [p for p in now["parts"] if p not in small]
            return self._commit(zone, table, df, by, "compact", kept, df.schema, True)

    def view(self, zone: str, table: str, name: str | None = None) -> None:
        self.read(zone, table).createOrReplaceTempView(name or f"{zone}_{table}")
