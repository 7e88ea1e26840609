"""Removal of repeated passages, found through difference-cover anchors.

A window of N words is removed where its word sequence also starts earlier. Only
anchors are compared first: sequences of N - V + 1 words at positions that are
in a difference cover modulo V. For any two starts there is a shift below V that
takes both onto the cover, so two equal windows always share an aligned anchor.
Anchors that occur once rule out the windows around them; the others are
extended: windows that hold one are hashed whole and settled exactly.

Both comparisons send hashes of 64 bits in blocks of bytes, each hash once a
batch of documents however often the batch holds it, so that a passage which
a third of all documents share is sent once a batch, not once a document.
Texts move in compressed form, to meet what was found about them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, partitions, rank_by, read, small_batches

#: Words of a window; the period and a cover of all its differences.
WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Blocks a shuffle partition is dealt in, so that partitions come out even.
BLOCKS = 4

# fixed odd multiplier of the rolling hash, and its inverse modulo 2**64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base & (2**64 - 1), np.uint64))])


class Words:
    """The words of a text as one run of bytes, with hashes of any sequence of them."""

    power = _powers(_BASE, 1 << 16)
    inverse = _powers(_INVERSE, 1 << 16)

    def __init__(self, data: bytes):
        self.words = data.split()
        self.n = len(self.words)
        size = np.fromiter(map(len, self.words), np.int64, self.n)
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size
        self.sums = None

    def _roll(self) -> None:
        flat = np.frombuffer(b" ".join(self.words), np.uint8)
        if len(flat) >= len(Words.power):
            Words.power, Words.inverse = _powers(_BASE, 2 * len(flat)), _powers(_INVERSE, 2 * len(flat))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[flat] * Words.power[: len(flat)])])

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the sequences of ``length`` words from each position in at."""
        if self.sums is None:
            self._roll()
        s, e = self.starts[at], self.ends[at + length - 1]
        with np.errstate(over="ignore"):
            return mix((self.sums[e] - self.sums[s]) * Words.inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def anchors(n: int) -> np.ndarray:
    """Positions of the anchors of n words."""
    at = np.arange(max(0, n - ANCHOR + 1))
    return at[np.isin(at % PERIOD, COVER)]


def _covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of n words the sequences of ``length`` words from starts cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _near(at: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows that hold a whole anchor of those at positions at."""
    if n < WINDOW or not len(at):
        return np.zeros(0, np.int64)
    edge = np.zeros(n + 2, np.int64)
    np.add.at(edge, np.maximum(at - (PERIOD - 1), 0), 1)
    np.add.at(edge, at + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: n - WINDOW + 1] > 0)


_SCHEMA = "kind int, list bigint, docs binary, hashes binary, at binary"
_NAMES = ["kind", "list", "docs", "hashes", "at"]


def _pen():
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _write(pen, docs: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes]:
    """Documents and positions as differences, compressed."""
    return pen.compress(np.diff(docs, prepend=0).astype("<i8").tobytes()), pen.compress(np.diff(at, prepend=0).astype("<i4").tobytes())


def _load(pen, docs: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(pen.decompress(docs), "<i8")), np.cumsum(np.frombuffer(pen.decompress(at), "<i4"), dtype=np.int64)


def _deal(pen, hashes: np.ndarray, docs: np.ndarray, at: np.ndarray, blocks: int, later: bool) -> pa.RecordBatch:
    """A batch's rows: kind 0, a row a block with each hash once, where it is first;
    kind 1, what the batch itself shows to be repeated: with later, all entries but
    the first of a hash, else all of them. Entries come in order of docs and at."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    sent = np.sort(order[new])
    again = np.zeros(len(h), bool)
    again[order] = ~new if later else np.repeat(np.diff(np.append(np.flatnonzero(new), len(h))) > 1, np.diff(np.append(np.flatnonzero(new), len(h))))
    block = (hashes[sent] % np.uint64(blocks)).astype(np.int64)
    turn = np.argsort(block, kind="stable")
    sent, cut = sent[turn], np.searchsorted(block[turn], np.arange(blocks + 1))
    rows = []
    for b in range(blocks):
        i = sent[cut[b] : cut[b + 1]]
        if len(i):
            d, a = _write(pen, docs[i], at[i])
            rows.append((0, b, d, hashes[i].tobytes(), a))
    if again.any():
        d, a = _write(pen, docs[again], at[again])
        rows.append((1, int(hashes[0] % np.uint64(blocks)), d, b"", a))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], _NAMES)


def _gather(pen, docs: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Entries by buckets of documents, each in order."""
    bucket = (mix(docs.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((at, docs, bucket))
    docs, at, cut = docs[order], at[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in range(buckets):
        if cut[k] < cut[k + 1]:
            yield (k, *_write(pen, docs[cut[k] : cut[k + 1]], at[cut[k] : cut[k + 1]]))


def _compare(rows: DataFrame, later: bool) -> DataFrame:
    """(_n, _at), a row a document: the entries whose hash another batch sent too, and
    those settled within a batch. With later, not the first of each hash by document
    and position. Entries travel by buckets of documents, not a row a document."""
    buckets = partitions(rows.sparkSession)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        own, pen = _pen()
        docs, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in batches:
            for kind, block, d, x, a in zip(*(b.column(k).to_pylist() for k in range(5))):
                if kind == 0:
                    held.setdefault(block, []).append((d, x, a))
                else:
                    where = _load(pen, d, a)
                    docs.append(where[0])
                    at.append(where[1])
        for k in sorted(held):
            parts = held.pop(k)
            h = np.frombuffer(b"".join(p[1] for p in parts), np.uint64)
            where = [_load(pen, p[0], p[2]) for p in parts]
            d, a = (np.concatenate([w[i] for w in where]) for i in (0, 1))
            order = np.lexsort((a, d, h))
            h, d, a = h[order], d[order], a[order]
            same = np.concatenate([[False], h[1:] == h[:-1]])
            keep = same if later else same | np.append(same[1:], False)
            docs.append(d[keep])
            at.append(a[keep])
        out = list(_gather(own, np.concatenate(docs), np.concatenate(at), buckets))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], ["bucket", "docs", "at"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pen = _pen()
        held: dict[int, list] = {}
        for b in batches:
            for k, d, a in zip(*(b.column(k).to_pylist() for k in range(3))):
                held.setdefault(k, []).append((d, a))
        for k in sorted(held):
            where = [_load(pen, *x) for x in held.pop(k)]
            d, a = (np.concatenate([w[i] for w in where]) for i in (0, 1))
            order = np.lexsort((a, d))
            d, a = d[order], a[order]
            ids, cut = np.unique(d, return_index=True)
            cut = np.append(cut, len(d))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([a[x:y].astype("<i4").tobytes() for x, y in zip(cut, cut[1:])], pa.binary())], ["_n", "_at"])

    met = rows.repartition(buckets, "list").mapInArrow(meet, "bucket bigint, docs binary, at binary")
    return met.repartition(buckets, "bucket").mapInArrow(each, "_n bigint, _at binary")


def _spread(rows: DataFrame, entries, blocks: int, later: bool) -> DataFrame:
    """entries(row without _n) gives hashes and positions of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pen, _ = _pen()
        for b in batches:
            got = sorted(((n, *entries(*rest)) for n, *rest in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)))), key=lambda x: x[0])
            got = [x for x in got if len(x[2])]
            if got:
                yield _deal(pen, np.concatenate([x[1] for x in got]), np.concatenate([np.full(len(x[2]), x[0], np.int64) for x in got]), np.concatenate([x[2] for x in got]), blocks, later)

    return rows.mapInArrow(run, _SCHEMA)


def _anchors_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    words = Words(text.encode())
    at = anchors(words.n)
    return (words.hashes(at, ANCHOR) if len(at) else np.zeros(0, np.uint64)), at


def _starts(at: bytes | None) -> np.ndarray:
    return np.frombuffer(at or b"", "<i4").astype(np.int64)


def _windows_of(zipped: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray]:
    words = Words(zstandard.ZstdDecompressor().decompress(zipped))
    near = _near(_starts(at), words.n)
    return (words.hashes(near, WINDOW) if len(near) else np.zeros(0, np.uint64)), near


def _settled(rows: DataFrame) -> DataFrame:
    """rows: _n, which names and orders documents, and _text. Gives _n, n_words,
    n_removed, kept (compressed) and kept_sha256. One plan: the compressed texts
    are shuffled once, and both joins read that."""
    spark = rows.sparkSession
    blocks = partitions(spark) * BLOCKS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pen = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pen.compress(t.encode()) for t in b.column(1).to_pylist()], pa.binary())], ["_n", "_zip"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pen, unpen = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for n, z, at in zip(*(b.column(k).to_pylist() for k in range(3))):
                words = unpen.decompress(z).split()
                starts = np.unique(_starts(at))
                gone = _covered(starts, len(words), WINDOW) if len(starts) else np.zeros(len(words), bool)
                kept = b" ".join([w for w, x in zip(words, gone.tolist()) if not x] if len(starts) else words)
                out.append((n, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), pen.compress(kept)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["_n", "n_words", "n_removed", "kept_sha256", "_kept"])

    packed = rows.mapInArrow(pack, "_n bigint, _zip binary").where("_n is not null").repartition(partitions(spark), "_n")  # the filter that an inner join adds: so both joins read one shuffle
    repeated = _compare(_spread(rows, _anchors_of, blocks, False), False)
    near = packed.join(repeated.hint("shuffle_hash"), "_n").select("_n", "_zip", "_at")
    later = _compare(_spread(near, _windows_of, blocks, True), True)
    return packed.join(later.hint("shuffle_hash"), "_n", "left").select("_n", "_zip", "_at").mapInArrow(cut, "_n bigint, n_words bigint, n_removed bigint, kept_sha256 string, _kept binary")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row; with kept also kept,
    the zstandard-compressed words that stay, joined by one space.

    A null text has no words. Documents are in the order of doc_id, nulls last,
    then of a hash of their text; rows alike in both are one document and get the
    same result. Texts under 20 words keep all. An empty table gives an empty
    result. Other columns are not read, whatever their names. Sequences of words are
    compared by 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["_kept"] * kept
    n, ids = own.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids and own.schema["doc_id"].dataType.typeName() in ("long", "integer", "short", "byte"):
        out = _settled(own.select(F.col("doc_id").cast("long").alias("_n"), "_text")).withColumn("doc_id", F.col("_n").cast(own.schema["doc_id"].dataType))
    else:  # ids that are null, repeated or no integers: number the documents first
        key = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", F.xxhash64("_text").alias("h"), F.md5("_text").alias("m"))
        keyed = own.withColumn("_key", key)
        ranks = rank_by(keyed.select("_key").distinct(), F.col("_key").asc())
        found = _settled(keyed.dropDuplicates(["_key"]).join(ranks, "_key").select(F.col("_rank").alias("_n"), "_text"))
        out = keyed.select("doc_id", "_key").join(ranks, keyed["_key"].eqNullSafe(ranks["_key"])).withColumnRenamed("_rank", "_n").join(found, "_n")
    return out.select(*columns).withColumnsRenamed({"_kept": "kept"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(read(spark, sf_dir, "documents"))
