"""Near-duplicates by SimHash, found through a byte-position inverted index.

Fingerprints that differ in at most R bits differ in at most R of their 8 bytes,
so they share at least 8 - R bytes at their positions. The index lists fingerprints
by the byte at a position, and a list of it by the byte at a second and third one
where there are so many rows that single bytes would leave lists long: of any 8 - R
shared positions, d are among the first R + d, so lists under each d of these lose
no pair. In a list, the shared positional bytes of each pair are tallied over all
positions; pairs that reach the guaranteed 8 - R are verified by their Hamming
distance. A list gives a spanning forest of its links, not all pairs.

The pipeline's stage has a rule of its own: texts whose sets of five-word shingles
have a Jaccard similarity of 0.8 or more are copies. The SimHash of the set is looked
up in the same index first, and its links are verified by the exact similarity. Most
copies lie beyond the radius (5 to 13 bits and more). They are found the same way with
a longer signature: one byte of each of 100 minima of the set under random orders.
Lists are named by four minima, the shared positional bytes of a pair are tallied,
and pairs that reach the least number are verified by the exact similarity. Members
of long lists, as a shared template makes them, are listed anew by their rarest shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, partitions, read, small_batches, stash

WORDS, RADIUS, SEED = 4, 4, 42
#: Byte positions of a fingerprint.
BYTES = 8
#: Random fingerprints that a list may hold on average before one more position names it.
LIST_ROWS = 64
#: Fingerprints that a block of lists is expected to hold.
BLOCK_ROWS = 1 << 16
#: Fingerprints from which on a block is listed anew.
HOT_ROWS = 4 * BLOCK_ROWS
#: Lists up to SHORT are tallied pair by pair; those above DENSE are listed anew by further positions.
SHORT, DENSE = 16, 2048
#: The stage's rule: words of a shingle, and the least Jaccard similarity of copies.
STAGE_WORDS, SIMILARITY = 5, 0.8
#: Bands of minima, and minima in each: a pair at 0.8 meets in none with probability (1 - 0.8**4)**25 = 2e-6.
BANDS, MINIMA = 25, 4
#: Positional bytes of a signature that copies share at least: of 100, 80 +- 4 at 0.8, so fewer with probability 1e-8.
SHARED = 55
#: Members up to which all pairs of a list are compared; members of longer ones meet by rare shingles.
LIST_PAIRS = 48
#: Leads that a member of long lists meets in the first round, MORE times as many in each further one, and the rounds
#: at most before all that is left is paired.
LEADS, MORE, ROUNDS = 3, 4, 4
#: Share of a round's pairs that are links, below which all that is left is paired.
YIELD = 0.005
#: Most common shingles that are told apart by their counts; all rarer ones come first, by hash.
COMMON = 1 << 18
#: Ids up to which a side of a join is broadcast, and pairs of a node and its root.
BROADCAST_ROWS, FEW_ROWS = 300_000, 1 << 16
_ORDERS = np.random.default_rng(SEED).integers(0, 2**31, BANDS * MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
# fixed odd multiplier of the rolling hash
_BASE = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash over word shingles, by majority of the shingles' XXH64."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(WORDS, len(words))
    of = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        h = np.array([of(flat[s:e], SEED) for s, e in zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist())], np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((counts * 2 > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, _text (a hash of the text) and _fp, a row a row of docs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found)], ["doc_id", "_text", "_fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_text"), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, _text bigint, _fp bigint")


def _tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair, how many byte positions hold the same byte in both."""
    return ((a ^ b).reshape(-1, 1).view(np.uint8) == 0).sum(1)


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs reach the guaranteed number of shared positions and pass the verification."""
    b = np.broadcast_to(b, a.shape)
    out = _tally(a, b) >= BYTES - radius
    out[out] = np.bitwise_count(a[out] ^ b[out]) <= radius
    return out


def _choices(free: list[int], needed: int, depth: int) -> list[tuple[int, ...]]:
    """Sets of ``depth`` positions, one of which at least is shared by every pair that
    shares ``needed`` of the free positions."""
    return list(combinations(free[: len(free) - needed + depth], depth))


def _mask(at: tuple[int, ...]) -> np.uint64:
    return np.uint64(sum(0xFF << (8 * p) for p in at))


def depth_of(rows: int, radius: int) -> int:
    """Byte positions that name a list: as many as keep a list of random fingerprints short."""
    return min(BYTES - radius, next(d for d in range(1, 9) if d == 8 or rows <= LIST_ROWS << (8 * d)))


class _Forest:
    """Links among distinct fingerprints of one block of the index, as a spanning forest."""

    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.radius, self.up, self.pairs = fps, radius, np.arange(len(fps)), []

    def _root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            r, t = self._root(x), self._root(y)
            if r != t:
                self.up[max(r, t)] = min(r, t)
                self.pairs.append((x, y))

    def _settled(self, group: np.ndarray) -> bool:
        first = self._root(int(group[0]))
        return all(self._root(x) == first for x in group[1:].tolist())

    def lists(self, at: np.ndarray, keys: np.ndarray, deeper) -> None:
        """at: places of fingerprints; those with the same key are one list. Short lists
        are tallied pair by pair, all lists at once; long ones by a search that takes
        what it has found out of the list; longer ones are listed anew by ``deeper``."""
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        size = np.diff(edge)
        short = np.repeat(size <= SHORT, size)
        for step in range(1, SHORT):
            same = np.flatnonzero((keys[step:] == keys[:-step]) & short[step:])
            if not len(same):
                break
            a, b = at[same], at[same + step]
            near = _near(self.fps[a], self.fps[b], self.radius)
            self._join(a[near], b[near])
        for s, m in zip(edge[:-1][size > SHORT].tolist(), size[size > SHORT].tolist()):
            group = at[s : s + m]
            if self._settled(group):
                continue
            if m > DENSE and deeper:
                deeper(group)
                continue
            rest = group
            while len(rest) > 1:
                queue, rest = [rest[0]], rest[1:]
                while queue and len(rest):
                    x = queue.pop()
                    near = _near(self.fps[rest], self.fps[x], self.radius)
                    if near.any():
                        got = rest[near]
                        self._join(np.full(len(got), x), got)
                        queue += list(got)
                        rest = rest[~near]

    def index(self, at: np.ndarray, shared: tuple[int, ...]) -> None:
        """Lists of fingerprints that agree at ``shared``; long ones by one more position,
        and by pieces of the other bits once enough positions agree."""

        def deeper(group: np.ndarray) -> None:
            needed = BYTES - self.radius - len(shared)
            if needed > 0:
                for (p,) in _choices([p for p in range(BYTES) if p not in shared], needed, 1):
                    self.index(group, (*shared, p))
            else:
                for mask in dense_masks(_mask(shared), self.radius):
                    self.lists(group, self.fps[group] & mask, None)

        self.lists(at, self.fps[at] & _mask(shared), deeper)


def _keys(own: np.ndarray, path: str, radius: int) -> np.ndarray:
    """What names a fingerprint's list under a path: the bytes at its positions, and
    after a slash a choice of fields among the other bits."""
    at, _, fields = path.partition("/")
    mask = _mask(tuple(map(int, at)))
    return own & (dense_masks(mask, radius)[int(fields)] if fields else mask)


def _deeper(path: str, radius: int) -> list[str]:
    """Paths that list the fingerprints of one path anew, by one more position each, or
    by fields of the other bits. Under the latter a list holds 2**16 fingerprints at
    most, as 48 of 64 bits agree at radius 4."""
    needed = BYTES - radius - len(path)
    if needed > 0:
        return [f"{path}{p}" for (p,) in _choices([p for p in range(BYTES) if str(p) not in path], needed, 1)]
    return [f"{path}/{k}" for k in range(len(dense_masks(np.uint64(0), radius)))]


def _post(fps: DataFrame, radius: int, paths: list[str] | None, split: int) -> DataFrame:
    """fps: _fp; or, without paths, blocks (_path, _part, _fps, _n) that hold _n
    fingerprints, which are listed anew. Gives blocks (_path, _part, _fps)."""

    def deal(own: np.ndarray, path: str, parts: int) -> pa.RecordBatch:
        part = (mix(_keys(own, path, radius)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        full = np.flatnonzero(cut[:-1] < cut[1:])
        data = [own[order[cut[j] : cut[j + 1]]].tobytes() for j in full]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(full), pa.string()), pa.array(full, pa.int64()), pa.array(data, pa.binary())], ["_path", "_part", "_fps"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for path in paths:
                yield deal(own, path, split)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                for finer in _deeper(path, radius):
                    yield deal(np.frombuffer(data.as_py(), np.uint64), finer, -(-n // BLOCK_ROWS))

    rows = fps.select("_fp") if paths else fps.select("_path", "_fps", "_n")
    return rows.mapInArrow(first if paths else again, "_path string, _part bigint, _fps binary")


def _meet(blocks: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of each block. Blocks are sorted by the shuffle and worked off one
    at a time: a task holds one block."""

    def settle(path: str, parts: list[bytes]) -> pa.RecordBatch:
        own = np.unique(np.frombuffer(b"".join(parts), np.uint64))
        forest = _Forest(own, radius)
        at = np.arange(len(own))
        if "/" in path:
            forest.lists(at, _keys(own, path, radius), None)
        else:
            forest.index(at, tuple(map(int, path)))
        pairs = own[np.array(forest.pairs, np.int64).reshape(-1, 2)].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(1) if len(pairs) else [], pa.int64()), pa.array(pairs.max(1) if len(pairs) else [], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            for path, part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if (path, part) != now:
                    if parts:
                        yield settle(now[0], parts)
                    now, parts = (path, part), []
                parts.append(data.as_py())
        if parts:
            yield settle(now[0], parts)

    dealt = blocks.repartition(partitions(blocks.sparkSession), "_path", "_part").sortWithinPartitions("_path", "_part")
    return dealt.select("_path", "_part", "_fps").mapInArrow(run, "a bigint, b bigint")


def links(fps: DataFrame, radius: int = RADIUS, depth: int | None = None) -> DataFrame:
    """fps: distinct _fp. Pairs (a, b) whose components are those of all links.

    A block holds the lists of one choice of positions whose keys hash alike. Blocks
    that a common key makes too large are listed anew by one more position, all of
    them, until none is left or their lists are bounded by the bits that differ.
    """
    rows = fps.count()
    choices = _choices(list(range(BYTES)), BYTES - radius, depth or depth_of(rows, radius))
    blocks, found = _post(fps, radius, ["".join(map(str, c)) for c in choices], max(1, -(-rows // BLOCK_ROWS))), []
    while True:
        blocks = stash(blocks)
        sizes = blocks.groupBy("_path", "_part").agg(F.sum(F.length("_fps") / 8).cast("long").alias("_n"))
        large = stash(sizes.where((F.col("_n") > HOT_ROWS) & ~F.contains("_path", F.lit("/"))))
        if large.isEmpty():
            found.append(_meet(blocks, radius))
            break
        found.append(_meet(blocks.join(large, ["_path", "_part"], "left_anti"), radius))
        blocks = _post(blocks.join(large, ["_path", "_part"]), radius, None, 0)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.distinct()


def dense_masks(mask: np.uint64, radius: int) -> list[np.uint64]:
    """Keys for fingerprints that agree under mask: their other bits in twice as
    many fields as the radius, of which at least half agree."""
    free = [b for b in range(64) if not int(mask) >> b & 1]
    fields = [free[k :: 2 * radius] for k in range(2 * radius)]
    return [np.uint64(int(mask) | sum(1 << b for f in c for b in f)) for c in combinations(fields, radius)]


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df as a side of a join: broadcast where it has few rows."""
    return F.broadcast(df) if rows <= FEW_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is its component's
    smallest node. Alternates large-star and small-star steps until every node is
    a root or has its root as the only neighbour; every step is cut from its lineage."""
    e = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stash(both.groupBy("a").agg(F.min("b").alias("_lo"), F.max("b").alias("_hi")))
        nodes, unsettled = near.agg(F.count("*"), F.expr("count_if(_lo < a and _lo < _hi)")).first()
        least = near.select("a", F.least("a", "_lo").alias("_m"))
        if not unsettled:
            return least.toDF("node", "root")
        large = both.where("b > a").join(_few(least, nodes), "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(_few(least, nodes), "a").where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b")).unionAll(least.select("a", F.col("_m").alias("b")))
        e = stash(small.distinct())


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (_key, _root) of all links so far with more of them (a, b), from the
    components of what these join: whole classes, and keys that are in none yet."""
    rows = roots.count()
    ends = links
    for end in "ab":
        ends = ends.join(_few(roots.toDF(end, f"_{end}"), rows), end, "left")
    more = components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    n = more.count()
    moved = roots.join(_few(more.toDF("_root", "_to"), n), "_root", "left").select("_key", F.coalesce("_to", "_root").alias("_root"))
    fresh = more.toDF("_key", "_root").join(_few(roots.select("_key"), rows), "_key", "left_anti")
    return stash(moved.unionAll(fresh))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, _text, _fp and _root (the class), a row a row of docs."""
    rows = stash(fingerprints(docs, id_col, text_col))
    fps = stash(rows.select("_fp").distinct())
    roots = components(links(fps, radius)).select(F.col("node").alias("_fp"), F.col("root").alias("_root"))
    return stash(rows.join(roots, "_fp", "left").select("doc_id", "_text", "_fp", F.coalesce("_root", "_fp").alias("_root")))


def dedup_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id for every row.

    Null, empty and blank texts have fingerprint zero and link as any other.
    Texts of fewer than four words are one shingle. Repeated rows have the same
    fingerprint and so one component. Null ids never name a component unless it
    has no other id. Other columns are not read, whatever their names. An empty table
    gives an empty result.
    """
    rows = classes(docs, id_col, text_col, radius)
    # written first, so that a large class meets its id in a join that can be split
    named = stash(rows.groupBy("_root").agg(F.min("doc_id").alias("component_id")))
    return rows.join(named, "_root").select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of all runs of STAGE_WORDS words, sorted; shorter texts are one run, blank ones none."""
    words = (text or "").encode().lower().split()
    k, n = min(STAGE_WORDS, len(words)), len(words)
    if not n:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    out = np.zeros(n - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out + each[j : n - k + 1 + j]) * _BASE
    return np.unique(mix(out))


def set_fingerprint(own: np.ndarray) -> int:
    """64-bit SimHash of a set of shingles, by majority of their hashes; zero of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(own), 1 << 16):
        counts += np.unpackbits(own[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((counts * 2 > len(own)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def _minima(own: np.ndarray) -> np.ndarray:
    """The least of a set under each of the random orders."""
    low, out = own.astype(np.uint32), np.full(BANDS * MINIMA, np.uint32(2**32 - 1))
    for at in range(0, len(low), 1 << 10):
        out = np.minimum(out, (low[at : at + (1 << 10), None] * _ORDERS).min(0))
    return out


def _bands(least: np.ndarray) -> np.ndarray:
    """A value a band: sets agree in one if their MINIMA minima under its orders are the same."""
    least, out = least.astype(np.uint64).reshape(BANDS, MINIMA), np.arange(BANDS, dtype=np.uint64)
    for k in range(MINIMA):
        out = mix(out ^ least[:, k])
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, _text, _key (a hash of the set of shingles), _size, _fp (its SimHash), _bytes
    (one of each minimum) and _bands, a row a row of docs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, fps, signs, bands = [], [], [], [], []
            for t in b.column(2):
                own = shingle_set(t.as_py())
                least = _minima(own)
                keys.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(len(own))
                fps.append(set_fingerprint(own))
                signs.append((least & np.uint32(0xFF)).astype(np.uint8).tobytes())
                bands.append(_bands(least) if len(own) else own)
            cols = [b.column(0), b.column(1), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(signs, pa.binary()), _lists(bands)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "_text", "_key", "_size", "_fp", "_bytes", "_bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("_text"), "text").mapInArrow(run, f"doc_id {kind}, _text bigint, _key bigint, _size bigint, _fp bigint, _bytes binary, _bands array<bigint>")


def by_fingerprint(kinds: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of keys whose fingerprints link: each key with one key of its own
    fingerprint, and those of the index's links with one another. Their components
    are those of all links."""
    of = stash(kinds.groupBy("_fp").agg(F.min("_key").alias("_rep")))
    same = kinds.join(of, "_fp").where("_key <> _rep").select(*_between("_key", "_rep"))
    met = links(of.select("_fp"), radius).join(of.toDF("a", "_x"), "a").join(of.toDF("b", "_y"), "b")
    return same.unionAll(met.select(*_between("_x", "_y"))).distinct()


def tallied(pairs: DataFrame, kinds: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) of keys, those that share SHARED positional bytes at least and
    whose sizes allow the similarity."""
    side = kinds.select("_key", "_size", "_bytes")
    both = pairs.join(side.toDF("a", "_m", "_x"), "a").join(side.toDF("b", "_n", "_y"), "b").where(F.least("_m", "_n") >= least * F.greatest("_m", "_n") - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, BANDS * MINIMA) for k in (2, 3))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array((x == y).sum(1) >= SHARED))

    return both.select("a", "b", "_x", "_y").mapInArrow(run, "a bigint, b bigint")


def texts_of(docs: DataFrame, kinds: DataFrame, keys: DataFrame) -> DataFrame:
    """_key and _zip, the compressed text of one row of each of the keys."""
    first = F.col("_first.doc_id").alias("_id"), F.col("_first._text").alias("_hash")
    wanted = stash(keys.select("_key").distinct().join(kinds, "_key").select("_key", *first))
    few = wanted.count() <= BROADCAST_ROWS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pen = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([pen.compress((t.as_py() or "").encode()) for t in b.column(b.num_columns - 1)], pa.binary())], b.schema.names[:-1] + ["_zip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").alias("_own"), F.xxhash64("text").alias("_same"), "text")
    texts = texts if few else texts.mapInArrow(pack, f"_own {kind}, _same bigint, _zip binary")
    texts = texts.join(F.broadcast(wanted) if few else wanted, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_same") == F.col("_hash")))
    texts = texts.select("_key", "text").mapInArrow(pack, "_key bigint, _zip binary") if few else texts.select("_key", "_zip")
    return stash(texts.groupBy("_key").agg(F.first("_zip").alias("_zip")))


def verified(docs: DataFrame, kinds: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) of keys, those whose sets have the similarity, by their texts.

    Texts travel compressed, each once to its pairs; a row a pair, none with a list of
    other members, so a common text is a skewed join, which adaptive execution splits.
    """
    pairs = stash(tallied(pairs, kinds, least))
    if pairs.isEmpty():
        return pairs
    texts = texts_of(docs, kinds, pairs.select(F.explode(F.array("a", "b")).alias("_key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pen, held = zstandard.ZstdDecompressor(), {}
        for b in batches:
            keep = []
            for a, x, y in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                if a not in held:
                    if len(held) >= 8:
                        held.clear()
                    held[a] = shingle_set(pen.decompress(x.as_py()).decode())
                other = shingle_set(pen.decompress(y.as_py()).decode())
                n = len(np.intersect1d(held[a], other, assume_unique=True))
                keep.append(n >= least * (len(held[a]) + len(other) - n) - 1e-9)
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.toDF("b", "_y"), "b").join(texts.toDF("a", "_x"), "a").select("a", "b", "_x", "_y")
    return stash(both.mapInArrow(run, "a bigint, b bigint"))


def prefixes(texts: DataFrame, least: float) -> DataFrame:
    """_key, _size, _h and _rest: of every set its rarest shingles, and how many of the set
    come no earlier than each. With all sets in one order, the first shingle that two
    sets have in common has at least as many after it in both as they share. So sets of
    the similarity meet in a shingle listed here, whatever the order; rare ones first keep lists short.

    The order is by count, of the COMMON most frequent shingles at most, then by hash.
    """
    spark = texts.sparkSession

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pen = zstandard.ZstdDecompressor()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([shingle_set(pen.decompress(z.as_py()).decode()) for z in b.column(1)])], ["_key", "_all"])

    each = stash(texts.mapInArrow(sets, "_key bigint, _all array<bigint>"))
    counts = stash(each.select(F.explode("_all").alias("_h")).groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1"))
    power, room = 64, COMMON
    for p, n in sorted(counts.groupBy(F.floor(F.log2("_n")).cast("int")).count().collect(), reverse=True):  # at most 63 rows
        room -= n
        if room < 0:
            break
        power = p
    common = counts.where(F.col("_n") >= F.lit(2.0**power)).toArrow()
    names = common.column("_h").to_numpy().view(np.uint64)
    by_name = np.argsort(names)
    shared = spark.sparkContext.broadcast((names[by_name], common.column("_n").to_numpy()[by_name]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = shared.value
        for b in batches:
            for key, x in zip(b.column(0), b.column(1)):
                own = x.values.to_numpy().view(np.uint64)
                at = np.searchsorted(names, own)
                at[at == len(names)] = 0
                count = np.where(names[at] == own, counts[at], 0) if len(names) else np.zeros(len(own), np.int64)
                m = len(own)
                n = min(m, int(m - least * m + 1e-6) + 1)
                first = own[np.lexsort((own, count))[:n]].view(np.int64)
                cols = [pa.array([key.as_py()] * n, pa.int64()), pa.array([m] * n, pa.int64()), pa.array(first), pa.array(m - np.arange(n, dtype=np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["_key", "_size", "_h", "_rest"])

    return stash(each.mapInArrow(run, "_key bigint, _size bigint, _h bigint, _rest bigint"))


def _enough(rest: list[str], sizes: list[str], least: float) -> Column:
    """Whether two sets can have the similarity, by what is left of each where they meet."""
    return F.least(*rest) >= (F.col(sizes[0]) + F.col(sizes[1])) * (least / (1 + least)) - 1e-6


def _between(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _placed(posts: DataFrame, roots: DataFrame) -> DataFrame:
    """posts of lists that hold several components, with _root, and _out: not of the list's largest."""
    placed = posts.join(roots, "_key", "left").withColumn("_root", F.coalesce("_root", "_key"))
    parts = placed.groupBy("_h", "_root").agg(F.count("*").alias("n"))
    lists = parts.groupBy("_h").agg(F.max(F.struct("n", "_root"))["_root"].alias("_main"), F.sum("n").alias("_of"), F.count("*").alias("n")).where("n > 1").drop("n")
    return stash(placed.join(lists, "_h").withColumn("_out", F.col("_root") != F.col("_main")))


def led(posts: DataFrame, roots: DataFrame, least: float, turn: int = 0) -> DataFrame:
    """Pairs (a, b) of members of different components: each member outside the largest
    component of a list meets leads of the list, one in the first turn and MORE times as
    many in each further one, drawn anew; LEADS times as many for a member at most, of
    the shortest list and of any. So it is linked after as many pairs as the share of
    its links among the lists asks for, however long they are."""
    width = MORE**turn
    placed = _placed(posts, roots)
    slot = F.pmod(F.xxhash64("_key", "_h", F.lit(turn)), F.lit(width)).alias("_slot")
    lead = F.min(F.struct(F.xxhash64("_h", "_key", F.lit(turn)).alias("o"), F.col("_key").alias("k"), F.col("_size").alias("m"), F.col("_rest").alias("r"), F.col("_root").alias("t"))).alias("l")
    met = placed.where("_out").join(placed.groupBy("_h", slot).agg(lead), "_h").where("_root <> l.t").where(_enough(["_rest", "l.r"], ["_size", "l.m"], least))
    drawn = F.struct(F.xxhash64("_h", "_slot", F.lit(turn)).alias("o"), F.col("l.k").alias("k"))
    asked = met.groupBy("_key").agg(F.min_by("l.k", F.struct("_of", drawn["o"])).alias("_near"), F.array_sort(F.collect_set(drawn))["k"].alias("_any"))
    leads = F.slice(F.array_distinct(F.concat(F.array("_near"), "_any")), 1, LEADS * width)
    return asked.select("_key", F.explode(leads).alias("_lead")).select(*_between("_key", "_lead")).distinct()


def crossing(posts: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """All pairs (a, b) of members of different components that meet in a list with enough
    after it. One of the two is outside the list's largest component; the smaller set
    meets by fewer of its shingles, as it must share more of them."""
    placed = _placed(posts, roots)
    names = ["_key", "_size", "_rest", "_root", "_out"]
    large = placed.select("_h", *[F.col(c).alias(f"x{c}") for c in names])
    small = placed.where(F.col("_rest") >= F.col("_size") * (2 * least / (1 + least)) - 1e-6).select("_h", *[F.col(c).alias(f"y{c}") for c in names])

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        both = x.join(y, "_h").where("x_root <> y_root and x_size >= y_size").where(_enough(["x_rest", "y_rest"], ["x_size", "y_size"], least))
        return both.select(*_between("x_key", "y_key"))

    return meet(large, small.where("y_out")).unionAll(meet(large.where("x_out"), small.where("not y_out"))).distinct()


def similar(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, _text and _root (the class), a row a row of docs: classes are the
    components of pairs of a Jaccard similarity of at least ``least``.

    Pairs within the SimHash radius come first. Then a list holds the sets that agree in
    a band. A set is compared with a few leads of its lists first where these hold several
    components, then in lists of up to LIST_PAIRS members each pair of members in
    different components. Members of longer lists that hold several components are
    listed anew by their rarest shingles (prefixes), where they meet other leads in each
    round, as long as these link, and then all that is still in another component: no
    link is lost there either, and a large class is not compared with its own members.
    """
    rows = stash(sketches(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_text")).alias("_first")
    kinds = stash(rows.groupBy("_key").agg(first, *[F.first(c).alias(c) for c in ("_size", "_fp", "_bytes", "_bands")]))
    posts = kinds.select("_key", "_size", F.explode("_bands").alias("v"))
    lists = stash(posts.groupBy("v").agg(F.count("*").alias("_of")).where("_of > 1"))
    members = stash(posts.join(lists, "v"))

    roots = kinds.where("false").select("_key", F.col("_key").alias("_root"))

    def still_open(members: DataFrame) -> DataFrame:
        placed = members.select("v", "_key", "_of").join(roots, "_key", "left").withColumn("_root", F.coalesce("_root", "_key"))
        lists = placed.groupBy("v").agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi")).where("_lo <> _hi").select("v")
        return stash(placed.join(lists, "v"))

    def linked(pairs: DataFrame) -> int:
        """How many of the pairs are links; these join classes."""
        nonlocal roots
        more = verified(docs, kinds, pairs, least)
        if n := more.count():
            roots = joined(roots, more)
        return n

    def rounds(posts: DataFrame, most: int) -> None:
        for turn in range(most):
            asked = stash(led(posts, roots, least, turn))
            if linked(asked) < max(1, YIELD * asked.count()):
                break

    linked(by_fingerprint(kinds))
    rounds(members.select("_key", "_size", F.col("v").alias("_h"), F.col("_size").alias("_rest")), 2)
    placed = still_open(members)
    short = placed.where(F.col("_of") <= LIST_PAIRS)
    if not short.isEmpty():
        each = short.alias("x").join(short.alias("y"), "v").where("x._root <> y._root and x._key < y._key")
        linked(each.select(F.col("x._key").alias("a"), F.col("y._key").alias("b")).distinct())
    long = still_open(placed.where(F.col("_of") > LIST_PAIRS)).select("_key").distinct()
    if not long.isEmpty():
        by_shingle = prefixes(texts_of(docs, kinds, long), least)
        rounds(by_shingle, ROUNDS)
        linked(crossing(by_shingle, roots, least))
    return stash(rows.select("doc_id", "_text", "_key").join(roots, "_key", "left").select("doc_id", "_text", F.coalesce("_root", "_key").alias("_root")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_components(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every class of similar(): that of the smallest doc_id, nulls last,
    then of the smallest text hash; of rows alike in both, any one.

    Null and blank texts are one class. Columns stay as they were, whatever their
    names; an empty table gives an empty one. Texts are not shuffled: the rows to
    drop are looked up by id and text hash.
    """
    found = similar(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_text")).alias("_first")
    kept = found.groupBy("_root").agg(first).select(F.col("_first.doc_id").alias("_id"), F.col("_first._text").alias("_hash"))
    each = found.groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash")).agg(F.count("*").alias("_of"))
    same = each["_id"].eqNullSafe(kept["_id"]) & (each["_hash"] == kept["_hash"])
    gone = stash(each.join(kept, same, "left_anti").drop("_of"))
    alike = stash(each.where("_of > 1").drop("_of"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_key"), F.xxhash64("text").alias("_same"))

    def among(some: DataFrame, how: str, df: DataFrame) -> DataFrame:
        some = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
        return df.join(some, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_same") == F.col("_hash")), how)

    rows = among(gone, "left_anti", rows)
    if not alike.isEmpty():
        once = among(alike, "left_semi", rows).groupBy("_key", "_same").agg(F.first("_row").alias("_row")).select("_row", "_key", "_same")
        rows = among(alike, "left_anti", rows).unionAll(once)
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
