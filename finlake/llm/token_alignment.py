"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers' token ends, as byte offsets, cut a text into elementary intervals:
the union of both end arrays. The owner of an interval in each tokenizer is found by
a binary search, so every interval is one overlap of a token of A with one of B. Ends
that both have in common close groups. A pair of ids is counted over the corpus; each
link is then judged by its pair's count.

A text is cut into units at single spaces between characters that are no white space.
No token of either tokenizer spans such a cut, so both end there, and what a unit
gives is remembered. Spark sums the pairs' counts; the links' scores are a join.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, stash
from .token_counts import _byte_letters

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Distinct units that a worker remembers, and code points of the longest; units encoded at once.
MEMO, SHORT, CHUNK = 150_000, 60, 20_000
#: Distinct pairs up to which their counts are broadcast; beyond, the join is left to a shuffle.
BROADCAST_PAIRS = 1_000_000
#: A pair's key: the id of A times this, and the id of B.
SHIFT = 16
_CUT = re.compile(r"(?<=[\w!-~])(?= [\w!-~])")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Aligner:
    """Both tokenizers, their tokens' bytes, and what the units so far have given."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker's threads would only get in each other's way
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {c: k for k, c in enumerate(_byte_letters())}
        entries = sorted(self.a.get_vocab().items(), key=lambda x: x[1])
        self.bytes_a = [b""] * (entries[-1][1] + 1)
        for token, k in entries:
            self.bytes_a[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.memo: dict[str, tuple] = {}
        self.past: dict[str, tuple] = {}

    def _learn(self, units: list[str]) -> dict[str, tuple]:
        """(tokens of A, tokens of B, groups, groups as text, pairs of its links) of
        each unit; nothing where the tokens' bytes are not the unit's."""
        ids_a = [x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)]
        ids_b = self.b.encode([u[1:] for u in units], num_threads=1)
        raw = [u.encode() for u in units]
        spell = lambda ids, entries: b"".join(map(entries.__getitem__, chain.from_iterable(ids)))
        n_a, n_b, n = (np.fromiter(map(len, x), np.int64, len(units)) for x in (ids_a, ids_b, raw))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64, int(k.sum())) for x, k in ((ids_a, n_a), (ids_b, n_b)))
        whole = b"".join(raw)
        ends = np.cumsum(n)
        same = whole == spell(ids_a, self.bytes_a) == spell(ids_b, self.bytes_b)
        if same and all(np.array_equal(np.cumsum(size[flat])[np.cumsum(k) - 1], ends) for size, flat, k in ((self.size_a, flat_a, n_a), (self.size_b, flat_b, n_b))):
            return dict(zip(units, self._links(flat_a, flat_b, n_a, n_b)))
        good = [k for k, (r, x, y) in enumerate(zip(raw, ids_a, ids_b)) if spell([x], self.bytes_a) == r == spell([y], self.bytes_b)]
        out = dict.fromkeys(units, ())
        if good:
            flat_a, flat_b = (np.array([t for k in good for t in x[k]], np.int64) for x in (ids_a, ids_b))
            out.update(zip((units[k] for k in good), self._links(flat_a, flat_b, n_a[good], n_b[good])))
        return out

    def _links(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Iterator[tuple]:
        """Units one behind the other, as tokens of A and B and their numbers: the tuples of _learn()."""
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.union1d(end_a, end_b)  # an elementary interval ends here
        of_a, of_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)  # its owners
        pairs = ((a[of_a] << SHIFT) | b[of_b]).astype("<u4").tobytes()
        shared = end_a[np.isin(end_a, end_b, assume_unique=True)]  # a group ends here
        close_a, close_b = np.searchsorted(end_a, shared, "right").tolist(), np.searchsorted(end_b, shared, "right").tolist()
        name_a, name_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups, x, y = [], 0, 0
        for u, v in zip(close_a, close_b):
            groups.append(f"{name_a[x] if u - x == 1 else ','.join(name_a[x:u])}|{name_b[y] if v - y == 1 else ','.join(name_b[y:v])}")
            x, y = u, v
        unit_end = end_a[np.cumsum(n_a) - 1]
        upto, closed = (4 * np.searchsorted(ends, unit_end, "right")).tolist(), np.searchsorted(shared, unit_end, "right").tolist()
        i = g = 0
        for na, nb, j, h in zip(n_a.tolist(), n_b.tolist(), upto, closed):
            yield na, nb, h - g, ";".join(groups[g:h]), pairs[i:j]
            i, g = j, h

    def units(self, units: list[str]) -> list[tuple]:
        """What each unit gives, remembered or new. Two generations of memory: what was
        met since the last change of generations survives the next."""
        missing = set(units).difference(self.memo)
        new = {u: self.past[u] for u in missing if u in self.past}
        todo = sorted(missing.difference(new))
        for at in range(0, len(todo), CHUNK):
            new.update(self._learn(todo[at : at + CHUNK]))
        get = self.memo.get
        out = [got if (got := get(u)) is not None else new[u] for u in units]
        self.memo.update((u, x) for u, x in new.items() if len(u) <= SHORT)
        if len(self.memo) > MEMO:
            self.memo, self.past = {}, self.memo
        return out

    def text(self, text: str | None) -> tuple[int, int, int, str, np.ndarray] | None:
        """(tokens of A, tokens of B, groups, groups as text, pairs of all links), or None
        where a text is null, empty, or not what its tokens spell."""
        return self.texts([text])[0]

    def texts(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray] | None]:
        cut = [_CUT.split(f" {t}") if t else [] for t in texts]
        found, out, at = self.units([u for x in cut for u in x]), [], 0
        for x in cut:
            own = found[at : at + len(x)]
            at += len(x)
            if not own or not all(own):
                out.append(None)
                continue
            a, b, g, names, pairs = zip(*own)
            out.append((sum(a), sum(b), sum(g), ";".join(names), np.frombuffer(b"".join(pairs), "<u4")))
        return out


def products(groups: str) -> list[tuple[int, int]]:
    """All pairs of a token of A and a token of B in one group, group by group: what
    many-to-many alignment takes where overlaps are too narrow."""
    out = []
    for g in groups.split(";") if groups else []:
        a, b = ([int(t) for t in x.split(",")] for x in g.split("|"))
        out += [(x, y) for x in a for y in b]
    return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """This process's aligner of two files: its memo serves all tasks that the worker runs."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] = (TOKENIZER_A, TOKENIZER_B), whole: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and pair, times: the distinct
    pairs of ids that the text's links hold, and how many links hold each; with whole
    also groups, the text of all groups. Repeated rows and null ids pass as they are."""
    small_batches(docs.sparkSession)
    paths = [public_tokenizers.path(t) for t in tokenizers]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        for b in batches:
            found = [x or (0, 0, 0, "", np.empty(0, "<u4")) for x in own.texts(b.column(1).to_pylist())]
            counted = [np.unique(x[4], return_counts=True) for x in found]
            at = np.cumsum([0, *[len(c[0]) for c in counted]]).astype(np.int32)
            flat = [np.concatenate([np.empty(0, np.int64), *[c[k].astype(np.int64) for c in counted]]) for k in (0, 1)]
            cols = [b.column(0), *[pa.array([x[k] for x in found], pa.int64()) for k in range(3)], pa.array([len(x[4]) for x in found], pa.int64())]
            cols += [pa.array([hashlib.sha256(x[3].encode()).hexdigest() if x[3] else "" for x in found])]
            cols += [pa.ListArray.from_arrays(pa.array(at), pa.array(f)) for f in flat]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "times"]
            if whole:
                cols, names = [*cols, pa.array([x[3] for x in found])], [*names, "groups"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pair array<bigint>, times array<bigint>"
    return docs.select(id_col, text_col).mapInArrow(run, schema + (", groups string" if whole else ""))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """_pair, count: how many links of the corpus hold a pair, and best, whether no
    other pair of its id of B has more."""
    links = aligned.select(F.explode(F.arrays_zip("pair", "times")).alias("_l")).select(F.col("_l.pair").alias("_pair"), F.col("_l.times").alias("_times"))
    counts = links.groupBy("_pair").agg(F.sum("_times").alias("count"))
    of_b = F.col("_pair").bitwiseAND((1 << SHIFT) - 1)
    most = counts.groupBy(of_b.alias("_b")).agg(F.max("count").alias("_most"))
    return counts.join(most, of_b == F.col("_b")).select("_pair", "count", (F.col("count") == F.col("_most")).alias("best"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] = (TOKENIZER_A, TOKENIZER_B), broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, a row a row of docs.

    A text that is null, empty, or not what its tokens spell has zeros and an empty
    digest. Texts of any length are aligned whole; an empty table gives an empty one;
    columns of other names are not read.
    """
    aligned = stash(alignments(docs, id_col, text_col, tokenizers).withColumn("_row", F.monotonically_increasing_id()))
    counts = stash(pair_counts(aligned))
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    digest = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    links = aligned.select("_row", *digest, F.explode_outer(F.arrays_zip("pair", "times")).alias("_l")).select("_row", *digest, F.col("_l.pair").alias("pair"), F.col("_l.times").alias("_times"))
    scored = links.join(counts, F.col("pair") == F.col("_pair"), "left").groupBy("_row", *digest).agg(
        F.coalesce(F.sum(F.when(F.col("best"), F.col("_times"))), F.lit(0)).alias("n_best"), F.coalesce(F.sum(F.col("_times") * F.col("count")), F.lit(0)).alias("count_sum"),
    )
    return scored.drop("_row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read(spark, sf_dir, "documents"))
