"""Toxicity grades by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(theta_k - w.x) with one weight vector for all ordered
thresholds. x says which hashed words and word beginnings a text holds. Weights
are found by proximal gradient steps with an L1 penalty, so that words which
tell nothing weigh exactly nothing, however long a text is. The result is the
expected severity, the sum over k of P(grade > k).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, read, small_batches

BUCKETS, HEADS = 1 << 22, (4, 5, 6, 7)
#: Labelled rows used for fitting, of each grade: those with the smallest hash of doc_id.
SAMPLE, STEPS, PENALTY = 3000, 300, 6e-4
#: Different grades that labels may have, and words that a worker remembers.
GRADES, MEMO = 100, 100_000
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def features(word: str) -> list[int]:
    """Hashed ids of a normalised word and its beginnings."""
    return [crc32(word.encode(), 1) % BUCKETS] + [crc32(word[:n].encode(), n + 1) % BUCKETS for n in HEADS if len(word) >= n]


def normal(word: str) -> str:
    return _EDGE.sub("", word.lower())


def present(text: str) -> np.ndarray:
    out = {i for w in {normal(w) for w in set(text.split())} if w for i in features(w)}
    return np.fromiter(sorted(out), np.uint32, len(out))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Ordinal:
    """Shared weights, ordered thresholds; grades are 0..K-1."""

    def __init__(self, grades: int = 2):
        self.grades = grades
        self.ids = np.zeros(0, np.uint32)
        self.weights = np.zeros(0)
        self.theta = np.full(max(0, grades - 1), 35.0) + np.arange(max(0, grades - 1))

    def fit(self, rows: list[np.ndarray], grade: np.ndarray, share: np.ndarray) -> "Ordinal":
        """share: how much of the labelled rows each grade makes up, to undo the sampling."""
        if len(rows) == 0 or len(set(grade)) < 2:
            return self  # nothing to tell apart: every severity is 0
        seen = np.zeros(BUCKETS, np.int32)
        for r in rows:
            seen[r] += 1  # a row's ids are distinct
        often = np.flatnonzero(seen >= 3)
        to = np.full(BUCKETS, -1, np.int32)
        to[often] = np.arange(len(often), dtype=np.int32)
        kept = [x[x >= 0] for x in (to[r] for r in rows)]
        size = np.array([len(x) for x in kept])
        full = np.flatnonzero(size)  # rows that have a feature
        col = np.concatenate(kept)
        starts = (np.cumsum(size) - size)[full]
        by_col = np.argsort(col, kind="stable").astype(np.int32)
        row = np.repeat(np.arange(len(rows), dtype=np.int32), size)[by_col]  # of each entry, by feature
        col_starts = np.searchsorted(col[by_col], np.arange(len(often)))
        del kept, by_col, to, seen
        n, m = len(rows), len(often)
        weight = (share / np.maximum(np.bincount(grade, minlength=self.grades), 1))[grade]
        below = np.clip(np.cumsum(share)[:-1], 1e-6, 1 - 1e-6)
        theta = np.log(below / (1 - below))
        w, sum_sq = np.zeros(m), np.full(m, 1e-8)
        theta_sq = np.full(len(theta), 1e-8)
        for _ in range(STEPS):
            eta = np.zeros(n)
            if m:
                eta[full] = np.add.reduceat(w[col], starts)
            edge = np.concatenate([[-np.inf], theta, [np.inf]])
            hi, lo = _sigmoid(edge[grade + 1] - eta), _sigmoid(edge[grade] - eta)
            hi, lo = np.where(grade == self.grades - 1, 1.0, hi), np.where(grade == 0, 0.0, lo)
            p = np.maximum(hi - lo, 1e-12)
            d_hi, d_lo = hi * (1 - hi), lo * (1 - lo)
            g_eta = weight * (d_hi - d_lo) / p
            g = np.add.reduceat(g_eta[row], col_starts) if m else np.zeros(0)
            sum_sq += g * g
            step = 0.5 / np.sqrt(sum_sq)
            w = w - step * g
            w = np.sign(w) * np.maximum(np.abs(w) - step * PENALTY, 0)
            g_theta = np.zeros(len(theta))
            for k in range(len(theta)):
                g_theta[k] = -(weight * d_hi / p)[grade == k].sum() + (weight * d_lo / p)[grade == k + 1].sum()
            theta_sq += g_theta**2
            theta = np.maximum.accumulate(theta - 0.5 * g_theta / np.sqrt(theta_sq))
        keep = w != 0
        self.ids, self.weights, self.theta = often[keep].astype(np.uint32), w[keep], theta
        return self

    def severity(self, eta):
        """Expected grade: the sum over the thresholds of P(grade > k)."""
        return sum(_sigmoid(eta - t) for t in self.theta) + 0.0 * eta


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic", sample: int = SAMPLE) -> Ordinal:
    """Fit on at most ``sample`` labelled rows of each grade.

    Grades are 0 and the labels above it, by rank, so that a label's size does not
    matter; more than GRADES are an error. Null or negative labels and null ids are left
    out; several labels of one id count as their largest. Of several rows of an id, the
    text of the smallest hash is learned from, so the driver gets one row an id.
    """
    own = labels.select(F.col(id_col).alias("_id"), F.col(grade_col).cast("long").alias("_y")).where("_y >= 0 and _id is not null")
    known = own.groupBy("_id").agg(F.max("_y").alias("_y"))
    total = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).limit(GRADES + 1).collect()}
    if len(total) > GRADES:
        raise ValueError(f"more than {GRADES} different grades in {grade_col}")
    grades = sorted({0, *total})
    if len(total) < 2:
        return Ordinal(max(2, len(grades)))
    chosen = None
    for k in sorted(total):
        some = known.where(F.col("_y") == k).orderBy(F.xxhash64("_id"), "_id").limit(sample)
        chosen = some if chosen is None else chosen.unionAll(some)
    pairs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")  # at most sample rows a grade
    pairs = pairs.groupBy("_id", "_y").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [present(t.as_py() or "").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.binary())], ["_id", "_y", "ids"])

    kind = pairs.schema["_id"].dataType.simpleString()
    got = pairs.select("_id", "_text", "_y").mapInArrow(run, f"_id {kind}, _y bigint, ids binary").toArrow().sort_by("_id").to_pydict()
    share = np.array([total.get(k, 0) for k in grades], float)
    rank = {k: r for r, k in enumerate(grades)}
    return Ordinal(len(grades)).fit([np.frombuffer(x, np.uint32) for x in got["ids"]], np.array([rank[y] for y in got["_y"]], int), share / share.sum())


def score(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """doc_id, severity, toxic for every row; with keep_columns all columns of docs,
    then _severity and _toxic. Severity counts grades by rank. A text is toxic when a
    grade above 0 is likelier than not.

    Null and empty texts hold no words: the thresholds alone grade them. Repeated
    rows are scored each; columns of like names keep their values. An empty table
    gives an empty one. No shuffle: each column goes through Python once.
    """
    small_batches(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast(dict(zip(model.ids.tolist(), model.weights.tolist())))  # as many as the sample has features
    first, spare = float(model.theta[0]), model
    names = docs.columns if keep_columns else [id_col, text_col]
    text = names.index(text_col)
    kept = len(names) if keep_columns else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, memo = weights.value, {}

        def learn(word: str) -> tuple[int, ...]:
            if len(memo) > MEMO:
                memo.clear()
            memo[word] = out = tuple(i for i in features(normal(word)) if i in w) if normal(word) else ()
            return out

        for b in batches:
            eta = np.zeros(b.num_rows)
            for k, t in enumerate(b.column(text)):
                hits: set[int] = set()
                for x in set((t.as_py() or "").split()):
                    ids = memo.get(x)
                    if ids is None:
                        ids = learn(x)
                    if ids:
                        hits.update(ids)
                eta[k] = sum(w[i] for i in sorted(hits))
            cols = b.columns[:kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spare.severity(eta)), pa.array(eta > first)], [f"c{k}" for k in range(kept)] + ["severity", "toxic"])

    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    kinds = ", ".join(f"c{k} {renamed.schema[f'c{k}'].dataType.simpleString()}" for k in range(kept))
    out = renamed.mapInArrow(run, f"{kinds}, severity double, toxic boolean")
    if not keep_columns:
        return out.withColumnRenamed("c0", "doc_id")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], *[F.col(x).alias(free_name(f"_{x}", names)) for x in ("severity", "toxic")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs that are not toxic, with their columns as they were.

    Null and empty texts are graded by the thresholds alone, which toxic documents
    being the fewer keeps them; null ids and repeated rows are judged each. An empty
    table gives an empty one; without labels of two grades all rows stay.
    """
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")), keep_columns=True)
    return scored.where(~F.col(free_name("_toxic", docs.columns))).select(*[f"`{c}`" for c in docs.columns])
