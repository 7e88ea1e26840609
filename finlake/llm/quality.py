"""Quality classifier: supervised subword embeddings.

Words and their character n-grams are hashed to rows of one embedding table; a
document is the mean of its rows, followed by a softmax over two classes. The
table and the output layer are learned together by stochastic gradient descent
in numpy. A word that repeats the one before it adds a feature of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches

#: Rows of the embedding table, its width, and the n-gram lengths.
BUCKETS, WIDTH, GRAMS = 1 << 17, 8, (3, 4)
#: Labelled rows used for fitting: those with the smallest hash of doc_id.
SAMPLE, EPOCHS, RATE, SEED = 4000, 6, 0.5, 7
KEEP = 0.3
#: Distinct words whose share of the score a worker remembers.
MEMO = 500_000


def features(word: str) -> list[int]:
    """Hashed ids of a word and its character n-grams."""
    b = f"<{word}>"
    return [crc32(b.encode()) % BUCKETS] + [crc32(b[i : i + n].encode(), n) % BUCKETS for n in GRAMS for i in range(len(b) - n + 1)]


REPEAT, CHANGE = crc32(b"=repeat") % BUCKETS, crc32(b"=change") % BUCKETS


def bag(text: str) -> Counter:
    """Feature ids of a text with their counts."""
    words = text.split()
    out: Counter = Counter()
    for w, n in Counter(words).items():
        for i in features(w):
            out[i] += n
    same = sum(map(eq, words, words[1:]))
    out[REPEAT] += same
    out[CHANGE] += max(0, len(words) - 1 - same)
    return +out


class Model:
    """Embedding table and output layer; fit() learns both."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
        self.out = np.zeros((WIDTH, 2), np.float32)
        self.bias = np.zeros(2, np.float32)

    def fit(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> "Model":
        if len(set(labels)) < 2:
            return self  # nothing to tell apart: every score is 0.5
        rng, steps, done = np.random.default_rng(SEED), EPOCHS * len(bags), 0
        share = np.bincount(labels, minlength=2) / len(labels)
        self.bias[:] = np.log(share)
        for _ in range(EPOCHS):
            for k in rng.permutation(len(bags)):
                ids, counts = bags[k]
                rate = RATE * (1 - done / steps)
                done += 1
                if not len(ids):
                    continue
                part = (counts / counts.sum()).astype(np.float32)
                hidden = part @ self.table[ids]
                z = hidden @ self.out + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[k]] -= 1
                back = self.out @ p
                self.out -= rate * np.outer(hidden, p)
                self.bias -= 0.1 * rate * p
                # a feature's step is scaled to the document, as the mean divides it
                self.table[ids] -= (rate * 20) * np.minimum(part, 0.05)[:, None] * back
        return self

    def folded(self) -> tuple[np.ndarray, float]:
        """The mean is linear, so each row folds into one number: its share of the logit."""
        return self.table @ (self.out[:, 1] - self.out[:, 0]), float(self.bias[1] - self.bias[0])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fold.

    Labels other than 0 and 1 and null ids are left out; several labels of one id
    count as their largest. Features are made on the executors, whole texts. Of several
    rows of an id, the text of the smallest hash is learned from, so the driver gets one
    row an id.
    """
    fold = F.crc32(F.col("_id").cast("string").cast("binary")) % 5
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y in (0, 1) and _id is not null").where(fold != 0)
        .groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )
    pairs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")  # at most sample rows
    pairs = pairs.groupBy("_id", "_y").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, counts = [], []
            for t in b.column(1):
                got = bag(t.as_py() or "")
                ids.append(np.fromiter(got.keys(), np.uint32, len(got)).tobytes())
                counts.append(np.fromiter(got.values(), np.uint32, len(got)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["_id", "_y", "ids", "counts"])

    kind = pairs.schema["_id"].dataType.simpleString()
    got = pairs.select("_id", "_text", "_y").mapInArrow(run, f"_id {kind}, _y int, ids binary, counts binary").toArrow().sort_by("_id").to_pydict()
    bags = [(np.frombuffer(i, np.uint32), np.frombuffer(c, np.uint32).astype(np.float32)) for i, c in zip(got["ids"], got["counts"])]
    return Model().fit(bags, got["_y"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    A null or empty text is scored by the output layer's bias alone. Rows of one
    id are scored each; a null id is not held out. Other columns are not read,
    whatever their names. An empty table gives an empty one. No shuffle.
    """
    small_batches(docs.sparkSession)
    weights, bias = model.folded()
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, memo = shared.value, {}

        def learn(word: str) -> tuple[float, int]:
            ids = features(word)
            if len(memo) > MEMO:
                memo.clear()
            memo[word] = out = (float(w[ids].sum()), len(ids))
            return out

        for b in batches:
            scores = []
            for t in b.column(1):
                words = (t.as_py() or "").split()
                total, n = 0.0, 0
                for x, c in Counter(words).items():
                    s, k = memo.get(x) or learn(x)
                    total += s * c
                    n += k * c
                if len(words) > 1:
                    same = sum(map(eq, words, words[1:]))
                    total += same * float(w[REPEAT]) + (len(words) - 1 - same) * float(w[CHANGE])
                    n += len(words) - 1
                scores.append(1 / (1 + np.exp(-(total / n if n else 0.0) - bias)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= keep) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return docs.select(id_col, text_col, held.alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
