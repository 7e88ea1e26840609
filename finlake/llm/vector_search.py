"""Exact top-k by inner product with vector-approximation files.

Every vector becomes a row of cells, one byte a component, and a shift of its own
that says how many low bits the cells lack. A first scan reads only the cells: they
bound each inner product from below and above, and the k-th best lower bound of a
query rules out every vector whose upper bound is smaller. What is left is visited
in rounds in the order of the upper bounds: a round reads the exact vectors of the
next places alone, and the k-th best score so far rules out what it has passed.
Rounds end when nothing is left, so the result is certain.

Queries and cells are packed in blocks; a block of queries meets a block of cells
in one task. Equal vectors are one cell row that carries its smallest ids, so a
vector that a third of the table repeats is scanned once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rank_by, read, small_batches, stash

K, EVERY, SCALE = 5, 50, 256
#: Rows of a block of queries and of cells, bits of a cell, and the places that a first round reads.
QUERY_BLOCK, CELL_BLOCK, CELL_BITS, READS = 1024, 8192, 8, 16
#: Bounds that do not fit a long are the ends of its range, which stand for "no bound".
_LOW, _HIGH = -(2**63), 2**63 - 1
#: Scores are ranked by 38 digits; beyond, they count as the largest such number.
_DIGITS = 10**38 - 1
#: Where a bound is cut to be ordered as a double.
_FAR = 10**300


def canonical(embedding: Column) -> Column:
    """floor(256 * x) / 256 of every component as double, exactly: from 2**45 on, x is that already."""
    return F.transform(embedding, lambda x: F.when(F.abs(x.cast("double")) < 2.0**45, F.floor(x.cast("double") * float(SCALE)).cast("double") / float(SCALE)).otherwise(x.cast("double")))


def _sound(embedding: Column) -> Column:
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(odd, F.lit(False))


def integers(values: np.ndarray) -> np.ndarray:
    """256 times the values: doubles where all are below 2**53 and so exact, else Python integers."""
    if not values.size or np.abs(values).max() < 2.0**45:
        return values * float(SCALE)
    return np.array([int(x * SCALE) if abs(x) < 2.0**1000 else int(x) * SCALE for x in values.ravel().tolist()], object).reshape(values.shape)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), dim)


def cells(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte a component, and a shift a row: a component is cell << shift and at most (1 << shift) - 1 more."""
    if not whole.shape[1]:
        return np.zeros(whole.shape, np.int8), np.zeros(len(whole), np.int16)
    top = np.maximum(whole.max(1), -whole.min(1) - 1)
    bits = np.array([int(x).bit_length() for x in top.tolist()])
    shift = np.maximum(0, bits - (CELL_BITS - 1)).astype(np.int16)
    if whole.dtype == object:
        return np.array([[int(x) >> int(s) for x in row] for row, s in zip(whole.tolist(), shift)], np.int8).reshape(whole.shape), shift
    return np.floor(whole / np.exp2(shift)[:, None]).astype(np.int8), shift


def bounds(ask: np.ndarray, cell: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most that each query's product with each vector may be."""
    dim, longest = max(1, ask.shape[1]), int(shift.max(initial=0))
    reach = max((abs(int(x)) for x in (ask.max(initial=0), ask.min(initial=0))), default=0) * dim << (CELL_BITS + longest)
    if reach < 2**52:  # sums below 2**53 are exact in doubles
        scale, ask, cell = np.exp2(shift), ask.astype(np.float64), cell.astype(np.float64)
    else:
        scale, ask, cell = np.array([1 << int(s) for s in shift], object), np.array([[int(x) for x in r] for r in ask.tolist()], object).reshape(ask.shape), cell.astype(object)
    base = (ask @ cell.T if ask.shape[1] else np.zeros((len(ask), len(cell)), scale.dtype)) * scale
    below, above = np.minimum(ask, 0).sum(1), np.maximum(ask, 0).sum(1)
    return base + below[:, None] * (scale - 1), base + above[:, None] * (scale - 1)


def _long(values: np.ndarray) -> np.ndarray:
    if values.dtype == object:
        return np.array([min(max(int(x), _LOW), _HIGH) for x in values], np.int64)
    return values.astype(np.int64)


def topk(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for every id divisible by ``every``, the k
    highest integer inner products with other ids, ties to the smaller id.

    Vectors that are null, or hold a null, a NaN or an infinity, and null ids take no
    part. Components of any size do; a score that does not fit a long is given as the
    nearest long and ranked by its exact value up to 38 digits. Vectors are compared
    with those of the same length; empty ones score 0. A row that repeats id and
    vector counts once; a query of several vectors is asked by its smallest. Fewer
    than k other ids give fewer rows; an empty table gives none. Other columns are
    not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("e")).where(F.col("id").isNotNull() & _sound(F.col("e")))
    whole = good.select("id", canonical(F.col("e")).alias("v"))
    # equal vectors: one row with the k + 1 smallest ids, as the query may be one of them
    salted = whole.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    place = F.row_number().over(Window.partitionBy("v", "salt").orderBy("id"))
    fewer = salted.withColumn("p", place).where(F.col("p") <= k + 1).groupBy("v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
    classes = stash(rank_by(fewer.select("v", "ids", F.size("v").alias("dim")), F.struct("dim", F.element_at("ids", 1)).asc()).withColumnRenamed("_rank", "i"))
    asked = whole.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    queries = stash(rank_by(asked, F.struct("dim", "id").asc()).withColumnRenamed("_rank", "q"))
    nq, nc = queries.count(), classes.count()
    if not nq or not nc:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    left = _survivors(queries, classes, -(-nq // QUERY_BLOCK), -(-nc // CELL_BLOCK), k)
    return _visited(left, queries, classes, k)


def _survivors(queries: DataFrame, classes: DataFrame, q_blocks: int, c_blocks: int, k: int) -> DataFrame:
    """(q, i, most): what the scan of the cells leaves of each query, with its upper bound."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        whole = integers(_matrix(table["v"], key[1].as_py()))
        cell, shift = cells(whole)
        row = {"cb": key[0].as_py(), "dim": key[1].as_py(), "i": table["i"].to_numpy().tobytes(), "n": table["n"].to_numpy().tobytes(), "shift": shift.tobytes(), "cells": cell.tobytes()}
        return pa.Table.from_pylist([row], schema=pa.schema([("cb", pa.int64()), ("dim", pa.int32()), *[(n, pa.binary()) for n in ("i", "n", "shift", "cells")]]))

    rows = classes.select("i", F.size("ids").cast("long").alias("n"), "dim", "v", F.expr(f"i div {CELL_BLOCK}").alias("cb"))
    packed = stash(rows.groupBy("cb", "dim").applyInArrow(pack, "cb bigint, dim int, i binary, n binary, shift binary, cells binary"))
    packed = packed.withColumn("qb", F.explode(F.expr(f"sequence(0L, {q_blocks - 1}L)")))
    questions = queries.select("q", "dim", "v", F.expr(f"q div {QUERY_BLOCK}").alias("qb"), F.explode(F.expr(f"sequence(0L, {c_blocks - 1}L)")).alias("cb"))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out, dims = [np.zeros((0, 4), np.int64)], left["dim"].to_numpy()
        for block in right.to_pylist():
            own = left.filter(pa.array(dims == block["dim"]))
            if not own.num_rows:
                continue
            ask, ids_q = integers(_matrix(own["v"], block["dim"])), own["q"].to_numpy()
            ids_c, ids_n, shift = np.frombuffer(block["i"], np.int64), np.frombuffer(block["n"], np.int64), np.frombuffer(block["shift"], np.int16)
            cell = np.frombuffer(block["cells"], np.int8).reshape(len(ids_c), block["dim"])
            for at in range(0, len(ask), 128):
                least, most = bounds(ask[at : at + 128], cell, shift)
                for r in range(len(least)):
                    # enough of the best classes to hold k ids besides the query's
                    low = np.array([float(min(max(x, -_FAR), _FAR)) for x in least[r]]) if least.dtype == object else least[r]
                    best = np.argpartition(-low, k)[: k + 1] if len(low) > k + 1 else np.arange(len(low))
                    best = best[np.argsort(-low[best], kind="stable")]
                    held = np.cumsum(ids_n[best])
                    floor = least[r][best[: np.searchsorted(held, k + 1) + 1]].min() if held[-1] >= k + 1 else None
                    keep = np.arange(len(low)) if floor is None else np.flatnonzero(most[r] >= floor)
                    out.append(np.stack([np.full(len(keep), ids_q[at + r]), ids_c[keep], _long(least[r][keep]), _long(most[r][keep])], 1))
        found = np.concatenate(out)
        return pa.table({n: pa.array(found[:, j]) for j, n in enumerate(("q", "i", "least", "most"))})

    found = stash(questions.groupBy("qb", "cb").cogroup(packed.groupBy("qb", "cb")).applyInArrow(scan, "q bigint, i bigint, least bigint, most bigint"))
    # the bound of all blocks together: the (k + 1)-th best lower bound, if classes hold single ids
    order = Window.partitionBy("q").orderBy(F.desc("least"), "i")
    floors = found.withColumn("r", F.row_number().over(order)).where(F.col("r") == k + 1).select("q", F.col("least").alias("floor"))
    left = found.join(floors, "q", "left").where(F.col("floor").isNull() | (F.col("most") >= F.col("floor")))
    return stash(left.select("q", "i", "most"))


def _visited(left: DataFrame, queries: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """The k best of each query, by exact vectors read in rounds in the order of their upper bounds."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for q, me, ask, own, ids in zip(*(b.column(j).to_pylist() for j in range(5))):
                product = sum(int(x) * int(y) for x, y in zip(integers(np.array(ask, np.float64)).tolist(), integers(np.array(own, np.float64)).tolist()))
                out += [(q, me, x, str(min(max(product, -_DIGITS), _DIGITS))) for x in ids if x != me]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["q", "id", "vec_id", "score"])

    best, reads, order = None, READS, Window.partitionBy("q").orderBy(F.desc("most"), "i")
    while True:
        placed = left.withColumn("r", F.row_number().over(order))
        now = placed.where(F.col("r") <= reads).select("q", "i")
        exact = now.join(classes.select("i", F.col("v").alias("cv"), "ids"), "i").join(queries.select("q", "id", F.col("v").alias("qv")), "q").select("q", "id", "qv", "cv", "ids")
        got = exact.mapInArrow(score, "q bigint, id bigint, vec_id bigint, score string").withColumn("score", F.col("score").cast("decimal(38,0)"))
        got = got if best is None else best.drop("rank").unionAll(got)
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        best = stash(got.distinct().withColumn("rank", rank).where(F.col("rank") <= k))
        # what the k-th best score so far has not passed
        sure = best.where(F.col("rank") == k).select("q", F.col("score").alias("_kth"))
        open_ = (F.col("_kth") <= F.col("most")) | F.col("_kth").isNull() | (F.col("most") == _HIGH)
        left = stash(placed.where(F.col("r") > reads).drop("r").join(sure, "q", "left").where(open_).select("q", "i", "most"))
        if left.isEmpty():
            break
        reads *= 8
    score_long = F.greatest(F.lit(_LOW).cast("decimal(38,0)"), F.least(F.lit(_HIGH).cast("decimal(38,0)"), "score")).cast("long")
    return best.select(F.col("id").alias("query_id"), "rank", "vec_id", score_long.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(read(spark, sf_dir, "embeddings"))
