"""Distinct counts and quantiles that add up: exact bitmaps, exact histograms, sketches.

What is kept a day or month is merged to any longer span, so that no span needs a read
of all its rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finlake.operators.core import missing, numbered
from finlake.sources.store import TableStore

c = F.col
#: Items of a sketch: its rank error is below RANK_ERROR in 99 of 100 cases.
SKETCH_K, RANK_ERROR = 400, 0.01


def number_ids(store: TableStore, table: str, ids: DataFrame, id_col: str) -> DataFrame:
    """id_col, number: a dense number for each id, kept in a table. Ids that it lacks are
    numbered behind those that it has, so that a number never changes."""
    new = ids.select(id_col).where(c(id_col).isNotNull()).distinct()
    known = store.read("state", table) if store.exists("state", table) else None
    first = 0
    if known is not None:
        new = missing(new, known, [id_col])
        first = (known.agg(F.max("number")).first()[0] or -1) + 1  # one value
    rows = numbered(new, "number", c(id_col)).withColumn("number", c("number") + first)
    store.append("state", table, rows.select(id_col, "number"))
    return store.read("state", table)


def bitmaps(rows: DataFrame, by: list[str], number: str = "number") -> DataFrame:
    """by, bucket, bits: which numbers each group holds, 32768 of them a row of 4 KB."""
    return rows.groupBy(*by, F.bitmap_bucket_number(c(number)).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(c(number))).alias("bits"))


def united(maps: DataFrame, by: list) -> DataFrame:
    """Bitmaps of smaller groups as those of larger ones."""
    names = [b if isinstance(b, Column) else c(b) for b in by]
    return maps.groupBy(*names, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(maps: DataFrame, by: list[str], alias: str = "n") -> DataFrame:
    """How many distinct numbers each group holds, exact."""
    return maps.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(alias))


def histogram(rows: DataFrame, by: list, value: str) -> DataFrame:
    """by, value, n: how often each value occurs; sums of n merge groups."""
    return rows.where(c(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))


def histogram_quantiles(counts: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, rows and exact quantiles (the least value that reaches the share) of the merged
    histograms. A group has a row a value here, so bounded domains such as days are meant."""
    merged = counts.groupBy(*by, value).agg(F.sum("n").alias("n"))
    up = Window.partitionBy(*by).orderBy(value)
    placed = merged.withColumns({"_upto": F.sum("n").over(up), "_all": F.sum("n").over(Window.partitionBy(*by))})
    return placed.groupBy(*by).agg(
        F.max("_all").alias("rows"), *[F.min(F.when(c("_upto") >= F.ceil(c("_all") * F.lit(s)), c(value))).alias(k) for k, s in shares.items()]
    )


def sketches(rows: DataFrame, by: list, value: str, k: int = SKETCH_K) -> DataFrame:
    """by, sketch: a mergeable summary of the values, of a size that does not grow."""
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(c(value).cast("double"), k).alias("sketch"))


def merged_sketches(parts: DataFrame, by: list) -> DataFrame:
    return parts.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantile(share: float) -> Column:
    """A value whose rank is within RANK_ERROR of the share."""
    return F.kll_sketch_get_quantile_double("sketch", F.lit(share))
