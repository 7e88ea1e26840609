"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key. Rows are put in the order of that key within
their source by ranges: the sizes of all ranges are summed, a running sum over a
source's ranges finds the range in which its budget ends, and only that range is
sorted to find the row. Budgets above a source's size repeat it in whole epochs
first. What decides a row's share is then one cut per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, rank_by, read, stash

#: Weights by the order of the sources, the share of all sizes to take, and how often a source may be taken.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: A key's leading bits that name its range.
RANGE_BITS = 12


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _source(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _key(id_: Column, text: Column) -> Column:
    return F.xxhash64(id_, text)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: one row a source (source, source_size). Adds target.

    Sources are ranked by code point, null last, over ranges of sources; the
    excess of full sources is reshared until none is above its most. Only the sum
    of what is left and the sum of weights come to the driver, once a round.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int") + 1)
    ranked = stash(rank_by(sizes, F.col("source").asc_nulls_last()).select("source", "source_size", weight.alias("_weight"), (F.col("source_size") * float(most)).alias("_cap")))
    total = float((ranked.agg(F.sum("source_size")).first()[0] or 0) * share)
    level = 0.0
    while True:
        full = F.col("_cap") <= F.col("_weight") * level
        got = ranked.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_weight")))).first()
        if not got[1]:
            break
        rise = (total - (got[0] or 0.0)) / got[1]
        if rise <= level:
            break
        level = rise
    return ranked.select("source", "source_size", F.least("_cap", F.col("_weight") * level).alias("target"))


def cuts(slim: DataFrame, **how) -> DataFrame:
    """slim: a row a document (_source, source, size, _key), cut from its lineage.

    One row a source: _source, source_size, target, _epochs, and the key at which
    the last, partial epoch ends, with the words left for the rows of that key.
    """
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    budget = F.floor(F.round("target", 6)).cast("long")
    goal = stash(
        targets(sizes, **how)
        .withColumn("_epochs", F.when(F.col("source_size") > 0, F.expr("cast(floor(round(target, 6)) as bigint) div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("_rest", budget - F.col("_epochs") * F.col("source_size"))
        .withColumn("_source", _source(F.col("source")))
        .drop("source")
    )
    where = F.shiftright("_key", 64 - RANGE_BITS)
    ranges = slim.groupBy("_source", where.alias("_range")).agg(F.sum("size").alias("_size"))  # at most 2**RANGE_BITS a source
    run = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossed = (
        ranges.withColumn("_before", F.sum("_size").over(run) - F.col("_size"))
        .join(goal.select("_source", "_rest"), "_source")
        .where((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_size")))
        .select("_source", "_range", (F.col("_rest") - F.col("_before")).alias("_left"))
    )
    inside = slim.withColumn("_range", where).join(crossed, ["_source", "_range"]).groupBy("_source", "_key").agg(F.sum("size").alias("_size"), F.count("*").alias("_copies"), F.first("_left").alias("_left"))
    run = Window.partitionBy("_source").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        inside.withColumn("_before", F.sum("_size").over(run) - F.col("_size"))
        .where((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_size")))
        .select("_source", F.col("_key").alias("_cut"), F.expr("(_left - _before) div _copies").alias("_partial"))
    )
    return stash(goal.drop("_rest").join(cut, "_source", "left"))


def _taken() -> Column:
    last = F.when(F.col("_cut").isNull(), 0).when(F.col("_key") < F.col("_cut"), F.col("size")).when(F.col("_key") == F.col("_cut"), F.least("size", "_partial")).otherwise(0)
    return (F.col("_epochs") * F.col("size") + last).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row.

    A null text has size 0 and is never taken. A null source is a source of its
    own, ranked last. Rows alike in id and text share one key: what is left at a
    cut is split evenly among them. An empty table gives an empty result.
    """
    slim = stash(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _source(F.col(source_col)).alias("_source"), size_of(F.col(text_col)).alias("size"), _key(F.col(id_col), F.col(text_col)).alias("_key")))
    return slim.join(cuts(slim, **how), "_source").select("doc_id", "size", "source_size", "target", _taken().alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes, with their columns, mix_words (words taken, repeats
    counted) and mix_target (the source's). Where docs has a column of such a name, in
    any case, the new one gets an underscore before it.

    Null and blank texts have no words and are not taken. A null source is a source of
    its own. Repeated rows share a key and what is left at a cut. An empty table gives
    an empty one.
    """
    names, key = docs.columns, _key(F.col("doc_id"), F.col("text"))
    measures = [_source(F.col("source")).alias("_source"), size_of(F.col("text")).alias("size"), key.alias("_key")]
    cut = cuts(stash(docs.select("doc_id", "source", *measures)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), *measures)
    taken = rows.join(cut, "_source").withColumn("_taken", _taken()).where("_taken > 0")
    new = [F.col(a).alias(free_name(b, names)) for a, b in (("_taken", "mix_words"), ("target", "mix_target"))]
    return taken.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], *new)
