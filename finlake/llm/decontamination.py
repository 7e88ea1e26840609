"""Benchmark decontamination by SimHash windows, with DataFrame functions only.

A window of a document has as many words as a benchmark item. Its SimHash over
five-word shingles is found among the items' fingerprints through multi-index
Hamming blocks: with R + 1 blocks, fingerprints within R bits agree in a block.
What is within R is verified by the exact weighted similarity of the two bags of
shingles.

A window of the similarity s has at least s / (1 + s) of both bags' shingles in
common. So only windows in which as many positions hold a shingle of one of the
items are fingerprinted, each against the items of all its length; no other window
can be similar. Of those, a window that begins with such a position, or the last
one of the text, holds all that one before it holds: the others are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stash

#: Bags at 0.8 differ in 8 to 12 bits on average, +- 3; above 28 with probability 1e-7.
WORDS, SIMILARITY, RADIUS = 5, 0.8, 28
#: Rows of the items' shingle index up to which it is broadcast; beyond it, it is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Word positions whose windows are cut together; of those with the same bag the first stays.
BLOCK_WORDS = 512
#: Bounds of the R + 1 blocks of a fingerprint.
_CUTS = [64 * k // (RADIUS + 1) for k in range(RADIUS + 2)]


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(spaced) > 0, F.split(spaced, " ")).otherwise(F.array().cast("array<string>"))


def shingles(words: Column, k: Column) -> Column:
    """Hashes of all runs of k words; none if there are fewer."""
    last = F.size(words) - k + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice(words, i, k), " ")))).otherwise(F.array().cast("array<bigint>"))


def _placed(words: Column, k: int) -> Column:
    """(k, at, h): the hashes of all runs of k words, with where they begin."""
    return F.transform(shingles(words, F.lit(k)), lambda h, i: F.struct(F.lit(k).alias("k"), i.alias("at"), h.alias("h")))


def simhash(bag: Column) -> Column:
    """64-bit SimHash: a bit is set if more than half of the hashes have it."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(bag, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int")) * 2 > F.size(bag))
    values = F.transform(bits, lambda on, b: F.when(on, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda x, y: x.bitwiseOR(y))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two bags of hashes, weights being counts."""
    count = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def _blocks(fp: Column) -> Column:
    """(block, value) of each of the R + 1 blocks."""
    own = lambda a, b: F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    return F.array(*[F.struct(F.lit(k).alias("block"), own(a, b).alias("value")) for k, (a, b) in enumerate(zip(_CUTS, _CUTS[1:]))])


def _first_block(differ: Column) -> Column:
    """The first block in which two fingerprints agree, by the bits that differ."""
    masks = [((1 << b) - (1 << a)) for a, b in zip(_CUTS, _CUTS[1:])]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m).cast("bigint")) == 0, k) for k, m in enumerate(signed)])


def _items(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """item_id, k (words of a shingle), n (words), bag, fp and item (a key), a row an item with words."""
    words = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    words = words.withColumn("k", F.least(F.size("w"), F.lit(WORDS)))
    bags = words.select("item_id", "k", F.size("w").alias("n"), shingles(F.col("w"), F.col("k")).alias("bag")).distinct()
    return stash(bags.withColumn("fp", simhash(F.col("bag"))).withColumn("item", F.xxhash64("item_id", "n", "bag")))


def _starts(keyed: DataFrame, items: DataFrame, lengths: list[int], broadcast: bool, least: float) -> DataFrame:
    """doc_id, _text, hits (n, k, starts): the windows that hold enough shingles of an item, by BLOCK_WORDS positions."""
    index = items.select("item", "k", "n", F.size("bag").alias("m"), F.explode(F.array_distinct("bag")).alias("h"))
    index = F.broadcast(index) if broadcast else index
    hashed = keyed.select("doc_id", "_text", words_of(F.col("t")).alias("w")).select(
        "doc_id", "_text", F.size("w").alias("size"),
        F.concat(*[_placed(F.col("w"), k) for k in lengths]).alias("all"),
    )
    # the outer form: from the other one Spark infers a filter that computes the array anew for each element
    spread = hashed.select("doc_id", "_text", "size", F.explode_outer("all").alias("x")).select("doc_id", "_text", "size", "x.*")
    found = spread.join(index, ["k", "h"]).groupBy("doc_id", "_text", "size", "item", "k", "n", "m").agg(F.sort_array(F.collect_set("at")).alias("at"))
    own = F.least(F.col("m"), F.col("size") - F.col("k") + 1)
    found = found.withColumn("need", F.ceil((own + F.col("m")) * (least / (1 + least)) - 1e-6).cast("int")).where(F.size("at") >= F.col("need"))
    last = F.greatest(F.lit(0), F.col("size") - F.col("n"))
    near = "filter(sequence(0, size(at) - need), i -> at[i + need - 1] - at[i] < m)"
    starts = F.array_distinct(F.transform(F.expr(near), lambda i: F.least(F.col("at")[i], last)))
    # the outer form again: a filter inferred from the other could be run before ``need`` is checked
    windows = found.select("doc_id", "_text", "n", "k", F.explode_outer(starts).alias("start")).where("start is not null")
    blocks = windows.groupBy("doc_id", "_text", "n", "k", F.floor(F.col("start") / BLOCK_WORDS)).agg(F.sort_array(F.collect_set("start")).alias("starts"))
    return stash(blocks.groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash")).agg(F.collect_list(F.struct("n", "k", "starts")).alias("hits")))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = SIMILARITY
) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words, hamming, and _text (a hash
    of the text): the best window of every item found in every document. Where an
    item runs over an end of the text, that is the first or last window, or the
    whole text if it has fewer words than the item.

    Words are runs of letters and digits in lower case. Items of fewer than five
    words are one shingle; items and documents without words match nothing. Null
    ids are kept as they are. Rows alike in id and text are reported once. Of
    equally similar windows the first is reported; windows near one another with the same
    bag are judged once, so a text may repeat a line without end. Other columns are not read.
    Empty tables give none.
    """
    items = _items(benchmark, item_col, item_text)
    small = items.agg(F.sum(F.size("bag"))).first()[0] or 0
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_text"), F.col(text_col).alias("t"))
    lengths = sorted(r[0] for r in items.select("k").distinct().collect()) or [WORDS]  # at most five
    hits = _starts(keyed, items, lengths, small <= BROADCAST_ROWS, least)
    windows = F.expr("aggregate(hits, 0L, (s, x) -> s + size(x.starts))")
    hits = F.broadcast(hits) if (hits.agg(F.sum(windows)).first()[0] or 0) <= BROADCAST_ROWS // 4 else hits
    texts = keyed.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")))
    whole = texts.dropDuplicates(["doc_id", "_text"]).select("doc_id", "_text", words_of(F.col("t")).alias("w"), "hits")
    whole = whole.select("doc_id", "_text", "hits", F.size("w").alias("size"), F.array(*[shingles(F.col("w"), F.lit(k)) for k in lengths]).alias("all"))
    # a block's part is cut out first: a row must carry neither the whole text nor all its windows
    at = f"array_position(array({', '.join(map(str, lengths))}), x.k) - 1"
    part = f"slice(all[{at}], x.starts[0] + 1, element_at(x.starts, -1) - x.starts[0] + least(x.n, size) - x.k + 1)"
    cut = f"transform(hits, x -> struct(x.n as n, x.k as k, x.starts as starts, least(x.n, size) as own, {part} as part))"
    blocks = whole.select("doc_id", "_text", F.explode_outer(F.expr(cut)).alias("x")).select("doc_id", "_text", "x.*")
    bags = blocks.withColumn("bags", F.expr("transform(starts, s -> slice(part, s - starts[0] + 1, own - k + 1))")).drop("part")
    named = bags.withColumn("names", F.expr("transform(bags, b -> xxhash64(sort_array(b)))"))
    new = F.expr("filter(transform(bags, (b, i) -> struct(starts[i] as start, b as bag, array_position(names, names[i]) = i + 1 as new)), x -> x.new)")
    found = named.select("doc_id", "_text", "n", "own", F.explode_outer(new).alias("x")).select("doc_id", "_text", "n", "own", "x.start", "x.bag")
    found = stash(found.withColumn("fp", simhash(F.col("bag"))))
    # multi-index Hamming blocks: a window meets the items of its length that agree with it in a block, in the first such
    left = found.select("*", F.explode_outer(_blocks(F.col("fp"))).alias("z"))
    right = items.select("item_id", "n", F.col("bag").alias("item_bag"), F.col("fp").alias("item_fp"), F.explode_outer(_blocks(F.col("fp"))).alias("z"))
    right = F.broadcast(right) if small <= BROADCAST_ROWS // (RADIUS + 1) else right
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    near = left.join(right, ["n", "z"]).where((_first_block(differ) == F.col("z.block")) & (F.bit_count(differ) <= RADIUS))
    best = F.struct(similarity(F.col("bag"), F.col("item_bag")).alias("similarity"), (-F.col("start")).alias("start"), F.col("own").alias("n"), F.bit_count(differ).alias("hamming"))
    scored = near.select("doc_id", "_text", "item_id", best.alias("best")).where(F.col("best.similarity") >= least)
    best = scored.groupBy("doc_id", "_text", "item_id").agg(F.max("best").alias("best"))
    return best.select(
        "doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.start")).alias("start_word"), F.col("best.n").alias("n_words"),
        F.col("best.hamming").alias("hamming"), "_text",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("_text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs that hold no benchmark item, with their columns as they were.

    Null and empty texts hold none and stay. Of repeated rows all stay or all go; rows
    of one id are judged each by its text. Null ids are rows like any other. An empty
    table of documents gives an empty one; without items all rows stay.
    """
    bad = stash(contaminated(docs, read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_key"), F.xxhash64("text").alias("_same"))
    bad = F.broadcast(bad) if bad.count() <= 100_000 else bad
    kept = rows.join(bad, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_same") == F.col("_hash")), "left_anti")
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
