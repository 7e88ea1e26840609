"""Document fingerprints by bottom-k sketches, with DataFrame functions only.

A text's sketch holds the k least distinct hashes of its shingles of five words, in
order. The sketch of a union is the k least of both sketches, so sketches of parts
merge into that of the whole in any order. Of two sketches, the k least of their union
are a sample of the shingles of both: the share of it that both sketches hold estimates
the resemblance. The k-th hash tells how many distinct shingles there are; both
together estimate containment. A sketch of fewer than k hashes is the whole set, and
its answers are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, read

WORDS, K = 5, 128
#: Rows that are sampled to place the ranges of the edited texts' order.
SAMPLE_ROWS = 20_000
_SPAN = 2.0**64


def words_of(text: Column) -> Column:
    """Runs of characters that are no ASCII white space, in lower case (A-Z)."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(plain != "", F.split(F.translate(plain, letters, letters.lower()), " ")).otherwise(F.array().cast("array<string>"))


def sketch(text: Column, words: int = WORDS, k: int = K) -> Column:
    """The k least distinct hashes of the text's shingles; a text of fewer words is
    one shingle, one without words has none, a null text is empty."""
    hashed = F.transform(words_of(text), lambda w: F.xxhash64(w))
    run = lambda w: F.when(
        F.size(w) >= words, F.transform(F.sequence(F.lit(1), F.size(w) - (words - 1)), lambda i: F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(words)]))
    ).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    # a variable of a lambda, so that the words are hashed once
    hashes = F.get(F.transform(F.array(hashed), run), F.lit(0))
    return least(hashes, k)


def least(hashes: Column, k: int = K) -> Column:
    """The k least distinct values, in order."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return least(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: of the k least of the union, the share that both
    hold. Two empty sketches are alike, an empty one and another are not."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact for sketches below k."""
    share = (F.element_at(a, -1).cast("double") + _SPAN / 2) / _SPAN
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: the common part of the union, by
    resemblance, over a's count; 1 for an empty a."""
    common = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_count(a, k)))


def fingerprint(a: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def merge_parts(parts: DataFrame, by: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """by, sketch: the sketches of parts merged by group. Hashes are ranked a group; the
    ranking keeps k a group and task before it shuffles, however many parts a group has."""
    hashes = parts.select(*by, F.explode_outer(sketch_col).alias("_h")).distinct()
    first = Window.partitionBy(*by).orderBy(F.col("_h").asc_nulls_last())
    top = hashes.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k)
    return top.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(sketch_col))  # k a group


def _bounds(keys: DataFrame, n: int) -> list:
    """Places that cut the order of _id and _hash into n ranges of like size, from a sample."""
    rows = keys.count()
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    found = sorted({(r[0], r[1]) for r in (keys.sample(share, 42) if share < 1 else keys).collect()})  # about SAMPLE_ROWS at most
    return sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """_id, _text, _sketch, _next, _next_sketch: texts by descending id with the text and
    the sketch behind each, the first behind the last. Equal ids go by a hash of the
    text; null ids come last.

    Rows are dealt by ranges of this order, whose bounds come from a sample, so that
    ids that repeat do not meet in one task; the first row of each range, found by a
    maximum, stands behind the last row of the range before it.
    """
    c, spark = F.col, docs.sparkSession
    order = F.struct("_has", "_id", "_hash")
    rows = docs.select(c(id_col).isNotNull().alias("_has"), F.coalesce(c(id_col).cast("long"), F.lit(0)).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    bounds = _bounds(rows.where("_has").select("_id", "_hash"), partitions(spark))
    cuts = F.array(*[F.struct(F.lit(True).alias("_has"), F.lit(i).cast("long").alias("_id"), F.lit(h).cast("long").alias("_hash")) for i, h in bounds])
    at = F.size(F.filter(cuts, lambda x: x > order)) if bounds else F.lit(0)
    rows = rows.withColumn("_at", at)
    heads = rows.groupBy("_at").agg(F.max_by("_text", order).alias("_head"))  # a row a range
    heads = heads.withColumn("_behind", F.coalesce(F.lag("_at").over(Window.orderBy("_at")), F.max("_at").over(Window.partitionBy(F.lit(0)))))
    heads = heads.select(c("_behind").alias("_at"), "_head", sketch(c("_head"), k=k).alias("_head_sketch"))
    inside = Window.partitionBy("_at").orderBy(c("_has").desc(), c("_id").desc(), c("_hash").desc())
    return (
        rows.withColumn("_sketch", sketch(c("_text"), k=k))
        .withColumns({"_next": F.lead("_text").over(inside), "_next_sketch": F.lead("_sketch").over(inside)})
        .join(heads, "_at", "left")
        .select(
            F.when(c("_has"), c("_id")).alias("_id"), "_text", "_sketch", F.coalesce("_next", "_head").alias("_next"), F.coalesce("_next_sketch", "_head_sketch").alias("_next_sketch"),
        )
    )


def edited(text: Column, following: Column) -> Column:
    """text with its last half, in code points, replaced by as many of the following text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, a row a row of docs.

    A null text counts as empty; an empty text's fingerprint is empty, and like that of
    another text without words. Repeated rows, null ids, an empty table and further
    columns pass as with_next() says; texts of any length are taken whole.
    """
    c = F.col
    rows = with_next(docs, id_col, text_col, k).withColumn("_edited", edited(c("_text"), c("_next")))
    rows = rows.withColumn("_edited_sketch", sketch(c("_edited"), k=k))
    return rows.select(
        c("_id").alias("doc_id"), F.char_length("_text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint(c("_sketch")).alias("fingerprint"), fingerprint(c("_edited_sketch")).alias("edited_fingerprint"),
        resemblance(c("_sketch"), c("_edited_sketch"), k).alias("near_edited"), resemblance(c("_sketch"), c("_next_sketch"), k).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
