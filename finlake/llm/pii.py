"""Personal data: fixed patterns first, then bootstrapped contextual extraction.
DataFrame functions only.

The fixed patterns give seed entities. A seed's context gives lexical patterns of its
kind: the word before it, the two words before it, the word after it, and the words on
both sides. Every other mention that looks like an identifier (digits in groups, a
token with a digit, a token around an at-sign) has such patterns too. Patterns and
instances form a bipartite graph, which is scored in rounds: a pattern is as good as
the share of its mentions that are known entities of one kind, by the lower end of
that share's interval, so that few mentions prove little; an instance is as good as
the best pattern it is seen in. Mentions under patterns of high confidence are new
entities of that kind, and their values seed the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stash

KINDS = ("email", "ip", "card", "phone")
# fixed patterns; possessive forms and look-behinds keep them linear in the text
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Characters of a mention, the characters that a token has and the digits that groups have at least.
_IN, LEAST = r"[^\s\x22'=:,;()<>|\[\]{}]", 6
_GROUPS = rf"(?<![\w.+@-])\+?\(?[0-9]{{1,6}}\)?(?:[\x20./-]{{1,2}}\(?[0-9]{{2,6}}\)?)++(?!{_IN})"
_AROUND_AT = rf"(?<!{_IN}){_IN.replace('[^', '[^@')}++@{_IN}++"
_TOKEN = rf"(?<!{_IN})(?={_IN.replace('[^', '[^0-9')}*+[0-9]){_IN}{{{LEAST},}}+"
MENTION = f"{_GROUPS}|{_AROUND_AT}|{_TOKEN}"
#: A pattern's least share of known entities, the width of its interval, and of how many different ones; rounds of scoring.
CONFIDENCE, WIDTH, SUPPORT, ROUNDS = 0.7, 2.0, 5, 3
#: New spans, in all rows together, up to which they are broadcast to the texts.
BROADCAST_SPANS = 300_000


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Whether a run of 16 to 19 digits, with separators, has a valid check digit."""
    d = F.reverse(_digits(x))
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.call_function("substr", d, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    total = F.aggregate(each, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v))
    return F.when(F.length(d).between(16, 19), total % 10 == 0).otherwise(F.lit(False))


def _octets(x: Column) -> Column:
    parts = F.split(x, r"\.")
    return F.forall(parts, lambda p: F.when(F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.coalesce(F.nullif(F.regexp_replace(p, "^0+", ""), F.lit("")).cast("int"), F.lit(0)) <= 255).otherwise(F.lit(False)))


_VALID = {"email": lambda x: F.lit(True), "ip": _octets, "card": _luhn, "phone": lambda x: F.length(_digits(x)).between(8, 15)}
_SIGN = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
_PATTERN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: Matches that are turned into spans at a time.
CHUNK = 256
_WORDS = ("before", "second", "after")
_SPANS = f"array<struct<start:bigint,end:bigint,value:string,{','.join(f'{w}:string' for w in _WORDS)}>>"
#: What stands between a word and what it is the context of.
_BETWEEN = r"[\s=:\x22'()<>|,;]"
_WORD = _BETWEEN.replace("[", "[^", 1)


def _pairs(text: Column, pattern: str, sign: str) -> Column:
    """Matches of a pattern with the text before and after each, and last the rest; none without the sign."""
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), gaps.alias("gap"), F.slice(gaps, 2, F.size(gaps)).alias("next"))
    return F.when(text.rlike(sign), pairs)


def _context(x: Column) -> list[Column]:
    """The last word, the last but one, and the next word around a match, in lower case; none has a digit."""
    two = rf"(?:({_WORD}*){_BETWEEN}+)?({_WORD}+){_BETWEEN}*$"
    left, right = F.substring(x["gap"], -80, 80), F.substring(x["next"], 1, 40)
    found = F.regexp_extract(left, two, 2), F.regexp_extract(left, two, 1), F.regexp_extract(right, rf"^{_BETWEEN}*({_WORD}+)", 1)
    return [F.when(~w.rlike("[0-9]"), F.lower(w)).otherwise("").alias(n) for n, w in zip(_WORDS, found)]


def _spans(pairs: Column, valid) -> Column:
    """Pairs as code points with the words around, those that pass ``valid``. The folds
    run over pieces of CHUNK pairs, as a fold that appends copies what it has."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        own = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value"), *_context(x)))
        return F.struct(F.coalesce(end, start).cast("bigint").alias("at"), F.when(x["m"].isNotNull(), F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    def state(at: Column) -> Column:
        return F.struct(at.cast("bigint").alias("at"), F.array().cast(_SPANS).alias("out"))

    def piece(acc: Column, k: Column) -> Column:
        inner = F.aggregate(F.slice(pairs, k * CHUNK + 1, F.lit(CHUNK)), state(acc["at"]), step)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.filter(inner["out"], lambda s: valid(s["value"]))).alias("out"))

    pieces = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int"))
    return F.when(F.size(pairs) > 0, F.aggregate(pieces, state(F.lit(0)), piece)["out"]).otherwise(F.array().cast(_SPANS))


def _line(kinds: tuple[str, ...], column) -> Column:
    return F.array_join(F.concat(*[F.transform(column(k), lambda s: F.concat(F.lit(f"{k}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))) for k in kinds]), ",")


def _mention(x: Column) -> Column:
    """Whether a match has enough digits, or an at-sign."""
    return (F.length(_digits(x)) >= LEAST) | x.contains("@") | ~x.rlike(r"^[\x20()+./0-9-]+$")


def seeds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """A row a row of docs: the spans of each kind, and the other mentions; _row holds docs' columns with keep."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if keep else []
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *row)
    cut = own.select("*", *[_pairs(text, _PATTERN[k], _SIGN[k]).alias(f"_p_{k}") for k in KINDS], _pairs(text, MENTION, "[0-9@]").alias("_p_mentions"))
    out = cut.select("*", *[_spans(F.col(f"_p_{k}"), _VALID[k]).alias(k) for k in KINDS], _spans(F.col("_p_mentions"), _mention).alias("mentions"))
    return out.drop("_text", *[f"_p_{k}" for k in (*KINDS, "mentions")]).withColumn("_id", F.monotonically_increasing_id())


def _patterns() -> Column:
    """The lexical patterns of a mention."""
    has = lambda *names: F.concat(*[F.col(n) for n in names]) != ""
    before = F.when(has("before"), F.concat(F.lit("<"), "before"))
    second = F.when(has("before") & has("second"), F.concat(F.lit("<<"), "second", F.lit(" "), "before"))
    after = F.when(has("after"), F.concat(F.lit(">"), "after"))
    both = F.when(has("before") & has("after"), F.concat(F.lit("<>"), "before", F.lit(" "), "after"))
    return F.array_compact(F.array(before, second, after, both))


def _lower_end(n: Column, of: Column, z: float = WIDTH) -> Column:
    """The lower end of the interval of a share of n among of, z standard deviations wide to each side."""
    share = n / of
    return (share + z * z / (2 * of) - z * F.sqrt(share * (1 - share) / of + z * z / (4 * of * of))) / (1 + z * z / of)


def discover(rows: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """rows: seeds(), written. Gives (_id, start, end, kind) of the new entities: each
    under the kind of the best pattern that it is seen in."""
    spread = None
    for k in (*KINDS, None):
        part = rows.select("_id", F.lit(k).cast("string").alias("kind"), F.explode(k or "mentions").alias("s")).select("_id", "kind", "s.*")
        spread = part if spread is None else spread.unionAll(part)
    # mentions that overlap an entity are that entity: told by the ends before and the starts behind
    order = Window.partitionBy("_id").orderBy("start", "end")
    base = F.col("kind").isNotNull()
    before = F.max(F.when(base, F.col("end"))).over(order)
    behind = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("_id").orderBy(F.desc("start"), F.desc("end")))
    spread = spread.withColumns({"_before": before, "_behind": behind})
    free = (F.coalesce("_before", F.lit(0)) <= F.col("start")) & (F.coalesce("_behind", F.col("end")) >= F.col("end"))
    spread = spread.where(base | free).select("_id", "kind", "start", "end", F.lower("value").alias("value"), _patterns().alias("patterns"))
    spread = stash(spread.where(F.size("patterns") > 0))
    # how often a pattern has each instance (value); hot patterns are summed where they are read
    graph = stash(spread.select(F.explode("patterns").alias("pattern"), "value", "kind").groupBy("pattern", "value", "kind").agg(F.count("*").alias("n")))
    known = stash(graph.where("kind is not null").groupBy("value").agg(F.max("kind").alias("known")))
    good = None
    for _ in range(rounds):
        scored = graph.join(known, "value", "left").groupBy("pattern", "known").agg(F.sum("n").alias("n"), F.count_distinct("value").alias("different"))
        total = graph.groupBy("pattern").agg(F.sum("n").alias("of"))
        best = scored.where("known is not null").join(total, "pattern").withColumn("score", _lower_end(F.col("n"), F.col("of")))
        best = best.where((F.col("score") >= confidence) & (F.col("different") >= support))
        good = stash(best.groupBy("pattern").agg(F.max_by("known", F.struct("score", "known")).alias("kind"), F.max("score").alias("score")))
        found = graph.where("kind is null").drop("kind").join(good, "pattern").groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("known"))
        more = stash(found.join(known, "value", "left_anti"))
        if more.isEmpty():
            break
        known = stash(known.unionAll(more))
    new = spread.where("kind is null").select("_id", "start", "end", F.explode("patterns").alias("pattern")).join(good, "pattern")
    return new.groupBy("_id", "start", "end").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))


def _with_new(rows: DataFrame) -> DataFrame:
    """rows with each kind's new spans added, in order."""
    span = F.struct("start", "end", *[F.lit("").alias(n) for n in ("value", *_WORDS)])
    each = discover(rows).groupBy("_id", "kind").agg(F.collect_list(span).alias("s"), F.count("*").alias("n"))
    new = stash(each.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "s"))).alias("_new"), F.sum("n").alias("n")))
    n = new.agg(F.sum("n")).first()[0]
    new = new.drop("n")
    rows = rows.join(F.broadcast(new) if n <= BROADCAST_SPANS else new, "_id", "left") if n else rows.withColumn("_new", F.lit(None).cast(f"map<string,{_SPANS}>"))
    return rows.withColumns({f"all_{k}": F.array_sort(F.concat(F.col(k), F.coalesce(F.col("_new")[k], F.array().cast(_SPANS)))) for k in KINDS})


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row.

    The counts and base_sha256 are those of the fixed patterns; spans adds what the
    patterns in context discover, under the kind whose seeds they follow. A null
    text has no spans: zero counts, the hash of the empty string, an empty list.
    Repeated rows are searched each. An empty table gives an empty result.
    """
    rows = _with_new(stash(seeds(docs, id_col, text_col)))
    base = F.sha2(_line(KINDS, F.col), 256)
    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base_sha256"), _line(KINDS, lambda k: F.col(f"all_{k}")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span replaced by [KIND]; overlapping spans become one, named after the first.
    Other columns, null texts and texts without spans stay as they were."""
    rows = _with_new(stash(seeds(docs, id_col, text_col, keep=True)))
    marked = F.array_sort(F.concat(*[F.transform(f"all_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("mark"))) for k in KINDS]))
    text = F.col(f"_row.`{text_col}`")

    # the folds carry what is left of the text, in pieces of CHUNK spans, as each cut copies its rest
    def state(at: Column, rest: Column) -> Column:
        return F.struct(at.cast("bigint").alias("at"), rest.alias("rest"), F.array().cast("array<string>").alias("out"))

    def head(x: Column, n: Column) -> Column:
        return F.call_function("substr", x, F.lit(1), F.greatest(F.lit(0), n).cast("int"))

    def tail(x: Column, n: Column) -> Column:
        return F.call_function("substr", x, (F.greatest(F.lit(0), n) + 1).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= acc["at"], F.array(head(acc["rest"], s["start"] - acc["at"]), s["mark"])).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), tail(acc["rest"], s["end"] - acc["at"]).alias("rest"), F.concat(acc["out"], piece).alias("out"))

    def some(acc: Column, k: Column) -> Column:
        own = F.slice("_marked", k * CHUNK + 1, F.lit(CHUNK))
        last = F.greatest(acc["at"], F.array_max(F.transform(own, lambda s: s["end"])))
        inner = F.aggregate(own, state(acc["at"], head(acc["rest"], last - acc["at"])), step)
        return F.struct(last.alias("at"), tail(acc["rest"], last - acc["at"]).alias("rest"), F.concat(acc["out"], F.array(F.array_join(inner["out"], ""))).alias("out"))

    pieces = F.sequence(F.lit(0), F.floor((F.size("_marked") - 1) / CHUNK).cast("int"))
    done = rows.withColumn("_marked", marked).withColumn("_cut", F.when(F.size("_marked") > 0, F.aggregate(pieces, state(F.lit(0), text), some)))
    whole = F.concat(F.array_join("_cut.out", ""), F.col("_cut.rest"))
    new = F.when(F.size("_marked") > 0, whole).otherwise(text)
    done = done.withColumn("_clean", new)
    return done.select(*[(F.col("_clean") if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data redacted and n_chars, where docs has it, counted anew.

    A null text stays null, and its n_chars becomes null; texts without personal data,
    null ids and repeated rows stay as they were; other columns stay, whatever their
    names. An empty table gives an empty one.
    """
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
