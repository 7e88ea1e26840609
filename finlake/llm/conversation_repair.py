"""Repair of conversations by cost layers of reachable grammar states.

A conversation is legal if its roles' initials read ``(s?(ua)+)?``. Rows are kept,
given another role or deleted, and empty turns are inserted, each at a cost. For
every cost from 0 on, a layer has a bitset over the turns for each state of the
grammar: bit j says that from this state, with j rows left, a legal end is reached at
that cost. A layer follows from earlier ones by shifts and masks of whole bitsets;
runs of rows that are kept at no cost are filled in by the carry of one addition.
The first layer that accepts gives the cost. Walking the layers from the front, by
the least letter that stays within the cost, gives the least audit.

Rows are sorted within their conversation by a shuffle and pass through a task as a
stream. What a task holds of a conversation is a byte a row, as long as the audit that
it returns, and up to HOLD bytes of its texts; longer ones are hashed by a second
stream that reads the audit first. Layers are made for blocks of BLOCK rows, from the
last to the first, so that their memory has a bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, read, small_batches, stash

REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: Rows of a block of layers, and bytes of a conversation's rows that a task holds.
BLOCK, HOLD = 1024, 8 << 20
#: Chance of a fault, in rows, of the damage that the query does.
SIDES = 20
# a row's code: the class of its role, and what is wrong with it
_CLASS = {"s": 1, "u": 2, "a": 3}
_GONE, _CUT = 4, 8
#: States: nothing yet, after system, after user, after assistant; the state after an added turn, and its role.
_NEXT = (2, 2, 3, 2)
_ROLE = ("", "system", "user", "assistant")
#: What it costs to end legally from each state.
_END = (0, 2 * INSERT, INSERT, 0)


def _bits(codes: bytes, want) -> int:
    """Bit j is set if the first of the last j rows is wanted."""
    n = len(codes)
    out = bytearray(n // 8 + 1)
    for i, x in enumerate(codes):
        if want(x):
            j = n - i
            out[j >> 3] |= 1 << (j & 7)
    return int.from_bytes(out, "little")


def layers(codes: bytes, end: tuple[int, ...] = _END) -> tuple[list[tuple[int, ...]], tuple[int, ...]]:
    """Layers of a block by cost, and the cost from each state over the whole block.
    end: the cost from each state behind the block, the least being 0."""
    n = len(codes)
    top, whole = 1 << n, (2 << n) - 2
    system, user, reply = (_bits(codes, lambda x, k=k: x == k) for k in (1, 2, 3))
    user_cut, reply_cut, system_cut = (_bits(codes, lambda x, k=k: x == k | _CUT) for k in (2, 3, 1))
    live, cut = _bits(codes, lambda x: x < _GONE), _bits(codes, lambda x: x >= _CUT and not x & _GONE)
    chain = (user & (reply << 1)) | (reply & (user << 1))
    none, out, cost = (0, 0, 0, 0), [], [-1] * 4
    while min(cost) < 0:
        c = len(out)
        ago = lambda k: out[c - k] if c >= k else none  # noqa: E731, B023
        one, two, five, six = ago(REROLE), ago(DELETE), ago(INSERT), ago(CUT + REROLE)
        now = []
        for s in range(4):
            to = _NEXT[s]
            x = (ago(1)[s] | ((two[s] << 1) & whole) | ((one[to] << 1) & live) | ((six[to] << 1) & cut) | five[to]) | (1 if end[s] <= c else 0)
            now.append(x)
        now[3] |= (five[2] << 1) & user_cut
        now[2] |= (five[3] << 1) & reply_cut
        now[1] |= (five[2] << 1) & user_cut
        now[0] |= ((five[2] << 1) & user_cut) | ((five[1] << 1) & system_cut)
        # rows that are kept at no cost: seeds, and runs of them by the carry of a sum
        seed = ((now[2] << 1) & user) | ((now[3] << 1) & reply)
        step = (seed << 1) & chain
        seed |= (chain & ~(chain + step)) | step
        now[3] |= seed & user
        now[2] |= seed & reply
        now[1] |= (now[2] << 1) & user
        now[0] |= ((now[2] << 1) & user) | ((now[1] << 1) & system)
        out.append(tuple(now))
        for s in range(4):
            if cost[s] < 0 and now[s] & top:
                cost[s] = c
    return out, tuple(cost)


def _moves(code: int, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, rows read, state after) of what may be done before or with a row, by letter."""
    out = [("D", DELETE, 1, state), ("I", INSERT, 0, _NEXT[state])]
    if not code & _GONE:
        kind, more = code & 3, CUT if code & _CUT else 0
        if kind == _NEXT[state] or (kind == 1 and state == 0):
            out.append(("K", more, 1, kind))
        out.append(("R", REROLE + more, 1, _NEXT[state]))
    return out


def _trace(codes: bytes, found: list[tuple[int, ...]], c: int, state: int) -> tuple[str, int]:
    """The least letters at cost c over a block, and the state behind it."""
    out, left = [], len(codes)
    while left:
        for letter, cost, used, after in _moves(codes[len(codes) - left], state):
            if c >= cost and found[c - cost][after] >> (left - used) & 1:
                out.append(letter)
                c, left, state = c - cost, left - used, after
                break
        else:
            raise AssertionError("layers without a way on")
    return "".join(out), state


def solve(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """The least cost of a conversation's repair, and the least audit of that cost."""
    starts = range(0, len(codes), block)
    ends, total, end = {}, 0, _END
    for at in reversed(starts):
        ends[at] = end
        last = layers(codes[at : at + block], end)
        total += min(last[1])
        end = tuple(x - min(last[1]) for x in last[1])
    total += end[0]
    state, out = 0, []
    for at in starts:
        part = codes[at : at + block]
        found, cost = last if at == 0 else layers(part, ends[at])
        letters, state = _trace(part, found, cost[state], state)
        out.append(letters)
    return total, "".join(out) + "I" * (_END[state] // INSERT)


_short = lru_cache(1 << 16)(solve)


def audit_of(codes: bytes) -> tuple[int, str]:
    return _short(codes) if len(codes) <= 16 else solve(codes)


def repaired(audit: Iterator[str], rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns that an audit makes of the rows."""
    state = 0
    for letter in audit:
        if letter == "I":
            state = _NEXT[state]
            yield _ROLE[state], ""
            continue
        role, text = next(rows)
        if letter == "K":
            state = _CLASS[role[0]]
            yield role, text
        elif letter == "R":
            state = _NEXT[state]
            yield _ROLE[state], text


class _Digest:
    """SHA-256 of turns, joined by newlines."""

    def __init__(self):
        self.sum, self.any = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.sum.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True


class _Open:
    """What a task holds of the conversation that passes through it."""

    def __init__(self, key):
        self.key, self.codes, self.rows, self.held = key, bytearray(), [], 0
        self.turns, self.first, self.last, self.before = 0, None, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, mark: str | None, again: bool) -> None:
        row = (turn, role, text)
        kind = _CLASS.get(role[:1], 0)
        again = again or row == self.before
        code = kind
        if mark is None:
            self.blank, code = self.blank + 1, kind | _GONE
        elif again:
            self.duplicate, code = self.duplicate + 1, kind | _GONE
        elif mark not in ".!?":
            self.truncated, code = self.truncated + 1, kind | _CUT
        if self.codes and (self.codes[-1] & 3, kind) not in ((1, 2), (2, 3), (3, 2)):
            self.illegal += 1
        self.codes.append(code)
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.first = turn if self.first is None else self.first
        self.before = row
        if self.held <= HOLD:
            self.held += len(role) + len(text) + 100
            self.rows.append((role, text))
        else:
            self.rows.clear()

    def close(self) -> dict:
        cost, audit = audit_of(bytes(self.codes))
        digest = _Digest()
        if self.held <= HOLD:
            for role, text in repaired(iter(audit), iter(self.rows)):
                digest.add(role, text)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return {
            "conv_id": self.key, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
            "cost": cost, "audit": audit, "repaired_sha256": digest.sum.hexdigest() if self.held <= HOLD else None,
        }


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to a row a conversation."""
    schema, now = None, None
    for b in batches:
        out = []
        for key, turn, role, text, mark, again, there in zip(*[c.to_pylist() for c in b.columns]):
            if now is None or now.key != key:
                if now is not None:
                    out.append(now.close())
                now = _Open(key)
            if there:
                now.add(turn, role, text, mark, again)
        schema = schema or _schema(b.column(0).type)
        yield pa.RecordBatch.from_pylist(out, schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.close()], schema)


def _schema(key: pa.DataType) -> pa.Schema:
    counts = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return pa.schema([("conv_id", key), *counts, ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of long conversations, each after a row with its audit as the text: their digests."""

    def rows():
        nonlocal kind
        for b in batches:
            kind = b.column(0).type
            yield from zip(*[c.to_pylist() for c in b.columns])

    def turns(key):
        nonlocal row
        while row is not None and row[0] == key:
            role, text = row[1], row[2]
            row = next(source, None)
            yield role, text

    kind = None
    source = rows()
    row = next(source, None)
    while row is not None:
        key, audit, digest = row[0], row[2], _Digest()
        row = next(source, None)
        for role, text in repaired(iter(audit), turns(key)):
            digest.add(role, text)
        for _ in turns(key):
            pass
        yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([digest.sum.hexdigest()])], ["_key", "_digest"])


def rows_of(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text; null roles and texts become one space."""
    c = F.col
    return table.select(
        c(conv_col).alias("conv_id"), c(turn_col).cast("long").alias("turn"), F.coalesce(c(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(c(text_col).cast("string"), F.lit(" ")).alias("text"),
    )


def _named(x: str) -> Column:
    return F.coalesce(F.col(x).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """rows_of() with the query's faults, chosen by the checksum of conv_id:turn. Rows
    that are dropped stay as rows with there = false, so that no conversation is lost."""
    at = F.crc32(F.concat(_named("conv_id"), F.lit(":"), _named("turn")).cast("binary")) % SIDES
    rows = rows.withColumn("_at", at)
    c = F.col
    return rows.select(
        "conv_id", "turn", F.when(c("_at") == 4, F.lit("user")).otherwise(c("role")).alias("role"),
        F.when(c("_at") == 1, F.lit("")).when(c("_at") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(c("text")).alias("text"),
        (c("_at") != 0).alias("there"), F.explode(F.when(c("_at") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def repair(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text as rows_of() gives them; there, if given and false,
    marks a row that only names its conversation. A row a conversation: gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows of the same turn go by role, then text, by bytes. A row counts as seen
    earlier if an earlier turn, or a row before it in this order, has its role and
    text. A null conversation id is a conversation of its own; null turns come first;
    an empty table gives none; further columns are not read. No text is cut.
    """
    spark, c = rows.sparkSession, F.col
    small_batches(spark)
    if "there" not in rows.columns:
        rows = rows.withColumn("there", F.lit(True))
    order = F.struct(c("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    sha = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    rows = rows.withColumn("_sha", sha).withColumn("_order", order)
    # only role and text that a conversation has twice; a partial sum a task, whatever repeats
    repeats = rows.where("there").groupBy(c("conv_id").alias("_c"), c("_sha").alias("_s")).agg(F.min("_order").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    same = c("conv_id").eqNullSafe(c("_c")) & (c("_sha") == c("_s"))
    mark = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    marked = rows.join(repeats, same, "left").select(
        "conv_id", "turn", "role", "text", F.when(mark != "", mark).alias("mark"), F.coalesce(c("_order") > c("_first"), F.lit(False)).alias("again"), "there",
    )
    place = ["conv_id", c("turn").asc_nulls_first(), "role", "text"]
    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = marked.repartition(partitions(spark), "conv_id").sortWithinPartitions(*place)
    columns = ", ".join(f"{n} bigint" for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    found = stash(dealt.mapInArrow(_scan, f"conv_id {kind}, {columns}, audit string, repaired_sha256 string"))
    long = found.where("repaired_sha256 is null")
    if long.isEmpty():
        return found
    texts = rows.where("there").join(long.select(c("conv_id").alias("_c")), c("conv_id").eqNullSafe(c("_c")), "left_semi")
    heads = long.select("conv_id", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), c("audit").alias("text"))
    both = heads.unionByName(texts.select("conv_id", F.lit(1).alias("_kind"), "turn", "role", "text"))
    stream = both.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "_kind", *place[1:]).select("conv_id", "role", "text")
    digests = stream.mapInArrow(_hash, f"_key {kind}, _digest string")
    done = found.join(digests, c("conv_id").eqNullSafe(c("_key")), "left")
    return done.withColumn("repaired_sha256", F.coalesce("repaired_sha256", "_digest")).drop("_key", "_digest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(rows_of(read(spark, sf_dir, "conversations"))))
