"""Token counts by prefix dynamic programming.

A text is cut into units at ASCII white space. No token of the vocabulary spans
white space, so the count of every prefix that ends at a unit is a running sum, and
the count of the text is the table's last entry. Inside a unit, a second table has
the count of every prefix by code points, so that "how many tokens has this prefix"
and "how much text fits this budget" are looked up, not encoded again.

The second table is a recurrence. The tokens of a word's prefix are those of a
shorter prefix and one more: the one vocabulary entry that ends there and that byte
pair merges leave apart from the token before it. So one step a byte finds the last
token of every open prefix, and one more with the word-end mark closes it.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, small_batches

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Distinct units whose counts a worker remembers; the memo starts anew beyond it.
MEMO = 500_000
_UNIT = re.compile(r"[^ \t-\r]+")
#: Code points of a unit whose prefix table is remembered.
SHORT = 100


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if it is printable
    Latin-1, else the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Merges:
    """Byte-pair merges of a tokenizer file, with counts of every prefix of a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {tuple(m): k for k, m in enumerate(pairs)}
        self.end = model.get("end_of_word_suffix") or ""
        self.vocabulary = set(model["vocab"])
        self.longest = max(len(t.removesuffix(self.end) if self.end else t) for t in self.vocabulary)
        self.letters = _byte_letters()
        self.apart: dict[tuple[str, str], bool] = {}

    def encode(self, symbols: list[str]) -> list[str]:
        """Merge the pair of the lowest rank until there is none."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda k: self.rank.get((symbols[k], symbols[k + 1]), len(self.rank)))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols = [*symbols[:best], symbols[best] + symbols[best + 1], *symbols[best + 2 :]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        body = token.removesuffix(self.end) if self.end and token != self.end else token
        return [*body[:-1], body[-1] + token[len(body) :]]

    def _follows(self, before: str, token: str) -> bool:
        """Whether merges leave the two tokens as they are, side by side."""
        key = (before, token)
        if key not in self.apart:
            if len(self.apart) > MEMO:
                self.apart.clear()
            self.apart[key] = self.encode(self._symbols(before) + self._symbols(token)) == [before, token]
        return self.apart[key]

    def _step(self, word: str, at: int, last: list[str], count: list[int], mark: str) -> tuple[str, int]:
        """The last token, and the count, of the prefix word[:at] with the mark."""
        for size in range(1, min(at, self.longest) + 1):
            token = word[at - size : at] + mark
            if token in self.vocabulary:
                before = last[at - size]
                if self._follows(before, token) if before else self.encode(self._symbols(token)) == [token]:
                    return token, count[at - size] + 1
        raise LookupError(f"no token ends at {at} of {word!r}")

    def prefixes(self, word: str) -> list[int]:
        """Tokens of each prefix of a word in its byte letters, as a whole word."""
        last, count, out = [""], [0], []
        for at in range(1, len(word) + 1):
            out.append(self._step(word, at, last, count, self.end)[1])
            token, n = self._step(word, at, last, count, "") if self.end else ("", 0)
            last.append(token)
            count.append(n)
        return out


def _simple(c: str) -> bool:
    """Whether a letter, digit or sign stays as it is whatever stands beside it."""
    return c.isascii() or (unicodedata.category(c)[0] in "LNPS" and unicodedata.is_normalized("NFC", c) and not "\u1100" <= c <= "\u11ff" and len(c.lower()) == 1)


class PrefixCounter:
    """Exact token counts of prefixes under one tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker's threads would only get in each other's way
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.memo: dict[bytes, int] = {}
        self.merges = Merges(path)
        self.inner: dict[str, list[int]] = {}

    def _units(self, units: set[bytes]) -> dict[bytes, int]:
        """Counts of units that the memo lacks; short ones are remembered."""
        todo, out = list(units), {}
        for at in range(0, len(todo), 10_000):
            part = todo[at : at + 10_000]
            found = self.tokenizer.encode_batch_fast([u.decode() for u in part], add_special_tokens=False)
            out.update(zip(part, map(len, found)))
        if len(self.memo) + len(out) > MEMO:
            self.memo.clear()
        self.memo.update((u, n) for u, n in out.items() if len(u) <= SHORT)
        return out

    def _each(self, units: list[bytes]) -> list[int]:
        try:
            return list(map(self.memo.__getitem__, units))
        except KeyError:
            own = {u: self.memo[u] for u in set(units) if u in self.memo}
            own |= self._units(set(units) - own.keys())
            return list(map(own.__getitem__, units))

    def sums(self, text: str) -> list[int]:
        """Tokens of the prefix up to each unit's end."""
        return list(accumulate(self._each(text.encode().split())))  # bytes are split at ASCII white space alone

    def counts(self, texts: list[str]) -> list[int]:
        """The count of every whole text: the last entry of its table."""
        return [(self.sums(t) or [0])[-1] for t in texts]

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """Ends of the units in code points, and the tokens of the prefix up to each."""
        return [m.end() for m in _UNIT.finditer(text)], self.sums(text)

    def _pieces(self, unit: str) -> list[tuple[int, int, int]]:
        """(start, end, tokens) of the words that the tokenizer sees in a unit, in code points."""
        found = self.tokenizer.encode(unit, add_special_tokens=False)
        out: list[list] = []
        for word, (a, b) in zip(found.word_ids, found.offsets):
            if out and word is not None and out[-1][3] == word:
                out[-1][1], out[-1][2] = max(out[-1][1], b), out[-1][2] + 1
            else:
                out.append([a, b, 1, word])
        return [tuple(x[:3]) for x in out]

    def inside(self, unit: str) -> list[int]:
        """Tokens of every prefix of a unit, from one code point on.

        Words of letters that no neighbour changes go by the recurrence. What a prefix
        may cut in two (contractions, special strings) or change (marks that combine)
        is encoded prefix by prefix.
        """
        known = self.inner.get(unit)
        if known is not None:
            return known
        out: list[int] = []
        if all(map(_simple, unit)):
            done = 0
            for a, b, n in self._pieces(unit):
                out += [done] * (a - len(out))
                word = unit[a:b].lower()
                if word.isalpha() or (n and not any(map(str.isalnum, word))):
                    letters, ends = "".join(self.merges.letters[x] for x in word.encode()), list(accumulate(len(c.encode()) for c in word))
                    each = self.merges.prefixes(letters)
                    out += [done + each[e - 1] for e in ends]
                else:
                    out += [done + self._plain(unit[a:k]) for k in range(a + 1, b + 1)]
                done += n
            out += [done] * (len(unit) - len(out))
        else:
            out = [self._plain(unit[:k]) for k in range(1, len(unit) + 1)]
        if len(self.inner) > MEMO // 10:
            self.inner.clear()
        if len(unit) <= SHORT:
            self.inner[unit] = out
        return out

    def _plain(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def prefix(self, text: str, n_chars: int, table=None) -> int:
        """Tokens of text[:n_chars], from the two tables."""
        ends, sums = table or self.table(text)
        k = bisect_right(ends, n_chars)
        base = sums[k - 1] if k else 0
        rest = _UNIT.search(text, ends[k - 1] if k else 0)
        if not rest or rest.start() >= n_chars:
            return base
        return base + self.inside(rest[0])[n_chars - rest.start() - 1]

    def fit(self, text: str, budget: int, table=None) -> int:
        """Code points of the longest prefix that has at most budget tokens."""
        ends, sums = table or self.table(text)
        k = bisect_right(sums, budget)
        if k == len(ends):
            return len(text)
        base, unit = (sums[k - 1] if k else 0), _UNIT.search(text, ends[k - 1] if k else 0)
        each = self.inside(unit[0])
        return unit.start() + max((i + 1 for i, n in enumerate(each) if base + n <= budget), default=0)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """This process's counter of a file: its memo serves all tasks that the worker runs."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = LIMIT, prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; with prefixes also prefix_end and
    prefix_tokens, the table of every unit boundary.

    A null text counts as empty: 0 bytes, 0 tokens. Null ids, repeated rows and
    further columns pass untouched or unread; an empty table gives an empty one.
    Texts of any length are counted whole. No shuffle: one pass over the input.
    """
    small_batches(docs.sparkSession)
    path = public_tokenizers.path(tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean" + (", prefix_end array<int>, prefix_tokens array<int>" if prefixes else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            tables = [own.table(t) for t in texts] if prefixes else []
            n = [(t[1] or [0])[-1] for t in tables] if prefixes else own.counts(texts)
            cols = [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            if prefixes:
                cols += [pa.array([t[k] for t in tables], pa.list_(pa.int32())) for k in (0, 1)]
                names += ["prefix_end", "prefix_tokens"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
