"""Column functions: lenient casts, conversion, pseudonyms, masks, identifiers.

All of them are built-in expressions, so that no row leaves the JVM.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from finlake import domain

KEY_VARIABLE = "FINLAKE_PII_KEY"
TOKEN_CHARS = 32


def parse(text: Column, kind: str) -> Column:
    """Text as ``kind``, null where it does not convert. Whole numbers may carry a
    decimal part of any digits, which is cut; dates may carry a time."""
    if kind in ("int", "bigint"):
        return F.when(text.rlike(r"^\s*[+-]?\d+(\.\d*)?\s*$"), text.try_cast("decimal(38,10)").try_cast(kind))
    if kind == "date":
        return text.try_cast("timestamp").try_cast("date")
    return text.try_cast(kind)


def blank_to_null(text: Column) -> Column:
    """Null for text of spaces only; other text as it is, untrimmed."""
    return F.when(F.length(F.trim(text)) > 0, text)


def to_eur(amount: Column, currency: Column) -> Column:
    """Euro of an amount, two decimals; null for a currency without a rate."""
    return F.round(F.try_divide(amount, domain.lookup(domain.RATES, currency)), 2)


def ratio(a: Column, b: Column, digits: int) -> Column:
    """a / b, rounded; null where b is 0 or null."""
    return F.round(F.try_divide(a, b), digits)


def pii_key() -> str:
    return os.environ.get(KEY_VARIABLE) or "finlake-development-key"


def token(column: Column, key: str | None = None) -> Column:
    """A stable pseudonym: equal values have equal tokens, null stays null."""
    return F.substring(F.sha2(F.concat(F.lit(key or pii_key()), column), 256), 1, TOKEN_CHARS)


def token_of(value: str | None, key: str | None = None) -> str | None:
    """The same pseudonym outside Spark."""
    return None if value is None else hashlib.sha256(((key or pii_key()) + value).encode()).hexdigest()[:TOKEN_CHARS]


def mask_tail(column: Column, keep: int, prefix: int = 0) -> Column:
    """Stars over all but the first ``prefix`` and last ``keep`` characters; text no
    longer than these is all stars; null stays null."""
    n = F.length(column)
    stars = F.repeat(F.lit("*"), F.greatest(n - keep - prefix, F.lit(0)))
    return F.when(n <= keep + prefix, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(column, F.lit(prefix)), stars, F.right(column, F.lit(keep))))


def mask_text(value: str | None, keep: int, prefix: int = 0) -> str | None:
    """The same mask outside Spark."""
    if value is None:
        return None
    hidden = len(value) - keep - prefix
    return "*" * len(value) if hidden <= 0 else value[:prefix] + "*" * hidden + value[-keep:]


def alert_id(*parts: Column) -> Column:
    """Identifier of an alert, from what makes it unique."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def money(column: Column) -> Column:
    """Exact two-decimal sum input: doubles as decimals, so that sums do not depend on order."""
    return column.cast("decimal(18,2)")
