"""Validation: the first rule a row breaks, and the typed rows that break none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlake import domain
from finlake.functions.exprs import parse
from finlake.sources.specs import CORRUPT, INGESTED, SOURCE_FILE, DatasetSpec

REASON, RAW = "_reason", "_raw"


def rejection_reason(spec: DatasetSpec, corrupt: Column | None = None, corrupt_reason: str = "ligne illisible") -> Column:
    """The message of the first broken rule, or null. Order: unreadable, missing,
    not convertible, country, vocabulary, currency of the country, entity of the
    country, negative. A null passes all but the first two."""
    c = F.col
    rules: list[tuple[Column, str]] = [((c(CORRUPT) if corrupt is None else corrupt).isNotNull(), corrupt_reason)]
    rules += [(c(n).isNull(), f"{n} manquant") for n in spec.required]
    rules += [(c(n).isNotNull() & parse(c(n), t).isNull(), f"{n} non convertible en {t.upper()}") for n, t in spec.types.items() if t != "string"]
    rules.append((~c("country_code").isin(*domain.COUNTRIES), "country_code hors périmètre"))
    rules += [(~c(n).isin(*domain.CODES[v]), f"{n} hors nomenclature") for n, v in spec.codes.items()]
    if "currency" in spec.columns:
        rules.append((c("currency") != domain.lookup(domain.CURRENCY, c("country_code")), "devise incohérente avec le pays"))
    home = F.coalesce(*[F.when(c("entity_type") == e, F.array(*map(F.lit, where))) for e, where in domain.PRESENCE.items()])
    rules.append((~F.array_contains(home, c("country_code")), "entité absente de ce pays"))
    rules += [(parse(c(n), "double") < 0, f"{n} négatif") for n in spec.positive]
    return F.coalesce(*[F.when(broken, F.lit(text)) for broken, text in rules])


def typed(rows: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Columns of the table, converted; lineage kept."""
    return rows.select(*[parse(F.col(c), t).alias(c) for c, t in spec.types.items()], INGESTED, SOURCE_FILE)


def rejects(rows: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Rows with a reason, as rows of the rejects table."""
    raw = F.concat_ws(" | ", *[F.coalesce(F.col(c), F.lit("")) for c in spec.columns])
    return rows.where(F.col(REASON).isNotNull()).select(
        F.lit(spec.name).alias("dataset"), SOURCE_FILE, INGESTED, F.col(REASON).alias("reject_reason"), raw.alias("raw_record"),
    )
