"""Raw to silver: deduplicate, enrich from referentials, convert, pseudonymise, flag.

A table is declared by its dimensions and its columns; the same declaration
serves batches and micro-batches.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from finlake import domain
from finlake.functions.exprs import mask_tail, to_eur, token
from finlake.operators import core
from finlake.sources.specs import INGESTED, SOURCE_FILE, SPECS
from finlake.sources.store import TableStore

log = logging.getLogger(__name__)
WINDOW_DAYS = 7
#: Whether new tables of events are partitioned by day beside the country; None: if the raw
#: table is, and fills these folders.
BY_DAY: bool | None = None
#: Bytes of a raw table from which on heavy keys are looked for before its joins.
SPREAD_BYTES = 1 << 30
#: Flags whose rows a run counts as outliers.
OUTLIERS = ("frais_aberrants", "delai_manquant", "origine_inhabituelle", "surpaiement")
c = F.col


def _eur(name: str, currency: str = "currency") -> tuple[str, Column]:
    return f"{name}_eur", to_eur(c(name), c(currency))


@dataclass(frozen=True)
class Dimension:
    """A referential joined by ``key``: column names there -> names here."""

    table: str
    key: str
    at: str
    columns: dict[str, str]

    def join(self, rows: DataFrame, read, heavy: list | None = None) -> DataFrame:
        """rows with the columns of the referential, reduced to a row a key first; read(table)
        gives it. Rows without a key, and those of heavy keys, do not meet in one partition."""
        side = core.deduplicate(read(self.table).select(self.key, *self.columns), self.key, [self.key])
        side = side.select(c(self.key).alias("_join"), *[c(a).alias(b) for a, b in self.columns.items()])
        return core.lookup_join(rows, side, self.at, "_join", heavy)


@dataclass(frozen=True)
class SilverTable:
    dataset: str
    dimensions: tuple[Dimension, ...]
    #: made when a plan is built, as expressions need a session
    columns: Callable[[], tuple[str | tuple[str, Column], ...]]

    @property
    def spec(self):
        return SPECS[self.dataset]

    @property
    def day(self) -> str | None:
        """The column of an event's day, by which the table is partitioned beside the country."""
        names = [x[0] for x in self.columns() if not isinstance(x, str)]
        return next((n for n in ("transaction_date", "operation_date", "repayment_date", "payment_date") if n in names), None)

    @property
    def partitioning(self) -> list[str]:
        return ["country_code", *([self.day] if self.day and BY_DAY is not False else [])]

    def grain(self, store: TableStore) -> list[str]:
        """The partitioning of a new table: days only if there is enough for a file a day.
        A table keeps what it was made with; TableStore.repartition() changes it."""
        raw = store.current("raw", self.spec.table) if BY_DAY is None else None
        full = BY_DAY or bool(raw and "event_day" in raw["partitioned_by"] and store.fills("raw", self.spec.table))
        return self.partitioning if full else ["country_code"]

    def build(self, source: DataFrame, read, as_of: date | None = None, keep: str = "earliest", heavy: dict[str, list] | None = None) -> DataFrame:
        """read(table) gives a raw referential; each is reduced to a row a key first. heavy:
        of the source's columns that join them, the values that many rows hold."""
        order = [self.spec.key] if self.spec.is_referential else [INGESTED, SOURCE_FILE]
        rows = core.deduplicate(source, self.spec.key, order, keep)
        for d in self.dimensions:
            rows = d.join(rows, read, (heavy or {}).get(d.at))
        rows = rows.withColumn("_today", F.lit(as_of).cast("date") if as_of else F.current_date())
        return rows.select(*[c(x) if isinstance(x, str) else x[1].alias(x[0]) for x in self.columns()], F.current_timestamp().alias("processed_at"))


def _customer() -> Column:
    return token(c("customer_id"))


def _wire() -> Column:
    return c("transaction_type").isin(*domain.WIRES)


def _claim() -> Column:
    return c("operation_type").isin(*domain.CLAIMS)


_LINEAGE = (SOURCE_FILE, INGESTED)
TABLES = {
    t.spec.table: t
    for t in (
        SilverTable("customers", (), lambda: (
            "customer_id", (
                "customer_token", _customer(),
            ), "country_code", "entity_type", "segment", "kyc_level", "onboarding_date", "region", "is_active",
            ("anciennete_mois", F.floor(F.months_between(c("_today"), c("onboarding_date"))).cast("int")),
            ("kyc_limite", c("kyc_level") == "BASIC"),
        )),
        SilverTable("accounts", (
            Dimension("customers", "customer_id", "customer_id", {"segment": "customer_segment", "kyc_level": "customer_kyc"}),
        ), lambda: (
            "account_id", "customer_id", ("customer_token", _customer()), "country_code", "entity_type", "account_type",
            ("account_number_masked", mask_tail(c("account_number"), 4)), ("iban_masked", mask_tail(c("iban"), 4, 2)),
            "currency", "balance", _eur("balance"), _eur("credit_limit"), "opened_date", "status", "customer_segment", "customer_kyc", "days_past_due",
            ("est_douteux", c("days_past_due") > domain.NPL_DAYS), ("est_pret", c("account_type") == "LOAN"),
            "annual_premium", _eur("annual_premium"), ("est_ouvert", c("status").isin("ACTIVE", "FROZEN")),
        )),
        SilverTable("bank_txn", (
            Dimension("accounts", "account_id", "account_id", {"customer_id": "customer_id", "account_type": "account_type"}),
            Dimension("accounts", "account_id", "beneficiary_account", {"country_code": "beneficiary_country"}),
            Dimension("customers", "customer_id", "customer_id", {"segment": "customer_segment"}),
            Dimension("branches", "branch_id", "branch_id", {"city": "branch_city", "branch_type": "branch_type"}),
        ), lambda: (
            "transaction_id", "timestamp", (
                "transaction_date", F.to_date("timestamp"),
            ), "account_id", "customer_id", ("customer_token", _customer()), "customer_segment", "account_type",
            "beneficiary_account", "beneficiary_country", "branch_id", "branch_city", "branch_type", "country_code", "entity_type", "transaction_type", "channel", "transaction_status",
            "currency", "amount", _eur("amount"), _eur("fee_amount"),
            ("est_aboutie", c("transaction_status") == "SUCCESS"),
            ("depasse_seuil_aml", _wire() & (c("amount") > domain.lookup(domain.AML_THRESHOLD, c("currency")))),
            ("est_transfrontalier", c("beneficiary_country").isNotNull() & (c("beneficiary_country") != c("country_code"))),
            ("frais_aberrants", (c("amount") > 0) & (F.try_divide(c("fee_amount"), c("amount")) > domain.MAX_FEE_RATIO)),
            ("beneficiaire_hors_groupe", c("beneficiary_country").isNull()), *_LINEAGE,
        )),
        SilverTable("insurance_ops", (
            Dimension("customers", "customer_id", "customer_id", {"segment": "customer_segment", "kyc_level": "customer_kyc"}),
        ), lambda: (
            "operation_id", "timestamp", ("operation_date", F.to_date("timestamp")), (
                "operation_month", F.trunc("timestamp", "month"),
            ), "customer_id", ("customer_token", _customer()),
            "customer_segment", "customer_kyc", "account_id", "country_code", "entity_type", "operation_type", "product_line", "currency", "amount", _eur("amount"), "claim_status", "processing_days",
            ("est_sinistre", _claim()), ("est_prime", c("operation_type").isin(*domain.PREMIUMS)), (
                "est_sinistre_regle", c("operation_type") == "CLAIM_PAYMENT",
            ),
            ("delai_manquant", _claim() & c("processing_days").isNull()), *_LINEAGE,
        )),
        SilverTable("mobile_money", (
            Dimension("customers", "customer_id", "sender_id", {"country_code": "sender_home_country", "segment": "sender_segment"}),
        ), lambda: (
            "payment_id", "timestamp", (
                "payment_date", F.to_date("timestamp"),
            ), ("payment_hour", F.hour("timestamp")), "sender_id", ("sender_token", token(c("sender_id"))), "receiver_id",
            (
                "receiver_token", token(c("receiver_id")),
            ), "sender_segment", "sender_country", "receiver_country", "country_code", "entity_type", "payment_type", "operator", "status", "currency", "amount",
            _eur("amount"), _eur("fee_amount"), ("est_aboutie", c("status") == "SUCCESS"), (
                "est_transfrontalier", c("sender_country") != c("receiver_country"),
            ),
            ("corridor", F.concat_ws("-", "sender_country", "receiver_country")),
            ("origine_inhabituelle", c("sender_home_country").isNotNull() & (c("sender_home_country") != c("sender_country"))), *_LINEAGE,
        )),
        SilverTable("loan_repayments", (
            Dimension("accounts", "account_id", "loan_account_id", {"balance": "encours", "currency": "account_currency"}),
        ), lambda: (
            "repayment_id", "timestamp", (
                "repayment_date", F.to_date("timestamp"),
            ), "loan_account_id", "customer_id", ("customer_token", _customer()), "country_code", "entity_type", "loan_type", "currency",
            "amount_due", "amount_paid", "interest_amount", _eur("amount_due"), _eur("amount_paid"), _eur("interest_amount"), _eur(
                "encours", "account_currency",
            ), "due_date", "payment_date",
            "days_overdue", "repayment_status", ("est_douteux", c("days_overdue") > domain.NPL_DAYS), (
                "echeance_soldee", c("amount_paid") >= c("amount_due"),
            ),
            ("surpaiement", c("amount_paid") > c("amount_due") * domain.OVERPAID), *_LINEAGE,
        )),
    )
}


def run(spark: SparkSession, store: TableStore, tables=None, countries=None, window_days: int = WINDOW_DAYS) -> dict[str, dict]:
    """Build and upsert silver tables; the window is cut at whole days. A table that
    fails is reported and does not stop the others."""
    out = {}
    for name in tables or TABLES:
        table = TABLES[name]
        try:
            source = core.within_countries(store.read("raw", name), countries)
            if not table.spec.is_referential:
                source = core.recent(source, table.spec.event_time, window_days, "day")
            raw, at = store.current("raw", name), [x for x in dict.fromkeys(d.at for d in table.dimensions) if x in source.columns]
            many = core.heavy_keys(source, at, sample=min(1.0, core.SAMPLE_ROWS / max(1, raw["rows"]))) if at and raw["bytes"] >= SPREAD_BYTES else None
            read, made = Observation(), Observation()  # filled by the write, so that nothing is read or kept for a count
            rows = table.build(source.observe(read, F.count("*").alias("n")), lambda t: store.read("raw", t), heavy=many)
            odd = F.coalesce(*[c(f) for f in OUTLIERS if f in rows.columns], F.lit(False))
            rows = rows.observe(made, F.count("*").alias("n"), F.count_if(odd).alias("odd"))
            done = store.merge("silver", name, rows, [table.spec.key, "country_code"], table.grain(store), unique=True)  # build() has left one row a key
            n_in, n_out, outliers = core.figures(read).get("n", 0), core.figures(made).get("n", 0), core.figures(made).get("odd", 0)
            out[name] = {"rows_in": n_in, "rows_out": n_out, "duplicates": n_in - n_out, "outliers": outliers, "added": done["added"]}
        except Exception as e:
            log.exception("silver %s failed", name)
            out[name] = {"error": str(e)[:500]}
    return out
