"""Dataset specifications: one object gives reading schema, types, rules and keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from finlake import domain

CORRUPT, SOURCE_FILE, INGESTED = "_corrupt_record", "source_file", "ingestion_timestamp"


@dataclass(frozen=True)
class DatasetSpec:
    """``columns``: SQL types by name, in table order, those with * are required.
    ``codes``: the vocabulary of a column. A referential has no event time."""

    name: str
    table: str
    key: str
    columns: dict[str, str]
    codes: dict[str, str] = field(default_factory=dict)
    event_time: str | None = None
    #: columns that must not be negative
    positive: tuple[str, ...] = ()

    @property
    def types(self) -> dict[str, str]:
        return {c: t.rstrip("*") for c, t in self.columns.items()}

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(c for c, t in self.columns.items() if t.endswith("*"))

    @property
    def is_referential(self) -> bool:
        return self.event_time is None

    @property
    def text_schema(self) -> T.StructType:
        """All columns as text, so that absent and unreadable stay apart."""
        return T.StructType([T.StructField(c, T.StringType()) for c in (*self.columns, CORRUPT)])

    @property
    def ddl(self) -> str:
        return ", ".join(f"`{c}` {t}" for c, t in (self.types | {INGESTED: "timestamp", SOURCE_FILE: "string"}).items())

    @property
    def partitioning(self) -> tuple[str, ...]:
        return ("country_code",) if self.is_referential else ("country_code", "event_day")


# fixed values: the columns of each dataset
SPECS = {
    s.name: s
    for s in (
        DatasetSpec(
            "customers", "customers", "customer_id",
            {
                "customer_id": "string*", "country_code": "string*", "entity_type": "string*", "segment": "string", "kyc_level": "string",
                "onboarding_date": "date", "region": "string", "is_active": "boolean",
            },
            {"entity_type": "entity_type", "segment": "segment", "kyc_level": "kyc_level"},
        ),
        DatasetSpec(
            "accounts", "accounts", "account_id",
            {
                "account_id": "string*", "customer_id": "string*", "country_code": "string*", "entity_type": "string*", "account_type": "string",
                "account_number": "string", "iban": "string", "currency": "string", "balance": "double", "credit_limit": "double",
                "opened_date": "date", "status": "string", "days_past_due": "int", "annual_premium": "double",
            },
            {"entity_type": "entity_type", "account_type": "account_type", "currency": "currency", "status": "account_status"},
        ),
        DatasetSpec(
            "branches", "branches", "branch_id",
            {
                "branch_id": "string*", "country_code": "string*", "entity_type": "string*", "city": "string", "region": "string",
                "branch_type": "string", "is_active": "boolean",
            },
            {"entity_type": "entity_type", "branch_type": "branch_type"},
        ),
        DatasetSpec(
            "products", "products", "product_id",
            {
                "product_id": "string*", "country_code": "string*", "entity_type": "string*", "category": "string", "product_name": "string",
                "currency": "string", "launch_date": "date", "is_active": "boolean",
            },
            {"entity_type": "entity_type", "currency": "currency"},
        ),
        DatasetSpec(
            "bank_txn", "bank_transactions", "transaction_id",
            {
                "transaction_id": "string*", "timestamp": "timestamp*", "account_id": "string*", "beneficiary_account": "string",
                "branch_id": "string*", "country_code": "string*", "transaction_type": "string", "amount": "double", "currency": "string",
                "channel": "string", "transaction_status": "string", "fee_amount": "double", "entity_type": "string*",
            },
            {
                "entity_type": "entity_type", "transaction_type": "transaction_type", "currency": "currency", "channel": "channel",
                "transaction_status": "transaction_status",
            }, "timestamp", ("amount", "fee_amount"),
        ),
        DatasetSpec(
            "insurance_ops", "insurance_operations", "operation_id",
            {
                "operation_id": "string*", "timestamp": "timestamp*", "customer_id": "string*", "account_id": "string*", "country_code": "string*",
                "operation_type": "string", "product_line": "string", "amount": "double", "currency": "string", "claim_status": "string",
                "processing_days": "int", "entity_type": "string*",
            },
            {
                "entity_type": "entity_type", "operation_type": "operation_type", "product_line": "product_line", "currency": "currency",
                "claim_status": "claim_status",
            }, "timestamp", ("amount",),
        ),
        DatasetSpec(
            "mobile_money", "mobile_money_payments", "payment_id",
            {
                "payment_id": "string*", "timestamp": "timestamp*", "sender_id": "string*", "receiver_id": "string*", "sender_country": "string*",
                "receiver_country": "string*", "amount": "double", "currency": "string", "payment_type": "string", "operator": "string",
                "status": "string", "fee_amount": "double", "entity_type": "string*", "country_code": "string*",
            },
            {
                "entity_type": "entity_type", "currency": "currency", "payment_type": "payment_type", "operator": "mobile_operator",
                "status": "mobile_status",
            }, "timestamp", ("amount", "fee_amount"),
        ),
        DatasetSpec(
            "loan_repayments", "loan_repayments", "repayment_id",
            {
                "repayment_id": "string*", "timestamp": "timestamp*", "loan_account_id": "string*", "customer_id": "string*",
                "country_code": "string*", "amount_due": "double", "amount_paid": "double", "interest_amount": "double", "currency": "string",
                "due_date": "date", "payment_date": "date", "days_overdue": "int", "loan_type": "string", "repayment_status": "string",
                "entity_type": "string*",
            },
            {
                "entity_type": "entity_type", "currency": "currency", "loan_type": "loan_type", "repayment_status": "repayment_status",
            }, "timestamp", ("amount_due", "amount_paid", "interest_amount"),
        ),
    )
}
REJECTS_DDL = "dataset string, source_file string, ingestion_timestamp timestamp, reject_reason string, raw_record string"
#: Referentials first: flows are enriched from them.
ORDER = tuple(sorted(SPECS, key=lambda n: not SPECS[n].is_referential))
assert all(v in domain.CODES for s in SPECS.values() for v in s.codes.values())
