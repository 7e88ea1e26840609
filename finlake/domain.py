"""Vocabulary of the domain: countries, currencies, thresholds and codes."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: country -> currency
CURRENCY = {"CI": "XOF", "SN": "XOF", "ML": "XOF", "BF": "XOF", "GN": "XOF", "TG": "XOF", "BJ": "XOF", "GH": "GHS"}
COUNTRIES = tuple(CURRENCY)
# fixed values: entity -> countries it works in
PRESENCE = {"BANK": COUNTRIES, "INSURANCE": COUNTRIES, "MOBILE_MONEY": ("CI", "SN", "BF", "GH"), "MICROFINANCE": ("ML", "GN", "BF")}
# fixed values: units of a currency for one euro
RATES = {"XOF": 655.957, "GHS": float(os.environ.get("FINLAKE_GHS_PER_EUR") or 17.5)}
# fixed values: amounts by currency from which a transfer is declared, or counts for a burst
AML_THRESHOLD = {"XOF": 1_000_000.0, "GHS": 5_000.0}
BURST_AMOUNT = {"XOF": 500_000.0, "GHS": 2_500.0}
# fixed values: minutes and transfers of a burst, times the yearly premium, and the ratios of the indicators
BURST_MINUTES, BURST_COUNT = 5, 3
CLAIM_RATIO = 3.0
NPL_CEILING, NPL_DAYS, LOSS_RATIO_ALERT = 0.05, 90, 0.70
MAX_FEE_RATIO, OVERPAID = 0.05, 1.01
LIQUIDITY_RATIO = float(os.environ.get("FINLAKE_LIQUIDITY_RATIO") or 0.02)

# fixed values: codes that a column may hold; the first mobile operator is the house's own, and a setting
CODES = {
    "segment": ("RETAIL", "SME", "CORPORATE", "PREMIUM"),
    "kyc_level": ("BASIC", "STANDARD", "ENHANCED"),
    "account_type": ("CURRENT", "SAVINGS", "LOAN", "MOBILE_WALLET", "INSURANCE_POLICY"),
    "account_status": ("ACTIVE", "FROZEN", "CLOSED", "DORMANT"),
    "branch_type": ("FULL_SERVICE", "DIGITAL_ONLY", "AGENCY_BANKING", "ATM_POINT"),
    "transaction_type": ("TRANSFER", "PAYMENT", "WITHDRAWAL", "DEPOSIT", "INTERNATIONAL_WIRE"),
    "channel": ("BRANCH", "ATM", "MOBILE_APP", "INTERNET_BANKING", "USSD"),
    "transaction_status": ("SUCCESS", "FAILED", "REVERSED"),
    "operation_type": ("PREMIUM_PAYMENT", "CLAIM_SUBMISSION", "CLAIM_PAYMENT", "POLICY_RENEWAL", "POLICY_CANCELLATION"),
    "product_line": ("VIE", "IARD_AUTO", "IARD_HABITATION", "IARD_SANTE", "PREVOYANCE"),
    "claim_status": ("PENDING", "APPROVED", "REJECTED", "PAID"),
    "payment_type": ("P2P", "MERCHANT_PAYMENT", "BILL_PAYMENT", "AIRTIME", "CROSS_BORDER_TRANSFER"),
    "mobile_operator": tuple(x for x in (os.environ.get("FINLAKE_MOBILE_OPERATORS") or "HOUSE_PAY,ORANGE_MONEY_PARTNER,MTN_PARTNER").split(",") if x),
    "mobile_status": ("SUCCESS", "FAILED", "PENDING"),
    "loan_type": ("CONSUMER", "MORTGAGE", "SME", "AGRICULTURAL", "MICROCREDIT"),
    "repayment_status": ("ON_TIME", "LATE", "DEFAULT"),
    "entity_type": tuple(PRESENCE),
    "currency": tuple(RATES),
}
# fixed values: groups of codes
WIRES = ("TRANSFER", "INTERNATIONAL_WIRE")
OUTFLOWS = ("WITHDRAWAL", "PAYMENT")
CLAIMS = ("CLAIM_SUBMISSION", "CLAIM_PAYMENT")
PREMIUMS = ("PREMIUM_PAYMENT", "POLICY_RENEWAL")
LIFE_LINES = ("VIE", "PREVOYANCE")

# fixed values: topics
RAW_TOPICS = {"bank_txn": "raw-bank-transactions", "insurance_ops": "raw-insurance-operations", "mobile_money": "raw-mobile-money-payments", "loan_repayments": "raw-loan-repayments"}
SILVER_TOPICS = {"bank_txn": "silver-bank-transactions", "insurance_ops": "silver-insurance-operations", "mobile_money": "silver-mobile-money"}
FRAUD_TOPIC, AML_TOPIC, LIQUIDITY_TOPIC, DLQ_TOPIC = "gold-fraud-alerts", "gold-aml-events", "gold-liquidity-alerts", "dlq-financial-events"


def lookup(values: dict, key: Column) -> Column:
    """values[key] as a constant map; null where the key is unknown."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def in_list(values) -> str:
    """Values as a SQL list."""
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"
