"""Seeded fixtures, calibrated and with planted anomalies, and oracles that find them.

Every value is a hash of (seed, row, name), so that any row can be made anew
alone, in any partition. Oracles work on the generated frames, not on silver.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finlake import domain
from finlake.operators import core
from finlake.streaming import rules

from .specs import SPECS

c = F.col
START, DAYS = "2026-01-01 00:00:00", 90
# fixed values: the ranges in which the indicators of the data lie
NPL_RANGE, LOSS_RANGE, NPL_MARGIN = (0.03, 0.08), (0.50, 0.85), 0.005


def uniform(seed: int, name: str, row: str = "id") -> Column:
    """A number in (0, 1) that depends on the seed, the name and the row alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), c(row)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def lognormal(seed: int, name: str, median: float, sigma: float) -> Column:
    normal = F.sqrt(-2 * F.ln(uniform(seed, name + "/r"))) * F.cos(2 * math.pi * uniform(seed, name + "/a"))
    return F.round(F.lit(median) * F.exp(normal * sigma), 2)


def choice(seed: int, name: str, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.floor(uniform(seed, name) * len(values)).cast("int") + 1)


def _identifier(letter: str, width: int, number: Column | None = None) -> Column:
    return F.concat(F.lit("FL-"), c("country_code"), F.lit(f"-{letter}-"), F.lpad((c("id") if number is None else number).cast("string"), width, "0"))


def _home(seed: int) -> Column:
    return choice(seed, "country", domain.COUNTRIES)


def _entity(seed: int) -> Column:
    by = {k: [e for e, where in domain.PRESENCE.items() if k in where] for k in domain.COUNTRIES}
    return F.coalesce(*[F.when(c("country_code") == k, choice(seed, "entity", v)) for k, v in by.items()])


def _day(seed: int, name: str, back: int) -> Column:
    return F.date_sub(F.to_date(F.lit(START)), F.floor(uniform(seed, name) * back).cast("int"))


def _moment(seed: int) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + F.floor(uniform(seed, "moment") * DAYS * 86400).cast("long"))


def _scale() -> Column:
    """Local amounts of the second currency are a hundredth of the first's."""
    return F.when(c("currency") == "GHS", 0.01).otherwise(1.0)


def _of_name(name: Column, low: float, high: float) -> Column:
    """A number of the range that depends on a name alone."""
    return F.lit(low) + (F.pmod(F.xxhash64(F.lit("target"), name), F.lit(1 << 20)) + 0.5) / float(1 << 20) * (high - low)


def npl_target(country: Column) -> Column:
    """Share of bad loans that a country's balances have: its own, and stable."""
    return _of_name(country, NPL_RANGE[0] + NPL_MARGIN, NPL_RANGE[1] - NPL_MARGIN)


def loss_target(country: Column, line: Column) -> Column:
    """Claims over premiums of a country and line."""
    return _of_name(F.concat(country, F.lit(":"), line), *LOSS_RANGE)


def customers(spark: SparkSession, n: int, seed: int) -> DataFrame:
    df = spark.range(1, n + 1).withColumn("country_code", _home(seed)).withColumn("entity_type", _entity(seed))
    return df.select(
        _identifier("C", 6).alias("customer_id"), "country_code", "entity_type", choice(
            seed, "segment", domain.CODES["segment"],
        ).alias("segment"), choice(seed, "kyc", domain.CODES["kyc_level"]).alias("kyc_level"),
        _day(seed, "onboarding", 3000).alias("onboarding_date"), F.concat(
            F.lit("Region "), F.floor(uniform(seed, "region") * 5).cast("string"),
        ).alias("region"), (uniform(seed, "active") < 0.93).alias("is_active"), "id",
    )


def accounts(clients: DataFrame, n: int, seed: int) -> DataFrame:
    """Accounts of the clients in turn; loans default by hash order up to the target share of balances."""
    spark, total = clients.sparkSession, clients.count()
    df = spark.range(1, n + 1).withColumn("_owner", (c("id") - 1) % total + 1).join(
        clients.select(c("id").alias("_owner"), "customer_id", "country_code", "entity_type"), "_owner",
    )
    kind = F.when(c("entity_type") == "INSURANCE", "INSURANCE_POLICY").when(c("entity_type") == "MOBILE_MONEY", "MOBILE_WALLET").otherwise(
        choice(seed, "kind", ("CURRENT", "SAVINGS", "LOAN"))
    )
    df = df.withColumn("account_type", kind).withColumn("currency", domain.lookup(domain.CURRENCY, c("country_code"))).withColumn(
        "balance", F.round(lognormal(seed, "balance", 400_000, 1.0) * _scale(), 2),
    )
    loan = F.when(c("account_type") == "LOAN", c("balance")).otherwise(0.0)
    df = core.running_share(df, "_share", "country_code", F.xxhash64(F.lit(seed), "id"), loan)
    overdue = F.when(
        c("_share") <= npl_target(c("country_code")), 91 + F.floor(uniform(seed, "late") * 200),
    ).otherwise(F.floor(uniform(seed, "late") * 90)).cast("int")
    number = F.lpad(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(10**12)).cast("string"), 12, "0")
    return df.withColumn("_n", number).select(
        _identifier("A", 7).alias("account_id"), "customer_id", "country_code", "entity_type", "account_type", c("_n").alias("account_number"), F.when(
            c("country_code") != "GH", F.concat("country_code", F.lit("93"), "_n", F.lpad(c("id").cast("string"), 8, "0")),
        ).alias("iban"),
        "currency", "balance", F.round(c("balance") * 0.5, 2).alias("credit_limit"), _day(seed, "opened", 2000).alias("opened_date"), choice(
            seed, "status", domain.CODES["account_status"],
        ).alias("status"),
        F.when(c("account_type") == "LOAN", overdue).alias("days_past_due"), F.when(
            c("account_type") == "INSURANCE_POLICY", F.round(lognormal(seed, "premium", 120_000, 0.4) * _scale(), 2),
        ).alias("annual_premium"), "id",
    )


def branches(spark: SparkSession, seed: int, n: int = 200) -> DataFrame:
    df = spark.range(1, n + 1).withColumn(
        "country_code", F.element_at(F.array(*map(F.lit, domain.COUNTRIES)), ((c("id") - 1) % len(domain.COUNTRIES) + 1).cast("int")),
    ).withColumn("entity_type", F.lit("BANK"))
    return df.select(
        _identifier("B", 4).alias("branch_id"), "country_code", "entity_type", F.concat(F.lit("Ville "), c("id").cast("string")).alias("city"),
        F.lit("Centre").alias("region"), choice(seed, "branch", domain.CODES["branch_type"]).alias("branch_type"), F.lit(True).alias("is_active"),
    )


def products(spark: SparkSession, seed: int, n: int = 50) -> DataFrame:
    df = spark.range(1, n + 1).withColumn("country_code", _home(seed)).withColumn("entity_type", _entity(seed))
    return df.select(
        _identifier("P", 3).alias("product_id"), "country_code", "entity_type",
        choice(seed, "category", domain.CODES["account_type"]).alias("category"),
        F.concat(F.lit("Produit "), c("id").cast("string")).alias("product_name"),
        domain.lookup(domain.CURRENCY, c("country_code")).alias("currency"), _day(seed, "launch", 2000).alias("launch_date"),
        F.lit(True).alias("is_active"),
    )


def _flow(accounts_: DataFrame, n: int, seed: int, tag: str, kinds: tuple[str, ...]) -> DataFrame:
    """n rows over the accounts of some types, in turn by hash."""
    own = core.numbered(accounts_.where(c("account_type").isin(*kinds)), "_k", F.concat(F.lit(tag), c("account_id")))
    total = own.count()
    if not total:
        return own.where("false").withColumn("timestamp", F.lit(None).cast("timestamp"))
    ids = accounts_.sparkSession.range(n).withColumn("_k", F.floor(uniform(seed, tag) * total).cast("long"))
    rows = ids.join(own.drop("id"), "_k").withColumn("timestamp", _moment(seed))
    return rows.withColumn("_uuid", F.substring(F.sha2(F.concat(F.lit(f"{seed}/{tag}/"), c("id").cast("string")), 256), 1, 32))


def bank(accounts_: DataFrame, branches_: DataFrame, n: int, seed: int) -> DataFrame:
    rows = _flow(accounts_, n, seed, "bank", ("CURRENT", "SAVINGS"))
    office = branches_.groupBy("country_code").agg(F.min("branch_id").alias("branch_id"))
    other = accounts_.select(c("id").alias("_to"), c("account_id").alias("beneficiary_account"))
    rows = rows.join(office, "country_code").withColumn(
        "_to", F.floor(uniform(seed, "to") * accounts_.count()).cast("long") + 1,
    ).join(other, "_to", "left")
    kind = choice(seed, "txn", domain.CODES["transaction_type"])
    return rows.withColumn("transaction_type", kind).withColumn("amount", F.round(lognormal(seed, "amount", 60_000, 0.6) * _scale(), 2)).select(
        c("_uuid").alias("transaction_id"), "timestamp", "account_id", F.when(
            c("transaction_type").isin(*domain.WIRES), c("beneficiary_account"),
        ).alias("beneficiary_account"), "branch_id", "country_code", "transaction_type", "amount", "currency",
        choice(
            seed, "channel", domain.CODES["channel"],
        ).alias("channel"), F.when(
            uniform(seed, "ok") < 0.95, "SUCCESS",
        ).otherwise("FAILED").alias("transaction_status"), F.round(c("amount") * 0.01, 2).alias("fee_amount"), "entity_type",
    )


def insurance(accounts_: DataFrame, n: int, seed: int) -> DataFrame:
    """Claims are scaled so that claims over premiums is the target in every country and line."""
    rows = _flow(accounts_, n, seed, "insurance", ("INSURANCE_POLICY",)).withColumn(
        "operation_type", F.when(uniform(seed, "op") < 0.8, "PREMIUM_PAYMENT").otherwise("CLAIM_PAYMENT"),
    ).withColumn("product_line", choice(seed, "line", domain.CODES["product_line"]))
    rows = rows.withColumn("_raw", F.round(c("annual_premium") / 12 * (0.8 + 0.4 * uniform(seed, "part")), 2))
    w, claim = Window.partitionBy("country_code", "product_line"), c("operation_type") == "CLAIM_PAYMENT"
    total = lambda cond: F.sum(F.when(cond, c("_raw")).otherwise(0.0)).over(w)
    factor = F.try_divide(loss_target(c("country_code"), c("product_line")) * total(~claim), total(claim))
    return rows.withColumn("_f", factor).select(
        c("_uuid").alias("operation_id"), "timestamp", "customer_id", "account_id", "country_code", "operation_type", "product_line", F.when(
            claim, c("_raw") * c("_f"),
        ).otherwise(c("_raw")).alias("amount"), "currency",
        F.when(claim, F.lit("PAID")).alias("claim_status"), F.when(
            claim, F.floor(uniform(seed, "delay") * 60).cast("int"),
        ).alias("processing_days"), "entity_type",
    )


def mobile(accounts_: DataFrame, n: int, seed: int) -> DataFrame:
    rows = _flow(accounts_, n, seed, "mobile", ("MOBILE_WALLET",))
    peer = accounts_.select(c("id").alias("_to"), c("customer_id").alias("receiver_id"), c("country_code").alias("receiver_country"))
    rows = rows.withColumn("_to", F.floor(uniform(seed, "peer") * accounts_.count()).cast("long") + 1).join(peer, "_to")
    return rows.withColumn("amount", F.round(lognormal(seed, "mobile", 15_000, 0.8) * _scale(), 2)).select(
        c("_uuid").alias("payment_id"), "timestamp", c("customer_id").alias("sender_id"), "receiver_id", c("country_code").alias("sender_country"), "receiver_country", "amount", "currency",
        choice(seed, "pay", domain.CODES["payment_type"]).alias("payment_type"), choice(
            seed, "operator", domain.CODES["mobile_operator"],
        ).alias("operator"), F.when(
            uniform(seed, "ok") < 0.96, "SUCCESS",
        ).otherwise("FAILED").alias("status"), F.round(c("amount") * 0.005, 2).alias("fee_amount"), "entity_type", "country_code",
    )


def loans(accounts_: DataFrame, n: int, seed: int) -> DataFrame:
    rows = _flow(accounts_, n, seed, "loan", ("LOAN",)).withColumn("amount_due", F.round(c("balance") / 24, 2))
    late = c("days_past_due") > domain.NPL_DAYS
    return rows.select(
        c("_uuid").alias("repayment_id"), "timestamp", c("account_id").alias("loan_account_id"), "customer_id", "country_code", "amount_due", F.when(late, 0.0).otherwise(c("amount_due")).alias("amount_paid"), F.round(
            c("amount_due") * 0.15, 2,
        ).alias("interest_amount"), "currency",
        F.to_date("timestamp").alias("due_date"), F.when(
            ~late, F.to_date("timestamp"),
        ).alias("payment_date"), F.when(late, c("days_past_due")).otherwise(0).alias("days_overdue"), choice(
            seed, "loan", ("CONSUMER", "MORTGAGE", "SME"),
        ).alias("loan_type"),
        F.when(late, "DEFAULT").otherwise("ON_TIME").alias("repayment_status"), "entity_type",
    )


# anomalies
def plant_bursts(txns: DataFrame, n: int, seed: int) -> DataFrame:
    """Three transfers above the burst amount within four minutes, for n accounts."""
    first = txns.groupBy("account_id").agg(
        F.min_by(F.struct(*txns.columns), F.struct("timestamp", "transaction_id")).alias("r")
    ).orderBy(F.xxhash64(F.lit(seed), "account_id")).limit(n)
    extra = first.select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"), "r.*")
    amount = domain.lookup(domain.BURST_AMOUNT, c("currency")) * 1.1
    made = {
        "transaction_id": F.concat(F.lit("burst-"), c("k").cast("string"), F.lit("-"), c("transaction_id")),
        "timestamp": F.timestamp_seconds(F.unix_timestamp("timestamp") + c("k") * 110 + 3600), "amount": F.round(amount, 2),
        "transaction_type": F.lit("TRANSFER"),
    }
    return txns.unionByName(extra.select(*[made[x].alias(x) if x in made else c(x) for x in txns.columns]))


def plant_foreign(payments: DataFrame, n: int, seed: int) -> DataFrame:
    """n payments are sent from another country of the same currency."""
    chosen = payments.where("country_code <> 'GH'").orderBy(F.xxhash64(F.lit(seed), "payment_id")).limit(n).select(c("payment_id").alias("_hit"))
    away = F.when(c("sender_country") == "CI", "SN").otherwise("CI")
    return payments.join(chosen, c("payment_id") == c("_hit"), "left").withColumn(
        "sender_country", F.when(c("_hit").isNotNull(), away).otherwise(c("sender_country")),
    ).drop("_hit")


def plant_claims(ops: DataFrame, policies: DataFrame, n: int, seed: int) -> DataFrame:
    """n paid claims become four times the policy's premium; the others of their
    country and line shrink, so that the line's total stays."""
    rows = ops.join(policies.select("account_id", "annual_premium"), "account_id", "left")
    chosen = ops.where("operation_type = 'CLAIM_PAYMENT'").orderBy(
        F.xxhash64(F.lit(seed), "operation_id")
    ).limit(n).select(c("operation_id").alias("_hit"))
    rows = rows.join(chosen, c("operation_id") == c("_hit"), "left").withColumn("_c", c("operation_type") == "CLAIM_PAYMENT").withColumn(
        "_new", F.when(c("_hit").isNotNull(), 4 * c("annual_premium")),
    )
    w = Window.partitionBy("country_code", "product_line", "_c")
    old, put, rest = F.sum("amount").over(w), F.coalesce(F.sum("_new").over(w), F.lit(0.0)), F.sum(F.when(c("_hit").isNull(), c("amount"))).over(w)
    shrunk = F.when(c("_c"), c("amount") * F.greatest(F.coalesce(F.try_divide(old - put, rest), F.lit(1.0)), F.lit(0.0))).otherwise(c("amount"))
    return rows.withColumn("amount", F.coalesce("_new", shrunk)).select(*ops.columns)


def plant_aml(txns: DataFrame, n: int, seed: int) -> DataFrame:
    """At least n transfers above the declaration threshold."""
    chosen = txns.where(
        "transaction_type = 'INTERNATIONAL_WIRE'"
    ).orderBy(F.xxhash64(F.lit(seed), "transaction_id")).limit(n).select(c("transaction_id").alias("_hit"))
    over = domain.lookup(domain.AML_THRESHOLD, c("currency")) * 1.2
    return txns.join(chosen, c("transaction_id") == c("_hit"), "left").withColumn(
        "amount", F.when(c("_hit").isNotNull(), F.round(over, 2)).otherwise(c("amount")),
    ).drop("_hit")


def find_bursts(txns: DataFrame) -> DataFrame:
    return rules.bursts_exact(rules.large(txns), by=("account_id",), amount="amount", tie="transaction_id")


def find_foreign(payments: DataFrame, clients: DataFrame) -> DataFrame:
    home = clients.select(c("customer_id").alias("sender_id"), c("country_code").alias("_home"))
    return payments.join(home, "sender_id").where("_home <> sender_country")


def find_claims(ops: DataFrame, policies: DataFrame) -> DataFrame:
    return ops.where("operation_type = 'CLAIM_PAYMENT'").join(
        policies.select("account_id", "annual_premium"), "account_id",
    ).where(c("amount") > domain.CLAIM_RATIO * c("annual_premium"))


def find_aml(txns: DataFrame) -> DataFrame:
    return txns.where(c("transaction_type").isin(*domain.WIRES) & (c("amount") > domain.lookup(domain.AML_THRESHOLD, c("currency"))))


def generate(
    spark: SparkSession, n_customers: int = 600, n_accounts: int = 1000, rows: int = 3000, seed: int = 20260813, anomalies: int = 5,
) -> dict[str, DataFrame]:
    """All eight datasets by name."""
    cu = customers(spark, n_customers, seed)
    ac = accounts(cu, n_accounts, seed)
    br, pr = branches(spark, seed), products(spark, seed)
    out = {
        "bank_txn": bank(ac, br, rows, seed), "insurance_ops": insurance(ac, rows, seed), "mobile_money": mobile(ac, rows, seed),
        "loan_repayments": loans(ac, rows, seed),
    }
    if anomalies:
        out["bank_txn"] = plant_aml(plant_bursts(out["bank_txn"], anomalies, seed), anomalies, seed)
        out["mobile_money"] = plant_foreign(out["mobile_money"], anomalies, seed)
        out["insurance_ops"] = plant_claims(out["insurance_ops"], ac, anomalies, seed)
    return {"customers": cu.drop("id"), "accounts": ac.drop("id"), "branches": br, "products": pr} | out


def deposit(data: dict[str, DataFrame], root: str, day: str = "20260331") -> list[str]:
    """Write CSV files in the landing layout; flow files are numbered after those there."""
    written = []
    for name, df in data.items():
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        P = jvm.org.apache.hadoop.fs.Path
        fs = P(root).getFileSystem(conf)
        text = df.select(
            *[(F.date_format(c(k), "yyyy-MM-dd'T'HH:mm:ss") if t in ("timestamp", "date") else c(k).cast("string")).alias(k) for k, t in df.dtypes]
        )
        parts = [("referentials", text)] if SPECS[name].is_referential else [
            (k[0], text.where(c("country_code") == k[0])) for k in text.select("country_code").distinct().collect()
        ]
        for where, part in parts:
            draft = f"{root}/_draft"
            part.coalesce(1).write.mode("overwrite").option("header", True).csv(draft)
            if where == "referentials":
                final = f"{root}/referentials/{name}.csv"
            else:
                folder = P(f"{root}/{where}/{name}")
                taken = [
                    int(m[1]) for i in (fs.listStatus(folder) if fs.exists(folder) else []) if (
                        m := re.search(rf"_{day}_(\d+)\.csv$", i.getPath().getName())
                    )
                ]
                final = f"{root}/{where}/{name}/{name}_{where}_{day}_{max(taken, default=0) + 1:02d}.csv"
            source = next(i.getPath() for i in fs.listStatus(P(draft)) if i.getPath().getName().startswith("part-"))
            fs.mkdirs(P(final).getParent())
            fs.delete(P(final), False)
            fs.rename(source, P(final))
            fs.delete(P(draft), True)
            written.append(final)
    return written


def conformance(data: dict[str, DataFrame]) -> dict[str, int]:
    """Violations by check; all are 0 for sound data."""
    cu, ac = data["customers"], data["accounts"]
    out = {f"{n}_key_repeated": df.groupBy(SPECS[n].key).count().where("count > 1").count() for n, df in data.items()}
    out["accounts_without_customer"] = core.orphans(ac, cu, "customer_id", "customer_id").count()
    out["transactions_without_account"] = core.orphans(data["bank_txn"], ac, "account_id", "account_id").count()
    out["operations_without_account"] = core.orphans(data["insurance_ops"], ac, "account_id", "account_id").count()
    out["payments_without_sender"] = core.orphans(data["mobile_money"], cu, "sender_id", "customer_id").count()
    out["repayments_without_loan"] = core.orphans(data["loan_repayments"], ac.where("account_type = 'LOAN'"), "loan_account_id", "account_id").count()
    out["currency_of_country"] = sum(
        df.where(c("currency") != domain.lookup(domain.CURRENCY, c("country_code"))).count() for df in data.values() if "currency" in df.columns
    )
    out["entity_of_country"] = sum(
        df.where(
            ~F.coalesce(*[F.when(c("entity_type") == e, c("country_code").isin(*w)) for e, w in domain.PRESENCE.items()])
        ).count() for df in data.values()
    )
    out["iban_in_ghana"] = ac.where("country_code = 'GH' and iban is not null").count()
    out["premium_off_policy"] = ac.where("(account_type = 'INSURANCE_POLICY') <> (annual_premium is not null)").count()
    return out


_FILE = r"^([a-z_]+)_([A-Z]{2})_([0-9]{8})_([0-9]{2})\.csv$"


def deposited(spark: SparkSession, root: str) -> dict[str, int]:
    """Violations by check in the files of a landing area, read again as text, so that
    an account number keeps its zeros; all are 0 for a sound deposit with anomalies."""
    from . import landing

    found = landing.discover(spark, root)
    read = {n: spark.read.options(header=True, inferSchema=False).csv([f.path for f in files]) for n, files in found.items()}
    out = {"referentials_missing": sum(n not in read for n, s in SPECS.items() if s.is_referential)}
    names = [(f.path.split("/")[-3:], n) for n, files in found.items() if not SPECS[n].is_referential for f in files]
    out["flow_files_missing"] = int(not names)
    out["names_off_pattern"] = sum(not (m := re.match(_FILE, p[-1])) or m[1] != n for p, n in names)
    out["files_in_other_countries"] = sum((m := re.match(_FILE, p[-1])) is not None and m[2] != p[-3] for p, _ in names)
    if out["referentials_missing"]:
        return out
    numbers = read["accounts"].where("account_number is not null")
    out["account_numbers_cut"] = numbers.where(F.length("account_number") != 12).count()
    universe = {
        "account_id": ("accounts", "account_id"), "beneficiary_account": ("accounts", "account_id"), "loan_account_id": ("accounts", "account_id"),
        "branch_id": ("branches", "branch_id"),
    }
    universe |= {k: ("customers", "customer_id") for k in ("customer_id", "sender_id", "receiver_id")}
    for n, df in read.items():
        spec = SPECS[n]
        out[f"{n}_key_repeated"] = df.groupBy(spec.key).count().where("count > 1").count()
        for k, (table, key) in universe.items():
            if k in df.columns and k != spec.key:
                out[f"{n}_{k}_orphans"] = core.orphans(df.where(c(k).isNotNull()), read[table], k, key).count()
        if {"currency", "country_code"} <= set(df.columns):
            out[f"{n}_currency_of_country"] = df.where(c("currency") != domain.lookup(domain.CURRENCY, c("country_code"))).count()
        home = F.coalesce(*[F.when(c("entity_type") == e, c("country_code").isin(*w)) for e, w in domain.PRESENCE.items()])
        out[f"{n}_entity_of_country"] = df.where(~home).count()
    typed = {n: df.withColumns({k: c(k).try_cast("double") for k in ("amount", "annual_premium") if k in df.columns}) for n, df in read.items()}
    if "bank_txn" in typed:
        moves = typed["bank_txn"].withColumn("timestamp", c("timestamp").try_cast("timestamp"))
        out["no_bursts"], out["no_declarations"] = int(find_bursts(moves).isEmpty()), int(find_aml(moves).isEmpty())
    if "mobile_money" in typed:
        out["no_foreign_payments"] = int(find_foreign(typed["mobile_money"], typed["customers"]).isEmpty())
    if "insurance_ops" in typed:
        out["no_excessive_claims"] = int(find_claims(typed["insurance_ops"], typed["accounts"]).isEmpty())
    return out
