"""The daily regulatory report: loans, insurance of the month, activity of the day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlake import domain
from finlake.functions.exprs import ratio
from finlake.operators import core
from finlake.sources.store import TableStore

c = F.col
KEYS = ["reporting_date", "country_code"]


def build(npl: DataFrame, loss: DataFrame, transactions: DataFrame, day: date) -> DataFrame:
    """A row a country that any of the three sides has. The month's loss ratio is
    that of the summed amounts; only counts and amounts of the day become 0."""
    at = F.lit(day).cast("date")
    stock = npl.where("loan_type = 'ENSEMBLE'").select("country_code", "nb_prets", "encours_total_eur", "encours_douteux_eur", "npl_ratio")
    month = loss.where(c("mois") == F.trunc(at, "month")).groupBy("country_code").agg(
        *[F.round(F.sum(x), 2).alias(x) for x in ("primes_acquises_eur", "sinistres_regles_eur")]
    )
    month = month.withColumn("loss_ratio", F.when(c("primes_acquises_eur") > 0, ratio(c("sinistres_regles_eur"), c("primes_acquises_eur"), 4)))
    today = transactions.where(c("transaction_date") == at).groupBy("country_code").agg(
        F.count("*").alias("nb_transactions"), F.round(F.sum("amount_eur"), 2).alias(
            "montant_transactions_eur"
        ), core.count_true(c("depasse_seuil_aml")).alias("nb_declarations_aml"), core.sum_where(
            c("depasse_seuil_aml"), c("amount_eur"),
        ).alias("montant_declare_aml_eur")
    )
    joined = core.full_join(core.full_join(stock, month, ["country_code"]), today, ["country_code"])
    zero = [
        F.coalesce(c(x), F.lit(0 if x.startswith("nb_") else 0.0)).alias(x) for x in (
            "nb_transactions", "montant_transactions_eur", "nb_declarations_aml", "montant_declare_aml_eur",
        )
    ]
    return joined.select(
        at.alias("reporting_date"), "country_code", "nb_prets", "encours_total_eur", "encours_douteux_eur", "npl_ratio", (
            c("npl_ratio") <= domain.NPL_CEILING
        ).alias("npl_conforme"), F.lit(domain.NPL_CEILING).alias("npl_seuil_bceao"),
        "primes_acquises_eur", "sinistres_regles_eur", "loss_ratio", (
            c("loss_ratio") <= domain.LOSS_RATIO_ALERT
        ).alias("loss_ratio_conforme"), F.lit(domain.LOSS_RATIO_ALERT).alias("loss_ratio_seuil_cima"), *zero,
    )


def run(spark: SparkSession, store: TableStore, day: date, countries=None) -> dict:
    sides = [
        core.within_countries(store.read(*t), countries) for t in (
            ("gold", "npl_ratio_by_country"), ("gold", "loss_ratio_by_product"), ("silver", "bank_transactions"),
        )
    ]
    rows = build(*sides, day).withColumn("processed_at", F.current_timestamp())
    return store.merge("gold", "regulatory_report", rows, KEYS, ["country_code"])
