"""Named analytic queries over the zones, as SQL over temporary views.

Views are <zone>_<table>; topics are topic_<name with _>. Rates come from the
domain module, so that a changed rate changes every query.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlake import domain
from finlake.sources.specs import SPECS
from finlake.sources.store import TableStore

_RATE = "CASE {0}currency " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in domain.RATES.items()) + " END"
_LIFE = domain.in_list(domain.LIFE_LINES)
_RAW = [s.table for s in SPECS.values()]
_ZONES = [
    ("bronze", "bank_transactions"), ("silver", "bank_transactions"), ("bronze", "customers"), ("silver", "customers"), ("bronze", "accounts"),
    ("silver", "accounts"),
] + [
    ("gold", t) for t in (
        "daily_transaction_volume", "npl_ratio_by_country", "customer_arpu_monthly", "loss_ratio_by_product", "claims_processing_time",
        "mobile_money_daily_flow", "cross_border_transfers",
    )
]


def _whole(x: str) -> str:
    return f"CAST(round({x}) AS BIGINT)"


def _grouped(source: str, by: dict[str, str], measures: dict[str, str], order: str, where: str = "true") -> str:
    """Measures by groups, each as name and expression."""
    columns = ", ".join(f"{e} AS {n}" for n, e in {**by, **measures}.items())
    return f"SELECT {columns} FROM {source} WHERE {where} GROUP BY {', '.join(by.values())} ORDER BY {order}"


QUERIES = {
    "soldes_par_pays": f"""SELECT country_code AS pays, currency AS devise, count(*) AS comptes, count_if(status = 'ACTIVE') AS comptes_actifs, {_whole("sum(balance)")} AS encours_devise_locale,
        {_whole(f"try_divide(sum(balance), {_RATE.format('')})")} AS encours_eur, {_whole(f"try_divide(avg(balance), {_RATE.format('')})")} AS solde_moyen_eur
        FROM raw_accounts GROUP BY country_code, currency ORDER BY encours_eur DESC, pays, devise""",
    "volumes_transactions": f"""SELECT country_code AS pays, transaction_type AS type_operation, count(*) AS volume, {_whole("sum(amount)")} AS montant_total, {_whole("percentile_approx(amount, 0.5)")} AS montant_median,
        {_whole("sum(fee_amount)")} AS commissions, round(100.0 * count_if(transaction_status <> 'SUCCESS') / count(*), 1) AS taux_echec_pct
        FROM raw_bank_transactions GROUP BY country_code, transaction_type ORDER BY pays, volume DESC, type_operation""",
    "comptages_par_entite": """SELECT entity_type AS entite, count(DISTINCT country_code) AS nb_pays, array_join(sort_array(collect_set(country_code)), ', ') AS pays_operes, count(*) AS clients,
        count_if(is_active) AS clients_actifs, count_if(kyc_level = 'ENHANCED') AS kyc_renforce, round(100.0 * count_if(segment IN ('CORPORATE', 'PREMIUM')) / count(*), 1) AS part_haut_de_gamme_pct
        FROM raw_customers GROUP BY entity_type ORDER BY clients DESC, entite""",
    "tracabilite_ingestion": " UNION ALL ".join(
        f"SELECT '{t}' AS table_brute, count(*) AS lignes, count(DISTINCT source_file) AS fichiers, max(ingestion_timestamp) AS derniere_ingestion FROM raw_{t}" for t in _RAW
    ) + " ORDER BY table_brute",
    "architecture_medaillon": " UNION ALL ".join(
        f"SELECT '{z}' AS zone, '{t}' AS table_nom, count(*) AS lignes FROM {z}_{t}" for z, t in _ZONES
    ) + " ORDER BY zone DESC, table_nom",
    "kpis_reglementaires": f"""SELECT country_code AS pays, nb_prets, nb_prets_douteux, {_whole("encours_total_eur")} AS encours_eur, {_whole("encours_douteux_eur")} AS encours_douteux_eur, round(npl_ratio * 100, 2) AS npl_pct,
        CASE WHEN seuil_bceao_depasse THEN 'ALERTE — au-dessus de 5 %' WHEN npl_ratio > 0.04 THEN 'vigilance' ELSE 'conforme' END AS statut_bceao
        FROM gold_npl_ratio_by_country WHERE loan_type = 'ENSEMBLE' ORDER BY npl_ratio DESC, pays""",
    "sinistralite_assurance": f"""SELECT l.country_code AS pays, l.product_line AS branche, {_whole("l.primes_acquises_eur")} AS primes_eur, {_whole("l.sinistres_regles_eur")} AS sinistres_eur, round(l.loss_ratio * 100, 1) AS loss_ratio_pct,
        CASE WHEN l.seuil_cima_depasse THEN 'au-dessus du seuil CIMA' ELSE 'conforme' END AS statut_cima, t.delai_moyen_jours, t.delai_p90_jours
        FROM gold_loss_ratio_by_product l LEFT JOIN gold_claims_processing_time t ON t.country_code = l.country_code AND t.ligne_metier = CASE WHEN l.product_line IN {_LIFE} THEN 'VIE' ELSE 'IARD' END
        WHERE l.loss_ratio IS NOT NULL ORDER BY l.loss_ratio DESC, pays, branche, l.mois LIMIT 20""",
    "corridors_mobile_money": f"""SELECT corridor, sens, sum(nb_transferts) AS transferts, {_whole("sum(montant_total_eur)")} AS montant_total_eur, {_whole("avg(montant_moyen_eur)")} AS montant_moyen_eur
        FROM gold_cross_border_transfers GROUP BY corridor, sens ORDER BY montant_total_eur DESC, corridor, sens LIMIT 15""",
    "corridors_ponderes": f"""SELECT corridor, sens, sum(nb_transferts) AS transferts, {_whole("sum(montant_total_eur)")} AS montant_total_eur, {_whole("try_divide(sum(montant_total_eur), sum(nb_transferts))")} AS montant_moyen_eur
        FROM gold_cross_border_transfers GROUP BY corridor, sens ORDER BY montant_total_eur DESC, corridor, sens LIMIT 15""",
    "rapport_reglementaire": f"""SELECT reporting_date AS journee_declaree, country_code AS pays, round(npl_ratio * 100, 2) AS npl_pct, CASE WHEN npl_conforme THEN 'oui' ELSE 'NON' END AS bceao_conforme,
        round(loss_ratio * 100, 1) AS loss_ratio_pct, CASE WHEN loss_ratio_conforme THEN 'oui' ELSE 'NON' END AS cima_conforme, nb_transactions, {_whole("montant_transactions_eur")} AS montant_journee_eur,
        nb_declarations_aml, {_whole("montant_declare_aml_eur")} AS montant_declare_eur FROM gold_regulatory_report ORDER BY reporting_date DESC, npl_ratio DESC, pays""",
    # one row a country and day from the rows of both sides: what the table holds, and what came after its last run
    "lambda_unifiee": """SELECT country_code AS pays, jour, coalesce(sum(n) FILTER (WHERE NOT direct), 0) AS operations_batch, count_if(direct) AS operations_temps_reel,
        round(coalesce(sum(eur) FILTER (WHERE NOT direct), 0), 2) AS montant_batch_eur, round(coalesce(sum(eur) FILTER (WHERE direct), 0), 2) AS montant_temps_reel_eur,
        round(coalesce(sum(eur), 0), 2) AS montant_total_eur,
        CASE WHEN bool_and(direct) THEN 'temps réel seul' WHEN NOT bool_or(direct) THEN 'batch seul' ELSE 'batch + temps réel' END AS provenance
        FROM (SELECT country_code, transaction_date AS jour, nb_transactions AS n, montant_total_eur AS eur, false AS direct FROM gold_daily_transaction_volume
            UNION ALL SELECT country_code, CAST(timestamp AS date), 1, amount_eur, true FROM topic_silver_bank_transactions
            WHERE transaction_id IS NOT NULL AND processed_at > coalesce((SELECT date_trunc('MILLISECOND', max(processed_at)) FROM gold_daily_transaction_volume), TIMESTAMP '1970-01-01 00:00:00'))
        GROUP BY country_code, jour ORDER BY pays, jour""",
    # the border of each country's day, so that an event of a day that was not computed again is not lost
    "lambda_par_jour": """WITH batch AS (SELECT country_code, transaction_date AS jour, max(processed_at) AS at, sum(nb_transactions) AS n, sum(montant_total_eur) AS eur FROM gold_daily_transaction_volume GROUP BY 1, 2)
        SELECT coalesce(b.country_code, t.country_code) AS pays, coalesce(b.jour, CAST(t.timestamp AS date)) AS jour, coalesce(max(b.n), 0) AS operations_batch,
        count_if(t.processed_at > coalesce(b.at, TIMESTAMP '1970-01-01 00:00:00')) AS operations_temps_reel, round(coalesce(max(b.eur), 0) + coalesce(sum(CASE WHEN t.processed_at > coalesce(b.at, TIMESTAMP '1970-01-01 00:00:00') THEN t.amount_eur END), 0), 2) AS montant_total_eur
        FROM batch b FULL OUTER JOIN (SELECT * FROM topic_silver_bank_transactions WHERE transaction_id IS NOT NULL) t ON b.country_code = t.country_code AND b.jour = CAST(t.timestamp AS date) GROUP BY 1, 2 ORDER BY 1, 2""",
    # one row a kind or country from the rows of both sides, told apart by where they come from
    "alertes_de_fraude": """SELECT alert_type AS type_alerte, count_if(NOT publiee) AS alertes_table, count(DISTINCT alert_id) FILTER (WHERE publiee) AS alertes_topic, count_if(publiee) AS messages_topic,
        count(DISTINCT subject_id) FILTER (WHERE NOT publiee) AS sujets_incrimines, sum(if(publiee, 0, occurrences)) AS evenements_couverts, round(sum(if(publiee, 0, amount_eur)), 2) AS montant_eur,
        if(count_if(NOT publiee) = count(DISTINCT alert_id) FILTER (WHERE publiee), 'cohérent', 'ÉCART') AS double_recepteur
        FROM (SELECT alert_id, alert_type, subject_id, occurrences, amount_eur, false AS publiee FROM gold_fraud_alerts
            UNION ALL SELECT alert_id, alert_type, subject_id, occurrences, amount_eur, true FROM topic_gold_fraud_alerts WHERE alert_id IS NOT NULL)
        GROUP BY alert_type ORDER BY type_alerte""",
    "surveillance_aml": """SELECT country_code AS pays, sum(declares) AS declarables_batch, count(DISTINCT vu.transaction_id) AS declarables_temps_reel, count(DISTINCT vu.account_id) AS comptes_concernes,
        round(coalesce(sum(vu.amount_eur), 0), 2) AS montant_temps_reel_eur, round(coalesce(max(vu.threshold_ratio), 0), 1) AS depassement_max_du_seuil, sum(declares) - count(DISTINCT vu.transaction_id) AS detenus_par_le_batch_seul
        FROM (SELECT country_code, 0 AS declares, struct(transaction_id, account_id, amount_eur, threshold_ratio) AS vu FROM topic_gold_aml_events WHERE event_id IS NOT NULL
            UNION ALL SELECT country_code, coalesce(nb_au_dessus_seuil_aml, 0), NULL FROM gold_daily_transaction_volume)
        GROUP BY country_code ORDER BY pays""",
    "file_de_rebut": _grouped(
        "topic_dlq_financial_events", {"etape": "stage", "jeu_de_donnees": "coalesce(dataset, '(fichier)')", "motif": "rejection_reason"},
        {"messages": "count(*)", "premier": "min(received_at)", "dernier": "max(received_at)", "exemple": "substr(max(original_message), 1, 60)"},
        "messages DESC, etape, motif", "rejection_reason IS NOT NULL",
    ),
    "fraicheur_du_flux": """SELECT country_code AS pays, count(*) AS evenements, max(_timestamp) AS dernier_message, round(avg(timestampdiff(MILLISECOND, ingestion_timestamp, processed_at)) / 1000.0, 1) AS latence_moyenne_s,
        round(max(timestampdiff(MILLISECOND, ingestion_timestamp, processed_at)) / 1000.0, 1) AS latence_max_s, round(avg(timestampdiff(MILLISECOND, processed_at, _timestamp)) / 1000.0, 1) AS publication_moyenne_s,
        timestampdiff(SECOND, max(_timestamp), current_timestamp()) AS age_dernier_message_s FROM topic_silver_bank_transactions WHERE transaction_id IS NOT NULL GROUP BY 1 ORDER BY 1""",
    "sante_kpi": """SELECT count_if(k = 'npl') AS npl_pays, count_if(k = 'npl' AND v BETWEEN 0.03 AND 0.08) AS npl_conformes, count_if(k = 'loss') AS loss_couples, count_if(k = 'loss' AND v BETWEEN 0.50 AND 0.85) AS loss_conformes
        FROM (SELECT 'npl' AS k, npl_ratio AS v FROM gold_npl_ratio_by_country WHERE loan_type = 'ENSEMBLE' UNION ALL SELECT 'loss', loss_ratio FROM gold_loss_ratio_by_product WHERE loss_ratio IS NOT NULL)""",
    "qualite_silver": f"""SELECT b.doublons, b.enrichissement_manquant, b.conversions_fausses, a.iban_nuls_inattendus FROM
        (SELECT count(*) - count(DISTINCT transaction_id) AS doublons, count_if(customer_segment IS NULL) AS enrichissement_manquant, count_if(abs(amount_eur - try_divide(amount, {_RATE.format('')})) > 0.02) AS conversions_fausses FROM silver_bank_transactions) b,
        (SELECT count_if(iban_masked IS NULL AND country_code <> 'GH') AS iban_nuls_inattendus FROM silver_accounts) a""",
    "entites_par_pays": "SELECT entity_type AS entite, array_join(sort_array(collect_set(country_code)), ', ') AS pays_operes"
    " FROM raw_customers GROUP BY entity_type ORDER BY entite",
}


def register(spark: SparkSession, store: TableStore, bus=None) -> None:
    """Views over every table, the bronze names of raw tables, and the topics."""
    for zone in ("raw", "silver", "gold"):
        for table in store.tables(zone):
            store.view(zone, table)
            if zone == "raw" and table in _RAW:
                store.view(zone, table, f"bronze_{table}")
    if bus is None:
        return
    contracts = {
        domain.SILVER_TOPICS["bank_txn"]: ("silver", "bank_transactions"), domain.FRAUD_TOPIC: ("gold", "fraud_alerts"),
        domain.AML_TOPIC: ("gold", "aml_events"),
    }
    for topic, where in contracts.items():
        if store.exists(*where):
            bus.values(topic, store.read(*where).schema).createOrReplaceTempView("topic_" + topic.replace("-", "_"))
    dlq = "dataset string, source_topic string, source_partition int, source_offset bigint, received_at timestamp, rejection_reason string, source_file string, stage string, original_message string"
    bus.values(domain.DLQ_TOPIC, dlq).createOrReplaceTempView("topic_" + domain.DLQ_TOPIC.replace("-", "_"))


def run(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(QUERIES[name])


def partition_health(store: TableStore) -> DataFrame:
    """Files and rows by partition of six raw tables."""
    out = None
    for t in ("bank_transactions", "insurance_operations", "mobile_money_payments", "loan_repayments", "customers", "accounts"):
        if store.exists("raw", t):
            one = store.partitions("raw", t).agg(
                F.count("*").alias("partitions"), F.sum("file_count").alias("fichiers"),
                F.round(F.avg("record_count")).cast("long").alias("lignes_par_partition"),
                F.round(F.avg("file_count"), 1).alias("fichiers_par_partition"),
            )
            one = one.select(F.lit(t).alias("table_brute"), "*")
            out = one if out is None else out.unionByName(one)
    return out.orderBy("lignes_par_partition", "table_brute")


def clear_text_columns(store: TableStore) -> list[str]:
    """Columns of silver accounts that should not be there in clear text."""
    return [c for c in store.read("silver", "accounts").columns if c in ("iban", "account_number")]


# charts
@dataclass(frozen=True)
class Chart:
    """A grouped query: metrics by SQL expression, filters, the rows to show."""

    source: str
    columns: dict[str, str]
    metrics: dict[str, str]
    filters: tuple[str, ...] = ()
    limit: int = 10_000
    order: str | None = field(default=None)

    def frame(self, df: DataFrame, countries=None) -> DataFrame:
        for f in self.filters:
            df = df.where(f)
        if countries and "country_code" in df.columns:
            df = df.where(F.col("country_code").isin(*countries))
        out = df.groupBy(*[F.expr(e).alias(n) for n, e in self.columns.items()]).agg(*[F.expr(e).alias(n) for n, e in self.metrics.items()])
        return out.orderBy(F.desc(self.order or next(iter(self.metrics))), *self.columns).limit(self.limit)


CHARTS = {
    "commissions_pays_entite": Chart(
        "gold_daily_transaction_volume", {"country_code": "country_code", "entity_type": "entity_type"}, {"commissions": "sum(commissions_eur)"},
    ),
    "carte_montants": Chart("gold_daily_transaction_volume", {"country_code": "country_code"}, {"montant": "sum(montant_total_eur)"}, limit=100),
    "arpc_mensuel": Chart("gold_customer_arpu_monthly", {"mois": "mois", "country_code": "country_code"}, {"arpc": "avg(arpc_eur)"}),
    "comptes_pays_type": Chart(
        "silver_accounts", {"country_code": "country_code", "account_type": "account_type"}, {"comptes": "count(*)"}, limit=10,
    ),
    "npl_pays": Chart("gold_npl_ratio_by_country", {"country_code": "country_code"}, {"npl": "max(npl_ratio)"}, ("loan_type = 'ENSEMBLE'",), 100),
    "sinistralite": Chart(
        "gold_loss_ratio_by_product", {"country_code": "country_code", "product_line": "product_line"},
        {"ratio": "try_divide(sum(sinistres_regles_eur), nullif(sum(primes_acquises_eur), 0))"},
    ),
    "aml_jour": Chart(
        "gold_daily_transaction_volume", {
            "jour": "transaction_date", "country_code": "country_code",
        }, {"declarations": "sum(nb_au_dessus_seuil_aml)"},
    ),
    "delais_sinistres": Chart(
        "gold_claims_processing_time", {"country_code": "country_code", "ligne_metier": "ligne_metier"}, {"delai": "avg(delai_moyen_jours)"},
        limit=5000,
    ),
    "heures": Chart(
        "silver_mobile_money_payments", {"heure": "payment_hour", "country_code": "country_code"}, {"montant": "sum(amount_eur)"}, limit=5000,
    ),
    "corridors": Chart("gold_cross_border_transfers", {"corridor": "corridor"}, {"montant": "sum(montant_total_eur)"}, ("sens = 'SORTANT'",), 5),
    "echecs_operateur": Chart(
        "silver_mobile_money_payments", {"operator": "operator", "country_code": "country_code"},
        {"echecs": "avg(CASE WHEN est_aboutie THEN 0.0 ELSE 1.0 END)"},
    ),
}


def chart(spark: SparkSession, name: str, countries=None) -> DataFrame:
    return CHARTS[name].frame(spark.table(CHARTS[name].source), countries)
