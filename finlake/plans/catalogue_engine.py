"""The engine's own indicator and rule functions, run over the star-schema tables under
the names of the silver tables, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from finlake import domain
from finlake.plans import gold
from finlake.plans.catalogue import _s, c, clients, deals, query, table
from finlake.streaming import rules

_DEALS = "orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"
_PARTS = "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"


def _money(x):
    return x.cast("decimal(18,2)")


def _mean(total: str, n: str) -> str:
    return f"CAST(round(CAST({total} / {n} AS DECIMAL(18,6)), 2) AS DOUBLE)"


def _bank(spark, d):
    """Orders as bank transactions."""
    rows = deals(spark, d, "o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate")
    return rows.select(
        c("n_name").alias("country_code"), F.to_date("o_orderdate").alias("transaction_date"), c("c_mktsegment").alias("entity_type"), c("o_orderpriority").alias("transaction_type"),
        (c("o_orderstatus") == "O").alias("est_aboutie"), _money(c("o_totalprice")).alias("amount_eur"), _money(c("o_custkey") % 7).alias("fee_amount_eur"),
        (c("o_totalprice") > 400000).alias("depasse_seuil_aml"), c("o_custkey").alias("customer_id"), c("o_orderkey").alias("transaction_id"),
    )


def _lines(spark, d):
    """Order lines with their order's country."""
    wanted = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_suppkey")
    return table(spark, d, "lineitem").select(*wanted).join(deals(spark, d, "o_orderdate", "o_orderpriority"), c("l_orderkey") == c("o_orderkey"), "left")


def _plain(df, *money):
    """Exact sums as doubles."""
    return df.select(*[c(k).cast("double").alias(k) if k in money else c(k) for k in df.columns])


@query(
    "engine_daily_volume",
    f"SELECT n_name AS country_code, CAST(o_orderdate AS DATE) AS transaction_date, c_mktsegment AS entity_type, o_orderpriority AS transaction_type, count(*) AS nb_transactions, count(*) FILTER (o_orderstatus = 'O') AS nb_abouties,"
    f" {_s('o_totalprice')} AS montant_total_eur, {_mean('sum(CAST(o_totalprice AS DECIMAL(18,2)))', 'count(*)')} AS montant_moyen_eur, CAST(sum(o_custkey % 7) AS DOUBLE) AS commissions_eur,"
    f" count(*) FILTER (o_totalprice > 400000) AS nb_au_dessus_seuil_aml, CAST(round(CAST(count(*) FILTER (o_orderstatus <> 'O') * 100.0 / count(*) AS DECIMAL(18,6)), 2) AS DOUBLE) AS taux_echec FROM {_DEALS} GROUP BY 1, 2, 3, 4",
)
def engine_daily_volume(spark, d):
    rows = gold.daily_volume(lambda t: _bank(spark, d))
    return _plain(rows, "montant_total_eur", "montant_moyen_eur", "commissions_eur", "taux_echec")


@query(
    "engine_arpu",
    f"SELECT n_name AS country_code, CAST(date_trunc('month', o_orderdate) AS DATE) AS mois, c_mktsegment AS segment, count(DISTINCT o_custkey) AS clients_actifs, CAST(sum(fee) AS DOUBLE) AS revenus_eur,"
    f" {_mean('sum(fee)', 'count(DISTINCT o_custkey)')} AS arpc_eur FROM (SELECT *, CAST(o_custkey % 7 AS DECIMAL(18,2)) AS fee FROM {_DEALS} WHERE o_orderstatus = 'O') GROUP BY 1, 2, 3",
)
def engine_arpu(spark, d):
    bank, client = _bank(spark, d), clients(spark, d, "c_mktsegment").select(c("c_custkey").alias("customer_id"), c("c_mktsegment").alias("segment"))
    none = bank.where("false").withColumns({"sender_id": c("customer_id"), "payment_date": c("transaction_date"), "repayment_date": c("transaction_date"), "interest_amount_eur": c("fee_amount_eur")})
    found = {"bank_transactions": bank, "customers": client}
    return _plain(gold.arpu(lambda t: found.get(t, none)), "revenus_eur", "arpc_eur")


@query(
    "engine_loss_ratio",
    "SELECT country_code, product_line, mois, CAST(p AS DOUBLE) AS primes_acquises_eur, CAST(s AS DOUBLE) AS sinistres_regles_eur, n AS nb_sinistres_regles, CASE WHEN p > 0 THEN CAST(round(CAST(s AS DECIMAL(38,10)) / p, 4) AS DOUBLE) END AS loss_ratio,"
    f" CASE WHEN p > 0 THEN CAST(round(CAST(s AS DECIMAL(38,10)) / p, 4) AS DOUBLE) > {domain.LOSS_RATIO_ALERT} END AS seuil_cima_depasse FROM (SELECT n_name AS country_code, o_orderpriority AS product_line, CAST(date_trunc('month', o_orderdate) AS DATE) AS mois,"
    " coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag = 'N'), 0) AS p, coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag = 'R'), 0) AS s,"
    f" count(*) FILTER (l_returnflag = 'R') AS n FROM {_PARTS} GROUP BY 1, 2, 3)",
)
def engine_loss_ratio(spark, d):
    rows = _lines(spark, d).select(
        c("n_name").alias("country_code"), c("o_orderpriority").alias("product_line"), F.trunc("o_orderdate", "month").alias("operation_month"), (c("l_returnflag") == "N").alias("est_prime"),
        (c("l_returnflag") == "R").alias("est_sinistre_regle"), c("l_extendedprice").cast("double").alias("amount_eur"),
    )
    return gold.loss_ratio(lambda t: rows)


@query(
    "engine_mobile_flow",
    f"SELECT n_name AS country_code, CAST(o_orderdate AS DATE) AS payment_date, count(*) AS nb_paiements, count(*) FILTER (o_orderstatus = 'O') AS nb_abouties, {_s('o_totalprice')} AS montant_total_eur, CAST(sum(o_custkey % 7) AS DOUBLE) AS commissions_eur,"
    f" count(DISTINCT o_custkey) AS utilisateurs_actifs, count(*) FILTER (c_mktsegment = 'BUILDING') AS nb_transfrontaliers, CAST(round(CAST(count(*) FILTER (o_orderstatus <> 'O') * 100.0 / count(*) AS DECIMAL(18,6)), 2) AS DOUBLE) AS taux_echec FROM {_DEALS} GROUP BY 1, 2",
)
def engine_mobile_flow(spark, d):
    rows = _bank(spark, d).withColumns({"payment_date": c("transaction_date"), "sender_id": c("customer_id"), "est_transfrontalier": c("entity_type") == "BUILDING"})
    return _plain(gold.mobile_flow(lambda t: rows), "montant_total_eur", "commissions_eur", "taux_echec")


_WAYS = f"(SELECT n_name AS country_code, 'SORTANT' AS sens, * FROM {_DEALS} UNION ALL SELECT c_mktsegment, 'ENTRANT', * FROM {_DEALS}) WHERE o_orderstatus = 'O'"


@query(
    "engine_cross_border",
    f"SELECT country_code, n_name || '-' || c_mktsegment AS corridor, sens, CAST(date_trunc('week', o_orderdate) AS DATE) AS semaine, count(*) AS nb_transferts, {_s('o_totalprice')} AS montant_total_eur,"
    f" {_mean('sum(CAST(o_totalprice AS DECIMAL(18,2)))', 'count(*)')} AS montant_moyen_eur FROM {_WAYS} GROUP BY 1, 2, 3, 4",
)
def engine_cross_border(spark, d):
    rows = _bank(spark, d).select(
        c("country_code").alias("sender_country"), c("entity_type").alias("receiver_country"), F.concat("country_code", F.lit("-"), "entity_type").alias("corridor"), "amount_eur",
        c("est_aboutie").alias("est_transfrontalier"), c("transaction_date").alias("payment_date"),
    )
    return _plain(gold.cross_border(lambda t, cut=True: rows), "montant_total_eur", "montant_moyen_eur")


@query(
    "engine_excessive_claims",
    "SELECT CAST(l_orderkey AS VARCHAR) AS subject_id, 'SINISTRE_EXCESSIF' AS alert_type, 'police' AS subject_kind, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(min(premium) AS DOUBLE) AS reference FROM"
    " lineitem JOIN (SELECT o_orderkey, CAST(CAST(o_totalprice AS DOUBLE) / 100 AS DOUBLE) AS full_premium, round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(4,2)), 2) AS premium FROM orders WHERE o_orderstatus <> 'P') p ON l_orderkey = o_orderkey"
    f" WHERE l_returnflag = 'R' AND full_premium > 0 AND l_extendedprice > {domain.CLAIM_RATIO} * full_premium GROUP BY 1",
)
def engine_excessive_claims(spark, d):
    operations = _lines(spark, d).select(
        c("l_orderkey").cast("string").alias("account_id"), F.when(c("l_returnflag") == "R", F.lit("CLAIM_PAYMENT")).otherwise(F.lit("OTHER")).alias("operation_type"), c("l_extendedprice").alias("amount_eur"),
        c("o_orderpriority").alias("product_line"), c("n_name").alias("country_code"), c("c_mktsegment").alias("entity_type"), c("o_orderdate").cast("timestamp").alias("timestamp"),
    )
    policies = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(c("o_orderkey").cast("string").alias("account_id"), (c("o_totalprice").cast("double") / 100).alias("annual_premium_eur"))
    found = rules.excessive_claims(operations, policies)
    return found.groupBy("subject_id", "alert_type", "subject_kind").agg(
        F.count("*").alias("n"), F.sum(_money(c("amount_eur"))).cast("double").alias("total"), F.min("reference_eur").cast("double").alias("reference")
    )


@query(
    "engine_liquidity_windows",
    "SELECT n_name AS country_code, time_bucket(INTERVAL 1 MINUTE, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 1 MINUTE AS window_start, CAST(sum(v) AS DOUBLE) AS net_out, count(*) AS operations FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2))"
    " WHEN event_type = 'signup' THEN -CAST(value AS DECIMAL(18,2)) ELSE 0 END AS v FROM events WHERE event_type <> 'error') JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey, (SELECT unnest(range(0, 5)) AS k) GROUP BY 1, 2 HAVING sum(v) > 0",
)
def engine_liquidity_windows(spark, d):
    kind = F.when(c("event_type") == "purchase", F.lit(domain.OUTFLOWS[0])).when(c("event_type") == "signup", F.lit("DEPOSIT")).otherwise(F.lit("OTHER"))
    rows = table(spark, d, "events").join(clients(spark, d), c("user_id") == c("c_custkey")).where("n_name is not null").select(
        c("n_name").alias("country_code"), c("ts").alias("timestamp"), (c("event_type") != "error").alias("est_aboutie"), kind.alias("transaction_type"), F.lit(False).alias("est_transfrontalier"),
        _money(c("value")).alias("amount_eur"),
    )
    found = rules.liquidity_windows(rows)
    return found.select("country_code", c("w.start").cast("timestamp_ntz").alias("window_start"), F.round("sorties_nettes_eur", 2).cast("double").alias("net_out"), "operations")


@query(
    "engine_aml_events",
    f"SELECT n_name AS country_code, count(*) AS n, {_s('o_totalprice')} AS total, CAST(max(round(CAST(o_totalprice AS DECIMAL(18,2)) / {domain.AML_THRESHOLD['XOF']}, 2)) AS DOUBLE) AS highest FROM {_DEALS} WHERE o_totalprice > 400000 GROUP BY 1",
)
def engine_aml_events(spark, d):
    more = {"event_id": "transaction_id", "customer_token": "customer_id", "account_id": "customer_id", "amount": "amount_eur", "channel": "entity_type", "beneficiary_country": "country_code", "source_file": "entity_type"}
    rows = _bank(spark, d).withColumns({k: c(v) for k, v in more.items()} | {"currency": F.lit("XOF"), "est_transfrontalier": F.lit(False), "timestamp": c("transaction_date").cast("timestamp")})
    found = rules.aml_events(rows)
    return found.groupBy("country_code").agg(F.count("*").alias("n"), F.sum("amount_eur").cast("double").alias("total"), F.max("threshold_ratio").cast("double").alias("highest"))
