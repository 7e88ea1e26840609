"""The operators over the star-schema tables, each with equivalent SQL.

Roles: nation is the country, region the currency zone, customer the client and
the account, orders the transactions, lineitem the payments and insurance
operations (returned lines are claims), part the product, events the bus.
Sums run over two-decimal numbers, so that they do not depend on the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finlake import domain
from finlake.functions import exprs as X
from finlake.operators import core
from finlake.streaming import rules

c = F.col
QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Zones that pay in the second currency.
GHS_ZONES = ("AMERICA", "MIDDLE EAST")
ZONE = f"CASE WHEN r_name IN {domain.in_list(GHS_ZONES)} THEN 'GHS' ELSE 'XOF' END"
RATE = f"CASE WHEN r_name IN {domain.in_list(GHS_ZONES)} THEN {domain.RATES['GHS']}e0 ELSE {domain.RATES['XOF']}e0 END"
KEY = "finlake-test-key"
#: Sample thresholds by currency for orders, between the tables' least and largest amounts.
DECLARED = {"XOF": 400_000.0, "GHS": 250_000.0}
TYPES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.withColumn("ts", c("ts").cast("timestamp")) if name == "events" else df


def shared_dir(spark: SparkSession) -> str:
    """Where queries write what they read again: the folder that all executors share. Only
    one process (a local master, as in tests) gets a folder of its own where none is set."""
    import re
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or tempfile.mkdtemp(prefix="finlake-")).rstrip("/")


def nations(spark, d, zone: bool = False) -> DataFrame:
    """nation, 25 rows; with zone also its region's name and currency."""
    n = table(spark, d, "nation")
    if not zone:
        return n.select("n_nationkey", "n_name")
    currency = F.when(c("r_name").isin(*GHS_ZONES), "GHS").otherwise("XOF")
    n = n.join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey"), "left")
    return n.select("n_nationkey", "n_name", "r_name", currency.alias("currency"))


def clients(spark, d, *columns: str, zone: bool = False) -> DataFrame:
    cu = table(spark, d, "customer").select("c_custkey", "c_nationkey", *columns)
    return cu.join(nations(spark, d, zone), c("c_nationkey") == c("n_nationkey"), "left")


def deals(spark, d, *columns: str, zone: bool = False) -> DataFrame:
    """orders with their client's country; with zone also its currency."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", *columns)
    return o.join(clients(spark, d, "c_mktsegment", zone=zone), c("o_custkey") == c("c_custkey"), "left")


_CLIENT = f"customer LEFT JOIN (SELECT n_nationkey, n_name, r_name, {ZONE} AS currency, {RATE} AS rate FROM nation LEFT JOIN region ON n_regionkey = r_regionkey) n ON c_nationkey = n_nationkey"
_DEAL = f"orders LEFT JOIN ({{}}) cl ON o_custkey = c_custkey".format(f"SELECT c_custkey, c_nationkey, c_mktsegment, n.* FROM {_CLIENT}")


def _d(x: str | Column) -> Column:
    """Sum of money as a double, exact."""
    return F.sum((c(x) if isinstance(x, str) else x).cast("decimal(18,2)")).cast("double")


def _s(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


def _r(x: Column, n: int) -> Column:
    return F.round(x.cast("decimal(18,6)"), n).cast("double")


def _q(x: str, n: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(18,6)), {n}) AS DOUBLE)"


def _eur(x: str, currency: str = "currency") -> Column:
    return _r(F.try_divide(c(x), domain.lookup(domain.RATES, c(currency))), 2)


@query(
    "balances_by_country",
    f"SELECT n_name AS country, currency, count(*) AS accounts, count(*) FILTER (c_acctbal > 0) AS active, {_s('c_acctbal')}"
    f" AS local_total, {_s(_q('c_acctbal / rate', 2))} AS eur_total, {_q(_s(_q('c_acctbal / rate', 2)) + ' / count(*)', 2)}"
    f" AS eur_mean FROM {_CLIENT} GROUP BY 1, 2",
)
def balances_by_country(spark, d):
    rows = clients(spark, d, "c_acctbal", zone=True).withColumn("eur", _eur("c_acctbal"))
    return rows.groupBy(c("n_name").alias("country"), "currency").agg(
        F.count("*").alias("accounts"), F.count_if(c("c_acctbal") > 0).alias("active"), _d("c_acctbal").alias("local_total"),
        _d("eur").alias("eur_total"), _r(_d("eur") / F.count("*"), 2).alias("eur_mean"),
    )


def _median(name: str, share: float = 0.5) -> Column:
    """A row's value whose rank is off by at most a 10,000th of the group, in a buffer of
    bounded size; groups of fewer rows give the exact one."""
    return F.percentile_approx(name, share, 10_000)


@query(
    "volumes_by_type",
    f"SELECT n_name AS country, o_orderpriority AS kind, count(*) AS volume, {_s('o_totalprice')} AS total, CAST(quantile_disc(o_totalprice,"
    f" 0.5) AS DOUBLE) AS median, {_q('100.0 * count(*) FILTER (o_orderstatus <> ' + chr(39) + 'F' + chr(39) + ') / count(*)', 1)}"
    f" AS failed_pct FROM {_DEAL} GROUP BY 1, 2",
)
def volumes_by_type(spark, d):
    rows = deals(spark, d, "o_orderpriority", "o_totalprice", "o_orderstatus")
    return rows.groupBy(c("n_name").alias("country"), c("o_orderpriority").alias("kind")).agg(
        F.count("*").alias("volume"), _d("o_totalprice").alias("total"), _median("o_totalprice").alias("median"), _r(
            F.count_if(c("o_orderstatus") != "F") * 100.0 / F.count("*"), 1,
        ).alias("failed_pct")
    )


@query(
    "counts_by_segment",
    "SELECT c_mktsegment AS segment, count(DISTINCT n_name) AS countries, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS"
    f" names, count(*) AS clients, {_q('100.0 * count(*) FILTER (c_acctbal > 5000) / count(*)', 1)} AS wealthy_pct FROM {_CLIENT}"
    " GROUP BY 1",
)
def counts_by_segment(spark, d):
    rows = clients(spark, d, "c_mktsegment", "c_acctbal")
    return rows.groupBy(c("c_mktsegment").alias("segment")).agg(
        F.count_distinct("n_name").alias("countries"), F.array_join(F.sort_array(F.collect_set("n_name")), ", ").alias("names"),
        F.count("*").alias("clients"), _r(F.count_if(c("c_acctbal") > 5000) * 100.0 / F.count("*"), 1).alias("wealthy_pct"),
    )


_TRACED = {
    "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id",
    "nation": "n_nationkey", "region": "r_regionkey",
}


@query(
    "traceability_union",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(DISTINCT {k}) AS n_keys, CAST(max({k}) AS BIGINT) AS last_key FROM {t}" for t, k in _TRACED.items()
    ),
)
def traceability_union(spark, d):
    out = None
    for t, k in _TRACED.items():
        one = table(spark, d, t).agg(
            F.count("*").alias("n_rows"), F.count_distinct(k).alias("n_keys"), F.max(k).cast("long").alias("last_key"),
        ).select(F.lit(t).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


_WHY = f"CASE WHEN o_custkey IS NULL THEN 'o_custkey manquant' WHEN o_orderpriority NOT IN {domain.in_list(TYPES)} THEN 'o_orderpriority hors nomenclature' WHEN c_acctbal < 0 THEN 'c_acctbal négatif' END"


@query(
    "rejection_reasons",
    f"SELECT coalesce({_WHY}, 'valide') AS reason, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)
def rejection_reasons(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderpriority").join(
        table(spark, d, "customer").select("c_custkey", "c_acctbal"), c("o_custkey") == c("c_custkey"), "left",
    )
    found = [
        (c("o_custkey").isNull(), "o_custkey manquant"), (~c("o_orderpriority").isin(*TYPES), "o_orderpriority hors nomenclature"),
        (c("c_acctbal") < 0, "c_acctbal négatif"),
    ]
    return rows.groupBy(F.coalesce(*[F.when(b, F.lit(t)) for b, t in found], F.lit("valide")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "quarantine_split",
    "SELECT o_orderkey, concat_ws(' | ', CAST(o_orderkey AS VARCHAR), coalesce(o_orderpriority, ''), coalesce(o_orderstatus, ''))"
    f" AS raw_record, 'o_orderpriority hors nomenclature' AS reason FROM orders WHERE o_orderpriority NOT IN {domain.in_list(TYPES)}",
)
def quarantine_split(spark, d):
    rows = table(spark, d, "orders").where(~c("o_orderpriority").isin(*TYPES))
    return rows.select(
        "o_orderkey",
        F.concat_ws(
            " | ", c("o_orderkey").cast("string"), F.coalesce("o_orderpriority", F.lit("")), F.coalesce("o_orderstatus", F.lit("")),
        ).alias("raw_record"),
        F.lit("o_orderpriority hors nomenclature").alias("reason"),
    )


_TEXT = "CASE WHEN event_id % 5 = 0 THEN 'x' || CAST(event_id AS VARCHAR) WHEN event_id % 5 = 1 THEN CAST(event_id AS VARCHAR) || '.0' WHEN event_id % 5 = 2 THEN '  ' WHEN event_id % 5 = 3 THEN '-' || CAST(event_id AS VARCHAR) ELSE CAST(event_id AS VARCHAR) || '.75' END"


@query(
    "safe_cast_probe",
    "SELECT event_id, coalesce(CAST(trunc(TRY_CAST(t AS DOUBLE)) AS BIGINT), -999999) AS whole, TRY_CAST(t AS DOUBLE) AS number,"
    f" nullif(trim(t), '') IS NULL AS blank FROM (SELECT event_id, {_TEXT} AS t FROM events)",
)
def safe_cast_probe(spark, d):
    n, t = c("event_id").cast("string"), c("event_id") % 5
    text = F.when(t == 0, F.concat(F.lit("x"), n)).when(
        t == 1, F.concat(n, F.lit(".0")),
    ).when(t == 2, F.lit("  ")).when(t == 3, F.concat(F.lit("-"), n)).otherwise(F.concat(n, F.lit(".75")))
    rows = table(spark, d, "events").select("event_id", text.alias("t"))
    return rows.select(
        "event_id", F.coalesce(X.parse(c("t"), "bigint"), F.lit(-999999)).alias("whole"), X.parse(c("t"), "double").alias("number"),
        X.blank_to_null(c("t")).isNull().alias("blank"),
    )


_LINE = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
_SHOW = "l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice"
for _name, _way in (("dedup_earliest", "ASC"), ("dedup_latest", "DESC")):
    _order = ", ".join(f"{x.strip()} {_way}" for x in _LINE.split(","))

    @query(_name, f"SELECT {_SHOW} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_order}) = 1")
    def _dedup(spark, d, keep=_name[6:]):
        rows = table(spark, d, "lineitem").withColumn("_key", F.struct("l_orderkey", "l_linenumber"))
        return core.deduplicate(rows, "_key", [x.strip() for x in _LINE.split(",")], keep).select(*[x.strip() for x in _SHOW.split(",")])


@query("fx_convert", f"SELECT o_orderkey, currency, {_q('o_totalprice / rate', 2)} AS amount_eur FROM {_DEAL}")
def fx_convert(spark, d):
    return deals(spark, d, "o_totalprice", zone=True).select("o_orderkey", "currency", _eur("o_totalprice").alias("amount_eur"))


@query("tokenise", f"SELECT c_custkey, substr(sha256('{KEY}' || c_name), 1, 32) AS token FROM customer")
def tokenise(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.token(c("c_name"), KEY).alias("token"))


@query(
    "mask_tail",
    "SELECT c_custkey, CASE WHEN length(c_name) <= 6 THEN repeat('*', length(c_name)) ELSE substr(c_name, 1, 2) || repeat('*',"
    " length(c_name) - 6) || right(c_name, 4) END AS masked, CASE WHEN length(c_mktsegment) <= 9 THEN repeat('*', length(c_mktsegment))"
    " ELSE repeat('*', length(c_mktsegment) - 9) || right(c_mktsegment, 9) END AS short FROM customer",
)
def mask_tail(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", X.mask_tail(c("c_name"), 4, 2).alias("masked"), X.mask_tail(c("c_mktsegment"), 9).alias("short"),
    )


@query(
    "recent_window",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= date_trunc('day', (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY)",
)
def recent_window(spark, d):
    return core.recent(
        table(spark, d, "orders").select("o_orderkey", c("o_orderdate").cast("timestamp").alias("o_orderdate")), "o_orderdate", 90, "day",
    ).select("o_orderkey", c("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))


@query(
    "enrich_transactions",
    "SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, cl.n_name AS country, cl.c_mktsegment AS segment, sn.n_name"
    " AS beneficiary_country, sn.n_name IS NOT NULL AND sn.n_name <> cl.n_name AS cross_border, sn.n_name IS NULL AS outside"
    f" FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN (SELECT c_custkey, c_mktsegment, n_name FROM {_CLIENT})"
    " cl ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey",
)
def enrich_transactions(spark, d):
    return transfers(spark, d).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", c("n_name").alias("country"), c("c_mktsegment").alias("segment"),
        "beneficiary_country", (c("beneficiary_country").isNotNull() & (c("beneficiary_country") != c("n_name"))).alias("cross_border"),
        c("beneficiary_country").isNull().alias("outside"),
    )


def transfers(spark, d, *more: str) -> DataFrame:
    """Lines with sender (client) and beneficiary (supplier) countries: left joins down the chain."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", *more)
    sup = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(
        table(spark, d, "nation").select(c("n_nationkey").alias("_k"), c("n_name").alias("beneficiary_country")), c("s_nationkey") == c("_k"), "left",
    )
    return lines.join(deals(spark, d, "o_orderdate"), c("l_orderkey") == c("o_orderkey"), "left").join(sup, c("l_suppkey") == c("s_suppkey"), "left")


_DECL = f"CASE WHEN currency = 'GHS' THEN {DECLARED['GHS']} ELSE {DECLARED['XOF']} END"


@query(
    "flag_aml",
    f"SELECT o_orderkey, o_totalprice, {_DECL} AS threshold, {_q(f'o_totalprice / ({_DECL})', 2)} AS threshold_ratio FROM {_DEAL}"
    f" WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > {_DECL}",
)
def flag_aml(spark, d):
    limit = domain.lookup(DECLARED, c("currency"))
    rows = deals(spark, d, "o_totalprice", "o_orderpriority", zone=True).where(
        c("o_orderpriority").isin("1-URGENT", "2-HIGH") & (c("o_totalprice") > limit)
    )
    return rows.select("o_orderkey", "o_totalprice", limit.alias("threshold"), _r(F.try_divide(c("o_totalprice"), limit), 2).alias("threshold_ratio"))


@query(
    "flag_fee_outlier",
    "SELECT l_returnflag, count(*) FILTER (l_extendedprice > 0 AND l_tax / nullif(l_discount, 0) > 0.5) AS outliers, count(*)"
    " FILTER (l_discount = 0) AS without_base, count(*) AS n FROM lineitem GROUP BY 1",
)
def flag_fee_outlier(spark, d):
    odd = (c("l_extendedprice") > 0) & (F.try_divide(c("l_tax"), c("l_discount")) > 0.5)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(odd).alias("outliers"), F.count_if(c("l_discount") == 0).alias("without_base"), F.count("*").alias("n"),
    )


_EURO = _q("o_totalprice / rate", 2)


@query(
    "daily_volume",
    "SELECT n_name AS country, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS kind, count(*) AS n, count(*) FILTER (o_orderstatus"
    f" = 'F') AS n_done, {_s(_EURO)} AS total_eur, {_q(_s(_EURO) + ' / count(*)', 2)} AS mean_eur, {_q('(count(*) - count(*) FILTER (o_orderstatus = ' + chr(39) + 'F' + chr(39) + ')) * 100.0 / count(*)', 2)}"
    f" AS failure_pct, count(*) FILTER (o_totalprice > {_DECL}) AS n_declared FROM {_DEAL} GROUP BY 1, 2, 3",
)
def daily_volume(spark, d):
    rows = deals(spark, d, "o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate", zone=True).withColumn("eur", _eur("o_totalprice"))
    done = F.count_if(c("o_orderstatus") == "F")
    return rows.groupBy(c("n_name").alias("country"), F.to_date("o_orderdate").alias("day"), c("o_orderpriority").alias("kind")).agg(
        F.count("*").alias("n"), done.alias("n_done"), _d("eur").alias("total_eur"), _r(_d("eur") / F.count("*"), 2).alias("mean_eur"), _r(
            (F.count("*") - done) * 100.0 / F.count("*"), 2,
        ).alias("failure_pct"), F.count_if(
            c("o_totalprice") > domain.lookup(DECLARED, c("currency"))
        ).alias("n_declared")
    )


_NPL_MEASURES = f"count(*) AS loans, count(*) FILTER (bad) AS bad_loans, {_s('c_acctbal')} AS total, CAST(sum(CASE WHEN bad THEN CAST(c_acctbal AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS bad_total"
_NPL_ROWS = "(SELECT n_name AS country, coalesce(kind, 'NON_VENTILE') AS kind, c_acctbal, c_acctbal < 1000 AS bad FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS kind FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) k ON o_custkey = c_custkey)"


def _npl_rows(spark, d) -> DataFrame:
    kinds = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max("o_orderpriority").alias("kind"))
    rows = clients(spark, d, "c_acctbal").join(kinds, c("o_custkey") == c("c_custkey"), "left")
    return rows.select(
        c("n_name").alias("country"), F.coalesce("kind", F.lit("NON_VENTILE")).alias("kind"), "c_acctbal", (c("c_acctbal") < 1000).alias("bad"),
    )


def _npl_measures() -> list[Column]:
    amount = c("c_acctbal").cast("decimal(18,2)")
    return [
        F.count("*").alias("loans"), F.count_if(c("bad")).alias("bad_loans"), F.sum(amount).cast("double").alias("total"),
        F.sum(F.when(c("bad"), amount).otherwise(F.lit(0))).cast("double").alias("bad_total"),
    ]


def _npl_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("npl", _r(F.try_divide(c("bad_total"), c("total")), 4))


_NPL = f"SELECT *, {_q('bad_total / nullif(total, 0)', 4)} AS npl FROM (SELECT country, kind, {_NPL_MEASURES} FROM {_NPL_ROWS} GROUP BY 1, 2 UNION ALL SELECT country, 'ENSEMBLE', {_NPL_MEASURES} FROM {_NPL_ROWS} GROUP BY 1)"


@query("npl_grouping_sets", _NPL)
def npl_grouping_sets(spark, d):
    return _npl_ratio(core.with_total(_npl_rows(spark, d), ["country"], "kind", "ENSEMBLE", *_npl_measures()))


@query("npl_union", _NPL)
def npl_union(spark, d):
    rows = _npl_rows(spark, d)
    parts = [rows.groupBy("country", k).agg(*_npl_measures()) for k in (c("kind"), F.lit("ENSEMBLE").alias("kind"))]
    return _npl_ratio(parts[0].unionByName(parts[1]))


@query(
    "arpu_monthly",
    f"SELECT n_name AS country, month, c_mktsegment AS segment, count(DISTINCT cust) AS clients, {_s('rev')} AS revenue, {_q(_s('rev') + ' / count(DISTINCT cust)', 2)}"
    " AS arpc FROM (SELECT o_custkey AS cust, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_totalprice AS rev"
    f" FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, CAST(date_trunc('month', l_shipdate) AS DATE), {_q('l_extendedprice * l_discount', 2)}"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'N' UNION ALL SELECT o_custkey, CAST(date_trunc('month',"
    f" l_shipdate) AS DATE), {_q('l_extendedprice * l_tax', 2)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE"
    f" l_returnflag = 'A') r LEFT JOIN (SELECT c_custkey, c_mktsegment, n_name FROM {_CLIENT}) cl ON cust = c_custkey GROUP"
    " BY 1, 2, 3",
)
def arpu_monthly(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", c("o_custkey").alias("cust"), "o_orderstatus", "o_totalprice", "o_orderdate")
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_shipdate", "l_returnflag", "l_extendedprice", "l_discount", "l_tax",
    ).where("l_returnflag in ('N', 'A')")
    # both line flows in one pass, the flag says which rate counts; a few lines an order
    fee = _r(c("l_extendedprice") * F.when(c("l_returnflag") == "N", c("l_discount")).otherwise(c("l_tax")), 2)
    fees = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.trunc("l_shipdate", "month").alias("month"), fee.alias("rev"))).alias("fees"))
    sale = F.when(c("o_orderstatus") == "F", F.array(F.struct(F.trunc("o_orderdate", "month").alias("month"), c("o_totalprice").alias("rev"))))
    none = F.array().cast("array<struct<month:date,rev:double>>")
    flows = o.join(fees, c("o_orderkey") == c("l_orderkey"), "left").select(
        "cust", F.explode(F.concat(F.coalesce(sale, none), F.coalesce("fees", none))).alias("f"),
    )
    rows = flows.select("cust", "f.*").join(clients(spark, d, "c_mktsegment"), c("cust") == c("c_custkey"), "left")
    return rows.groupBy(
        c("n_name").alias("country"), "month", c("c_mktsegment").alias("segment"),
    ).agg(F.count_distinct("cust").alias("clients"), _d("rev").alias("revenue")).withColumn("arpc", _r(c("revenue") / c("clients"), 2))


_CLAIM = "CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END"
_PREM = "CASE WHEN l_returnflag = 'N' AND p_size > 5 THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END"
_LOSS = f"SELECT p_brand AS line, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(sum({_PREM}) AS DOUBLE) AS premiums, CAST(sum({_CLAIM}) AS DOUBLE) AS claims, count(*) FILTER (l_returnflag = 'R') AS n_claims FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"


def loss_rows(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_returnflag", "l_extendedprice").join(
        table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), c("l_partkey") == c("p_partkey"), "left",
    )
    amount = c("l_extendedprice").cast("decimal(18,2)")
    total = lambda cond: F.sum(F.when(cond, amount).otherwise(F.lit(0))).cast("double")
    rows = rows.groupBy(c("p_brand").alias("line"), F.trunc("l_shipdate", "month").alias("month")).agg(
        total((c("l_returnflag") == "N") & (c("p_size") > 5)).alias("premiums"), total(c("l_returnflag") == "R").alias("claims"),
        F.count_if(c("l_returnflag") == "R").alias("n_claims"),
    )
    return rows.withColumn("loss_ratio", F.when(c("premiums") > 0, _r(F.try_divide(c("claims"), c("premiums")), 4)))


@query(
    "loss_ratio",
    f"SELECT *, CASE WHEN premiums > 0 THEN {_q('claims / premiums', 4)} END AS loss_ratio, CASE WHEN premiums > 0 THEN {_q('claims / premiums', 4)}"
    f" > 0.7 END AS above FROM ({_LOSS})",
)
def loss_ratio(spark, d):
    rows = loss_rows(spark, d)
    return rows.withColumn("above", c("loss_ratio") > domain.LOSS_RATIO_ALERT)


_DELAY = "(SELECT l_linestatus AS line, l_returnflag AS kind, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE days >= 0"


@query(
    "processing_time",
    f"SELECT line, kind, count(*) AS n, {_q('CAST(sum(days) AS DOUBLE) / count(*)', 1)} AS mean_days, CAST(quantile_disc(days,"
    " 0.5) AS DOUBLE) AS median_days, CAST(quantile_disc(days, 0.9) AS DOUBLE) AS p90_days, CAST(max(days) AS BIGINT) AS max_days"
    f" FROM {_DELAY} GROUP BY 1, 2",
)
def processing_time(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linestatus", "l_returnflag", "l_shipdate").join(
        table(spark, d, "orders").select("o_orderkey", "o_orderdate"), c("l_orderkey") == c("o_orderkey"),
    )
    rows = rows.select(
        c("l_linestatus").alias("line"), c("l_returnflag").alias("kind"), F.datediff("l_shipdate", "o_orderdate").alias("days"),
    ).where("days >= 0")
    disc = lambda p: F.expr(f"cast(percentile_disc({p}) WITHIN GROUP (ORDER BY days) as double)")  # noqa: E731  as many values as there are days
    return rows.groupBy("line", "kind").agg(
        F.count("*").alias("n"), _r(F.sum("days").cast("double") / F.count("*"), 1).alias("mean_days"), disc(0.5).alias("median_days"),
        disc(0.9).alias("p90_days"), F.max("days").cast("long").alias("max_days"),
    )


_CROSS = "(SELECT l_extendedprice, l_shipdate, l_suppkey, o_custkey, cn.n_name AS sender, sn.n_name AS receiver FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey)"


@query(
    "mobile_daily_flow",
    f"SELECT sender AS country, CAST(l_shipdate AS DATE) AS day, count(*) AS n, {_s('l_extendedprice')} AS total, count(DISTINCT"
    f" o_custkey) AS senders, count(*) FILTER (sender <> receiver) AS cross_border FROM {_CROSS} GROUP BY 1, 2",
)
def mobile_daily_flow(spark, d):
    rows = transfers(spark, d, "l_shipdate")
    return rows.where("n_name is not null and beneficiary_country is not null").groupBy(
        c("n_name").alias("country"), F.to_date("l_shipdate").alias("day"),
    ).agg(
        F.count("*").alias("n"), _d("l_extendedprice").alias("total"), F.count_distinct("o_custkey").alias("senders"),
        F.count_if(c("n_name") != c("beneficiary_country")).alias("cross_border"),
    )


_BOTH = " UNION ALL ".join(
    f"SELECT {side} AS country, sender || '-' || receiver AS corridor, '{way}' AS way, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, l_extendedprice FROM {_CROSS} WHERE sender <> receiver" for side, way in (
        ("sender", "SORTANT"), ("receiver", "ENTRANT"),
    )
)
_WEEKLY = f"SELECT country, corridor, way, week, count(*) AS n, {_s('l_extendedprice')} AS total, {_q(_s('l_extendedprice') + ' / count(*)', 2)} AS mean FROM ({_BOTH}) GROUP BY 1, 2, 3, 4"


@query("corridor_weekly_both_ways", _WEEKLY)
def corridor_weekly_both_ways(spark, d):
    rows = transfers(spark, d, "l_shipdate").where("n_name <> beneficiary_country")
    sides = F.explode(
        F.array(
            F.struct(c("n_name").alias("country"), F.lit("SORTANT").alias("way")),
            F.struct(c("beneficiary_country").alias("country"), F.lit("ENTRANT").alias("way")),
        )
    )
    rows = rows.select(
        F.concat_ws("-", "n_name", "beneficiary_country").alias("corridor"), F.date_trunc("week", "l_shipdate").cast("date").alias("week"),
        "l_extendedprice", sides.alias("s"),
    ).select("*", "s.*")
    return rows.groupBy("country", "corridor", "way", "week").agg(
        F.count("*").alias("n"), _d("l_extendedprice").alias("total"), _r(_d("l_extendedprice") / F.count("*"), 2).alias("mean"),
    )


@query(
    "corridor_top",
    f"SELECT corridor, way, CAST(sum(n) AS BIGINT) AS n, {_s('total')} AS total, {_q('avg(CAST(mean AS DECIMAL(18,2)))', 2)} AS"
    f" mean_of_means, {_q(_s('total') + ' / sum(n)', 2)} AS weighted_mean FROM ({_WEEKLY}) GROUP BY 1, 2 ORDER BY total DESC, corridor,"
    " way LIMIT 15",
)
def corridor_top(spark, d):
    rows = corridor_weekly_both_ways(spark, d).groupBy("corridor", "way").agg(
        F.sum("n").alias("n"), _d("total").alias("total"),
        _r(F.sum(c("mean").cast("decimal(18,2)")).cast("double") / F.count("*"), 2).alias("mean_of_means"),
    ).withColumn("weighted_mean", _r(c("total") / c("n"), 2))
    return rows.orderBy(F.desc("total"), "corridor", "way").limit(15)


_DAY, _MONTH = "1998-03-15", "1998-03-01"


@query(
    "regulatory_report",
    f"SELECT country, DATE '{_DAY}' AS reporting_date, loans, total, npl, npl <= 0.05 AS npl_ok, premiums, claims, CASE WHEN"
    f" premiums > 0 THEN {_q('claims / premiums', 4)} END AS loss_ratio, coalesce(n, 0) AS n, coalesce(amount, 0) AS amount"
    f" FROM (SELECT country, loans, total, npl FROM ({_NPL}) WHERE kind = 'ENSEMBLE') a FULL OUTER JOIN (SELECT n_name AS country,"
    " CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS premiums,"
    f" CAST(sum({_CLAIM}) AS DOUBLE) AS claims FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey"
    f" = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate >= DATE '{_MONTH}' AND l_shipdate < DATE '1998-04-01'"
    f" GROUP BY 1) b USING (country) FULL OUTER JOIN (SELECT n_name AS country, count(*) AS n, {_s('o_totalprice')} AS amount"
    f" FROM {_DEAL} WHERE CAST(o_orderdate AS DATE) = DATE '{_DAY}' GROUP BY 1) t USING (country)",
)
def regulatory_report(spark, d):
    stock = _npl_ratio(_npl_rows(spark, d).groupBy("country").agg(*_npl_measures())).select("country", "loans", "total", "npl")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_shipdate", "l_returnflag")
    month = lines.join(deals(spark, d), c("l_orderkey") == c("o_orderkey"), "left").where(
        f"l_shipdate >= '{_MONTH}' and l_shipdate < '1998-04-01' and n_name is not null"
    )
    amount = c("l_extendedprice").cast("decimal(18,2)")
    month = month.groupBy(c("n_name").alias("country")).agg(
        *[F.sum(F.when(c("l_returnflag") == f, amount).otherwise(F.lit(0))).cast("double").alias(n) for f, n in (("N", "premiums"), ("R", "claims"))]
    )
    today = deals(spark, d, "o_totalprice", "o_orderdate").where(
        F.to_date("o_orderdate") == F.lit(_DAY).cast("date")
    ).groupBy(c("n_name").alias("country")).agg(
        F.count("*").alias("n"), _d("o_totalprice").alias("amount"),
    )
    joined = core.full_join(core.full_join(stock, month, ["country"]), today, ["country"])
    return joined.select(
        "country", F.lit(_DAY).cast("date").alias("reporting_date"), "loans", "total", "npl", (c("npl") <= domain.NPL_CEILING).alias("npl_ok"),
        "premiums", "claims", F.when(c("premiums") > 0, _r(F.try_divide(c("claims"), c("premiums")), 4)).alias("loss_ratio"),
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("amount", F.lit(0.0)).alias("amount"),
    )


@query(
    "kpi_status",
    "SELECT country, npl, CASE WHEN npl > 0.05 THEN 'ALERTE' WHEN npl > 0.04 THEN 'vigilance' ELSE 'conforme' END AS status, CASE"
    f" WHEN npl BETWEEN 0.03 AND 0.08 THEN 'oui' ELSE 'NON' END AS in_range FROM ({_NPL}) WHERE kind = 'ENSEMBLE'",
)
def kpi_status(spark, d):
    rows = npl_grouping_sets(spark, d).where("kind = 'ENSEMBLE'")
    status = F.when(c("npl") > domain.NPL_CEILING, "ALERTE").when(c("npl") > 0.04, "vigilance").otherwise("conforme")
    return rows.select("country", "npl", status.alias("status"), F.when(c("npl").between(0.03, 0.08), "oui").otherwise("NON").alias("in_range"))


@query(
    "topk_loss",
    f"SELECT line, month, premiums, claims, n_claims, {_q('claims / premiums', 4)} AS loss_ratio, mean_days FROM ({_LOSS}) l LEFT"
    f" JOIN (SELECT p_brand AS b, {_q('CAST(sum(p_size) AS DOUBLE) / count(*)', 1)} AS mean_days FROM part GROUP BY 1) t ON t.b"
    " = l.line WHERE premiums > 0 ORDER BY loss_ratio DESC, line, month LIMIT 20",
)
def topk_loss(spark, d):
    side = table(spark, d, "part").groupBy(c("p_brand").alias("b")).agg(_r(F.sum("p_size").cast("double") / F.count("*"), 1).alias("mean_days"))
    return loss_rows(spark, d).where("loss_ratio is not null").join(side, c("b") == c("line"), "left").drop("b").orderBy(
        F.desc("loss_ratio"), "line", "month",
    ).limit(20)


@query(
    "orphan_anti",
    "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus"
    " = 'F') GROUP BY 1",
)
def orphan_anti(spark, d):
    lost = core.orphans(
        table(spark, d, "lineitem").select("l_orderkey"), table(spark, d, "orders").where("o_orderstatus = 'F'"), "l_orderkey", "o_orderkey",
    )
    return lost.groupBy("l_orderkey").agg(F.count("*").alias("n"))


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").where("value > 20")


#: Sliding windows of an hour every quarter: starts that hold an event are its quarter and the three before.
_SLIDE = "(SELECT user_id, ts, value, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 15 MINUTE AS w FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE value > 20)"
_BURST = f"SELECT user_id, w AS window_start, count(*) AS occurrences, {_s('value')} AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM {_SLIDE} GROUP BY 1, 2 HAVING count(*) >= 3"


def _windows(spark, d) -> DataFrame:
    return rules.burst_windows(
        _events(spark, d).withColumn("value", c("value").cast("decimal(18,2)")), "60 minutes", "15 minutes", 3, ("user_id",), "ts", "value",
    )


def _burst_columns(rows: DataFrame, windows: bool, *more) -> DataFrame:
    at = lambda x, name: c(x).cast("timestamp_ntz").alias(name)
    start = [at("span.start", "window_start")] if windows else []
    return rows.select(
        "user_id", *start, c("held.events").alias("occurrences"), c("held.total").cast("double").alias("total"), at("since", "first_ts"),
        at("held.until", "last_ts"), *more,
    )


@query("burst_sliding", _BURST)
def burst_sliding(spark, d):
    return _burst_columns(_windows(spark, d), True)


@query(
    "burst_collapse",
    "SELECT user_id, first_ts, max(occurrences) AS occurrences, max(total) AS total, max(last_ts) AS last_ts, min(window_start)"
    f" AS window_start FROM ({_BURST}) GROUP BY 1, 2",
)
def burst_collapse(spark, d):
    rows = rules.collapse(_windows(spark, d), ("user_id",))
    return _burst_columns(rows, True)


@query(
    "burst_exact",
    "WITH a AS (SELECT user_id, ts, event_id, value, coalesce(epoch_us(lead(ts, 2) OVER w) - epoch_us(ts) <= 3600000000, false)"
    " AS s FROM events WHERE value > 20 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, coalesce(lag(s,"
    " 1) OVER w, false) OR coalesce(lag(s, 2) OVER w, false) AS r FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),"
    " g AS (SELECT *, sum(CASE WHEN s AND NOT r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED"
    f" PRECEDING) AS k FROM b) SELECT user_id, count(*) AS occurrences, {_s('value')} AS total, min(ts) AS first_ts, max(ts)"
    " AS last_ts FROM g WHERE s OR r GROUP BY user_id, k",
)
def burst_exact(spark, d):
    rows = rules.bursts_exact(
        _events(spark, d).withColumn("value", c("value").cast("decimal(18,2)")), 3600, 3, ("user_id",), "ts", "value", "event_id",
    )
    return _burst_columns(rows, False)


@query(
    "excessive_claim",
    f"SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, premium, {_q('l_extendedprice / premium', 1)} AS times FROM"
    " lineitem JOIN (SELECT o_orderkey, o_totalprice / 100 AS premium FROM orders WHERE o_orderstatus <> 'P') p ON l_orderkey"
    " = o_orderkey WHERE l_returnflag = 'R' AND premium > 0 AND l_extendedprice > 3.0 * premium",
)
def excessive_claim(spark, d):
    policies = table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", (c("o_totalprice") / 100).alias("premium"))
    rows = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice",
    ).join(policies, c("l_orderkey") == c("o_orderkey"))
    return rows.where((c("premium") > 0) & (c("l_extendedprice") > domain.CLAIM_RATIO * c("premium"))).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "premium",
        _r(F.try_divide(c("l_extendedprice"), c("premium")), 1).alias("times"),
    )


_OUT = "CASE WHEN event_type IN ('purchase', 'view') THEN CAST(value AS DECIMAL(18,2)) WHEN event_type = 'signup' THEN -CAST(value AS DECIMAL(18,2)) ELSE 0 END"
_LIQ = f"SELECT n_name AS country, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 15 MINUTE AS window_start, CAST(sum({_OUT}) AS DOUBLE) AS net_out, count(*) AS n FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY 1, 2 HAVING sum({_OUT}) > 0"


@query(
    "liquidity_windows",
    f"SELECT l.country, window_start, net_out, n, {_q('net_out / stock', 4)} AS ratio FROM ({_LIQ}) l JOIN (SELECT n_name AS country,"
    f" {_s('c_acctbal')} / 1000 AS stock FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1)"
    f" s ON s.country = l.country WHERE {_q('net_out / stock', 4)} > 0.02",
)
def liquidity_windows(spark, d):
    amount = c("value").cast("decimal(18,2)")
    out = F.when(c("event_type").isin("purchase", "view"), amount).when(c("event_type") == "signup", -amount).otherwise(F.lit(0))
    rows = table(spark, d, "events").join(clients(spark, d), c("user_id") == c("c_custkey")).where("n_name is not null")
    win = rows.groupBy(
        c("n_name").alias("country"), F.window("ts", "60 minutes", "15 minutes").alias("w"),
    ).agg(F.sum(out).cast("double").alias("net_out"), F.count("*").alias("n")).where("net_out > 0")
    stock = clients(spark, d, "c_acctbal").where("c_acctbal > 0").groupBy(c("n_name").alias("country")).agg((_d("c_acctbal") / 1000).alias("stock"))
    return win.join(stock, "country").withColumn(
        "ratio", _r(F.try_divide(c("net_out"), c("stock")), 4),
    ).where(c("ratio") > domain.LIQUIDITY_RATIO).select(
        "country", c("w.start").cast("timestamp_ntz").alias("window_start"), "net_out", "n", "ratio",
    )


@query(
    "json_extract",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(json_extract_string(props, '$.id'), sha256(props))"
    " AS dedup_key FROM events",
)
def json_extract(spark, d):
    rows = table(spark, d, "events").withColumn("v", F.from_json("props", "k int"))
    return rows.select("event_id", c("v.k").alias("k"), F.coalesce(F.get_json_object("props", "$.id"), F.sha2("props", 256)).alias("dedup_key"))


_BROKEN = "CASE WHEN event_id % 7 = 0 THEN 'message JSON illisible' WHEN event_id % 11 = 0 THEN 'k manquant' WHEN event_id % 13 = 0 THEN 'k non convertible en INT' END"
_PAYLOAD = "CASE WHEN event_id % 7 = 0 THEN 'nope' WHEN event_id % 11 = 0 THEN '{\"j\": 1}' WHEN event_id % 13 = 0 THEN '{\"k\": \"beaucoup\"}' ELSE props END"


@query(
    "dlq_summary",
    "SELECT event_type AS dataset, reason, count(*) AS messages, min(ts) AS first_ts, max(ts) AS last_ts, substr(max(payload),"
    f" 1, 60) AS sample FROM (SELECT *, {_BROKEN} AS reason, {_PAYLOAD} AS payload FROM events) WHERE reason IS NOT NULL GROUP"
    " BY 1, 2",
)
def dlq_summary(spark, d):
    n = c("event_id")
    payload = F.when(n % 7 == 0, F.lit("nope")).when(n % 11 == 0, F.lit('{"j": 1}')).when(
        n % 13 == 0, F.lit('{"k": "beaucoup"}'),
    ).otherwise(c("props"))
    rows = table(spark, d, "events").withColumn("payload", payload).withColumn(
        "v", F.from_json("payload", "k string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}),
    )
    found = [
        (c("v").isNull() | c("v._bad").isNotNull(), "message JSON illisible"), (c("v.k").isNull(), "k manquant"),
        (X.parse(c("v.k"), "int").isNull(), "k non convertible en INT"),
    ]
    rows = rows.withColumn("reason", F.coalesce(*[F.when(b, F.lit(t)) for b, t in found])).where("reason is not null")
    return rows.groupBy(c("event_type").alias("dataset"), "reason").agg(
        F.count("*").alias("messages"), F.min("ts").cast("timestamp_ntz").alias("first_ts"), F.max("ts").cast("timestamp_ntz").alias("last_ts"),
        F.substring(F.max("payload"), 1, 60).alias("sample"),
    )


@query(
    "freshness",
    f"SELECT event_type AS kind, count(*) AS n, max(ts) AS last_ts, {_q('avg(ms) / 1000.0', 1)} AS mean_s, {_q('max(ms) / 1000.0', 1)}"
    " AS max_s FROM (SELECT event_type, ts, (epoch_us(ts) // 1000) - (epoch_us(date_trunc('hour', ts)) // 1000) AS ms FROM events)"
    " GROUP BY 1",
)
def freshness(spark, d):
    ms = F.expr("timestampdiff(MILLISECOND, date_trunc('hour', ts), ts)")
    rows = table(spark, d, "events").select("event_type", "ts", ms.alias("ms"))
    return rows.groupBy(c("event_type").alias("kind")).agg(
        F.count("*").alias("n"), F.max("ts").cast("timestamp_ntz").alias("last_ts"),
        _r(F.sum("ms").cast("double") / F.count("*") / 1000.0, 1).alias("mean_s"), _r(F.max("ms") / 1000.0, 1).alias("max_s"),
    )


@query(
    "lambda_merge",
    "WITH border AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS edge FROM events), b AS (SELECT event_type, CAST(ts AS DATE)"
    f" AS day, count(*) AS n, {_s('value')} AS v FROM events, border WHERE ts <= edge GROUP BY 1, 2), l AS (SELECT event_type,"
    f" CAST(ts AS DATE) AS day, count(*) AS n, {_s('value')} AS v FROM events, border WHERE ts > edge GROUP BY 1, 2) SELECT"
    " coalesce(b.event_type, l.event_type) AS kind, coalesce(b.day, l.day) AS day, coalesce(b.n, 0) AS n_batch, coalesce(l.n,"
    f" 0) AS n_live, {_q('coalesce(b.v, 0) + coalesce(l.v, 0)', 2)} AS total, CASE WHEN b.event_type IS NULL THEN 'temps réel"
    " seul' WHEN l.event_type IS NULL THEN 'batch seul' ELSE 'batch + temps réel' END AS origin FROM b FULL OUTER JOIN l ON"
    " b.event_type = l.event_type AND b.day = l.day",
)
def lambda_merge(spark, d):
    e = table(spark, d, "events")
    span = e.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi")).select(F.expr("lo + (hi - lo) div 2").alias("at"))
    rows = e.crossJoin(F.broadcast(span)).withColumn("live", F.unix_micros("ts") > c("at"))  # one row
    # both sides from one scan: what a full join of the two aggregates gives
    g = rows.groupBy(c("event_type").alias("kind"), F.to_date("ts").alias("day")).agg(
        F.count_if(~c("live")).alias("n_batch"), F.count_if(c("live")).alias("n_live"), _d("value").alias("total"),
    )
    return g.withColumn("origin", F.when(c("n_batch") == 0, "temps réel seul").when(c("n_live") == 0, "batch seul").otherwise("batch + temps réel"))


@query(
    "reconciliation",
    "SELECT coalesce(a.k, b.k) AS kind, coalesce(a.n, 0) AS stored, coalesce(b.m, 0) AS messages, coalesce(b.dd, 0) AS distinct_messages,"
    " CASE WHEN coalesce(a.n, 0) = coalesce(b.dd, 0) THEN 'cohérent' ELSE 'ÉCART' END AS verdict FROM (SELECT event_type AS k,"
    " count(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY 1) a FULL OUTER JOIN (SELECT event_type AS k, count(*) AS"
    " m, count(DISTINCT event_id % 1000) AS dd FROM events WHERE event_type <> 'click' GROUP BY 1) b ON a.k = b.k",
)
def reconciliation(spark, d):
    e = table(spark, d, "events").select(c("event_type").alias("kind"), "event_id")
    left = e.where("kind <> 'signup'").groupBy("kind").agg(F.count("*").alias("n"))
    right = e.where("kind <> 'click'").groupBy("kind").agg(F.count("*").alias("m"), F.count_distinct(c("event_id") % 1000).alias("dd"))
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    return core.full_join(left, right, ["kind"]).select(
        "kind", zero("n").alias("stored"), zero("m").alias("messages"), zero("dd").alias("distinct_messages"),
        F.when(zero("n") == zero("dd"), "cohérent").otherwise("ÉCART").alias("verdict"),
    )


@query(
    "hourly_heatmap", f"SELECT CAST(extract('hour' FROM ts) AS INTEGER) AS hour, event_type AS kind, {_s('value')} AS total"
    " FROM events GROUP BY 1, 2",
)
def hourly_heatmap(spark, d):
    return table(spark, d, "events").groupBy(F.hour("ts").alias("hour"), c("event_type").alias("kind")).agg(_d("value").alias("total"))


@query(
    "failure_rate",
    f"SELECT l_linestatus AS operator, n_name AS country, {_q('CAST(sum(CASE WHEN l_returnflag = ' + chr(39) + 'R' + chr(39) + ' THEN 1 ELSE 0 END) AS DOUBLE) / count(*)', 4)}"
    " AS failures FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2",
)
def failure_rate(spark, d):
    sup = table(spark, d, "supplier").join(table(spark, d, "nation"), c("s_nationkey") == c("n_nationkey")).select("s_suppkey", "n_name")
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_linestatus", "l_returnflag").join(sup, c("l_suppkey") == c("s_suppkey"))
    return rows.groupBy(c("l_linestatus").alias("operator"), c("n_name").alias("country")).agg(
        _r(F.count_if(c("l_returnflag") == "R").cast("double") / F.count("*"), 4).alias("failures")
    )


@query(
    "nullif_ratio",
    f"SELECT p_type AS kind, {_q('CAST(sum(CASE WHEN p_size > 49 THEN p_size ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN p_size > 50 THEN p_size ELSE 0 END), 0)', 4)}"
    f" AS guarded, {_q('CAST(sum(CASE WHEN p_size > 40 THEN p_size ELSE 0 END) AS DOUBLE) / nullif(sum(p_size), 0)', 4)} AS share"
    " FROM part GROUP BY 1",
)
def nullif_ratio(spark, d):
    above = lambda n: F.sum(F.when(c("p_size") > n, c("p_size")).otherwise(0)).cast("double")
    return table(spark, d, "part").groupBy(c("p_type").alias("kind")).agg(
        _r(F.try_divide(above(49), above(50)), 4).alias("guarded"), _r(F.try_divide(above(40), F.sum("p_size").cast("double")), 4).alias("share"),
    )


@query(
    "accounts_top",
    "SELECT n_name AS country, c_mktsegment AS segment, count(*) AS accounts FROM customer JOIN nation ON c_nationkey = n_nationkey"
    " GROUP BY 1, 2 ORDER BY accounts DESC, country, segment LIMIT 10",
)
def accounts_top(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), c("c_nationkey") == c("n_nationkey"))
    return rows.groupBy(
        c("n_name").alias("country"), c("c_mktsegment").alias("segment"),
    ).agg(F.count("*").alias("accounts")).orderBy(F.desc("accounts"), "country", "segment").limit(10)


@query(
    "scalar_counters",
    "SELECT (SELECT count(*) - count(DISTINCT l_orderkey * 10 + l_linenumber) FROM lineitem) AS duplicates, (SELECT count(*) FROM"
    " customer WHERE c_acctbal < 0) AS negative, (SELECT count(*) FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000) AS"
    " in_range, (SELECT count(*) FROM nation WHERE n_name LIKE '%A') AS named",
)
def scalar_counters(spark, d):
    parts = [
        table(spark, d, "lineitem").agg((F.count("*") - F.count_distinct(c("l_orderkey") * 10 + c("l_linenumber"))).alias("duplicates")),
        table(spark, d, "customer").agg(F.count_if(c("c_acctbal") < 0).alias("negative")),
        table(spark, d, "orders").agg(F.count_if(c("o_totalprice").between(100000, 200000)).alias("in_range")),
        table(spark, d, "nation").agg(F.count_if(c("n_name").like("%A")).alias("named")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # rows of one
    return out


_OLD = "SELECT o_orderkey, o_custkey, o_totalprice, 'old' AS origin FROM orders WHERE o_orderkey % 3 <> 0"
_NEW = "SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice, 'new' AS origin FROM orders WHERE o_orderkey % 2 = 0"


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.where("o_orderkey % 3 <> 0").withColumn("origin", F.lit("old")), o.where("o_orderkey % 2 = 0").withColumn(
        "o_totalprice", c("o_totalprice") + 1,
    ).withColumn("origin", F.lit("new"))


for _name, _kept, _other in (("merge_upsert", _NEW, _OLD), ("merge_insert_only", _OLD, _NEW)):

    @query(
        _name,
        f"SELECT * FROM ({_kept}) UNION ALL SELECT * FROM ({_other}) x WHERE NOT EXISTS (SELECT 1 FROM ({_kept}) k WHERE k.o_orderkey"
        " = x.o_orderkey)",
    )
    def _merge(spark, d, only=_name == "merge_insert_only"):
        old, new = _sides(spark, d)
        return core.upsert(old, new, ["o_orderkey"], only)


@query(
    "schema_evolution",
    f"SELECT o_orderkey, o_custkey, NULL::DOUBLE AS o_totalprice, 'wide' AS origin FROM orders WHERE o_orderkey % 2 = 1 UNION ALL {_NEW}",
)
def schema_evolution(spark, d):
    old = table(spark, d, "orders").where("o_orderkey % 2 = 1").select("o_orderkey", "o_custkey", F.lit("wide").alias("origin"))
    return old.unionByName(_sides(spark, d)[1], allowMissingColumns=True)


@query(
    "routing",
    "SELECT topic, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'raw-bank-transactions' WHEN 'view' THEN 'raw-insurance-operations'"
    " WHEN 'purchase' THEN 'raw-mobile-money-payments' WHEN 'error' THEN 'raw-loan-repayments' END AS topic FROM events) WHERE"
    " topic IS NOT NULL GROUP BY 1",
)
def routing(spark, d):
    from finlake.sources.landing import topic_of

    folder = domain.lookup(
        {
            "click": "bank_txn", "view": "insurance_ops", "purchase": "mobile_money", "error": "loan_repayments", "signup": "customers",
        }, c("event_type"),
    )
    path = F.concat(F.lit("landing/CI/"), folder, F.lit("/"), c("event_id").cast("string"), F.lit(".csv"))
    return table(spark, d, "events").select(topic_of(path).alias("topic")).where("topic is not null").groupBy("topic").agg(F.count("*").alias("n"))


@query(
    "alert_ids",
    "SELECT event_id, substr(sha256('RAFALE' || '|' || CAST(user_id AS VARCHAR) || '|' || event_type), 1, 32) AS alert_id, 'k='"
    " || coalesce(json_extract_string(props, '$.k'), '') || ' ' || event_type AS detail FROM events WHERE event_type = 'error'",
)
def alert_ids(spark, d):
    rows = table(spark, d, "events").where("event_type = 'error'")
    return rows.select(
        "event_id", X.alert_id(F.lit("RAFALE"), c("user_id").cast("string"), c("event_type")).alias("alert_id"),
        F.concat_ws("", F.lit("k="), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")), F.lit(" "), "event_type").alias("detail"),
    )


@query(
    "foreign_origin",
    f"SELECT sender AS home, receiver AS other, count(*) AS alerts, {_s('l_extendedprice')} AS total FROM {_CROSS} WHERE sender"
    " <> receiver AND l_extendedprice > 50000 GROUP BY 1, 2",
)
def foreign_origin(spark, d):
    odd = c("beneficiary_country").isNotNull() & (c("n_name") != c("beneficiary_country")) & (c("l_extendedprice") > 50000)
    return transfers(spark, d).where(odd).groupBy(
        c("n_name").alias("home"), c("beneficiary_country").alias("other"),
    ).agg(F.count("*").alias("alerts"), _d("l_extendedprice").alias("total"))


@query(
    "seniority",
    "SELECT c_custkey, CAST(date_diff('month', CAST(first AS DATE), DATE '2002-01-01') AS INTEGER) AS months, date_trunc('month',"
    " first) = first AS at_start FROM (SELECT o_custkey AS c_custkey, date_trunc('month', min(o_orderdate)) AS first FROM orders"
    " GROUP BY 1)",
)
def seniority(spark, d):
    rows = table(spark, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.trunc(F.min("o_orderdate"), "month").alias("first"))
    return rows.select(
        "c_custkey", F.floor(F.months_between(F.lit("2002-01-01").cast("date"), "first")).cast("int").alias("months"),
        (F.trunc("first", "month") == c("first")).alias("at_start"),
    )


# streams: a file source run to its end, compared with the batch result
_STREAM_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stream(spark: SparkSession, d: str) -> DataFrame:
    reader = spark.readStream.schema(_STREAM_SCHEMA)
    return reader.parquet(f"{d}/events.parque[t]").withColumn("ts", c("ts").cast("timestamp"))  # as a pattern it may be a file or a folder


def _drain(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream to its end; the rows it emitted, written to a folder all can read."""
    import uuid

    spark = df.sparkSession
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(rows: DataFrame, number: int) -> None:
        rows.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/n={number}")

    df.writeStream.outputMode(mode).option(
        "checkpointLocation", f"{out}/checkpoint",
    ).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/rows")


@query("stream_dedup", "SELECT user_id % 50 AS k, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def stream_dedup(spark, d):
    """Events told apart by client and type within a long watermark, then counted."""
    rows = _stream(spark, d).select(
        "ts", (c("user_id") % 50).alias("k"), "event_type",
    ).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["k", "event_type"])
    return _drain(rows, "append").groupBy("k").agg(F.count("*").alias("kinds"))


@query("stream_burst", _BURST)
def stream_burst(spark, d):
    """Sliding windows in update mode: the last state of each window is the batch result."""
    rows = _stream(spark, d).withWatermark("ts", "3 days").where("value > 20").withColumn("value", c("value").cast("decimal(18,2)"))
    out = _drain(rules.burst_windows(rows, "60 minutes", "15 minutes", 3, ("user_id",), "ts", "value"), "update")
    return _burst_columns(
        out.groupBy("user_id", "span").agg(F.max_by(F.struct("since", "held"), "_batch").alias("s")).select("user_id", "span", "s.*"), True,
    )


@query(
    "stream_burst_alerts",
    "WITH a AS (SELECT user_id, ts, event_id, value, coalesce(epoch_us(lead(ts, 2) OVER w) - epoch_us(ts) <= 3600000000, false)"
    " AS s FROM events WHERE value > 20 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, coalesce(lag(s,"
    " 1) OVER w, false) OR coalesce(lag(s, 2) OVER w, false) AS r FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),"
    " g AS (SELECT *, sum(CASE WHEN s AND NOT r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED"
    f" PRECEDING) AS k FROM b) SELECT user_id, count(*) AS occurrences, {_s('value')} AS total, min(ts) AS first_ts, max(ts) AS last_ts,"
    " max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR AS closed FROM g WHERE s OR r GROUP BY user_id, k",
)
def stream_burst_alerts(spark, d):
    """One row a burst from keyed state: what was told last of it, and whether it is final."""
    from finlake.streaming import bursts, state

    before = {k: spark.conf.get(k, None) for k in state.SETTINGS}
    state.use_rocksdb(spark)
    try:
        rows = _stream(spark, d).withWatermark("ts", "2 hours").where("value > 20")
        told = _drain(bursts.stream_bursts(rows, None, 3600, 3, ("user_id",), "ts", "value", "event_id"), "append")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)
    last = told.groupBy("user_id", "since").agg(F.max_by(F.struct("held", "told"), F.struct("_batch", c("told") == bursts.CLOSED)).alias("s"))
    rows = last.select("user_id", "since", "s.*").where(c("told") != bursts.WITHDRAWN)
    return _burst_columns(rows, False, (c("told") == bursts.CLOSED).alias("closed")).withColumn("total", _r(c("total"), 2))


def entry(spark: SparkSession, d: str = "/root/testdata/sf0.001") -> DataFrame:
    return balances_by_country(spark, d).orderBy(F.desc("eur_total"))


from finlake.plans import catalogue_tables  # noqa: E402,F401  adds its queries
from finlake.plans import catalogue_increments  # noqa: E402,F401  adds its queries
from finlake.plans import catalogue_engine  # noqa: E402,F401  adds its queries
