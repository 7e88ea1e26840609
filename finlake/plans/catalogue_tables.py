"""Queries that run the engine's own tables, rules, charts and streams over the
star-schema tables, each with equivalent SQL.

Where the operator works on files, the query writes a table of its own in the shared
folder, through the same TableStore that the medallion uses, and returns what is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlake.functions import exprs as X
from finlake.operators import core, quality
from finlake.plans import analytics
from finlake.plans.catalogue import c, clients, deals, query, shared_dir, table
from finlake.plans.catalogue import _d, _drain, _s, _stream  # the catalogue's exact sums and stream reader
from finlake.plans.silver import Dimension
from finlake.sources.specs import DatasetSpec
from finlake.sources.store import TableStore


# relational operators
@query(
    "country_restriction",
    "SELECT n_name AS country, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ('FRANCE',"
    " 'KENYA', 'NATION_3', 'NATION_7') GROUP BY 1",
)
def country_restriction(spark, d):
    rows = core.within_countries(clients(spark, d), ["FRANCE", "KENYA", "NATION_3", "NATION_7"], "n_name")
    return rows.groupBy(c("n_name").alias("country")).agg(F.count("*").alias("n"))


@query("drop_duplicates_by_id", "SELECT count(DISTINCT l_orderkey) AS n_orders, count(*) AS n_lines FROM lineitem")
def drop_duplicates_by_id(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey")
    kept = lines.dropDuplicates(["l_orderkey"]).agg(F.count("*").alias("n_orders"))
    return kept.crossJoin(lines.agg(F.count("*").alias("n_lines")))  # rows of one


_CTE = """WITH busy AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), grouped AS (SELECT n AS orders_of_client, count(*) AS clients FROM busy GROUP BY 1)
SELECT orders_of_client, clients FROM grouped ORDER BY 2 DESC, 1 LIMIT 10"""


@query("cte_and_ordinals", _CTE)
def cte_and_ordinals(spark, d):
    name = f"orders_{uuid.uuid4().hex}"
    table(spark, d, "orders").createOrReplaceTempView(name)
    return spark.sql(_CTE.replace("FROM orders", f"FROM {name}"))


#: The left joins of silver by dimension: fact, its key, and the columns that the dimension gives.
_SIDES = {
    "insurance_client_join": (
        "lineitem", "l_suppkey", "l_orderkey, l_linenumber",
        Dimension("supplier", "s_suppkey", "l_suppkey", {"s_name": "holder", "s_nationkey": "home"}),
    ),
    "mobile_sender_join": (
        "orders", "o_custkey", "o_orderkey", Dimension("customer", "c_custkey", "o_custkey", {"c_nationkey": "home", "c_mktsegment": "segment"}),
    ),
    "loan_account_join": (
        "lineitem", "l_partkey", "l_orderkey, l_linenumber",
        Dimension("part", "p_partkey", "l_partkey", {"p_retailprice": "outstanding", "p_brand": "brand"}),
    ),
}
for _name, (_fact, _at, _ids, _side) in _SIDES.items():
    _cols = ", ".join(f"{a} AS {b}" for a, b in _side.columns.items())

    _show = [f"coalesce({x}, -1) AS {x}" if x == "home" else x for x in _side.columns.values()]

    @query(
        _name,
        f"SELECT {_ids}, {', '.join(_show)} FROM {_fact} LEFT JOIN (SELECT {_side.key} AS k, {_cols} FROM {_side.table} WHERE {_side.key}"
        f" % 3 <> 0) ON k = {_at}",
    )
    def _joined(spark, d, fact=_fact, ids=_ids, side=_side, show=tuple(_show)):
        """A referential with gaps, reduced to a row a key, joined as silver does it."""
        names = [x.strip() for x in ids.split(",")]
        rows = table(spark, d, fact).select(*names, *([] if side.at in names else [side.at]))
        known = table(spark, d, side.table).where(f"{side.key} % 3 <> 0")
        return side.join(rows, lambda _: known).selectExpr(*names, *show)


@query(
    "npl_composite_join",
    "SELECT n_name AS country, coalesce(kind, 'NON_VENTILE') AS kind, count(*) AS n FROM (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) a LEFT JOIN"
    " (SELECT o_custkey, sn.n_name AS country, max(l_shipmode) AS kind FROM (SELECT l_orderkey, l_suppkey, l_returnflag AS l_shipmode FROM lineitem) JOIN orders ON l_orderkey = o_orderkey"
    " JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2) k ON o_custkey = c_custkey AND k.country = n_name GROUP BY 1, 2",
)
def npl_composite_join(spark, d):
    """Kinds by client and country, joined on both."""
    home = table(spark, d, "nation").select("n_nationkey", c("n_name").alias("country"))
    sup = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(
        home, c("s_nationkey") == c("n_nationkey"),
    ).select("s_suppkey", "country")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag").join(
        table(spark, d, "orders").select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"),
    )
    kinds = lines.join(sup, c("l_suppkey") == c("s_suppkey")).groupBy(
        c("o_custkey").alias("c_custkey"), "country",
    ).agg(F.max("l_returnflag").alias("kind"))
    stock = table(spark, d, "customer").join(home, c("c_nationkey") == c("n_nationkey")).select("c_custkey", "country")
    rows = stock.join(kinds, ["c_custkey", "country"], "left")
    return rows.groupBy("country", F.coalesce("kind", F.lit("NON_VENTILE")).alias("kind")).agg(F.count("*").alias("n"))


# validation: the engine's own rules over a specification of the star schema
_SPEC = DatasetSpec(
    "orders", "orders", "o_orderkey",
    {
        "o_orderkey": "bigint*", "country_code": "string*", "o_orderdate": "timestamp*", "amount": "double", "currency": "string",
        "entity_type": "string*",
    },
    {"currency": "currency", "entity_type": "entity_type"}, "o_orderdate", ("amount",),
)
_CODE = "CASE o_custkey % 9 WHEN 0 THEN 'CI' WHEN 1 THEN 'SN' WHEN 2 THEN 'ML' WHEN 3 THEN 'BF' WHEN 4 THEN 'GN' WHEN 5 THEN 'TG' WHEN 6 THEN 'BJ' WHEN 7 THEN 'GH' ELSE 'FR' END"
_TEXTS = (
    f"SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS o_orderkey, {_CODE} AS country_code, CASE WHEN o_orderkey % 89 = 0 THEN 'demain' ELSE '2026-01-02 03:04:05' END AS o_orderdate,"
    " CASE WHEN o_orderkey % 83 = 0 THEN 'beaucoup' WHEN o_orderkey % 79 = 0 THEN '-5.5' ELSE '10.25' END AS amount, CASE WHEN o_orderkey % 73 = 0 THEN 'EUR' WHEN o_orderkey % 71 = 0 THEN 'GHS' WHEN o_custkey % 9 = 7 THEN 'GHS' ELSE 'XOF' END AS currency,"
    " CASE WHEN o_orderkey % 67 = 0 THEN 'CASINO' WHEN o_orderkey % 61 = 0 THEN 'MICROFINANCE' ELSE 'BANK' END AS entity_type FROM orders"
)
_BROKEN = (
    "CASE WHEN o_orderkey IS NULL THEN 'o_orderkey manquant' WHEN o_orderdate = 'demain' THEN 'o_orderdate non convertible en TIMESTAMP' WHEN amount = 'beaucoup' THEN 'amount non convertible en DOUBLE'"
    " WHEN country_code = 'FR' THEN 'country_code hors périmètre' WHEN currency = 'EUR' THEN 'currency hors nomenclature' WHEN entity_type = 'CASINO' THEN 'entity_type hors nomenclature'"
    " WHEN currency <> CASE WHEN country_code = 'GH' THEN 'GHS' ELSE 'XOF' END THEN 'devise incohérente avec le pays'"
    " WHEN entity_type = 'MICROFINANCE' AND country_code NOT IN ('ML', 'GN', 'BF') THEN 'entité absente de ce pays' WHEN amount = '-5.5' THEN 'amount négatif' END"
)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """orders as text columns with planted faults, as a landing file gives them."""
    name = f"orders_{uuid.uuid4().hex}"
    table(spark, d, "orders").createOrReplaceTempView(name)
    rows = spark.sql(_TEXTS.replace("AS VARCHAR", "AS STRING").replace("FROM orders", f"FROM {name}"))
    return rows.withColumns(
        {"_corrupt_record": F.lit(None).cast("string"), "source_file": F.lit("f.csv"), "ingestion_timestamp": F.current_timestamp()}
    )


@query("engine_rejection_reasons", f"SELECT coalesce({_BROKEN}, 'valide') AS reason, count(*) AS n FROM ({_TEXTS}) GROUP BY 1")
def engine_rejection_reasons(spark, d):
    rows = _texts(spark, d).withColumn("reason", quality.rejection_reason(_SPEC))
    return rows.groupBy(F.coalesce("reason", F.lit("valide")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "typed_projection",
    f"SELECT country_code AS country, count(*) AS n, count(CAST(o_orderkey AS BIGINT)) AS keys, {_s('CAST(amount AS DOUBLE)')}"
    f" AS total, max(CAST(o_orderdate AS TIMESTAMP)) AS last_at FROM ({_TEXTS}) WHERE {_BROKEN} IS NULL GROUP BY 1",
)
def typed_projection(spark, d):
    good = quality.typed(_texts(spark, d).where(quality.rejection_reason(_SPEC).isNull()), _SPEC)
    return good.groupBy(c("country_code").alias("country")).agg(
        F.count("*").alias("n"), F.count("o_orderkey").alias("keys"), _d("amount").alias("total"), F.max("o_orderdate").cast("timestamp_ntz").alias("last_at")
    )


@query(
    "rejected_records",
    f"SELECT 'orders' AS dataset, {_BROKEN} AS reject_reason, concat_ws(' | ', coalesce(o_orderkey, ''), country_code, o_orderdate,"
    f" amount, currency, entity_type) AS raw_record FROM ({_TEXTS}) WHERE {_BROKEN} IS NOT NULL",
)
def rejected_records(spark, d):
    rows = _texts(spark, d).withColumn(quality.REASON, quality.rejection_reason(_SPEC))
    return quality.rejects(rows, _SPEC).select("dataset", "reject_reason", "raw_record")


_STAMP = "CASE WHEN event_id % 17 = 0 THEN 'hier' WHEN event_id % 19 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END"


@query(
    "timestamp_guard",
    "SELECT event_type AS kind, count(*) FILTER (TRY_CAST(t AS TIMESTAMP) IS NULL) AS refused, max(TRY_CAST(t AS TIMESTAMP)) AS"
    f" last_at FROM (SELECT event_type, {_STAMP} AS t FROM events) GROUP BY 1",
)
def timestamp_guard(spark, d):
    n = c("event_id")
    text = F.when(n % 17 == 0, "hier").when(n % 19 == 0, F.lit(None)).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = table(spark, d, "events").select(c("event_type").alias("kind"), X.parse(text, "timestamp").alias("at"))
    return rows.groupBy("kind").agg(F.count_if(c("at").isNull()).alias("refused"), F.max("at").cast("timestamp_ntz").alias("last_at"))


@query(
    "topic_demultiplex",
    "SELECT event_type AS topic, count(*) AS n, count(*) FILTER (event_id % 7 = 0) AS lost, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
)
def topic_demultiplex(spark, d):
    """Messages of mixed topics, each parsed by its topic's schema; those without a key are lost."""
    e = table(spark, d, "events")
    body = F.to_json(F.struct(F.when(c("event_id") % 7 != 0, c("event_id")).alias("event_id"), "user_id"))
    sent = e.select(c("event_type").alias("topic"), body.alias("payload"))
    rows = sent.withColumn("v", F.from_json("payload", "event_id bigint, user_id bigint"))
    return rows.groupBy("topic").agg(
        F.count("*").alias("n"), F.count_if(c("v.event_id").isNull()).alias("lost"), F.count_distinct("v.user_id").alias("users"),
    )


@query(
    "second_job_dead_letters",
    "SELECT event_type AS dataset, 'event_id manquant' AS rejection_reason, 'silver_to_gold' AS stage, count(*) AS n, min(props)"
    " AS original_message FROM events WHERE event_id % 7 = 0 GROUP BY 1",
)
def second_job_dead_letters(spark, d):
    from finlake.streaming.jobs import dead_letters

    rows = table(spark, d, "events").withColumns({
        "topic": c("event_type"), "partition": F.lit(0), "offset": c("event_id"), "kafka_timestamp": c("ts"), "payload": c("props"),
        "_why": F.when(c("event_id") % 7 == 0, F.lit("event_id manquant")),
    })
    lost = dead_letters(rows, "events", "silver_to_gold", "_why", None)
    return lost.groupBy(c("source_topic").alias("dataset"), "rejection_reason", "stage").agg(
        F.count("*").alias("n"), F.min("original_message").alias("original_message"),
    )


# tables: written, merged, evolved, compacted and read back
def _store(spark: SparkSession) -> TableStore:
    return TableStore(spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _built(spark: SparkSession, d: str) -> TableStore:
    """Two thirds of the orders, then an upsert of every second one with a new price, by status."""
    store, rows = _store(spark), _orders(spark, d)
    store.merge("q", "orders", rows.where("o_orderkey % 3 <> 0"), ["o_orderkey", "o_orderstatus"], ["o_orderstatus"])
    store.merge("q", "orders", rows.where("o_orderkey % 2 = 0").withColumn("o_totalprice", c("o_totalprice") + 1), ["o_orderkey", "o_orderstatus"])
    return store


_BUILT = "(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0)"


@query("store_upsert", f"SELECT * FROM {_BUILT}")
def store_upsert(spark, d):
    return _built(spark, d).read("q", "orders")


@query("store_partitions", f"SELECT 'o_orderstatus=' || o_orderstatus AS partition, count(*) AS record_count FROM {_BUILT} GROUP BY 1")
def store_partitions(spark, d):
    return _built(spark, d).partitions("q", "orders").select("partition", "record_count")


@query(
    "store_history",
    "SELECT 1 AS version, 'upsert' AS operation, count(*) AS n, count(*) AS added FROM orders WHERE o_orderkey % 3 <> 0 UNION"
    f" ALL SELECT 2, 'upsert', (SELECT count(*) FROM {_BUILT}), (SELECT count(*) FROM orders WHERE o_orderkey % 6 = 0)",
)
def store_history(spark, d):
    log = _built(spark, d).history("q", "orders")
    return spark.createDataFrame(
        [(e["version"], e["operation"], e["rows"], e["added"]) for e in log], "version int, operation string, n bigint, added bigint",
    )


@query("store_compaction", "SELECT 'o_orderstatus=' || o_orderstatus AS partition, count(*) AS record_count, 1 AS file_count FROM orders GROUP BY 1")
def store_compaction(spark, d):
    """Three appends by status, then one file a partition, as all are far below the target."""
    store, rows = _store(spark), _orders(spark, d)
    for k in range(3):
        store.append("q", "orders", rows.where(f"o_orderkey % 3 = {k}"), ["o_orderstatus"])
    store.compact("q", "orders", target_mb=512)
    return store.partitions("q", "orders").select("partition", "record_count", c("file_count").cast("int").alias("file_count"))


@query(
    "store_insert_only",
    "SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0) AS first, (SELECT count(*) FROM orders WHERE o_orderkey"
    " % 6 = 0) AS added, (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0) AS n, 0 AS again",
)
def store_insert_only(spark, d):
    store, rows, key = _store(spark), _orders(spark, d), ["o_orderkey"]
    first = store.merge("q", "orders", rows.where("o_orderkey % 3 <> 0"), key, mode="insert_only")["added"]
    more = store.merge("q", "orders", rows.where("o_orderkey % 2 = 0"), key, mode="insert_only")
    again = store.merge("q", "orders", rows.where("o_orderkey % 2 = 0"), key, mode="insert_only")["added"]
    return spark.createDataFrame([(first, more["added"], more["rows"], again)], "first bigint, added bigint, n bigint, again int")


@query(
    "store_evolution",
    "SELECT o_orderstatus AS status, count(*) AS n, count(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) AS priced FROM orders GROUP BY 1",
)
def store_evolution(spark, d):
    """A table made from its specification, then rows with a column more."""
    store, rows = _store(spark), _orders(spark, d)
    store.create("q", "orders", "o_orderkey bigint, o_orderstatus string", ["o_orderstatus"])
    store.append("q", "orders", rows.where("o_orderkey % 2 = 1").select("o_orderkey", "o_orderstatus"))
    store.append("q", "orders", rows.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus", "o_totalprice"))
    return store.read("q", "orders").groupBy(c("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count("o_totalprice").alias("priced"))


@query(
    "partition_health",
    "SELECT table_name, count(*) AS partitions, CAST(round(avg(n)) AS BIGINT) AS rows_per_partition FROM (SELECT 'orders' AS table_name, o_orderstatus AS p, count(*) AS n FROM orders GROUP BY 2"
    " UNION ALL SELECT 'customer', c_mktsegment, count(*) FROM customer GROUP BY 2) GROUP BY 1",
)
def partition_health(spark, d):
    store, out = _store(spark), None
    for name, by in (("orders", "o_orderstatus"), ("customer", "c_mktsegment")):
        store.append("q", name, table(spark, d, name), [by])
        one = store.partitions("q", name).agg(
            F.count("*").alias("partitions"), F.round(F.avg("record_count")).cast("long").alias("rows_per_partition"),
        )
        one = one.select(F.lit(name).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


# charts, by the charts' own grouped query
def _charted(spark, source: DataFrame, by: dict, measure: dict, filters=(), limit: int = 10_000) -> DataFrame:
    return analytics.Chart("", by, measure, tuple(filters), limit).frame(source)


_EUR = "CAST(o_totalprice AS DECIMAL(18,2))"
_EUR_SUM = "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)"
_CHARTS = {
    "chart_fees_by_country_and_entity": (
        "deal", {"country": "n_name", "entity": "c_mktsegment"}, {"total": f"CAST(sum({_EUR}) AS DOUBLE)"}, (), 10_000,
    ),
    "chart_amount_map": ("deal", {"country": "n_name"}, {"total": f"CAST(sum({_EUR}) AS DOUBLE)"}, (), 100),
    "chart_monthly_mean": (
        "deal", {"month": "CAST(date_trunc('month', o_orderdate) AS DATE)", "country": "n_name"}, {"mean": f"CAST(round(CAST({_EUR_SUM} / count(*) AS DECIMAL(18,6)), 2) AS DOUBLE)"}, (), 10_000,
    ),
    "chart_share_of_total": ("deal", {"country": "n_name"}, {"highest": "max(o_totalprice)"}, ("o_orderpriority = '5-LOW'",), 100),
    "chart_declarations_by_day": (
        "deal", {"day": "CAST(o_orderdate AS DATE)", "country": "n_name"}, {"n": "sum(CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END)"}, (),
        100_000,
    ),
    "chart_delays": ("deal", {"country": "n_name", "line": "o_orderpriority"}, {"mean_days": "CAST(sum(extract(DOY FROM o_orderdate)) AS DOUBLE) / count(*)"}, (), 5000),
    "chart_corridors": (
        "deal", {"corridor": "concat(n_name, '-', c_mktsegment)"}, {"total": f"CAST(sum({_EUR}) AS DOUBLE)"}, ("o_orderstatus = 'O'",), 5,
    ),
}
_FROM = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
for _name, (_, _by, _measure, _filters, _limit) in _CHARTS.items():
    _cols = ", ".join(
        f"{e} AS {n}" for n, e in (_by | {n: f"CAST({e} AS BIGINT)" if e.startswith("sum(CASE") else e for n, e in _measure.items()}).items()
    )
    _where = " AND ".join(_filters) or "true"

    @query(
        _name,
        f"SELECT {_cols} FROM {_FROM} WHERE {_where} GROUP BY {', '.join(_by.values())} ORDER BY {next(iter(_measure))} DESC, {', '.join(_by)}"
        f" LIMIT {_limit}",
    )
    def _chart(spark, d, by=_by, measure=_measure, filters=_filters, limit=_limit):
        source = deals(spark, d, "o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate").where("n_name is not null")
        return _charted(spark, source, by, measure, filters, limit)


# streams
@query(
    "stream_mixed_topics", "SELECT event_type AS topic, count(*) AS n FROM (SELECT DISTINCT event_type, event_id % 500 AS k FROM events) GROUP BY 1",
)
def stream_mixed_topics(spark, d):
    """Repeats told by key over several topics in one stream, within a long watermark."""
    from finlake.streaming.jobs import drop_repeats

    rows = _stream(spark, d).select("ts", "event_type", F.concat_ws("|", "event_type", c("event_id") % 500).alias("key"))
    return _drain(drop_repeats(rows, "key", "ts", "60 days"), "append").groupBy(c("event_type").alias("topic")).agg(F.count("*").alias("n"))


@query("stream_event_time_dedup", f"SELECT CAST(ts AS DATE) AS day, count(DISTINCT event_id) AS n, {_s('value')} AS total FROM events GROUP BY 1")
def stream_event_time_dedup(spark, d):
    """Events sent twice, one a key and event time, by a watermark on event time."""
    twice = _stream(spark, d).select("event_id", "ts", "value").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    kept = _drain(twice.withWatermark("ts", "60 days").dropDuplicates(["event_id", "ts"]), "append")
    return kept.groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("event_id").alias("n"), _d("value").alias("total"))


_RUN = "SELECT user_id, ts, event_id, value, coalesce(epoch_us(lead(ts, 2) OVER w) - epoch_us(ts) <= 3600000000, false) AS s FROM events WHERE value > 20 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query(
    "burst_alert_texts",
    f"SELECT substr(sha256('RAFALE_VIREMENTS|' || CAST(user_id AS VARCHAR) || '|' || strftime(first_ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(first_ts) % 1000000 = 0 THEN '' ELSE rtrim('.' || lpad(CAST(epoch_us(first_ts) % 1000000 AS VARCHAR), 6, '0'), '0') END), 1, 32) AS alert_id,"
    f" user_id AS subject_id, CAST(n AS INTEGER) AS occurrences FROM (SELECT user_id, b, count(*) AS n, min(ts) AS first_ts FROM (SELECT *, sum(CASE WHEN s AND NOT r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM"
    f" (SELECT *, coalesce(lag(s, 1) OVER w, false) OR coalesce(lag(s, 2) OVER w, false) AS r FROM ({_RUN}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) WHERE s OR r GROUP BY 1, 2)",
)
def burst_alert_texts(spark, d):
    """Alerts of exact bursts: their ids, subjects and sizes."""
    from finlake.streaming import rules

    rows = table(spark, d, "events").where("value > 20").withColumns(
        {"account_id": c("user_id"), "country_code": F.lit("CI"), "entity_type": F.lit("BANK"), "currency": F.lit("XOF")}
    )
    bursts = rules.bursts_exact(rows, 3600, 3, ("account_id", "country_code", "entity_type", "currency"), "ts", "value", "event_id")
    return rules.burst_alerts(bursts).select("alert_id", "subject_id", "occurrences")
