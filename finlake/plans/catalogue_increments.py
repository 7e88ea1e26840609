"""Queries of what is kept up by change or merged from parts: gold by signed deltas,
sliding windows by panes, distinct counts by bitmaps, quantiles by histogram and sketch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from finlake.operators import core
from finlake.plans import distinct, increments
from finlake.plans.catalogue import _BURST, _LIQ, _burst_columns, _d, _events, _q, _r, _s, c, clients, query, table
from finlake.plans.catalogue_tables import _store
from finlake.sources import buckets
from finlake.streaming import rules
from finlake.streaming.jobs import keyed, opened

_MONTH = "CAST(date_trunc('month', o_orderdate) AS DATE)"
# what the table holds in the end: moved and repriced orders, late ones, some taken out
_FINAL = (
    "(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 5 ELSE o_totalprice END AS price, CAST(date_trunc('month', CASE WHEN o_orderkey % 7 = 0"
    " THEN o_orderdate + INTERVAL 40 DAY ELSE o_orderdate END) AS DATE) AS month FROM orders WHERE o_orderkey % 11 <> 0)"
)


def _kept_up(spark, d, indicator):
    """A table that is loaded, upserted with late rows and moved groups, and thinned; the indicator after each step."""
    store, keys = _store(spark), ["o_orderkey"]
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", c("o_totalprice").alias("price"), c("o_orderdate").alias("day"))
    place = lambda df: df.withColumns({"month": F.trunc("day", "month").cast("date"), "year": F.year("day")}).drop("day")
    store.merge("silver", "orders", place(orders.where("o_orderkey % 10 <> 3")), keys, ["year"], unique=True)
    increments.maintain(store, "kept_up", indicator)
    moved = orders.where("o_orderkey % 7 = 0 OR o_orderkey % 10 = 3")
    moved = moved.withColumns({"day": F.when(c("o_orderkey") % 7 == 0, F.date_add("day", 40)).otherwise(c("day")), "price": F.when(c("o_orderkey") % 7 == 0, c("price") + 5).otherwise(c("price"))})
    store.merge("silver", "orders", place(moved), keys, unique=True)
    increments.maintain(store, "kept_up", indicator)
    store.merge("silver", "orders", store.read("silver", "orders").withColumn("_gone", c("o_orderkey") % 11 == 0).where("_gone"), keys, removed="_gone", unique=True)
    increments.maintain(store, "kept_up", indicator)
    return store.read("gold", "kept_up").drop("processed_at")


@query(
    "gold_by_deltas",
    f"SELECT month, o_orderstatus, count(*) AS n_orders, {_s('price')} AS total, CAST(round(CAST({_s('price')} / count(*) AS DECIMAL(18,6)), 2) AS DOUBLE) AS mean FROM {_FINAL} GROUP BY 1, 2",
)
def gold_by_deltas(spark, d):
    indicator = increments.Indicator(
        "orders", lambda: {"month": c("month"), "o_orderstatus": c("o_orderstatus")}, lambda: {"eur": c("price")},
        lambda: {"n_orders": c("n"), "total": increments.total("eur"), "mean": _r(increments.total("eur") / c("n"), 2)},
    )
    return _kept_up(spark, d, indicator)


@query("gold_clients_by_deltas", f"SELECT month, count(*) AS n_orders, count(DISTINCT o_custkey) AS clients FROM {_FINAL} GROUP BY 1")
def gold_clients_by_deltas(spark, d):
    """Distinct clients a month, which go when their last order goes."""
    indicator = increments.Indicator("orders", lambda: {"month": c("month")}, lambda: {"eur": c("price")}, lambda: {"n_orders": c("n"), "clients": c("distinct")}, "o_custkey")
    return _kept_up(spark, d, indicator)


@query("burst_by_panes", _BURST)
def burst_by_panes(spark, d):
    rows = _events(spark, d).withColumn("value", c("value").cast("decimal(18,2)"))
    return _burst_columns(rules.burst_windows_by_panes(rows, "60 minutes", "15 minutes", 3, ("user_id",), "ts", "value"), True)


@query(
    "liquidity_by_panes",
    f"SELECT l.country, window_start, net_out, n, {_q('net_out / stock', 4)} AS ratio FROM ({_LIQ}) l JOIN (SELECT n_name AS country,"
    f" {_s('c_acctbal')} / 1000 AS stock FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1) s ON s.country = l.country",
)
def liquidity_by_panes(spark, d):
    amount = c("value").cast("decimal(18,2)")
    out = F.when(c("event_type").isin("purchase", "view"), amount).when(c("event_type") == "signup", -amount).otherwise(F.lit(0))
    rows = table(spark, d, "events").join(clients(spark, d), c("user_id") == c("c_custkey")).where("n_name is not null").withColumnRenamed("n_name", "country")
    windows = rules.sums_by_panes(rows, {"net_out": out, "n": F.lit(1)}, "60 minutes", "15 minutes", ("country",), "ts").where("net_out > 0")
    stock = clients(spark, d, "c_acctbal").where("c_acctbal > 0").groupBy(c("n_name").alias("country")).agg((_d("c_acctbal") / 1000).alias("stock"))
    return windows.join(stock, "country").select(
        "country", c("w.start").cast("timestamp_ntz").alias("window_start"), c("net_out").cast("double").alias("net_out"), "n", _r(F.try_divide(c("net_out").cast("double"), c("stock")), 4).alias("ratio"),
    )


def _client_days(spark, d):
    """A bitmap of the clients of each country and day; clients are numbered in two steps, as they come."""
    store, rows = _store(spark), table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")).join(clients(spark, d), c("o_custkey") == c("c_custkey"), "left")
    distinct.number_ids(store, "clients", rows.where("day < date '1995-01-01'"), "o_custkey")
    numbers = distinct.number_ids(store, "clients", rows, "o_custkey")
    return distinct.bitmaps(rows.join(numbers, "o_custkey"), ["n_name", "day"])


@query(
    "distinct_clients_by_bitmaps",
    "SELECT n_name AS country, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(DISTINCT o_custkey) AS clients FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"
    " UNION ALL SELECT n_name, NULL, count(DISTINCT o_custkey) FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"
    " WHERE o_orderdate >= TIMESTAMP '1994-11-17' AND o_orderdate < TIMESTAMP '1996-02-05' GROUP BY 1",
)
def distinct_clients_by_bitmaps(spark, d):
    """By month, and over a span of days that is no whole month, from the same days."""
    days = _client_days(spark, d)
    month = distinct.counted(distinct.united(days, ["n_name", F.trunc("day", "month").alias("month")]), ["n_name", "month"], "clients")
    span = days.where("day >= date '1994-11-17' AND day < date '1996-02-05'")
    span = distinct.counted(distinct.united(span, ["n_name"]), ["n_name"], "clients").withColumn("month", F.lit(None).cast("date"))
    return month.unionByName(span).select(c("n_name").alias("country"), "month", "clients")


@query(
    "quantiles_by_histogram",
    "SELECT l_shipmode, count(*) AS rows, CAST(quantile_disc(days, 0.5) AS INTEGER) AS p50, CAST(quantile_disc(days, 0.9) AS INTEGER) AS p90 FROM"
    " (SELECT l_returnflag AS l_shipmode, CAST(l_quantity AS INTEGER) AS days FROM lineitem) GROUP BY 1",
)
def quantiles_by_histogram(spark, d):
    rows = table(spark, d, "lineitem").select(c("l_returnflag").alias("l_shipmode"), c("l_quantity").cast("int").alias("days"), (c("l_orderkey") % 12).alias("part"))
    parts = distinct.histogram(rows, ["l_shipmode", "part"], "days")
    return distinct.histogram_quantiles(parts, ["l_shipmode"], "days", {"p50": 0.5, "p90": 0.9})


@query(
    "quantiles_by_sketch",
    "SELECT n_name AS country, count(*) AS n, true AS p50_within, true AS p90_within FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
def quantiles_by_sketch(spark, d):
    """Sketches a month, merged; the share of rows below each answer is held against the stated error."""
    rows = table(spark, d, "orders").select("o_custkey", "o_totalprice", F.trunc("o_orderdate", "month").alias("month")).join(clients(spark, d), c("o_custkey") == c("c_custkey")).where("n_name is not null")
    parts = distinct.sketches(rows, ["n_name", "month"], "o_totalprice")
    found = distinct.merged_sketches(parts, ["n_name"]).select("n_name", distinct.sketch_quantile(0.5).alias("_p50"), distinct.sketch_quantile(0.9).alias("_p90"))
    below = lambda q: F.count_if(c("o_totalprice") < c(q)) / F.count("*")
    upto = lambda q: F.count_if(c("o_totalprice") <= c(q)) / F.count("*")
    off = 2 * distinct.RANK_ERROR
    within = lambda q, share: (below(q) <= share + off) & (upto(q) >= share - off)
    return rows.join(found, "n_name").groupBy(c("n_name").alias("country")).agg(F.count("*").alias("n"), within("_p50", 0.5).alias("p50_within"), within("_p90", 0.9).alias("p90_within"))


@query(
    "heavy_key_join",
    "SELECT coalesce(c_mktsegment, 'none') AS segment, count(*) AS n, count(k) AS keyed FROM (SELECT CASE WHEN event_id % 10 < 5 THEN 1 WHEN event_id % 10 < 8 THEN NULL ELSE user_id END AS k FROM events) LEFT JOIN customer ON k = c_custkey GROUP BY 1",
)
def heavy_key_join(spark, d):
    """Half of the rows on one key, three tenths without a key."""
    key = F.when(c("event_id") % 10 < 5, F.lit(1)).when(c("event_id") % 10 < 8, F.lit(None)).otherwise(c("user_id"))
    rows = table(spark, d, "events").select("event_id", key.cast("long").alias("k"))
    heavy = core.heavy_keys(rows, ["k"])["k"]
    side = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    out = core.lookup_join(rows, side, "k", "c_custkey", [int(x) for x in heavy])
    return out.groupBy(F.coalesce("c_mktsegment", F.lit("none")).alias("segment")).agg(F.count("*").alias("n"), F.count("k").alias("keyed"))


@query(
    "messages_parsed_once",
    "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, count(DISTINCT coalesce(json_extract_string(props, '$.id'), json_extract_string(props, '$.k'), sha256(props))) AS keys FROM events GROUP BY 1",
)
def messages_parsed_once(spark, d):
    """Keys and columns of a message from one parse."""
    rows = keyed(table(spark, d, "events").select(c("props").alias("payload")), ["id", "k"])
    rows = rows.select("_dedup_key", *opened("_json", StructType([StructField("k", LongType())])))
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("_dedup_key").alias("keys"))


@query(
    "bucketed_join",
    "SELECT o_orderstatus, l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
)
def bucketed_join(spark, d):
    """Both sides bucketed by the order: the join itself shuffles nothing."""
    names = [f"finlake_{t}_{uuid.uuid4().hex}" for t in ("lines", "orders")]
    lines = buckets.write(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity"), names[0], "l_orderkey", 16)
    orders = buckets.write(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), names[1], "o_orderkey", 16)
    return lines.join(orders, c("l_orderkey") == c("o_orderkey")).groupBy("o_orderstatus", "l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("quantity")
    )
