"""The two streaming jobs: raw events to silver, silver to alerts.

Job 1 parses and validates events, drops repeats by arrival time, sends bad ones
to the dead-letter topic and the others to the silver table, then to the silver
topic. Job 2 reads silver topics: stateless rules in one query, sliding-window
rules in one each. Every table write is a keyed merge and every publication is
named by its batch, so that a repeated batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from finlake import domain
from finlake.functions.exprs import blank_to_null
from finlake.operators import quality
from finlake.plans.silver import TABLES
from finlake.sources.specs import CORRUPT, INGESTED, SOURCE_FILE, SPECS
from finlake.sources.store import TableStore

from . import bursts, rules
from .state import behind, use_rocksdb

c = F.col
ARRIVAL_WATERMARK, EVENT_WATERMARK, TRIGGER = "10 minutes", "3 days", "20 seconds"
DATASETS = ("bank_txn", "insurance_ops", "mobile_money", "loan_repayments")


# job 1
def parse_events(messages: DataFrame, dataset: str) -> DataFrame:
    """Envelope and the event's text columns, blanks as null, with the reason of the
    first broken rule and a key to tell repeats by."""
    spec = SPECS[dataset]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*spec.columns, INGESTED, SOURCE_FILE, "_bad")])
    rows = messages.withColumn("_v", F.from_json("payload", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    rows = rows.withColumn(CORRUPT, F.when(c("_v").isNull(), F.coalesce("payload", F.lit(""))).otherwise(c("_v._bad")))
    rows = rows.select(*messages.columns, CORRUPT, *[blank_to_null(c(f"_v.`{n}`")).alias(n) for n in (*spec.columns, INGESTED, SOURCE_FILE)])
    late = F.when(c(INGESTED).try_cast("timestamp").isNull(), F.lit(f"{INGESTED} non convertible en TIMESTAMP"))
    reason = F.coalesce(quality.rejection_reason(spec, c(CORRUPT), "message JSON illisible"), late)
    return rows.withColumn(quality.REASON, reason).withColumn("_dedup_key", F.coalesce(c(spec.key), F.sha2(F.coalesce("payload", F.lit("")), 256)))


def drop_repeats(rows: DataFrame, key: str = "_dedup_key", time: str = "kafka_timestamp", delay: str = ARRIVAL_WATERMARK) -> DataFrame:
    """One event a key within the watermark of its arrival; state is bounded by it."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def dead_letters(rows: DataFrame, dataset: str, stage: str, reason: str = quality.REASON, source: str | None = SOURCE_FILE) -> DataFrame:
    """Rejected messages with where they came from, and the message as it was."""
    return rows.where(c(reason).isNotNull()).select(
        F.lit(dataset).alias("dataset"), c("topic").alias("source_topic"), c("partition").alias("source_partition"), c("offset").alias("source_offset"), c("kafka_timestamp").alias("received_at"),
        c(reason).alias("rejection_reason"), (
            c(source) if source else F.lit(None).cast("string")
        ).alias("source_file"), F.lit(stage).alias("stage"), c("payload").alias("original_message"),
    )


def _trigger(writer, once: bool):
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TRIGGER)


def raw_to_silver(spark: SparkSession, bus, store: TableStore, dataset: str, checkpoints: str, once: bool = True, sides=None) -> StreamingQuery:
    """Start job 1 for one dataset. sides(table) gives the referentials: the raw tables, or
    buckets.Sides, which are dealt by key once a version instead of once a batch."""
    sides = sides or (lambda t: store.read("raw", t))
    spec, table = SPECS[dataset], TABLES[SPECS[dataset].table]
    events = drop_repeats(parse_events(bus.stream([domain.RAW_TOPICS[dataset]]), dataset))

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            name = f"r2s-{dataset}-{number}"
            bad = dead_letters(rows, dataset, "raw_to_silver")
            if not bad.isEmpty():
                bus.publish(bad, domain.DLQ_TOPIC, "dataset", name)
            good = rows.where(c(quality.REASON).isNull()).withColumn(INGESTED, c(INGESTED).try_cast("timestamp"))
            if good.isEmpty():
                return
            silver = table.build(quality.typed(good, spec), sides).persist()
            try:
                store.merge("silver", spec.table, silver, [spec.key, "country_code"], table.grain(store), unique=True)  # the table first, then the topic
                if dataset in domain.SILVER_TOPICS:
                    bus.publish(silver, domain.SILVER_TOPICS[dataset], "country_code", name)
            finally:
                silver.unpersist()
        finally:
            rows.unpersist()

    return _trigger(
        events.writeStream.queryName(f"raw_to_silver_{dataset}").option(
            "checkpointLocation", f"{checkpoints}/raw_to_silver/{dataset}",
        ).foreachBatch(batch),
        once,
    ).start()


# job 2
def _silver_schema(spark: SparkSession, store: TableStore, dataset: str) -> T.StructType:
    """The contract of a silver topic: the silver table's schema, or before the table
    exists the schema that job 1 gives it."""
    table = TABLES[SPECS[dataset].table]
    if store.exists("silver", SPECS[dataset].table):
        return store.read("silver", SPECS[dataset].table).schema
    empty = lambda name: spark.createDataFrame([], next(s.ddl for s in SPECS.values() if s.table == name))
    return table.build(empty(SPECS[dataset].table), empty).schema


def keyed(messages: DataFrame, keys: list[str]) -> DataFrame:
    """messages with _json, the payload parsed once (null if it is no JSON), and
    _dedup_key, the first of the keys that it holds or else its hash."""
    parsed = messages.withColumn("_json", F.try_parse_json("payload"))
    found = [F.try_variant_get("_json", f"$.{k}", "string") for k in keys]
    return parsed.withColumn("_dedup_key", F.coalesce(*found, F.sha2(F.coalesce("payload", F.lit("")), 256)))


def opened(value: str, schema: T.StructType) -> list[Column]:
    """The fields of a parsed message as columns; what does not fit its type is null."""
    return [F.try_variant_get(c(value), f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema]


def unit_rules(spark: SparkSession, bus, store: TableStore, checkpoints: str, once: bool = True) -> StreamingQuery:
    """Declaration threshold, foreign origin and excessive claims: one query over three
    topics. A message is parsed once, to a variant that its key and columns are taken from."""
    topics = domain.SILVER_TOPICS
    stream = drop_repeats(keyed(bus.stream(list(topics.values())), [SPECS[d].key for d in topics]))

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            name = f"unit-{number}"
            parsed = {}
            for dataset, topic in topics.items():
                own, key = rows.where(c("topic") == topic), F.try_variant_get("_json", f"$.{SPECS[dataset].key}", "string")
                bad = own.withColumn("_why", F.when(key.isNull(), F.lit(f"{SPECS[dataset].key} manquant")))
                lost = dead_letters(bad, dataset, "silver_to_gold", "_why", None)
                if not lost.isEmpty():
                    bus.publish(lost, domain.DLQ_TOPIC, "dataset", f"{name}-{dataset}")
                parsed[dataset] = own.where(key.isNotNull()).select(*opened("_json", _silver_schema(spark, store, dataset)))
            alerts = None
            if "bank_txn" in parsed:
                aml = rules.aml_events(parsed["bank_txn"]).dropDuplicates(["event_id"])
                _emit(store, bus, aml, "aml_events", "event_id", domain.AML_TOPIC, name)
            if "mobile_money" in parsed:
                alerts = rules.foreign_origin(parsed["mobile_money"])
            if "insurance_ops" in parsed and store.exists("silver", "accounts"):
                claims = rules.excessive_claims(parsed["insurance_ops"], store.read("silver", "accounts").dropDuplicates(["account_id"]))
                alerts = claims if alerts is None else alerts.unionByName(claims)
            if alerts is not None:
                _emit(store, bus, alerts.dropDuplicates(["alert_id"]), "fraud_alerts", "alert_id", domain.FRAUD_TOPIC, name)
        finally:
            rows.unpersist()

    return _trigger(
        stream.writeStream.queryName("unit_rules").option("checkpointLocation", f"{checkpoints}/silver_to_gold/unit").foreachBatch(batch), once,
    ).start()


def _emit(store: TableStore, bus, alerts: DataFrame, table: str, key: str, topic: str, batch: str, removed: str | None = None) -> None:
    """Table first, then topic: a crash between both repeats the topic's batch by the same
    name. Fraud alerts are dealt to a topic's partitions by their id, of which there are
    many. Alerts of which ``removed`` is true go from the table and are not published."""
    alerts = alerts.persist()
    try:
        if not alerts.isEmpty():
            store.merge("gold", table, alerts, [key, "country_code"], ["country_code"], removed=removed, unique=True)
            alive = alerts.where(~c(removed)).drop(removed) if removed else alerts
            if not removed or not alive.isEmpty():
                bus.publish(alive, topic, key if topic == domain.FRAUD_TOPIC else "country_code", batch)
    finally:
        alerts.unpersist()


def _silver_messages(spark: SparkSession, bus, store: TableStore) -> DataFrame:
    """Bank transactions of the topic."""
    rows = bus.stream([domain.SILVER_TOPICS["bank_txn"]])
    return rows.select(F.from_json("payload", _silver_schema(spark, store, "bank_txn")).alias("_v")).select("_v.*").where("transaction_id is not null")


def _silver_events(spark: SparkSession, bus, store: TableStore) -> DataFrame:
    """Bank transactions of the topic by event time, one a transaction."""
    return _silver_messages(spark, bus, store).withWatermark("timestamp", EVENT_WATERMARK).dropDuplicates(["transaction_id", "timestamp"])


def burst_rule(spark: SparkSession, bus, store: TableStore, checkpoints: str, once: bool = True) -> StreamingQuery:
    """One alert a burst, by keyed state: told when it opens and when it changes, final once
    the watermark has passed. The table holds what bursts_exact() finds in all that came."""
    use_rocksdb(spark)
    told = bursts.stream_bursts(rules.large(_silver_messages(spark, bus, store)), EVENT_WATERMARK)

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            sides = [rules.burst_alerts(rows.where((c("told") == bursts.WITHDRAWN) == gone)).withColumn("_removed", F.lit(gone)) for gone in (False, True)]
            _emit(store, bus, sides[0].unionByName(sides[1]).dropDuplicates(["alert_id"]), "fraud_alerts", "alert_id", domain.FRAUD_TOPIC, f"burst-{number}", "_removed")
        finally:
            rows.unpersist()

    return _trigger(
        told.writeStream.queryName("burst_rule").outputMode("append").option("checkpointLocation", f"{checkpoints}/silver_to_gold/burst_state").foreachBatch(batch), once
    ).start()


def burst_window_rule(spark: SparkSession, bus, store: TableStore, checkpoints: str, once: bool = True) -> StreamingQuery:
    """Bursts by sliding windows, in update mode: the last windows of a bounded run count too."""
    windows = rules.burst_windows(rules.large(_silver_events(spark, bus, store)))

    def batch(rows: DataFrame, number: int) -> None:
        _emit(
            store, bus, rules.burst_alerts(rules.collapse(rows)).dropDuplicates(["alert_id"]), "fraud_alerts", "alert_id", domain.FRAUD_TOPIC,
            f"burst-{number}",
        )

    return _trigger(
        windows.writeStream.queryName("burst_window_rule").outputMode("update").option(
            "checkpointLocation", f"{checkpoints}/silver_to_gold/burst",
        ).foreachBatch(batch),
        once,
    ).start()


def liquidity_rule(spark: SparkSession, bus, store: TableStore, checkpoints: str, once: bool = True) -> StreamingQuery:
    windows = rules.liquidity_windows(_silver_events(spark, bus, store))

    def batch(rows: DataFrame, number: int) -> None:
        stock = rules.outstanding(store.read("silver", "accounts"))
        _emit(store, bus, rules.liquidity_alerts(rows, stock), "liquidity_alerts", "alert_id", domain.LIQUIDITY_TOPIC, f"liquidity-{number}")

    return _trigger(
        windows.writeStream.queryName("liquidity_rule").outputMode("update").option(
            "checkpointLocation", f"{checkpoints}/silver_to_gold/liquidity",
        ).foreachBatch(batch),
        once,
    ).start()


RULES = {"unitaires": unit_rules, "rafales": burst_rule, "liquidite": liquidity_rule}
#: Also by name: bursts by sliding windows, with an alert for each first event of a window.
ALL_RULES = RULES | {"rafales_fenetres": burst_window_rule}


def supervise(queries: list[StreamingQuery], once: bool) -> list[str]:
    """Wait for all (once) or for the first to end; the messages of those that failed."""
    errors = []
    for q in queries:
        try:
            q.awaitTermination() if once else q.sparkSession.streams.awaitAnyTermination()
        except Exception as e:
            errors.append(f"{q.name}: {str(e)[:300]}")
        if not once:
            break
    for q in queries:
        if q.isActive:
            q.stop()
    return errors


def lag(query: StreamingQuery) -> int | None:
    """Messages that wait, by the last progress: what its sources say is behind the latest
    offset (Kafka does), else by files not yet read; None before there is a figure."""
    return behind((query.lastProgress or {}).get("sources", []))
