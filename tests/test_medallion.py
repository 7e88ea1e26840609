"""Landing to gold, then streams to alerts, over generated files."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from finlake import cli, domain
from finlake.operators import core
from finlake.plans import analytics, gold, ingest, regulatory, silver
from finlake.sources import datagen, landing
from finlake.sources.bus import FileBus
from finlake.sources.specs import SPECS
from finlake.sources.store import DuplicateKeys, TableStore
from finlake.streaming import jobs

PLANTED = 3


@pytest.fixture(scope="module")
def made(spark):
    data = datagen.generate(spark, 120, 240, 300, anomalies=PLANTED)
    return {k: v.cache() for k, v in data.items()}


@pytest.fixture(scope="module")
def lake(spark, made, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    silver.BY_DAY = False  # 300 rows over 90 days and 8 countries: hundreds of folders of one row
    files = datagen.deposit(made, f"{root}/landing")
    with open(f"{root}/landing/CI/bank_txn/bank_txn_CI_20260401_01.csv", "w") as f:
        f.write(",".join(SPECS["bank_txn"].columns) + "\nx1,2026-01-01T00:00:00,a,,b,CI,TRANSFER,beaucoup,XOF,ATM,SUCCESS,0,BANK\nx2,2026-01-01T00:00:00,a,,b,CI,TRANSFER,1,GHS,ATM,SUCCESS,0,BANK\n")
    store = TableStore(spark, f"{root}/tables")
    done = {o.dataset: o for o in ingest.run(spark, store, f"{root}/landing")}
    assert not any(o.error for o in done.values()), done
    return root, store, done, files


def test_generated_data_is_sound(made):
    assert {k: v for k, v in datagen.conformance(made).items() if v} == {}


def test_deposited_files_conform(spark, lake, tmp_path):
    root, _, _, files = lake
    found = datagen.deposited(spark, f"{root}/landing")
    odd = {"bank_txn_currency_of_country", "bank_txn_account_id_orphans", "bank_txn_branch_id_orphans"}  # the fixture's broken rows
    assert len(found) >= 25 and {k for k, v in found.items() if v} <= odd
    bad = tmp_path / "CI" / "bank_txn"
    bad.mkdir(parents=True)
    (bad / "bank_txn_SN_20260101_01.csv").write_text("transaction_id\n1\n")
    (bad / "odd.csv").write_text("transaction_id\n1\n")
    got = datagen.deposited(spark, str(tmp_path))
    assert (got["referentials_missing"], got["names_off_pattern"], got["files_in_other_countries"]) == (4, 1, 1)


def test_numbers_and_shares_in_buckets(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    assert sorted(r.k for r in core.numbered(df, "k", F.col("id")).collect()) == list(range(500))
    rows = core.running_share(df, "s", "g", F.col("id"), F.col("id").cast("double")).collect()
    for g in range(3):
        own = sorted((r for r in rows if r.g == g), key=lambda r: r.s)
        steps = [b.s - a.s for a, b in zip(own, own[1:])]
        assert abs(own[-1].s - 1) < 1e-9 and all(abs(d - r.id / sum(x.id for x in own)) < 1e-9 for d, r in zip(steps, own[1:]))


def test_oracles_find_what_was_planted(made):
    assert datagen.find_bursts(made["bank_txn"]).count() == PLANTED
    assert datagen.find_foreign(made["mobile_money"], made["customers"]).count() == PLANTED
    assert datagen.find_claims(made["insurance_ops"], made["accounts"]).count() >= PLANTED
    assert datagen.find_aml(made["bank_txn"]).count() >= PLANTED


def test_clean_data_has_no_alerts(spark):
    data = datagen.generate(spark, 120, 240, 300, anomalies=0)
    assert datagen.find_bursts(data["bank_txn"]).count() == datagen.find_foreign(data["mobile_money"], data["customers"]).count() == 0
    ratio = data["insurance_ops"].groupBy("country_code", "product_line").agg((F.sum(F.when(F.col("operation_type") == "CLAIM_PAYMENT", F.col("amount"))) / F.sum(F.when(F.col("operation_type") != "CLAIM_PAYMENT", F.col("amount")))).alias("r")).where("r is not null")
    ratio = ratio.withColumn("goal", datagen.loss_target(F.col("country_code"), F.col("product_line"))).where("r is not null").collect()
    assert all(abs(x.r - x.goal) < 1e-6 for x in ratio) and len({x.goal for x in ratio}) > 10
    assert all(datagen.LOSS_RANGE[0] <= x.goal <= datagen.LOSS_RANGE[1] for x in ratio)
    again = datagen.generate(spark, 120, 240, 300, anomalies=0)
    assert data["bank_txn"].exceptAll(again["bank_txn"]).count() == 0


def test_ingest_quarantines_and_repeats_to_nothing(spark, lake):
    root, store, done, _ = lake
    assert done["bank_txn"].rejected == 2 and set(done["bank_txn"].reasons) == {"amount non convertible en DOUBLE", "devise incohérente avec le pays"}
    assert store.read("raw", "ingestion_rejects").count() == 2
    assert "beaucoup" in store.read("raw", "ingestion_rejects").orderBy("raw_record").first().raw_record
    again = ingest.run(spark, store, f"{root}/landing", ["bank_txn", "customers"], chunk=3)
    assert [o.inserted for o in again] == [0, 0]
    assert set(landing.discover(spark, f"{root}/landing", countries=["CI"])["bank_txn"][0].path.split("/")) >= {"CI"}
    assert len(ingest.bronze_views(store)) == 8


def test_silver_gold_report(spark, lake, made):
    root, store, *_ = lake
    out = silver.run(spark, store, window_days=0)
    assert not any("error" in o for o in out.values()), out
    assert out["bank_transactions"]["rows_out"] == made["bank_txn"].count()
    assert out["mobile_money_payments"]["outliers"] == PLANTED
    again = silver.run(spark, store, ["accounts", "bank_transactions"], window_days=0)
    assert [o["added"] for o in again.values()] == [0, 0]
    assert analytics.clear_text_columns(store) == []
    gold_out = gold.run(spark, store, window_days=0)
    assert not any("error" in o for o in gold_out.values()), gold_out
    assert all(o["added"] == 0 for o in gold.run(spark, store, window_days=0).values())
    npl = store.read("gold", "npl_ratio_by_country")
    assert npl.where("loan_type = 'ENSEMBLE' and npl_ratio > 0.09").count() == 0
    whole, parts = (npl.where(f"loan_type {op} 'ENSEMBLE'").agg(F.sum("nb_prets")).first()[0] for op in ("=", "<>"))
    assert whole == parts
    assert regulatory.run(spark, store, date(2026, 2, 3))["rows"] >= 1
    assert regulatory.run(spark, store, date(2026, 2, 3))["added"] == 0
    # a window cuts at whole days, so that a rerun changes no complete day
    day = store.read("gold", "daily_transaction_volume").drop("processed_at")
    before = {tuple(r) for r in day.collect()}
    gold.run(spark, store, ["daily_transaction_volume"], window_days=5)
    assert {tuple(r) for r in store.read("gold", "daily_transaction_volume").drop("processed_at").collect()} == before


def test_streams_agree_with_oracles_and_replay_to_nothing(spark, lake, made):
    root, store, *_ = lake
    if not store.exists("silver", "accounts"):
        silver.run(spark, store, window_days=0)
    gold.run(spark, store, ["daily_transaction_volume"], window_days=0)
    bus, live = FileBus(spark, f"{root}/bus"), TableStore(spark, f"{root}/tables")
    for name in domain.RAW_TOPICS:
        rows = made[name].select(*[F.col(k).cast("string").alias(k) for k in made[name].columns], F.lit("2026-04-01T00:00:00").alias("ingestion_timestamp"), F.lit("f.csv").alias("source_file"))
        bus.publish(rows, domain.RAW_TOPICS[name], "country_code", "1")
        bus.publish(rows.limit(5), domain.RAW_TOPICS[name], "country_code", "2")  # repeats
    bad = spark.createDataFrame([("CI", "nope"), ("CI", '{"amount": "1"}')], "kafka_key string, payload string")
    bus.send(bad, domain.RAW_TOPICS["bank_txn"], "3")

    def counts():
        return {t: live.read("gold", t).count() for t in ("fraud_alerts", "aml_events")} | {"silver": live.read("silver", "bank_transactions").count()}

    def play(tag):
        first = [jobs.raw_to_silver(spark, bus, live, d, f"{root}/{tag}") for d in jobs.DATASETS]
        assert jobs.supervise(first, True) == []
        second = [rule(spark, bus, live, f"{root}/{tag}") for rule in jobs.RULES.values()]
        assert jobs.supervise(second, True) == []

    play("checkpoints-1")
    dlq = bus.values(domain.DLQ_TOPIC, "rejection_reason string, stage string, original_message string")
    assert {r.rejection_reason for r in dlq.collect()} == {"message JSON illisible", "transaction_id manquant"}
    got = counts()
    kinds = {r.alert_type: r.n for r in live.read("gold", "fraud_alerts").groupBy("alert_type").agg(F.count("*").alias("n")).collect()}
    assert kinds["ORIGINE_INHABITUELLE"] == PLANTED and kinds["SINISTRE_EXCESSIF"] == datagen.find_claims(made["insurance_ops"], made["accounts"]).count()
    accounts = {r.account_id for r in datagen.find_bursts(made["bank_txn"]).collect()}
    assert {r.subject_id for r in live.read("gold", "fraud_alerts").where("alert_type = 'RAFALE_VIREMENTS'").collect()} == accounts
    assert got["aml_events"] == datagen.find_aml(made["bank_txn"]).count()
    play("checkpoints-2")  # checkpoints lost: everything is read again
    assert counts() == got

    analytics.register(spark, live, bus)
    for name in analytics.QUERIES:
        if name not in ("rapport_reglementaire", "kpis_reglementaires", "sinistralite_assurance", "corridors_mobile_money", "corridors_ponderes", "sante_kpi", "architecture_medaillon") or live.exists("gold", "regulatory_report"):
            analytics.run(spark, name).collect()
    health = analytics.run(spark, "qualite_silver").first()
    assert (health.doublons, health.conversions_fausses, health.iban_nuls_inattendus) == (0, 0, 0)
    assert {r.double_recepteur for r in analytics.run(spark, "alertes_de_fraude").collect()} == {"cohérent"}
    # what the batch consolidates after the stream leaves nothing to the live side
    gold.run(spark, live, ["daily_transaction_volume"], window_days=0)
    analytics.register(spark, live, bus)
    assert analytics.run(spark, "lambda_unifiee").where("operations_temps_reel > 0").count() == 0
    assert analytics.run(spark, "lambda_par_jour").where("operations_temps_reel > 0").count() == 0
    assert analytics.run(spark, "surveillance_aml").where("detenus_par_le_batch_seul <> 0").count() == 0
    for name, chart in analytics.CHARTS.items():
        if chart.source.startswith("silver") or live.exists("gold", chart.source.removeprefix("gold_")):
            assert analytics.chart(spark, name).count() > 0, name
    assert analytics.partition_health(live).count() == 6


def test_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.create("z", "t", "k int, p string, v int", ["p"])
    assert store.read("z", "t").count() == 0
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, p string, v int")
    assert store.merge("z", "t", rows, ["k"])["added"] == 2
    with pytest.raises(DuplicateKeys):
        store.merge("z", "t", rows.unionAll(rows), ["k"])
    wider = spark.createDataFrame([(2, "b", 5, "new")], "k int, p string, v int, w string")
    assert store.merge("z", "t", wider, ["k"])["added"] == 0
    assert {(r.k, r.v, r.w) for r in store.read("z", "t").collect()} == {(1, 1, None), (2, 5, "new")}
    assert store.merge("z", "t", wider.withColumn("v", F.lit(7)), ["k"], mode="insert_only")["added"] == 0
    store.merge("z", "t", spark.createDataFrame([(9, "b", 9, "x")], wider.schema), ["k"], mode="replace_partitions")
    assert {r.k for r in store.read("z", "t").collect()} == {1, 9}
    for k in range(3):
        store.append("z", "log", spark.range(10).repartition(3).withColumnRenamed("id", f"n{k}" if k else "id"))
    assert store.history("z", "log")[-1]["rows"] == 30 and "n2" in store.read("z", "log").columns
    assert len(store.files("z", "log")) > 1 and store.compact("z", "log")["rows"] == 30 and len(store.files("z", "log")) == 1
    assert [h["operation"] for h in store.history("z", "t")][:2] == ["create", "upsert"]
    assert store.partitions("z", "t").count() == 2


def test_store_rewrites_only_what_a_merge_touches(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = spark.createDataFrame([(k, f"a:{k % 4}" if k % 4 else None, k) for k in range(40)], "k int, p string, v int")
    store.merge("z", "t", rows, ["k", "p"], ["p"])
    before = {p["path"] for p in store.current("z", "t")["parts"]}
    store.merge("z", "t", rows.where("p = 'a:1'").withColumn("v", F.lit(-1)), ["k", "p"])
    after = {p["path"] for p in store.current("z", "t")["parts"]}
    assert len(before & after) == 3 and store.read("z", "t").count() == 40 and store.read("z", "t").where("v = -1").count() == 10
    store.merge("z", "t", spark.createDataFrame([(0, None, 9), (99, None, 9)], rows.schema), ["k", "p"], mode="insert_only")
    assert after < {p["path"] for p in store.current("z", "t")["parts"]}
    assert store.read("z", "t").where("p is null and v = 9").count() == 1
    assert store.current("z", "t")["rows"] == store.read("z", "t").count() == 41
    store.compact("z", "t")
    assert store.read("z", "t").count() == 41 and store.partitions("z", "t").where("file_count > 1").count() == 0
    now = store.read("z", "t")
    store.merge("z", "t", now.where("k < 5").withColumn("v", F.lit(5)), ["k", "p"])  # a source that reads the table itself
    assert store.read("z", "t").where("v = 5").count() >= 5 and store.read("z", "t").count() == 41


def test_a_day_is_merged_into_its_own_folders(spark, made, tmp_path, monkeypatch):
    """A one-day upsert leaves the folders of the other days as they are, also where the day is no key."""
    monkeypatch.setattr(silver, "BY_DAY", True)
    by = silver.TABLES["bank_transactions"].partitioning
    assert by == ["country_code", "transaction_date"] and silver.TABLES["accounts"].partitioning == ["country_code"]
    rows = made["bank_txn"].withColumn("transaction_date", F.to_date("timestamp")).where("country_code in ('CI', 'GH', 'SN') and transaction_date < date '2026-02-10'")
    store = TableStore(spark, str(tmp_path))
    store.merge("z", "t", rows, ["transaction_id", "country_code"], by)
    before = {p["path"] for p in store.current("z", "t")["parts"]}
    one = rows.agg(F.max("transaction_date")).first()[0]
    day = rows.where(F.col("transaction_date") == F.lit(one)).withColumn("channel", F.lit("ATM"))
    assert store.merge("z", "t", day, ["transaction_id", "country_code"])["added"] == 0
    after = {p["path"] for p in store.current("z", "t")["parts"]}
    assert all(f"transaction_date={one}" in p for p in before ^ after) and before ^ after and before & after
    assert store.read("z", "t").count() == rows.count() and store.read("z", "t").where(F.col("transaction_date") == F.lit(one)).where("channel <> 'ATM'").count() == 0


def test_a_key_that_moves_to_another_partition(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = spark.createDataFrame([(k, f"d{k % 3}", k) for k in range(9)], "k int, d string, v int")
    store.merge("z", "t", rows, ["k"], ["d"])
    store.merge("z", "t", spark.createDataFrame([(1, "d9", 100)], rows.schema), ["k"])
    assert {(r.k, r.d, r.v) for r in store.read("z", "t").where("k = 1").collect()} == {(1, "d9", 100)} and store.read("z", "t").count() == 9


def test_a_source_is_computed_once(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.append("z", "t", spark.range(3).selectExpr("id as k", "id as v"))
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: (seen.add(1), x)[1], "bigint")
    for mode in ("upsert", "insert_only"):
        before = seen.value
        store.merge("z", "t", spark.range(10, 30).select(count("id").alias("k"), F.col("id").alias("v")), ["k"], mode=mode)
        assert seen.value - before == 20


def test_compaction_meets_its_target_in_partitions(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    wide = spark.range(60_000).select("id", F.when(F.col("id") % 20 == 0, "small").otherwise("large").alias("p"), F.sha2(F.col("id").cast("string"), 512).alias("a"), F.sha2(F.concat(F.lit("x"), "id"), 512).alias("b"))
    for k in range(4):
        store.append("z", "t", wide.where(f"id % 4 = {k}"), ["p"])
    assert {r.file_count for r in store.partitions("z", "t").where("partition = 'p=large'").collect()} == {4} or store.partitions("z", "t").count() == 2
    store.compact("z", "t", target_mb=2)
    files = {}
    for path, size in store.files("z", "t"):
        files.setdefault(path.split("p=")[1].split("/")[0], []).append(size)
    assert len(files["small"]) == 1 and len(files["large"]) > 2
    assert all(s < 1.5 * (2 << 20) for s in files["large"]) and store.read("z", "t").count() == 60_000
    assert store.compact("z", "t", target_mb=2) is None  # as many files as the bytes need
    assert not any(f.name == "_drafts" and any(f.iterdir()) for f in tmp_path.iterdir())


def test_kafka_options(spark):
    from finlake.sources.bus import KafkaBus, messages

    bus = KafkaBus(spark, "h:9092", "latest")
    got = bus._options(["a", "b"])
    assert got["subscribe"] == "a,b" and got["startingOffsets"] == "latest" and got["kafka.bootstrap.servers"] == "h:9092" and got["kafka.isolation.level"] == "read_committed"
    assert bus._target("t")["topic"] == "t" and bus._target("t")["kafka.acks"] == "all"
    raw = spark.createDataFrame([("t", 1, 2, bytearray(b"k"), None, bytearray(b"{}"))], "topic string, partition int, offset bigint, key binary, timestamp timestamp, value binary")
    assert KafkaBus._envelope(raw).columns == ["topic", "partition", "offset", "kafka_key", "kafka_timestamp", "payload"]
    out = messages(spark.createDataFrame([("CI", 1)], "c string, n int"), "c").first()
    assert (out.kafka_key, out.payload) == ("CI", '{"c":"CI","n":1}')
    with pytest.raises(Exception, match="(?i)kafka"):
        bus.stream(["a"])  # no connector here: what is asked of it is right up to the source's name


def test_files_that_no_rule_routes_are_published(spark, tmp_path):
    import base64

    (tmp_path / "in/odd").mkdir(parents=True)
    (tmp_path / "in/odd/notes.bin").write_bytes(b"\xff\x00hello")
    bus = FileBus(spark, str(tmp_path / "bus"))
    for _ in range(2):  # the same files again add nothing
        assert landing.publish_rejects(spark, bus, str(tmp_path / "in")) == 1
    got = bus.values(domain.DLQ_TOPIC, "rejection_reason string, source_file string, stage string, original_message string").collect()
    assert [(r.stage, r.rejection_reason, base64.b64decode(r.original_message)) for r in got] == [("landing", "chemin non reconnu", b"\xff\x00hello")]


def test_young_files_wait(spark, tmp_path):
    header = ",".join(SPECS["bank_txn"].columns)
    (tmp_path / "new/CI/bank_txn").mkdir(parents=True)
    f = tmp_path / "new/CI/bank_txn/bank_txn_CI_20260101_01.csv"
    f.write_text(header + "\n")
    now = f.stat().st_mtime
    assert landing.settled(spark, str(tmp_path / "in"), str(tmp_path / "new"), 5, now + 1) == 0
    assert landing.settled(spark, str(tmp_path / "in"), str(tmp_path / "new"), 5, now + 6) == 1
    assert (tmp_path / "in/CI/bank_txn" / f.name).exists() and not f.exists()


def test_a_replayed_batch_while_a_stream_runs(spark, tmp_path):
    """A repeated publication reaches a running stream again, and the keyed merge absorbs it."""
    bus, store = FileBus(spark, str(tmp_path / "bus")), TableStore(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(k, k) for k in range(5)], "k int, v int")
    bus.publish(rows, "t", None, "1")
    seen = []

    def batch(df, n):
        got = df.select(F.from_json("payload", "k int, v int").alias("r")).select("r.*").dropDuplicates(["k"])
        seen.append(df.count())
        store.merge("z", "t", got, ["k"])

    def play():
        bus.stream(["t"]).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    play()
    bus.publish(rows, "t", None, "1")
    play()
    assert sum(seen) == 10 and store.read("z", "t").count() == 5 and bus.table("t").count() == 5


def test_commands_run(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli.session, "build", lambda **_: spark)
    w, land, bus = str(tmp_path / "w"), str(tmp_path / "l"), str(tmp_path / "b")
    run = lambda *a: cli.main([*a, "--warehouse", w])
    assert run("seed", "--landing", land, "--customers", "40", "--accounts", "60", "--rows", "60") == 0
    assert run("ingest", "--landing", land, "--bus", bus) == 0 and run("silver", "--window-days", "0") == 0 and run("gold", "--window-days", "0") == 0
    assert run("regulatory", "--report-date", "2026-02-03") == 0 and run("compact", "--tables", "accounts") == 0
    assert run("query", "--name", "soldes_par_pays") == 0 and run("query", "--name", "sante_partitionnement") == 0
    assert "0 files that no rule routes" in capsys.readouterr().out
    assert run("raw-to-silver", "--datasets", "bank_txn", "--bus", bus, "--checkpoints", str(tmp_path / "c"), "--once") == 0
    assert run("silver-to-gold", "--rules", "rafales", "--bus", bus, "--checkpoints", str(tmp_path / "c"), "--once") == 0


def test_analytic_values(spark, lake):
    """Values of the named queries against the tables they read."""
    root, store, *_ = lake
    if not store.exists("gold", "daily_transaction_volume"):
        silver.run(spark, store, window_days=0)
        gold.run(spark, store, window_days=0)
    analytics.register(spark, store)
    cut = {r.pays: (r.comptes, r.encours_devise_locale) for r in analytics.run(spark, "soldes_par_pays").collect()}
    want = store.read("raw", "accounts").groupBy("country_code").agg(F.count("*").alias("n"), F.sum("balance").alias("s")).collect()
    assert cut == {r.country_code: (r.n, round(r.s)) for r in want}
    volumes = {(r.pays, r.type_operation): r.volume for r in analytics.run(spark, "volumes_transactions").collect()}
    assert sum(volumes.values()) == store.read("raw", "bank_transactions").count()
    trace = {r.table_brute: r.lignes for r in analytics.run(spark, "tracabilite_ingestion").collect()}
    assert trace == {s.table: store.read("raw", s.table).count() for s in SPECS.values()}
    kpi = analytics.run(spark, "kpis_reglementaires").collect()
    assert {r.pays: r.nb_prets for r in kpi} == {r.country_code: r.nb_prets for r in store.read("gold", "npl_ratio_by_country").where("loan_type = 'ENSEMBLE'").collect()}
    assert all((r.statut_bceao != "conforme") == (r.npl_pct > 4) for r in kpi)
    who = {r.entite: r.clients for r in analytics.run(spark, "comptages_par_entite").collect()}
    assert who == {r.entity_type: r["count"] for r in store.read("raw", "customers").groupBy("entity_type").count().collect()}
    health = analytics.run(spark, "sante_kpi").first()
    assert health.npl_pays == len(kpi) and 0 <= health.npl_conformes <= health.npl_pays


def test_archive_and_event_stream(spark, tmp_path):
    root = tmp_path / "in"
    (root / "CI" / "bank_txn").mkdir(parents=True)
    header = ",".join(SPECS["bank_txn"].columns)
    (root / "CI" / "bank_txn" / "bank_txn_CI_20260101_01.csv").write_text(header + "\nt1,2026-01-01T00:00:00,a,,b,CI,TRANSFER,1,XOF,ATM,SUCCESS,0,BANK\n")
    events = landing.stream_events(spark, SPECS["bank_txn"], str(root))
    q = events.writeStream.format("memory").queryName("routed").trigger(availableNow=True).start()
    q.awaitTermination()
    row = spark.table("routed").first()
    assert row.topic == domain.RAW_TOPICS["bank_txn"] and '"transaction_id":"t1"' in row.payload and '"ingestion_timestamp"' in row.payload
    (root / "odd").mkdir()
    (root / "odd" / "notes.txt").write_text("hello")
    lost = landing.file_rejects(spark, str(root)).collect()
    assert [(r.stage, r.rejection_reason, r.original_message) for r in lost] == [("landing", "chemin non reconnu", "aGVsbG8=")]
    assert {h.key: bytes(h.value).decode() for h in lost[0].headers}["reason"] == "chemin non reconnu"
    found = landing.discover(spark, str(root))["bank_txn"]
    assert landing.archive(spark, landing.aged(found, 0), str(root), str(tmp_path / "old")) == (1, 0)
    assert (tmp_path / "old/CI/bank_txn/bank_txn_CI_20260101_01.csv").exists() and not landing.discover(spark, str(root))


def test_cli_parses():
    p = cli.parser()
    a = p.parse_args(["compact", "--warehouse", "w", "--countries", "CI,GH", "--min-input-files", "3"])
    assert a.countries == ["CI", "GH"] and a.target_size_mb == 32
    assert p.parse_args(["silver-to-gold", "--warehouse", "w", "--bus", "b", "--checkpoints", "c", "--rules", "rafales", "--once"]).rules == ["rafales"]
    assert str(p.parse_args(["regulatory", "--warehouse", "w", "--report-date", "2026-01-02"]).report_date) == "2026-01-02"
