"""Specs, routing, casts, masks and rules on small rows."""

import pytest
from pyspark.sql import functions as F

from finlake import domain
from finlake.functions import exprs
from finlake.operators import core, quality
from finlake.sources import landing
from finlake.sources.specs import CORRUPT, ORDER, SPECS
from finlake.streaming import rules


@pytest.mark.parametrize(
    "path, name",
    [("a/referentials/customers.csv", "customers"), ("a/CI/bank_txn/bank_txn_CI_20260101_01.csv", "bank_txn"), ("a/CI/unknown/x.csv", ""), ("x.csv", ""), ("a/referentials/bank_txn.csv", ""), ("a/CI/bank_txn/x.json", "")],
)
def test_dataset_of_path(path, name):
    assert landing.dataset_of(path) == name


def test_specs():
    assert len(SPECS) == 8 and all(SPECS[n].is_referential for n in ORDER[:4])
    for s in SPECS.values():
        assert s.key in s.required and {"country_code", "entity_type"} <= set(s.columns)
        assert "ingestion_timestamp timestamp" in s.ddl.replace("`", "") and CORRUPT in s.text_schema.names
    assert len(domain.COUNTRIES) == 8 and len({*domain.RAW_TOPICS.values(), *domain.SILVER_TOPICS.values()}) == 7


def test_grace_and_chunks():
    files = [landing.Landed(f"f{k}", "bank_txn", 1000.0 + 60 * k, 1) for k in range(10)]
    assert len(landing.aged(files, 5, now=1000 + 600)) == 6
    assert landing.aged(files, 0) == files and [len(x) for x in landing.chunks(files, 4)] == [4, 4, 2]


def test_parse(spark):
    rows = spark.createDataFrame([("12.0",), ("12",), ("beaucoup",), ("",), (None,), ("-3.7",), ("2026-01-05T10:00:00",)], "t string")
    got = rows.select(exprs.parse(F.col("t"), "int").alias("i"), exprs.parse(F.col("t"), "double").alias("d"), exprs.parse(F.col("t"), "date").cast("string").alias("day")).collect()
    assert [r.i for r in got] == [12, 12, None, None, None, -3, None]
    assert got[0].d == 12.0 and got[2].d is None and got[6].day == "2026-01-05"


@pytest.mark.parametrize("value, keep, prefix, want", [("CI93CI1010010100000000000123", 4, 2, "CI" + "*" * 22 + "0123"), ("12345678", 4, 0, "****5678"), ("123456", 4, 2, "******"), ("", 4, 0, ""), (None, 4, 2, None)])
def test_mask(spark, value, keep, prefix, want):
    row = spark.createDataFrame([(value,)], "v string").select(exprs.mask_tail(F.col("v"), keep, prefix).alias("m")).first()
    assert row.m == want == exprs.mask_text(value, keep, prefix)


def test_token(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string").select(exprs.token(F.col("v"), "k").alias("t"), exprs.token(F.col("v"), "other").alias("o")).collect()
    assert rows[0].t == rows[1].t == exprs.token_of("a", "k") and rows[0].t != rows[2].t and rows[0].t != rows[0].o
    assert rows[3].t is None and len(rows[0].t) == 32


def _txn(**change):
    row = dict(transaction_id="t", timestamp="2026-01-01T00:00:00", account_id="a", beneficiary_account=None, branch_id="b", country_code="CI", transaction_type="TRANSFER", amount="10.5", currency="XOF", channel="ATM", transaction_status="SUCCESS", fee_amount="0", entity_type="BANK")
    return row | change | {CORRUPT: change.get(CORRUPT)}


@pytest.mark.parametrize(
    "change, why",
    [
        ({}, None), ({CORRUPT: "x"}, "ligne illisible"), ({"transaction_id": None}, "transaction_id manquant"), ({"amount": "beaucoup"}, "amount non convertible en DOUBLE"), ({"country_code": "FR"}, "country_code hors périmètre"),
        ({"channel": "FAX"}, "channel hors nomenclature"), ({"currency": "GHS"}, "devise incohérente avec le pays"), ({"entity_type": "MICROFINANCE"}, "entité absente de ce pays"), ({"amount": "-1"}, "amount négatif"), ({"amount": None}, None),
        ({"transaction_id": None, "amount": "x"}, "transaction_id manquant"), ({"timestamp": "hier"}, "timestamp non convertible en TIMESTAMP"), ({"country_code": "GH", "currency": "GHS", "entity_type": "MICROFINANCE"}, "entité absente de ce pays"),
    ],
)
def test_rejection(spark, change, why):
    spec = SPECS["bank_txn"]
    row = _txn(**change)
    df = spark.createDataFrame([tuple(row[n] for n in spec.text_schema.names)], spec.text_schema)
    assert df.select(quality.rejection_reason(spec).alias("r")).first().r == why


def test_dedup_is_stable(spark):
    rows = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("k", 1, "c"), ("j", 5, "z")], "k string, o int, v string")
    first = {r.k: r.v for r in core.deduplicate(rows, "k", ["o"]).collect()}
    again = {r.k: r.v for r in core.deduplicate(rows.repartition(3), "k", ["o"]).collect()}
    assert first == again and first["j"] == "z" and first["k"] in ("a", "c")
    assert {r.v for r in core.deduplicate(rows, "k", ["o"], "latest").where("k = 'k'").collect()} == {"b"}


def test_recent(spark):
    rows = spark.sql("select timestamp'2026-01-31 12:00:00' - make_interval(0,0,0,d) as timestamp from (select explode(sequence(0, 20)) d)")
    assert core.recent(rows, "timestamp", 7).count() == 8
    assert core.recent(rows, "timestamp", 7, "month").count() == 21
    assert core.recent(rows, "timestamp", 0).count() == core.recent(rows, "nope", 3).count() == 21
    assert core.recent(rows.where("false"), "timestamp", 3).count() == 0


def test_upsert_matches_null_keys_and_widens(spark):
    old = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "k string, s string, v int")
    new = spark.createDataFrame([("a", None, 9, True), ("c", None, 3, False)], "k string, s string, v int, w boolean")
    got = {(r.k, r.s): (r.v, r.w) for r in core.upsert(old, new, ["k", "s"]).collect()}
    assert got == {("a", None): (9, True), ("b", "x"): (2, None), ("c", None): (3, False)}
    assert {r.k: r.v for r in core.upsert(old, new, ["k", "s"], True).collect()} == {"a": 1, "b": 2, "c": 3}


def _events(spark, seconds):
    rows = [("acc", "CI", "BANK", "XOF", 600_000.0, 900.0, 1_767_225_600 + s) for s in seconds]
    return spark.createDataFrame(rows, "account_id string, country_code string, entity_type string, currency string, amount double, amount_eur double, s long").withColumn("timestamp", F.timestamp_seconds("s"))


@pytest.mark.parametrize("seconds, exact, sliding", [([10, 140, 270], 1, True), ([50, 180, 310], 1, False), ([0, 70, 90, 110], 1, True), ([0, 100, 400], 0, False), ([0, 1, 2, 1000, 1001, 1002], 2, True)])
def test_bursts_exact_and_sliding(spark, seconds, exact, sliding):
    rows = rules.large(_events(spark, seconds))
    assert rules.bursts_exact(rows).count() == exact
    found = rules.collapse(rules.burst_windows(rows))
    assert (found.count() > 0) is sliding
    if seconds == [0, 70, 90, 110]:  # windows that start later have another first event
        assert found.count() == 2
    for a in rules.burst_alerts(found).collect():
        assert a.alert_type == "RAFALE_VIREMENTS" and len(a.alert_id) == 32 and "virements > 500,000 XOF" in a.detail


def test_no_bare_casts_of_text():
    """Untyped text is converted by parse() or try_cast alone."""
    import inspect

    from finlake.operators import quality as q

    assert ".cast(" not in inspect.getsource(q)
