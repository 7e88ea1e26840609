"""Every query of the catalogue against the same query as SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from finlake.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def cells(df, columns):
    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or x != x:
            return "-"
        return repr(float(x)) if isinstance(x, float) else str(x).replace(" 00:00:00", "")

    return sorted(str([one(x) for x in r]) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, duck, name):
    got, want = catalogue.QUERIES[name](spark, data).toPandas(), duck.sql(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert cells(got, columns) == cells(want, columns)


def test_entry(spark, data):
    assert catalogue.entry(spark, data).count() == 25


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = catalogue.flag_aml(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice)" in plan or "In(o_orderpriority" in plan
    assert "o_orderstatus" not in plan
    dedup = catalogue.QUERIES["dedup_earliest"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in dedup


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plans_join_and_scan_what_they_read(spark, data):
    report = plan_of(catalogue.regulatory_report(spark, data))
    assert "s_suppkey" not in report and "r_name" not in report
    volumes = plan_of(catalogue.volumes_by_type(spark, data))
    assert "r_name" not in volumes and "percentile_approx" in volumes and "percentile_disc" not in volumes
    assert plan_of(catalogue.arpu_monthly(spark, data)).count("o_totalprice") and plan_of(catalogue.arpu_monthly(spark, data)).count("Relation [o_orderkey") == 1
