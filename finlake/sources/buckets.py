"""Referentials as tables bucketed and sorted by their key, so that a join with them, and
their reduction to a row a key, needs no shuffle of them: the facts alone move."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from finlake.operators.core import deduplicate

from .store import TableStore

BUCKETS = 64
#: The key of each referential.
KEYS = {"accounts": "account_id", "customers": "customer_id", "branches": "branch_id"}


def write(df: DataFrame, name: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """df as a table of the session's warehouse, a file a bucket, and that table."""
    df.repartition(buckets, key).write.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


class Sides:
    """read(table) for SilverTable.build(): bucketed copies of a store's referentials, a row
    a key, made anew when the store has a new version. One for the life of a stream or a
    run of batches; close() drops the copies."""

    def __init__(self, spark: SparkSession, store: TableStore, buckets: int = BUCKETS):
        self.spark, self.store, self.buckets, self.made = spark, store, buckets, {}

    def __call__(self, table: str) -> DataFrame:
        version = self.store.current("raw", table)["version"]
        key = KEYS.get(table)
        if key is None:
            return self.store.read("raw", table)
        known, name = self.made.get(table, (None, None))
        if known != version:
            fresh = f"finlake_{table}_{uuid.uuid4().hex}"
            write(deduplicate(self.store.read("raw", table), key, [key]), fresh, key, self.buckets)
            self.made[table] = (version, fresh)
            if name:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        return self.spark.table(self.made[table][1])

    def close(self) -> None:
        for _, name in self.made.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.made.clear()
