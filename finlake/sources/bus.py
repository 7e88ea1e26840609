"""Topics: JSON-lines folders with a message envelope, or Kafka where its connector is.

A folder holds one sub-folder a topic and in it files that are written once. The
envelope is (topic, partition, offset, kafka_key, kafka_timestamp, payload). A
batch publishes under a name of its own: a repeated batch replaces its files, so a
later reader finds each message once. The new files have new names, so a stream that
runs meanwhile reads them as new messages, as a broker would deliver them again;
keyed merges and deduplication by key absorb that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "topic string, partition int, offset bigint, kafka_key string, kafka_timestamp timestamp, payload string"
MAX_PER_TRIGGER = 20_000


def messages(df: DataFrame, key: str | None, headers: DataFrame | None = None) -> DataFrame:
    """(kafka_key, payload) of rows: the key column, and all columns as JSON; with headers, which name the key, also these."""
    key_col = F.col(f"`{key}`").cast("string") if key else F.lit(None).cast("string")
    out = df.select(key_col.alias("kafka_key"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("payload"))
    return out if headers is None else out.join(headers.withColumnRenamed(key, "kafka_key"), "kafka_key", "left")


class FileBus:
    def __init__(self, spark: SparkSession, root: str, max_files: int = 50):
        self.spark, self.root, self.max_files = spark, root.rstrip("/"), max_files

    def publish(self, df: DataFrame, topic: str, key: str | None = None, batch: str = "0", headers: DataFrame | None = None) -> None:
        """Rows as messages: key column, to_json of all columns. headers: (key, headers) by key."""
        self.send(messages(df, key, headers), topic, batch)

    def send(self, messages: DataFrame, topic: str, batch: str = "0") -> None:
        """(kafka_key, payload) and, where there are any, headers, as they are."""
        more = ["headers"] if "headers" in messages.columns else []
        out = messages.select(
            F.lit(topic).alias("topic"), F.spark_partition_id().alias("partition"), F.monotonically_increasing_id().alias("offset"), "kafka_key",
            F.current_timestamp().alias("kafka_timestamp"), "payload", *more,
        )
        out.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{self.root}/{topic}/batch={batch}")

    def _ready(self, topics: list[str]) -> list[str]:
        spark = self.spark
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        out = []
        for t in topics:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{t}")
            p.getFileSystem(conf).mkdirs(p)
            out.append(f"{self.root}/{t}")
        return out

    def stream(self, topics: list[str]) -> DataFrame:
        """All topics as one stream."""
        out = None
        for path in self._ready(topics):
            one = self.spark.readStream.schema(ENVELOPE).option(
                "maxFilesPerTrigger", self.max_files,
            ).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(path)
            out = one if out is None else out.unionByName(one)
        return out

    def table(self, topic: str) -> DataFrame:
        """A topic's messages so far, as a relation."""
        return self.spark.read.schema(ENVELOPE).option("recursiveFileLookup", "true").json(self._ready([topic])[0])

    def values(self, topic: str, schema) -> DataFrame:
        """Messages parsed by a schema, with _timestamp, _partition_id, _partition_offset, _message."""
        parsed = self.table(topic).withColumn("_v", F.from_json("payload", schema))
        return parsed.select(
            "_v.*", F.col("kafka_timestamp").alias("_timestamp"), F.col("partition").alias("_partition_id"),
            F.col("offset").alias("_partition_offset"), F.col("payload").alias("_message"),
        )


class KafkaBus:
    """The same interface over the Kafka connector, for sessions that have its jar."""

    def __init__(self, spark: SparkSession, servers: str, starting: str = "earliest"):
        self.spark, self.servers, self.starting = spark, servers, starting

    def _options(self, topics: list[str]) -> dict[str, str]:
        return {
            "kafka.bootstrap.servers": self.servers, "subscribe": ",".join(topics), "startingOffsets": self.starting, "failOnDataLoss": "false",
            "kafka.isolation.level": "read_committed",
        }

    @staticmethod
    def _envelope(df: DataFrame) -> DataFrame:
        return df.selectExpr(
            "topic", "partition", "offset", "cast(key as string) as kafka_key", "timestamp as kafka_timestamp", "cast(value as string) as payload",
        )

    def stream(self, topics: list[str]) -> DataFrame:
        return self._envelope(
            self.spark.readStream.format("kafka").options(**self._options(topics)).option("maxOffsetsPerTrigger", MAX_PER_TRIGGER).load()
        )

    def table(self, topic: str) -> DataFrame:
        return self._envelope(self.spark.read.format("kafka").options(**self._options([topic])).load())

    values = FileBus.values
    publish = FileBus.publish

    def send(self, messages: DataFrame, topic: str, batch: str = "0") -> None:
        more = ["headers"] if "headers" in messages.columns else []
        out = messages.selectExpr("kafka_key as key", "payload as value", *more)
        out.write.format("kafka").options(**self._target(topic)).save()

    def _target(self, topic: str) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.servers, "topic": topic, "kafka.acks": "all", "kafka.enable.idempotence": "true"}
