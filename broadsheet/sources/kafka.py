"""Kafka topics as streaming sources and sinks. Needs Spark's Kafka connector package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

# Topic names.
SCRAPED, PROCESSED = "scraped-data", "processed-data"
LABELLED, VERIFY = "labelled-data", "verify-data"
MALFORMED = "malformed-data"  # our own


def read_topic(spark: SparkSession, servers: str, topic: str, per_batch: int | None = None) -> DataFrame:
    """Messages of a topic as column `value`, a string."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("failOnDataLoss", "false")
        .option("subscribe", topic)
    )
    if per_batch:
        reader = reader.option("maxOffsetsPerTrigger", per_batch)
    return reader.load().selectExpr("CAST(value AS STRING) AS value")


def write_topic(
    messages: DataFrame, servers: str, checkpoint: str, topic: str | None = None
) -> DataStreamWriter:
    """Writer of column `value`, to one topic or to the one named in column `topic`."""
    writer = (
        messages.writeStream.outputMode("append")
        .format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("checkpointLocation", checkpoint)
    )
    return writer.option("topic", topic) if topic else writer
