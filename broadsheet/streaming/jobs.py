"""The stream jobs between Kafka topics. Each returns a writer: call start() on it."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from broadsheet.sources import kafka
from broadsheet.streaming import messages as ms


def publish(articles: DataFrame, servers: str, topic: str = kafka.SCRAPED) -> None:
    """Send a batch of articles (source, title, text) as messages."""
    sent = ms.to_message(articles.select("source", "text", "title"))
    writer = sent.write.format("kafka").option("kafka.bootstrap.servers", servers)
    writer.option("topic", topic).save()


def clean_topic(spark: SparkSession, servers: str, checkpoint: str) -> DataStreamWriter:
    """Scraped articles, cleaned, to the topic of processed ones, or to that of malformed ones."""
    scraped = kafka.read_topic(spark, servers, kafka.SCRAPED)
    return kafka.write_topic(ms.clean_and_route(scraped), servers, checkpoint)


def score_topic(
    spark: SparkSession, servers: str, checkpoint: str, model: PipelineModel, text: str, **options
) -> DataStreamWriter:
    """Processed articles, scored, to the topic of labelled ones, of those to be verified, or of
    malformed ones."""
    processed = kafka.read_topic(spark, servers, kafka.PROCESSED)
    routed = ms.score_and_route(processed, model, text, **options)
    return kafka.write_topic(routed, servers, checkpoint)
