"""The stream jobs: parse, clean, score and route article messages.

Each step is a DataFrame transformation that works the same on a batch.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from broadsheet.functions import text as tx
from broadsheet.functions.words import STOPWORDS
from broadsheet.operators.models import score
from broadsheet.sources.kafka import LABELLED, MALFORMED, PROCESSED, VERIFY

MESSAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "text", "title")])
_CORRUPT = "_corrupt"
_PARSED = T.StructType([*MESSAGE.fields, T.StructField(_CORRUPT, T.StringType())])


def parse(messages: DataFrame) -> DataFrame:
    """The fields of JSON messages, and the raw message where it cannot be read.

    An empty message and one without a value cannot be read either; both are kept as ''.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    data = messages.select("value", F.from_json("value", _PARSED, options).alias("data"))
    # A null struct is a message that holds no JSON at all.
    raw = F.when(F.col("data").isNull(), F.coalesce("value", F.lit(""))).otherwise(F.col(f"data.{_CORRUPT}"))
    return data.select(*[f"data.{f.name}" for f in MESSAGE.fields], raw.alias(_CORRUPT))


def good(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col(_CORRUPT).isNull()).drop(_CORRUPT)


def bad(parsed: DataFrame) -> DataFrame:
    """Malformed messages, for a log or a topic of their own."""
    return parsed.where(F.col(_CORRUPT).isNotNull()).select(F.col(_CORRUPT).alias("value"))


def clean(parsed: DataFrame, stopwords: list[str] = STOPWORDS) -> DataFrame:
    """Title and text cleaned and without stop words."""
    return parsed.withColumns(
        {c: tx.remove_stopwords(tx.clean(F.col(c)), stopwords) for c in ("title", "text")}
    )


def to_message(df: DataFrame) -> DataFrame:
    """All columns as one JSON column `value`."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def clean_messages(messages: DataFrame) -> DataFrame:
    """Messages in, cleaned messages out; `malformed` has the others."""
    return to_message(clean(good(parse(messages))))


def malformed(messages: DataFrame) -> DataFrame:
    """(topic, value): messages that cannot be read, as they came, for a topic of their own."""
    return bad(parse(messages)).select(F.lit(MALFORMED).alias("topic"), "value")


def clean_and_route(messages: DataFrame) -> DataFrame:
    """(topic, value): cleaned messages and malformed ones, each for its topic, in one pass."""
    parsed = parse(messages)
    is_bad = F.col(_CORRUPT).isNotNull()
    tidy = {c: tx.remove_stopwords(tx.clean(F.col(c)), STOPWORDS) for c in ("title", "text")}
    value = F.to_json(F.struct("source", tidy["text"].alias("text"), tidy["title"].alias("title")))
    return parsed.select(
        F.when(is_bad, MALFORMED).otherwise(PROCESSED).alias("topic"),
        F.when(is_bad, F.col(_CORRUPT)).otherwise(value).alias("value"),
    )


def with_label(df: DataFrame, p_real: str = "score") -> DataFrame:
    return df.withColumns(
        {"label": tx.real_or_fake(F.col(p_real)), "confidence": F.col(p_real).cast("double")}
    )


def with_topic(df: DataFrame, threshold: float = 0.8, literal: bool = False) -> DataFrame:
    """The topic of each scored article: unsure ones go to be verified.

    `confidence` is the probability of "real", so sureness is taken from either end;
    literal=True compares the probability itself, which also verifies every sure fake.
    """
    p = F.col("confidence")
    sure = p if literal else F.greatest(p, 1 - p)
    return df.withColumn("topic", F.when(sure < threshold, VERIFY).otherwise(LABELLED))


def score_and_route(messages: DataFrame, model: PipelineModel, text: str, **options) -> DataFrame:
    """(topic, value): cleaned messages scored by a model that reads column `text`; malformed
    ones go to their topic as they came."""
    parsed = parse(messages)
    scored = score(model, parsed.withColumn(text, F.coalesce("text", F.lit(""))))
    routed = with_topic(with_label(scored), **options)
    fields = ["source", "text", "title", "label", "confidence"]
    is_bad = F.col(_CORRUPT).isNotNull()
    return routed.select(
        F.when(is_bad, MALFORMED).otherwise(F.col("topic")).alias("topic"),
        F.when(is_bad, F.col(_CORRUPT)).otherwise(F.to_json(F.struct(*fields))).alias("value"),
    )


def first_seen(
    urls: DataFrame, time: str | None = None, delay: str = "1 hour", remember: str | None = None
) -> DataFrame:
    """Each address once.

    With a time column an address is kept until the watermark, `delay` behind the latest time,
    passes it. With `remember` addresses have no time of their own: each is kept for at least so long
    after it arrived, and may then come through again. Either way the state is bounded by the
    addresses of that span. With neither, an address is never forgotten and the state
    grows with the number of addresses.
    """
    if remember is not None:
        arrived = "_arrived"
        while arrived in urls.columns:
            arrived += "_"
        stamped = urls.withColumn(arrived, F.current_timestamp()).withWatermark(arrived, remember)
        return stamped.dropDuplicatesWithinWatermark(["url"]).drop(arrived)
    if time is None:
        return urls.dropDuplicates(["url"])
    return urls.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url"])


def write_files(df: DataFrame, path: str, checkpoint: str, by: str | None = None) -> DataStreamWriter:
    """Append to Parquet files, once each even after a restart; `by` makes a folder per topic."""
    writer = df.writeStream.outputMode("append").format("parquet")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return writer.partitionBy(by) if by else writer


def write_sinks(df: DataFrame, sinks: dict[str, str], checkpoint: str, by: str = "topic") -> DataStreamWriter:
    """Each batch to several Parquet sinks, the rows of a topic to the folder of that topic.

    A batch is written below its number and replaces what an earlier try of the same number has
    left, so a batch that stopped between two sinks and is run again doubles nothing. Rows of
    topics without a sink are not written. Read with `read_sink`.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()  # scored once for all sinks
        try:
            for topic, path in sinks.items():
                own = batch.where(F.col(by) == topic).drop(by)
                own.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a sink of `write_sinks`."""
    return spark.read.parquet(path).drop("batch")


def run_available(writer: DataStreamWriter) -> StreamingQuery:
    """Process what is there and stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
