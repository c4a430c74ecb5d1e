"""Article tables from CSV, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ARTICLE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.StringType()),  # may be dirty: see features.clean_label
    ]
)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = ARTICLE, multi_line: bool = False
) -> DataFrame:
    """Articles with a header line; quoted fields may hold doubled quotes.

    An empty field is null, quoted or not. With schema=None the types are inferred, which
    costs a pass over the data. Files are split among tasks by line; where quoted fields hold
    newlines, ask for multi_line, which reads a file in one task.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line)
    reader = reader.option("quote", '"').option("escape", '"')
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("header", True)
    writer.option("quote", '"').option("escape", '"').csv(path)


def drain(df: DataFrame) -> None:
    """Run the whole plan and throw the rows away, without sending them to the driver."""
    df.write.format("noop").mode("overwrite").save()
