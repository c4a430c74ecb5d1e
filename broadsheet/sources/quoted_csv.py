"""CSV files whose quoted fields hold newlines, read by many tasks.

A line break ends a record only if an even number of quotes stands before it. Spark's text
reader gives each task ranges of a file; the number of quotes of each range is counted first,
and the running sum over the ranges of a file, one row each, tells whether a range begins
within a field. Each task then puts the lines of its ranges together into records. What
a record has in other ranges is sent to be joined with it: two pieces a range at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.operators.lookup import hint, is_small

# kind 0 is a whole record, 1 the rest of one begun in an earlier range, 2 the start of one.
_PIECES = "path string, range bigint, kind int, first boolean, value string"


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, first): the records as text, and whether it is the first of its file. Empty ones are left out."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    sums = lines.groupBy("path", "range").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    inside = sums.select("path", "range", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    inside = inside.where("inside")  # one row a range at most
    if is_small(inside):
        told = lines.join(hint(inside, True), ["path", "range"], "left")  # keeps the lines in order
    else:
        numbered = lines.withColumn("at", F.monotonically_increasing_id())
        joined = numbered.join(inside, ["path", "range"], "left")
        told = joined.repartition("path", "range").sortWithinPartitions("path", "range", "at").drop("at")
    pieces = told.select("path", "range", "value", F.coalesce("inside", F.lit(False)).alias("inside")).mapInArrow(_assembled, _PIECES)
    whole = pieces.where("kind = 0").select("value", "first")
    parts = pieces.where("kind > 0")
    order = Window.partitionBy("path").orderBy("range", "kind")
    numbered = parts.withColumn("record", F.sum((F.col("kind") == 2).cast("int")).over(order))
    text = F.array_sort(F.collect_list(F.struct("range", "kind", "value")))
    joined = numbered.groupBy("path", "record").agg(
        F.array_join(F.transform(text, lambda p: p["value"]), "\n").alias("value"), F.max("first").alias("first")
    )
    return whole.unionByName(joined.select("value", "first")).withColumn("value", F.regexp_replace("value", r"\r\z", "")).where("value <> ''")


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the lines of one partition, range after range."""
    here, held, kind, first, open_ = None, [], 0, False, False
    out: list[tuple] = []

    def end_of_range() -> None:
        # A record of the file's end that has no newline after it is whole as well.
        if held:
            out.append((*here, 1 if kind == 1 else 2, first, "\n".join(held)))

    for batch in batches:
        for path, start, value, inside in zip(*(c.to_pylist() for c in batch.columns)):
            if (path, start) != here:
                end_of_range()
                here, held, open_ = (path, start), [], inside
                kind, first = (1 if inside else 0), start == 0
            held.append(value)
            open_ ^= value.count('"') % 2 == 1
            if not open_:
                out.append((*here, kind, first, "\n".join(held)))
                held, kind, first = [], 0, False
        if out:
            yield _batch(out)
            out.clear()
    end_of_range()
    yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
    columns = zip(*rows) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(columns, types)], names=["path", "range", "kind", "first", "value"]
    )


def read_quoted_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """The rows of CSV files with a header each; columns by position, doubled quotes in quoted fields.

    Quotes stand only around fields, as RFC 4180 asks. An empty field is null, quoted or not.
    """
    rows = records(spark, path).where(~F.col("first"))
    options = {"quote": '"', "escape": '"'}
    parsed = rows.select(F.from_csv("value", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("row"))
    return parsed.select("row.*")
