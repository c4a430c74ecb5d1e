"""Run logs: CSV files whose header depends on the number of stages."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.operators.runlog import KINDS

# Names and types of the columns that are not double.
_INT = ["num_workers", "mem_per_worker", "cores_per_worker", "num_stages", "num_tasks"]
_LONG = ["num_rows"]
# Measures of one stage, in file order.
STAGE_METRICS = [
    "time", "throughput", "executorRunTime", "executorCpuTime", "jvmGCTime", "recordsRead", "bytesRead",
]


def _schema(header: str) -> T.StructType:
    def kind(name: str) -> T.DataType:
        if name in _INT:
            return T.IntegerType()
        if name in _LONG or re.fullmatch(r"stage\d+_(recordsRead|bytesRead)", name):
            return T.LongType()
        return T.StringType() if name in ("remark", "run_id") else T.DoubleType()

    return T.StructType([T.StructField(n, kind(n)) for n in header.split(",")])


def _as_path(uri: str) -> str:
    """The path to give to a reader, with what it would take as a pattern escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def read_runs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All runs in one wide table, with their kind and the folder they came from.

    One pass over the lines finds the header of each file. Files with the same header, which
    depends on the number of stages, are then one CSV scan with the schema of that header, and the scans are united by
    name, so nothing is joined and Spark's reader does the parsing. Columns a run does not have
    are null, and so are values that do not fit their column. The kind is taken from the start of the name of the file, or of the folder a
    Spark job wrote.
    """
    lines = spark.read.text(paths, recursiveFileLookup=True, pathGlobFilter="*.csv")
    is_head = F.col("value").rlike("^(run_id,)?num_workers,")
    heads = lines.where(is_head).select("value", F.col("_metadata.file_path").alias("path")).distinct()
    # One row per different header; the paths are those that Spark's file index holds.
    by_head = heads.groupBy("value").agg(F.sort_array(F.collect_set("path")).alias("paths")).collect()
    if not by_head:
        raise ValueError(f"no run log below {paths}")

    def scan(head: str, files: list[str]) -> DataFrame:
        reader = spark.read.schema(_schema(head)).option("header", True).option("escape", '"')
        return reader.csv([_as_path(f) for f in files]).withColumn("_path", F.col("_metadata.file_path"))

    # The widest header first: its columns are those of all others, in order.
    scans = [scan(r["value"], r["paths"]) for r in sorted(by_head, key=lambda r: len(r["value"]), reverse=True)]
    runs = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    prefix = F.regexp_extract("_path", r".*/(SS|WS|W-)[^/]*\.csv(?:/[^/]*)?$", 1)
    kind = F
    for short, name in KINDS.items():
        kind = kind.when(prefix == short, name)
    folder = F.regexp_replace("_path", r"/[^/]*\.csv(/part-[^/]*)?$", "")
    return runs.withColumns({"scaling_type": kind.otherwise(None), "log_dir": folder}).drop("_path")


def read_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The same, fastest run first."""
    return read_runs(spark, paths).orderBy("E2E_time")


def write_runs(runs: DataFrame, path: str) -> None:
    """One log: the name of the folder must start with the short kind and end in .csv."""
    runs.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_metrics(exported: DataFrame, path: str) -> None:
    exported.write.mode("overwrite").option("header", True).csv(path)


def run_record(
    spark: SparkSession,
    config: dict[str, int | float | str],
    num_rows: int,
    seconds: float,
    stages: list[dict[str, float]],
) -> DataFrame:
    """One-row run log: config, stage columns in order, end-to-end time and throughput."""
    row: dict[str, object] = {
        "num_workers": int(config["num_workers"]),
        "mem_per_worker": int(config["mem_per_worker"]),
        "cores_per_worker": int(config["cores_per_worker"]),
        "dataset_scale": float(config["dataset_scale"]),
        "num_rows": int(num_rows),
        "num_stages": len(stages),
        "num_tasks": int(sum(s.get("numTasks", 0) for s in stages)),
        "remark": str(config.get("remark", "")),
    }
    for i, stage in enumerate(stages):
        for metric in STAGE_METRICS:
            whole = metric in ("recordsRead", "bytesRead")
            row[f"stage{i}_{metric}"] = (int if whole else float)(stage.get(metric, 0))
    row["E2E_time"] = float(seconds)
    row["E2E_throughput"] = num_rows / seconds if seconds > 0 else 0.0
    return spark.createDataFrame([tuple(row.values())], _schema(",".join(row)))
