"""Stage metrics from Spark's own event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators.runlog import throughput

# The fields used of the events JobStart and StageCompleted.
JOB_START = "Event string, `Job ID` long, `Stage IDs` array<long>"
STAGE_COMPLETED = """
  Event string,
  `Stage Info` struct<
    `Stage ID`: long, `Number of Tasks`: long, `Submission Time`: long, `Completion Time`: long,
    Accumulables: array<struct<Name: string, Value: string>>>
"""

# Metric names and the accumulables Spark keeps them in.
ACCUMULABLES = {
    "executorRunTime": "internal.metrics.executorRunTime",
    "executorCpuTime": "internal.metrics.executorCpuTime",
    "jvmGCTime": "internal.metrics.jvmGCTime",
    "recordsRead": "internal.metrics.input.recordsRead",
    "bytesRead": "internal.metrics.input.bytesRead",
}


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an event log folder or file, as column `value`."""
    return spark.read.option("recursiveFileLookup", True).text(path)


def stage_metrics(lines: DataFrame, since: int = 0) -> DataFrame:
    """One row per completed stage: job, tasks, time in seconds, executor times in ms.

    `since` leaves out stages submitted before that time, in milliseconds of the epoch.
    """

    def events(kind: str, fields: str) -> DataFrame:
        # Most lines are about single tasks: they are passed over before they are parsed.
        of_kind = lines.where(F.col("value").contains(f'"{kind}"'))
        parsed = of_kind.select(F.from_json("value", fields).alias("e")).select("e.*")
        return parsed.where(F.col("Event") == kind)

    jobs = (
        events("SparkListenerJobStart", JOB_START)
        .select(F.explode("Stage IDs").alias("stage_id"), F.col("Job ID").alias("job"))
        .groupBy("stage_id")
        .agg(F.min("job").alias("job_id"))  # a reused stage belongs to its first job
    )
    info = F.col("Stage Info")
    completed = events("SparkListenerStageCompleted", STAGE_COMPLETED)
    done = completed.where(info["Submission Time"] >= since).select(
        info["Stage ID"].alias("stage_id"),
        info["Number of Tasks"].alias("num_tasks"),
        ((info["Completion Time"] - info["Submission Time"]) / 1000).alias("time"),
        info["Accumulables"].alias("acc"),
    )

    def value_of(name: str):
        of_name = F.filter("acc", lambda a: a["Name"] == name)
        total = F.aggregate(
            of_name, F.lit(0).cast("long"), lambda s, a: s + F.coalesce(a["Value"].try_cast("long"), F.lit(0))
        )
        return F.coalesce(total, F.lit(0))

    measured = done.select(
        "stage_id", "num_tasks", "time", *[value_of(a).alias(m) for m, a in ACCUMULABLES.items()]
    )
    # CPU time is logged in nanoseconds, the other times in milliseconds.
    measured = measured.withColumn("executorCpuTime", F.floor(F.col("executorCpuTime") / 1_000_000))
    measured = measured.withColumn("throughput", throughput(F.col("recordsRead"), F.col("time")))
    return measured.join(jobs, "stage_id", "left").select(
        "job_id", "stage_id", "num_tasks", "time", "throughput", *ACCUMULABLES
    )
