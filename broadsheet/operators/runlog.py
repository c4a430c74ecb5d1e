"""Analysis of run logs: one row per run, seven columns per stage."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.operators.lookup import groups_are_few, hint

# Run kinds by the prefix of their file name.
KINDS = {"SS": "Strong_Scaling", "WS": "Weak_Scaling", "W-": "Worker_Sweep"}

# Total columns and the stage metric each one is made from.
TOTALS = {
    "total_stage_time": ("time", "sum"),
    "average_stage_throughput": ("throughput", "mean"),
    "Total_Executor_Run_Time": ("executorRunTime", "sum"),
    "Total_Executor_CPU_Time": ("executorCpuTime", "sum"),
    "Total_JVM_GC_Time": ("jvmGCTime", "sum"),
}


def throughput(rows: Column, seconds: Column) -> Column:
    """Rows per second, 0 without any time."""
    return F.when(seconds > 0, rows / seconds).otherwise(F.lit(0.0))


def _plus(cols: list[Column], start: Column) -> Column:
    return reduce(lambda a, b: a + b, cols, start)


def run_totals(runs: DataFrame) -> DataFrame:
    """Sums and means over the stage columns of each run; missing stages are skipped.

    All stages of a run are in its row, so this is a projection without a shuffle.
    """
    totals = {}
    for name, (metric, how) in TOTALS.items():
        cols = [F.col(c) for c in runs.columns if re.fullmatch(rf"stage\d+_{metric}", c)]
        total = _plus([F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols], F.lit(0.0))
        present = _plus([c.isNotNull().cast("int") for c in cols], F.lit(0))
        totals[name] = total if how == "sum" else F.try_divide(total, present)
    return runs.withColumns(totals)


def label_runs(runs: DataFrame) -> DataFrame:
    workers, cores = F.col("num_workers"), F.col("cores_per_worker")
    name = F.concat(workers.cast("string"), F.lit("W-"), cores.cast("string"), F.lit("C"))
    return runs.withColumns({"config_name": name, "total_cores": workers * cores})


def cpu_efficiency(runs: DataFrame) -> DataFrame:
    """CPU time as percent of executor run time."""
    share = F.try_divide(F.col("Total_Executor_CPU_Time"), F.col("Total_Executor_Run_Time"))
    return runs.withColumn("CPU_Efficiency", share * 100)


def speedup(runs: DataFrame, kind: str = "scaling_type", tie: str = "run_id") -> DataFrame:
    """Throughput over that of the smallest run of the same kind, by total cores.

    The first run is found with min_by(), which is summed up in each task, so a kind that
    holds most of the runs needs no window of its own.
    """
    first = runs.groupBy(kind).agg(
        F.min_by("E2E_throughput", F.struct("total_cores", tie)).alias("_base")
    )
    joined = runs.join(hint(first, groups_are_few(runs, [kind])), kind)
    return joined.withColumn("speedup", F.try_divide("E2E_throughput", "_base")).drop("_base")


def tagged_union(groups: dict[str, DataFrame]) -> DataFrame:
    """Run tables of several kinds in one, with their kind; missing columns become null."""
    tagged = [df.withColumn("scaling_type", F.lit(kind)) for kind, df in groups.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def export_columns(runs: DataFrame) -> DataFrame:
    """Config, end-to-end and total columns without the stages, by kind and cores."""
    config = ["scaling_type", "num_workers", "cores_per_worker", "dataset_scale"]
    e2e = [c for c in runs.columns if c.startswith("E2E_")]
    kept = runs.select(*config, *e2e, *TOTALS)
    cores = F.col("num_workers") * F.col("cores_per_worker")
    return cpu_efficiency(kept.withColumn("total_cores", cores)).orderBy(
        "scaling_type", "total_cores"
    )


def unpivot_stages(runs: DataFrame, key: str = "run_id") -> DataFrame:
    """(run, stage, metric, value), one row for each filled stage column."""
    cols = [c for c in runs.columns if re.fullmatch(r"stage\d+_\w+", c)]
    numbers = runs.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    long = numbers.unpivot([key], cols, "column", "value").where("value is not null")
    return long.select(
        key,
        F.regexp_extract("column", r"^stage(\d+)_", 1).cast("int").alias("stage"),
        F.regexp_extract("column", r"^stage\d+_(.*)$", 1).alias("metric"),
        "value",
    )


def total_tasks(stages: DataFrame) -> DataFrame:
    return stages.agg(F.coalesce(F.sum("num_tasks"), F.lit(0)).alias("num_tasks"))
