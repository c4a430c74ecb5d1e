"""Run-log queries: orders stand in for runs and their lines for stages."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from broadsheet.operators import runlog as rl
from broadsheet.operators.runlog import KINDS
from broadsheet.plans.base import query, rounded, table
from broadsheet.session import shared_dir, stored
from broadsheet.sources import runlogs

STAGES = 7
_MEASURES = {
    "time": "sum(l_quantity)",
    "throughput": "max(l_extendedprice)",
    "executorRunTime": "sum(l_quantity * 100)",
    "executorCpuTime": "sum(l_quantity * l_linenumber)",
    "jvmGCTime": "sum(l_suppkey / 2)",
    "recordsRead": "sum(l_partkey)",
    "bytesRead": "sum(l_suppkey)",
}
_STAGE_COLUMNS = {
    f"stage{i}_{m}": f"{measure} FILTER (WHERE l_linenumber = {i + 1})"
    for i in range(STAGES)
    for m, measure in _MEASURES.items()
}
# The status of an order as the kind of run.
_STATUS = {"F": "SS", "O": "WS", "P": "W-"}

_RUN_COLUMNS = {
    "run_id": "CAST(o_orderkey AS {text})",
    "status": "o_orderstatus",
    "num_workers": "CAST(substring(o_orderpriority, 1, 1) AS INT)",
    "mem_per_worker": "48",
    "cores_per_worker": "4",
    "dataset_scale": "CAST(0.5 AS DOUBLE)",
    "num_rows": "o_custkey",
    "num_stages": "CAST(coalesce(n, 0) AS INT)",
    "num_tasks": "CAST(coalesce(n, 0) AS INT)",
    "remark": "concat('\"', o_orderpriority, '\", run ', o_orderkey)",
}


def wide_runs(spark, folder):
    """One row per order, with seven columns for each of its line numbers."""
    # Seven sums for each line number, then one row per order: the rows that are shuffled are those of
    # the table, and not rows of all columns for each line.
    lines = table(spark, folder, "lineitem").repartition("l_orderkey")
    measures = [F.expr(f"{measure} AS {m}") for m, measure in _MEASURES.items()]
    numbered = lines.groupBy("l_orderkey", "l_linenumber").agg(*measures)
    aggs = [
        F.max(F.when(F.col("l_linenumber") == i + 1, F.col(m))).alias(f"stage{i}_{m}")
        for i in range(STAGES)
        for m in _MEASURES
    ]
    stages = numbered.groupBy("l_orderkey").agg(F.count("l_linenumber").alias("n"), *aggs)
    orders = table(spark, folder, "orders")
    joined = orders.join(stages, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.selectExpr(
        *[f"{sql.format(text='STRING')} AS {name}" for name, sql in _RUN_COLUMNS.items()],
        *_STAGE_COLUMNS,
        "o_totalprice / 1000 AS E2E_time",
        "CASE WHEN o_totalprice > 0 THEN o_custkey / (o_totalprice / 1000) ELSE 0 END AS E2E_throughput",
    )


def _wide_sql() -> str:
    stage = ", ".join(f"{measure} AS {name}" for name, measure in _STAGE_COLUMNS.items())
    columns = ", ".join(f"{sql.format(text='VARCHAR')} AS {name}" for name, sql in _RUN_COLUMNS.items())
    named = ", ".join(_STAGE_COLUMNS)
    return f"""runs AS (SELECT {columns}, {named}, o_totalprice / 1000 AS E2E_time,
      CASE WHEN o_totalprice > 0 THEN o_custkey / (o_totalprice / 1000) ELSE 0 END AS E2E_throughput
      FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, {stage}
        FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""


_WIDE = _wide_sql()


def _sum_sql(metric: str) -> str:
    return "(" + " + ".join(f"coalesce(stage{i}_{metric}, 0)" for i in range(STAGES)) + ")"


_THROUGHPUTS = "[" + ", ".join(f"stage{i}_throughput" for i in range(STAGES)) + "]"
_TOTALS = f"""totals AS (SELECT *, {_sum_sql("time")} AS total_stage_time,
  list_avg({_THROUGHPUTS}) AS average_stage_throughput,
  {_sum_sql("executorRunTime")} AS Total_Executor_Run_Time,
  {_sum_sql("executorCpuTime")} AS Total_Executor_CPU_Time, {_sum_sql("jvmGCTime")} AS Total_JVM_GC_Time FROM runs)"""
_TOTAL_NAMES = list(rl.TOTALS)
_ROUND_TOTALS = ", ".join(f"round({c}, 4) AS {c}" for c in _TOTAL_NAMES)
_KIND = "CASE status WHEN 'F' THEN 'Strong_Scaling' WHEN 'O' THEN 'Weak_Scaling' WHEN 'P' THEN 'Worker_Sweep' END"


def _tagged(spark, folder):
    runs = wide_runs(spark, folder)
    return rl.tagged_union(
        {KINDS[short]: runs.where(F.col("status") == status) for status, short in _STATUS.items()}
    )


@query(f"WITH {_WIDE}, {_TOTALS} SELECT run_id, {_ROUND_TOTALS} FROM totals")
def run_totals(spark, folder):
    return rl.run_totals(wide_runs(spark, folder)).select("run_id", *rounded(*_TOTAL_NAMES, places=4))


@query(f"""WITH {_WIDE} SELECT run_id, num_workers || 'W-' || cores_per_worker || 'C' AS config_name,
  num_workers * cores_per_worker AS total_cores FROM runs""")
def run_labels(spark, folder):
    return rl.label_runs(wide_runs(spark, folder)).select("run_id", "config_name", "total_cores")


@query(f"""WITH {_WIDE}, {_TOTALS} SELECT run_id,
  round(Total_Executor_CPU_Time / nullif(Total_Executor_Run_Time, 0) * 100, 6) AS CPU_Efficiency FROM totals""")
def cpu_efficiency(spark, folder):
    out = rl.cpu_efficiency(rl.run_totals(wide_runs(spark, folder)))
    return out.select("run_id", *rounded("CPU_Efficiency"))


@query("""
SELECT o_orderkey, round(CASE WHEN o_totalprice > 0 THEN o_custkey / o_totalprice ELSE 0 END, 6) AS throughput
FROM orders
""")
def throughput(spark, folder):
    rate = rl.throughput(F.col("o_custkey"), F.col("o_totalprice"))
    return table(spark, folder, "orders").select("o_orderkey", F.round(rate, 6).alias("throughput"))


@query(f"""WITH {_WIDE} SELECT run_id, {_KIND} AS scaling_type,
  round(E2E_throughput / first_value(E2E_throughput) OVER (PARTITION BY status
    ORDER BY num_workers * cores_per_worker, run_id), 6) AS speedup FROM runs""")
def speedup(spark, folder):
    out = rl.speedup(rl.label_runs(_tagged(spark, folder)))
    return out.select("run_id", "scaling_type", *rounded("speedup"))


@query(f"WITH {_WIDE} SELECT run_id, {_KIND} AS scaling_type, round(E2E_time, 6) AS E2E_time FROM runs")
def tagged_union(spark, folder):
    return _tagged(spark, folder).select("run_id", "scaling_type", *rounded("E2E_time"))


_EXPORT_NAMES = ["E2E_time", "E2E_throughput", *_TOTAL_NAMES]


@query(f"""WITH {_WIDE}, {_TOTALS} SELECT {_KIND} AS scaling_type, num_workers, cores_per_worker, dataset_scale,
  {", ".join(f"round({c}, 6) AS {c}" for c in _EXPORT_NAMES)}, num_workers * cores_per_worker AS total_cores,
  round(Total_Executor_CPU_Time / nullif(Total_Executor_Run_Time, 0) * 100, 6) AS CPU_Efficiency FROM totals""")
def exported_metrics(spark, folder):
    """Written as CSV and read back."""
    path = f"{shared_dir(spark, 'metrics')}/processed_metrics.csv"
    runlogs.write_metrics(rl.export_columns(rl.run_totals(_tagged(spark, folder))), path)
    back = spark.read.option("header", True).option("inferSchema", True).csv(path)
    rounding = {c: F.round(c, 6) for c in [*_EXPORT_NAMES, "CPU_Efficiency"]}
    return back.withColumns(rounding)


_LONG = " UNION ALL ".join(
    f"SELECT run_id, {i} AS stage, '{m}' AS metric, round(stage{i}_{m}::DOUBLE, 4) AS value FROM runs "
    f"WHERE stage{i}_{m} IS NOT NULL"
    for i in range(STAGES)
    for m in _MEASURES
)


@query(f"WITH {_WIDE} {_LONG}")
def stage_values(spark, folder):
    out = rl.unpivot_stages(wide_runs(spark, folder))
    return out.withColumn("value", F.round("value", 4))


def _logs(spark, folder) -> str:
    """The runs as CSV logs, each in the file of its kind and its highest stage."""
    base = shared_dir(spark, "logs")
    runs = wide_runs(spark, folder)
    last = F.greatest(*[F.when(F.col(f"stage{i}_time").isNotNull(), i + 1).otherwise(0) for i in range(STAGES)])
    runs = stored(runs.withColumn("last", last), "runs")

    def write(log: tuple[str, str, int]) -> None:
        status, short, stages = log
        spare = [c for c in runs.columns if c.startswith("stage") and int(c[5]) >= stages]
        part = runs.where((F.col("status") == status) & (F.col("last") == stages))
        runlogs.write_runs(part.drop("status", "last", *spare), f"{base}/{short}{stages}.csv")

    logs = [(status, short, stages) for status, short in _STATUS.items() for stages in range(STAGES + 1)]
    with ThreadPool(8) as pool:
        pool.map(inheritable_thread_target(spark)(write), logs)
    return base


_READ_STAGES = ", ".join(f"round(stage{i}_{m}, 4) AS stage{i}_{m}" for i in range(STAGES) for m in ("time", "recordsRead"))


@query(f"""WITH {_WIDE} SELECT run_id, {_KIND} AS scaling_type, remark, num_rows, {_READ_STAGES},
  round(E2E_time, 6) AS E2E_time FROM runs""")
def read_runs(spark, folder):
    runs = runlogs.read_runs(spark, _logs(spark, folder))
    names = [f"stage{i}_{m}" for i in range(STAGES) for m in ("time", "recordsRead")]
    stages = [F.round(n, 4).alias(n) for n in names]
    return runs.select("run_id", "scaling_type", "remark", "num_rows", *stages, *rounded("E2E_time"))


@query(f"WITH {_WIDE} SELECT run_id, round(E2E_time, 6) AS E2E_time, 'logs' AS log_dir FROM runs")
def sorted_results(spark, folder):
    runs = runlogs.read_results(spark, _logs(spark, folder))
    short = F.regexp_extract("log_dir", r"/(logs)-[0-9a-f]+$", 1)
    return runs.select("run_id", *rounded("E2E_time"), short.alias("log_dir"))
