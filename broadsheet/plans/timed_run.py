"""A timed run of the feature projection, logged like any other run."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators.features import replicate, with_features
from broadsheet.operators.order import head_fraction
from broadsheet.sources.articles import drain
from broadsheet.sources.eventlog import read_event_log, stage_metrics
from broadsheet.sources.runlogs import run_record, write_runs


def timed_run(
    spark: SparkSession,
    articles: DataFrame,
    key: str,
    config: dict[str, int | float | str],
    log_dir: str,
    name: str = "SS",
    copies: int = 3,
    event_log: str | None = None,
) -> DataFrame:
    """Features of int(rows * scale) rows out of `copies` times the articles.

    The rows are taken by hash, so the plan has no limit at its root and no row reaches the
    driver. Stage columns need the path of this application's event log.
    """
    scale = float(config["dataset_scale"])
    chosen = replicate(articles, copies, "_copy")
    if scale < 1:
        chosen = head_fraction(chosen.withColumn("_key", F.struct(key, "_copy")), "_key", scale)
        chosen = chosen.drop("_key")
    rows = chosen.count()
    featured = with_features(chosen.drop("_copy"))
    start = time.time()
    drain(featured)
    seconds = time.time() - start
    stages = []
    if event_log:
        since = int(start * 1000)
        done = stage_metrics(read_event_log(spark, event_log), since).orderBy("job_id", "stage_id")
        for stage in done.collect():  # a handful of stages of this run
            stages.append({**stage.asDict(), "numTasks": stage["num_tasks"]})
    record = run_record(spark, config, rows, seconds, stages)
    shape = f"{config['num_workers']}W-{config['cores_per_worker']}C"
    write_runs(record, f"{log_dir.rstrip('/')}/{name}_{shape}.csv")
    return record.withColumn("log_name", F.lit(f"{name}_{shape}"))
