"""Run logs with different headers, the session's own event log, and a timed run."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import runlog as rl
from broadsheet.plans.timed_run import timed_run
from broadsheet.sources import runlogs
from broadsheet.sources.articles import drain, read_csv, write_csv
from broadsheet.sources.eventlog import read_event_log, stage_metrics

HEAD = "num_workers,mem_per_worker,cores_per_worker,dataset_scale,num_rows,num_stages,num_tasks,remark"


def write_log(path, workers, stages, e2e):
    names = [f"stage{i}_{m}" for i in range(len(stages)) for m in runlogs.STAGE_METRICS]
    cells = [v for s in stages for v in (s, s * 10, s * 1000, s * 500, s * 20, int(s * 7), int(s * 9))]
    remark = f'"{workers} workers, ""quoted"""'
    head = ",".join([HEAD, *names, "E2E_time", "E2E_throughput"])
    row = ",".join(map(str, [workers, 48, 4, 1.0, 100, len(stages), 3, remark, *cells, e2e, 100 / e2e]))
    path.write_text(f"{head}\n{row}\n")


@pytest.fixture()
def logs(tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    write_log(folder / "SS-4_1W-4C.csv", 1, [2.0], 10.0)
    write_log(folder / "SS-8_2W-4C.csv", 2, [2.0, 4.0, 6.0], 5.0)
    write_log(folder / "WS-4_1W-4C.csv", 1, [1.0, 3.0, 5.0, 7.0, 9.0], 8.0)
    write_log(folder / "W-1-128_1W-128C.csv", 1, [2.0, 4.0, 6.0], 4.0)
    (folder / "other.csv").write_text("a,b\n1,2\n")
    return str(folder)


def test_logs_of_several_headers(spark, logs):
    runs = runlogs.read_runs(spark, logs)
    got = {(r.scaling_type, r.num_workers): r for r in rl.run_totals(runs).collect()}
    assert set(got) == {("Strong_Scaling", 1), ("Strong_Scaling", 2), ("Weak_Scaling", 1), ("Worker_Sweep", 1)}
    two = got["Strong_Scaling", 2]
    assert two.total_stage_time == 12.0 and two.average_stage_throughput == 40.0
    assert two.remark == '2 workers, "quoted"' and two.stage3_time is None
    assert two.log_dir.endswith("/logs") and two.Total_JVM_GC_Time == 240.0
    out = rl.export_columns(rl.run_totals(runs))
    assert len(out.columns) == 13 and out.first().CPU_Efficiency == 50.0
    sped = rl.speedup(rl.label_runs(runs), tie="E2E_time").collect()
    assert {(r.scaling_type, r.config_name): r.speedup for r in sped}["Strong_Scaling", "2W-4C"] == 2.0
    assert [r.E2E_time for r in runlogs.read_results(spark, logs).collect()] == [4.0, 5.0, 8.0, 10.0]
    long = rl.unpivot_stages(runs.withColumn("run_id", F.col("E2E_time")))
    assert long.count() == (1 + 3 + 5 + 3) * 7


def test_no_logs(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        runlogs.read_runs(spark, str(tmp_path))


def test_own_event_log(spark):
    spark.range(0, 100_000, 1, 4).groupBy((F.col("id") % 7).alias("k")).count().collect()
    folder = spark.conf.get("spark.eventLog.dir")
    assert glob.glob(f"{folder.removeprefix('file:')}/*")
    stages = stage_metrics(read_event_log(spark, folder))
    rows = stages.orderBy("job_id", "stage_id").collect()
    assert rows and all(r.num_tasks > 0 and r.time >= 0 and r.job_id is not None for r in rows)
    assert any(r.executorRunTime > 0 for r in rows) and any(r.num_tasks == 4 for r in rows)
    assert rl.total_tasks(stages).first().num_tasks >= sum(r.num_tasks for r in rows)


def test_timed_run_is_logged(spark, small, tmp_path):
    from broadsheet.plans.base import articles

    config = {"num_workers": 1, "mem_per_worker": 8, "cores_per_worker": 8, "dataset_scale": 0.5, "remark": "test, short"}
    log = spark.conf.get("spark.eventLog.dir")
    record = timed_run(spark, articles(spark, small), "doc_id", config, str(tmp_path), "SS-8", event_log=log).first()
    assert record.num_rows == 300 and record.num_stages >= 1 and record.E2E_throughput > 0
    back = runlogs.read_runs(spark, str(tmp_path)).first()
    assert back.scaling_type == "Strong_Scaling" and back.remark == "test, short"
    assert back.stage0_time == pytest.approx(record.stage0_time)


def test_csv_with_newlines_and_quotes(spark, tmp_path):
    rows = [('a "quoted" title', "line\nbreak, comma", "1"), ("b", None, "0"), ("c", "", "x")]
    df = spark.createDataFrame(rows, "title string, text string, label string")
    write_csv(df, str(tmp_path / "csv"))
    back = read_csv(spark, str(tmp_path / "csv"), multi_line=True)
    want = [tuple(v or None for v in row) for row in rows]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(want, key=str)
    inferred = read_csv(spark, str(tmp_path / "csv"), schema=None, multi_line=True)
    assert inferred.columns == ["title", "text", "label"] and inferred.count() == 3
    drain(back)


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_quoted_newlines_are_read_in_parallel(spark, tmp_path, ends):
    """Ranges of a few hundred bytes, records of many ranges, as the reader of whole files has it."""
    import random

    from broadsheet.sources.articles import ARTICLE
    from broadsheet.sources.quoted_csv import read_quoted_csv, records

    rnd = random.Random(8)

    def field():
        if rnd.random() < 0.1:
            return ""
        text = "".join(rnd.choice(["a", "b ", ",", "\n", '"', "é", "\n\n"]) for _ in range(rnd.choice([3, 30, 900])))
        return '"' + text.replace('"', '""') + '"' if rnd.random() < 0.9 or set(text) & set(',\n"') else text

    for name in ("x", "y"):
        body = "".join(",".join(field() for _ in range(3)) + ends for _ in range(120))
        (tmp_path / f"{name}.csv").write_bytes(("title,text,label" + ends + body + ends).encode())
    want = read_csv(spark, str(tmp_path), multi_line=True).collect()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        found = read_quoted_csv(spark, str(tmp_path), ARTICLE)
        assert records(spark, str(tmp_path)).rdd.getNumPartitions() > 8
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == len(want) >= 200
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_order_lines_are_shuffled_once_and_narrow(spark, small):
    from broadsheet.plans.runs import wide_runs

    plan = wide_runs(spark, small)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange" in line and "l_orderkey" in line]
    assert len(dealt) == 1 and "l_linenumber" not in dealt[0].split("ENSURE")[0].split("hashpartitioning")[1]
