"""Session settings and the shared folder for data that outlives one job."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session_options(num_workers: int, mem_per_worker: int, cores_per_worker: int) -> dict[str, str]:
    """Cluster settings for a given shape; memory in GB is split 60 / 40 heap and off-heap."""
    heap = int(mem_per_worker * 0.6)
    return {
        "spark.executor.instances": str(num_workers),
        "spark.executor.cores": str(cores_per_worker),
        "spark.cores.max": str(num_workers * cores_per_worker),
        "spark.executor.memory": f"{heap}g",
        "spark.memory.offHeap.enabled": "true",
        "spark.memory.offHeap.size": f"{mem_per_worker - heap}g",
        "spark.memory.fraction": "0.8",
        "spark.executor.extraJavaOptions": "-XX:+UseG1GC -XX:InitiatingHeapOccupancyPercent=35",
        "spark.sql.adaptive.enabled": "true",
        # An upper limit that AQE coalesces down: too few partitions cannot be mended later.
        "spark.sql.shuffle.partitions": str(max(200, 3 * num_workers * cores_per_worker)),
        # The state of a stream that remembers every address outgrows the heap.
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        # Whole pages travel to Python: ten thousand of them may not fit into one batch.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
        "spark.sql.session.timeZone": "UTC",
    }


def build_session(
    app: str = "broadsheet", master: str | None = None, options: dict[str, str] | None = None
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (options or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path below spark.checkpoint.dir; a local folder only when Spark runs locally."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = os.path.join(tempfile.gettempdir(), "broadsheet")
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    for paths in _RECORDING:
        paths.append(path)
    return path


_RECORDING: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that `shared_dir` gives out within the block."""
    paths: list[str] = []
    _RECORDING.append(paths)
    try:
        yield paths
    finally:
        _RECORDING[:] = [other for other in _RECORDING if other is not paths]  # not one with equal paths


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once as a table in the shared folder, and read from there.

    Used before work that passes over the same rows many times: it cuts the lineage, and
    the table outlives the executors that made it.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` has written, once nothing will read them any more."""
    for table in tables:
        discard_path(table.sparkSession, table.stored_at)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def discard_path(spark: SparkSession, path: str) -> None:
    """Delete a folder, in any store that Spark can write to."""
    folder, store = _folder(spark, path)
    store.delete(folder, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    folder, store = _folder(spark, path)
    return store.exists(folder)
