"""Cluster settings and the shared folder."""

from __future__ import annotations

from broadsheet.session import session_options, shared_dir, stored


def test_cluster_settings():
    options = session_options(num_workers=16, mem_per_worker=24, cores_per_worker=4)
    assert options["spark.executor.memory"] == "14g" and options["spark.memory.offHeap.size"] == "10g"
    assert options["spark.cores.max"] == "64" and options["spark.sql.shuffle.partitions"] == "200"
    large = session_options(num_workers=1000, mem_per_worker=64, cores_per_worker=8)
    assert large["spark.sql.shuffle.partitions"] == "24000"


def test_shared_folder_is_the_one_of_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert first.startswith(base) and first != second
    kept = stored(spark.range(5), "numbers")
    assert kept.count() == 5 and kept.inputFiles()[0].removeprefix("file://").startswith(base)


def test_addresses_in_a_state_store_on_disk(spark, tmp_path):
    from broadsheet.streaming import messages as ms

    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, session_options(1, 8, 4)[name])
    try:
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "1.txt").write_text("a\nb\na\n")
        urls = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "url")
        ms.run_available(ms.write_files(ms.first_seen(urls), str(tmp_path / "out"), str(tmp_path / "check")))
        assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    finally:
        spark.conf.unset(name)


def test_tables_are_recorded_and_deleted(spark):
    from broadsheet.session import discard, path_exists, recorded, stored

    with recorded() as outer:
        with recorded() as inner:
            table = stored(spark.range(3).toDF("n"), "kept")
        assert table.count() == 3 and inner == outer == [table.stored_at]
        more = stored(spark.range(2).toDF("n"), "more")
    assert len(outer) == 2 and len(inner) == 1
    discard(table)
    assert not path_exists(spark, table.stored_at) and path_exists(spark, more.stored_at)
