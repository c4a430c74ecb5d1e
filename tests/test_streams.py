"""Stream jobs over JSON files: same as the batch, exact after a restart."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from broadsheet.sources import kafka
from broadsheet.streaming import messages as ms

LINES = [
    json.dumps({"source": "a", "text": "The cats! don't RUN", "title": "Big News"}),
    json.dumps({"source": "b", "title": "no text"}),
    "{broken",
    json.dumps({"source": "c", "text": "x" * 6000, "title": None}),
]


def drain(spark, folder, path, check):
    lines = spark.readStream.text(folder)
    ms.run_available(ms.write_files(ms.clean_messages(lines), path, check))
    return sorted(r.value for r in spark.read.parquet(path).collect())


def test_clean_stream_equals_batch_and_restarts(spark, tmp_path):
    folder, path, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(LINES[:3]))
    first = drain(spark, str(folder), str(path), str(check))
    assert first == sorted(r.value for r in ms.clean_messages(spark.read.text(str(folder))).collect())
    assert len(first) == 2
    assert json.loads(first[0]) == {"source": "a", "text": "cats dont run", "title": "big news"}
    assert json.loads(first[1])["text"] == ""
    (folder / "2.json").write_text(LINES[3])
    again = drain(spark, str(folder), str(path), str(check))
    assert len(again) == 3 and set(first) <= set(again)


def test_malformed_messages_are_kept_apart(spark):
    parsed = ms.parse(spark.createDataFrame([(line,) for line in LINES], "value string"))
    assert [r.value for r in ms.bad(parsed).collect()] == ["{broken"]
    assert ms.good(parsed).count() == 3


@pytest.mark.parametrize("literal, topics", [(False, ["labelled-data", "verify-data", "labelled-data"]), (True, ["verify-data", "verify-data", "labelled-data"])])
def test_topics(spark, literal, topics):
    scored = spark.createDataFrame([(0, 0.05), (1, 0.6), (2, 0.8)], "id int, score double")
    routed = ms.with_topic(ms.with_label(scored), literal=literal).orderBy("id").collect()
    assert [r.topic for r in routed] == topics
    assert [r.label for r in routed] == ["fake", "real", "real"]


def test_routing_into_folders(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps({"id": i, "score": i / 10}) for i in range(11)))
    stream = spark.readStream.schema("id int, score double").json(str(folder))
    routed = ms.with_topic(ms.with_label(stream))
    ms.run_available(ms.write_files(routed, str(tmp_path / "out"), str(tmp_path / "c"), by="topic"))
    by_topic = {r.topic: r.n for r in spark.read.parquet(str(tmp_path / "out")).groupBy("topic").agg(F.count("*").alias("n")).collect()}
    assert by_topic == {"verify-data": 5, "labelled-data": 6}


def test_addresses_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    check = tmp_path / "check"
    for name, urls in (("1", ["a", "b", "a"]), ("2", ["b", "c"])):
        (folder / f"{name}.json").write_text("\n".join(json.dumps({"url": u, "ts": "2024-01-01 00:00:00"}) for u in urls))
        stream = spark.readStream.schema("url string, ts timestamp").json(str(folder))
        for kind, time in (("state", None), ("mark", "ts")):
            out = ms.first_seen(stream, time)
            ms.run_available(ms.write_files(out, f"{tmp_path}/out-{kind}", f"{check}-{kind}"))
    for kind in ("state", "mark"):
        got = sorted(r.url for r in spark.read.parquet(f"{tmp_path}/out-{kind}").collect())
        assert got == ["a", "b", "c"]


def test_state_of_visited_addresses_is_flat(spark, tmp_path):
    """Many batches of new and old addresses: each comes once within the time promised."""
    folder = tmp_path / "in"
    folder.mkdir()
    held = []
    for hour in range(9):
        urls = [f"u{hour}-{i}" for i in range(20)] + [f"u{max(0, hour - 1)}-{i}" for i in range(20)]
        rows = [json.dumps({"url": u, "ts": f"2024-01-01 {hour:02}:30:00"}) for u in urls]
        (folder / f"{hour}.json").write_text("\n".join(rows))
        stream = spark.readStream.schema("url string, ts timestamp").json(str(folder))
        out = ms.first_seen(stream, "ts", delay="2 hours")
        query = ms.run_available(ms.write_files(out, str(tmp_path / "out"), str(tmp_path / "check")))
        held += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # Five hours of addresses at most, however many batches there are.
    assert max(held[len(held) // 2 :]) <= 100 and max(held[-4:]) == max(held[8:12])
    seen = [r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(seen) == len(set(seen)) == 9 * 20


def test_addresses_are_forgotten_after_a_while(spark, tmp_path):
    import time

    folder = tmp_path / "in"
    folder.mkdir()
    held = []
    for batch in range(5):
        urls = [f"u{batch}-{i}" for i in range(10)] + ["again"]
        (folder / f"{batch}.json").write_text("\n".join(json.dumps({"url": u, "_arrived": 1}) for u in urls))
        stream = spark.readStream.schema("url string, _arrived int").json(str(folder))
        out = ms.first_seen(stream, remember="1 second")
        query = ms.run_available(ms.write_files(out, str(tmp_path / "out"), str(tmp_path / "check")))
        held += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        time.sleep(1.5)
    seen = [r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert set(seen) == {f"u{b}-{i}" for b in range(5) for i in range(10)} | {"again"}
    assert held[-1] <= 30 and len(seen) - seen.count("again") == 50


def test_kafka_needs_its_package(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        kafka.read_topic(spark, "localhost:1", kafka.SCRAPED)


def test_jobs_between_topics(spark, tmp_path, monkeypatch):
    """The jobs with folders in place of topics."""
    from broadsheet.operators import models
    from broadsheet.streaming import jobs

    for topic in (kafka.SCRAPED, kafka.PROCESSED):
        (tmp_path / topic).mkdir()
    (tmp_path / kafka.SCRAPED / "1.json").write_text("\n".join(LINES))

    def read_topic(session, servers, topic):
        return session.readStream.text(str(tmp_path / topic))

    def write_topic(df, servers, checkpoint):
        return ms.write_files(df, f"{checkpoint}-out", checkpoint, by="topic")

    monkeypatch.setattr(jobs.kafka, "read_topic", read_topic)
    monkeypatch.setattr(jobs.kafka, "write_topic", write_topic)
    ms.run_available(jobs.clean_topic(spark, "none", str(tmp_path / "c1")))
    first = spark.read.parquet(str(tmp_path / "c1-out"))
    cleaned = first.where(F.col("topic") == kafka.PROCESSED)
    bad = [r.value for r in first.where(F.col("topic") == kafka.MALFORMED).collect()]
    assert cleaned.count() == 3 and len(bad) == len(LINES) - 3 and set(bad) <= set(LINES)
    cleaned.select("value").write.mode("append").text(str(tmp_path / kafka.PROCESSED))
    train = spark.createDataFrame([("cats dogs run", 1), ("lies hoax", 0)] * 4, "title_text string, label int")
    model = models.fit_classifier(train.coalesce(1), "lr")
    ms.run_available(jobs.score_topic(spark, "none", str(tmp_path / "c2"), model, "title_text"))
    rows = spark.read.parquet(str(tmp_path / "c2-out")).collect()
    assert len(rows) == 3 and {r.topic for r in rows} <= {kafka.LABELLED, kafka.VERIFY}
    fields = {"source", "text", "title", "label", "confidence"}
    assert all(set(json.loads(r.value)) <= fields and json.loads(r.value)["label"] in ("real", "fake") for r in rows)


def test_a_batch_run_again_doubles_nothing(spark, tmp_path):
    """The job dies between its two sinks; after a restart every row is there once."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps({"id": i, "topic": "ab"[i % 2]}) for i in range(10)))
    sinks = {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")}

    def run(blocked):
        stream = spark.readStream.schema("id int, topic string").json(str(folder))
        # A sink that cannot be written: its folder lies below a file.
        paths = {"a": sinks["a"], "b": str(tmp_path / "file" / "b")} if blocked else sinks
        ms.run_available(ms.write_sinks(stream, paths, str(tmp_path / "check")))

    (tmp_path / "file").write_text("in the way")
    with pytest.raises(Exception):
        run(blocked=True)
    assert ms.read_sink(spark, sinks["a"]).count() == 5  # the first sink was written
    run(blocked=False)
    (folder / "2.json").write_text(json.dumps({"id": 10, "topic": "a"}))
    run(blocked=False)
    assert sorted(r.id for r in ms.read_sink(spark, sinks["a"]).collect()) == [0, 2, 4, 6, 8, 10]
    assert sorted(r.id for r in ms.read_sink(spark, sinks["b"]).collect()) == [1, 3, 5, 7, 9]
