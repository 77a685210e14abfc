import pytest
from pyspark.sql import functions as F

from rivulet.streaming import observe, streams


@pytest.fixture
def source(spark, tmp_path):
    df = spark.sql("SELECT id AS event_id, id % 3 AS user_id, timestamp_seconds(id * 10) AS ts, cast(id AS double) AS value FROM range(20)")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return lambda files=None: streams.parquet_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=files)


def test_windows(source):
    out = streams.time_windows(streams.event_time(source(), "ts", "1 hour"), "ts", "1 minute", by=["user_id"])
    assert sum(r["n"] for r in streams.to_memory(out, "w1", "complete").collect()) == 20


def test_distinct(source):
    out = streams.distinct_within(streams.event_time(source(1), "ts", "1 day"), ["user_id"])
    assert streams.to_memory(out, "d1").count() == 3


def test_state_across_micro_batches(source):
    got = streams.to_memory(streams.running_counts(source(1), "user_id", "value", "ts"), "s1", "update")
    last = got.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("t")).orderBy("user_id").collect()
    assert [(r["n"], r["t"]) for r in last] == [(7, 63.0), (7, 70.0), (6, 57.0)]


def test_buffers_across_micro_batches(source):
    got = streams.to_memory(streams.count_buffers(source(1), "user_id", 3, "event_id"), "b1").collect()
    assert sorted((r["user_id"], r["batch"], len(r["items"])) for r in got) == [(0, 0, 3), (0, 1, 3), (1, 0, 3), (1, 1, 3), (2, 0, 3), (2, 1, 3)]
    with pytest.raises(ValueError):
        streams.count_buffers(source(), "user_id", 0, "event_id")


def test_batches_stay_off_the_driver(spark, source, monkeypatch):
    from rivulet.plans import catalogue

    out = streams.to_folder(streams.count_buffers(source(1), "user_id", 3, "event_id"))
    assert sorted((r["user_id"], r["batch"], len(r["items"])) for r in out.collect()) == [(0, 0, 3), (0, 1, 3), (1, 0, 3), (1, 1, 3), (2, 0, 3), (2, 1, 3)]
    assert out.inputFiles()
    monkeypatch.setattr(streams, "to_memory", lambda *a: pytest.fail("to the driver"))
    assert catalogue.queries()["stream_batches"](spark, "/root/testdata/sf0.001").inputFiles()


def test_micro_batches(source, tmp_path):
    seen = []
    streams.micro_batches(source(1), lambda df, i: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == 20


def test_observed(spark):
    o = observe.Observed(spark.range(10), "seen", n=F.count("*"), top=F.max("id"))
    assert o.df.count() == 10
    assert o.get() == {"n": 10, "top": 9}


def test_collector_and_tracker():
    now = [0.0]
    c = observe.Collector(clock=lambda: now[0])
    for ms in (10, 20, 30):
        c.start()
        now[0] += ms / 1000
        c.end(ms != 20)
    c.skip()
    c.complete()
    s = c.snapshot()
    assert (s["processed"], s["failed"], s["skipped"], round(s["p50"]), round(s["max"])) == (2, 1, 1, 20, 30)
    t = observe.Tracker(["read", "split"], total=10, clock=lambda: now[0])
    events = []
    t.listen(events.append)
    now[0] += 2
    t.record("read", 4, 4)
    t.record("split", 4, 12, errors=1)
    assert t.rate == 2 and t.expansion("split") == 3 and t.eta_ms() == 3000
    assert "split: 4 in, 12 out, 1 errors" in t.complete() and [e["type"] for e in events] == ["progress", "error", "complete"]
