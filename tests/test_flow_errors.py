import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.operators import errors, flow, stats
from rivulet.operators.errors import ProcessingError, Strategy
from rivulet.operators.flow import Flow, Registry
from rivulet.operators.state import State


def test_flow_of_stages(numbers):
    f = Flow.start(numbers(1, 2, 3, 4, 5), ["ord"]).filter("odd", F.col("v") % 2 == 1).map("doubled", v=F.col("v") * 2).take("two", 2)
    result = f.execute()
    assert result.success and [r["v"] for r in result.data.collect()] == [2, 6] and result.metadata["rows"] == 2
    assert [s["name"] for s in result.metadata["stages"]] == ["odd", "doubled", "two"]
    assert f.state.keys() == ["odd", "doubled", "two"]
    with pytest.raises(ValueError):
        f.filter("odd", F.lit(True))


def test_flows_are_immutable(numbers):
    a = Flow.start(numbers(1, 2), ["ord"])
    b = a.filter("f", F.col("v") > 1)
    assert len(a.to_array()) == 2 and len(b.to_array()) == 1 and "f" not in a.state


def test_nested_arrays(spark):
    df = spark.createDataFrame([(1, [[[1, -2], [3]], [[4]]]), (2, [[]])], "id int, a array<array<array<int>>>")
    f = Flow.start(df, ["id"]).flatten("one", "a", "b", "p1").flatten("two", "b", "c", "p2").flatten("three", "c", "d", "p3").filter("positive", F.col("d") > 0)
    assert f.reduce(F.sum("d").alias("s"))["s"] == 8
    assert [r["d"] for r in f.to_array()] == [1, 3, 4]


def test_branch_state_and_context(numbers):
    f = Flow.start(numbers(1, 2, 3), ["ord"], lambda: {"limit": 2})
    f = f.add("above", lambda df, state, context: df.where(F.col("v") >= context["limit"]))
    f = f.branch("side", lambda df, state: state["above"].count() > 1, lambda df: df.withColumn("side", F.lit("many")), lambda df: df.withColumn("side", F.lit("few")))
    assert {r["side"] for r in f.to_array()} == {"many"}


def test_sinks(numbers):
    f = Flow.start(numbers(-5, 3, -2, 7, 1, -1, 9, 4), ["ord"])
    seen = []
    f.for_each(lambda row, i: seen.append((i, row["v"])))
    assert seen == list(enumerate([-5, 3, -2, 7, 1, -1, 9, 4]))
    positive = f.filter("p", F.col("v") > 0)
    r = positive.reduce(F.count("*").alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    assert tuple(r) == (5, 24, 1, 9)
    assert f.fold(F.lit(""), lambda s, x: F.concat(s, x["v"].cast("string"), F.lit(",")), ["v"]) == "-5,3,-2,7,1,-1,9,4,"


def test_composition(numbers):
    add, double = flow.lift("v", F.col("v") + 1), flow.lift("v", F.col("v") * 2)
    df = numbers(1)
    assert flow.pipe(add, double)(df).first()["v"] == 4
    assert flow.compose(add, double)(df).first()["v"] == 3
    assert flow.pipe(flow.identity)(df).first()["v"] == 1
    for f in (flow.pipe, flow.compose):
        with pytest.raises(ValueError):
            f()


def test_parallel_and_merge(numbers):
    df = numbers(1, 2)
    a, b = flow.parallel(flow.lift("v", F.col("v") + 1), flow.identity)(df)
    assert sorted(r["v"] for r in flow.merge(a, b).collect()) == [1, 2, 2, 3]
    with pytest.raises(ProcessingError, match="Parallel step failed"):
        flow.parallel(lambda d: d.select("nope"))(df)


def test_failing_predicate_fails_the_flow(numbers):
    doubled = Flow.start(numbers(1, 2, 3, 4, 5), ["ord"]).map("d", v=F.col("v") * 2)
    result = doubled.filter("f", F.when(F.col("v") == 6, F.raise_error(F.lit("bad row")).cast("boolean")).otherwise(True)).execute()
    assert not result.success and result.error["code"] == "UNHANDLED_ERROR" and "bad row" in result.error["message"]


def failing(row):
    if row["v"] in (2, 4):
        raise ValueError(f"Failed on {row['v']}")
    return row["v"] * 2


def test_strategies(numbers):
    wrapped = errors.attempt(numbers(1, 2, 3, 4), failing, T.IntegerType(), "ord")
    data = lambda df: [r["result"]["data"] for r in df.orderBy("ord").collect()]
    assert data(errors.resolve(wrapped, Strategy.SKIP_FAILED)) == [2, 6]
    assert data(errors.resolve(wrapped, Strategy.WRAP_ERRORS)) == [2, None, 6, None]
    assert data(errors.until_failure(wrapped)) == [2]
    bad = errors.failures(wrapped).orderBy("ord").first()["result"]
    assert bad["error"].asDict() == {"code": "STREAM_ERROR", "message": "Failed on 2", "retryable": False} and bad["metadata"]["item_index"] == 1
    with pytest.raises(ProcessingError, match="2 of 4 items failed") as e:
        errors.resolve(wrapped, Strategy.COLLECT_ERRORS)
    assert e.value.code == "LIST_PROCESSING_ERRORS" and e.value.errors == [(1, "Failed on 2"), (3, "Failed on 4")]
    with pytest.raises(ProcessingError, match="Failed on 2"):
        errors.resolve(wrapped, Strategy.FAIL_FAST)
    report = stats.batch_report(wrapped).first()
    assert (report["total"], report["successful"], report["failed"]) == (4, 2, 2)


def test_retry():
    waits, calls = [], []

    def flaky(row):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("Rate Limit reached")
        return "ok"

    assert errors.try_call(flaky, {}, 5, 100, sleep=waits.append)[:2] == (True, "ok")
    assert waits == [0.1, 0.2]
    ok, _, code, _, again, tries, _ = errors.try_call(lambda r: 1 / 0, {}, 5)
    assert (ok, code, again, tries) == (False, "STREAM_ERROR", False, 1)
    assert errors.try_call(lambda r: (_ for _ in ()).throw(RuntimeError("ETIMEDOUT")), {}, 2)[2:6] == ("ETIMEDOUT", "ETIMEDOUT", True, 2)
    with pytest.raises(ValueError):
        errors.try_call(flaky, {}, 0)


def test_breaker_and_rate(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([True, True, False, False])], "id int, bad boolean")
    assert [r["rejected"] for r in errors.breaker(df, F.col("bad"), 2, ["id"]).orderBy("id").collect()] == [False, False, True, True]


def test_statistics(numbers):
    df = numbers(*range(1, 11))
    r = stats.timing_stats(df, "v").first()
    assert (r["p50"], r["p95"], r["p99"], r["avg"]) == (5, 10, 10, 5.5)
    empty = stats.timing_stats(df.where("v > 99"), "v").first()
    assert set(empty) == {0.0}
    squares = stats.number_stats(df.withColumn("q", F.col("v") * F.col("v")), "q").first()
    assert (squares["count"], squares["sum"], squares["min"], squares["max"]) == (10, 385, 1, 100)
    assert stats.sketch_percentiles(df, "v").first()["p50"] == 5


def test_nearest_ranks_against_sorting(spark):
    import math
    import random

    draw = random.Random(9)
    rows = [(draw.choice(["a", "b", None]), draw.choice([1.0, 2.0, draw.random() * 100, None])) for _ in range(3000)] + [("one", 5.0), ("none", None)]
    percents = (0, 1, 25, 50, 95, 99, 100)
    got = {r["k"]: r for r in stats.nearest_ranks(spark.createDataFrame(rows, "k string, v double").repartition(4), "v", percents, ["k"]).collect()}
    for k in ("a", "b", None, "one"):
        values = sorted(v for g, v in rows if g == k and v is not None)
        assert got[k]["n"] == len(values)
        assert [got[k][f"p{p}"] for p in percents] == [values[max(0, math.ceil(p * len(values) / 100) - 1)] for p in percents]
    assert "none" not in got


def test_state(numbers):
    s = State().with_key("a", numbers(1))
    assert s.keys() == ["a"] and not s.has_snapshot("a") and s.materialize("a").count() == 1 and s.has_snapshot("a")
    copy = s.clone()
    copy.add_lazy("b", numbers(2))
    assert "b" not in s and set(copy.accumulated) == {"a"}
    with pytest.raises(KeyError, match="there are: a"):
        s.stream("zz")


def test_registry(numbers):
    r = Registry()
    kind = T.StructType([T.StructField("v", T.IntegerType())])
    r.register("odd", lambda df: df.where("v % 2 = 1"), kind, kind, ["numbers"])
    with pytest.raises(ValueError, match="already"):
        r.register("odd", lambda df: df)
    assert r.names() == ["odd"] and [f.name for f in r.by_tags("x", "numbers")] == ["odd"] and r.get("z") is None
    assert r.execute("odd", numbers(1, 2)).data.count() == 1
    assert r.execute("z", numbers(1)).error["code"] == "NOT_FOUND"
    assert r.execute("odd", numbers(1).select(F.lit("x").alias("v"))).error["code"] == "INVALID_INPUT"


def test_advice():
    assert flow.advise("ReadFiles") == {"category": "io_bound", "recommended": True, "strength": 0.95, "approach": "to_streaming"}
    assert flow.advise("sortRows")["recommended"] is False
    assert flow.advise("double")["category"] == "pure_transform"


def test_outputs_and_logs(spark, numbers, tmp_path):
    import json
    import logging

    from rivulet.functions import logs
    from rivulet.sources import sinks

    df = numbers(1, 2)
    assert sinks.checked(df, df.schema) is df
    with pytest.raises(TypeError, match="w int"):
        sinks.checked(df, T.StructType([T.StructField("w", T.IntegerType())]))
    assert [json.loads(r["json"])["v"] for r in sinks.json_rows(df).orderBy("json").collect()] == [1, 2]
    sinks.write_table(df, str(tmp_path / "t"), ["v"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    record = logging.LogRecord("c", logging.INFO, "", 0, "seen", (), None)
    record.data = {"embedding": [0.5] * 384, "n": 1}
    line = json.loads(logs.JsonFormatter().format(record))
    assert line["event"] == "seen" and line["embedding"].startswith("[Embedding: dim=384") and line["n"] == 1
    assert logs.CompactFormatter().format(record).startswith("I c: seen")
