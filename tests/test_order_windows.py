import random

import pytest
from pyspark.sql import functions as F

from rivulet.operators import order, running, windows


def values(df, key="ord", name="v"):
    return [r[name] for r in df.orderBy(key).collect()]


def test_take_and_skip(numbers):
    df = numbers(10, 20, 30)
    assert values(order.take(df, 2, ["ord"])) == [10, 20]
    assert values(order.take(df, 0, ["ord"])) == [] == values(order.take(df, -1, ["ord"]))
    assert values(order.skip(df, 2, ["ord"])) == [30]
    assert values(order.skip_step(df, -3, ["ord"])) == [10, 20, 30]
    with pytest.raises(ValueError):
        order.skip(df, -1, ["ord"])
    with pytest.raises(ValueError):
        order.skip(df, 1, [])


def test_pages(numbers):
    df = numbers(*range(100))
    assert values(order.page(df, 2, 10, ["ord"])) == list(range(20, 30))
    assert values(order.page(df, 10, 10, ["ord"])) == []
    assert values(order.keyset_page(df, "v", 9, 10)) == list(range(10, 20))


def test_while(numbers):
    df = numbers(1, 2, 5, 1, 2)
    assert values(order.take_while(df, F.col("v") < 3, ["ord"])) == [1, 2]
    assert values(order.skip_while(df, F.col("v") < 3, ["ord"])) == [5, 1, 2]
    assert values(order.take_while(df, F.col("v") < 9, ["ord"])) == [1, 2, 5, 1, 2]
    assert values(order.skip_while(df, F.col("v") < 9, ["ord"])) == []
    assert values(order.take_while(df, F.lit(None).cast("boolean"), ["ord"])) == []


@pytest.mark.parametrize("distributed", [False, True])
def test_dense_position(spark, distributed):
    rows = [(x,) for x in random.Random(3).sample(range(10_000), 2000)]
    got = order.with_position(spark.createDataFrame(rows, "k long").repartition(7), ["k"], distributed=distributed).orderBy("k").collect()
    assert [r["idx"] for r in got] == list(range(2000))
    assert [r["k"] for r in got] == sorted(x for x, in rows)


def test_halving(spark):
    df = spark.range(200).select("id", F.lit("x" * 90).alias("s"))
    assert order.halve_to_bytes(df, ["id"], 6000, 20).count() == 50
    assert order.halve_to_bytes(df, ["id"], 10, 20).count() == 20
    assert order.halve_to_bytes(df, ["id"], 10**6, 20).count() == 200


def items(df, name):
    return [[i["v"] for i in r["items"]] for r in df.orderBy(name).collect()]


def test_batches(numbers):
    df = numbers(1, 2, 3, 4, 5)
    assert items(windows.batch(df, 2, ["ord"]), "batch") == [[1, 2], [3, 4], [5]]
    assert values(windows.unbatch(windows.batch(df, 2, ["ord"]))) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        windows.batch(df, 0, ["ord"])
    cut = df.limit(1).select(windows.batch_items(F.array(*map(F.lit, range(5))), 2).alias("b"), windows.batch_items(F.array().cast("array<int>"), 2).alias("e")).first()
    assert cut["b"] == [[0, 1], [2, 3], [4]] and cut["e"] == []
    sized = windows.variable_batches(numbers(*range(10)), [1, 3, 2], ["ord"])
    assert [(r["batch"], r["v"]) for r in sized.orderBy("ord").collect()] == [(0, 0), (1, 1), (1, 2), (1, 3), (2, 4), (2, 5)]


@pytest.mark.parametrize(
    ("n", "size", "slide", "expected"),
    [
        (5, 2, 2, [[1, 2], [3, 4]]),
        (4, 3, 1, [[1, 2, 3], [2, 3, 4]]),
        (8, 4, 2, [[1, 2, 3, 4], [3, 4, 5, 6], [5, 6, 7, 8]]),
        (8, 2, 3, [[1, 2], [4, 5], [7, 8]]),
        (10, 2, 4, [[1, 2], [5, 6], [9, 10]]),
        (7, 2, 3, [[1, 2], [4, 5]]),
    ],
)
def test_count_windows(numbers, n, size, slide, expected):
    assert items(windows.count_window(numbers(*range(1, n + 1)), size, slide, ["ord"]), "window") == expected


def test_count_windows_against_a_model(numbers):
    draw = random.Random(5)
    for _ in range(6):
        n, size, slide = draw.randint(1, 25), draw.randint(1, 7), draw.randint(1, 9)
        rows = list(range(n))
        model = [rows[s : s + size] for s in range(0, n, slide) if len(rows[s : s + size]) == size]
        assert items(windows.count_window(numbers(*rows), size, slide, ["ord"]), "window") == model, (n, size, slide)


def test_window_sizes_are_checked(numbers):
    for size, slide in ((0, 1), (1, 0), (-1, 1)):
        with pytest.raises(ValueError):
            windows.count_window(numbers(1), size, slide, ["ord"])
    with pytest.raises(ValueError):
        windows.buffer_time(numbers(1), 0, "ord", ["ord"])


def test_buffers(numbers):
    df = numbers(1, 2, 9, 3, 9, 4).withColumn("k", F.lit(1))
    got = windows.buffer_until(df, F.col("v") == 9, ["ord"])
    assert [r["buffer"] for r in got.orderBy("ord").collect()] == [0, 0, 0, 1, 1, 2]
    folded = windows.buffer_fold(df, lambda held, row: len(held) == 1, ["ord"], ["k"])
    assert [r["buffer"] for r in folded.orderBy("ord").collect()] == [0, 0, 1, 1, 2, 2]


def test_time_buffers(spark):
    df = spark.sql("SELECT id, timestamp_seconds(id * 4) AS ts FROM range(6)")
    got = windows.buffer_time(df, 10, "ts", ["id"], 2).orderBy("id").collect()
    assert [(r["bucket"], r["buffer"]) for r in got] == [(0, 0), (0, 0), (0, 1), (1, 0), (1, 0), (2, 0)]


def test_running_state(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "b", 3.0), (3, "a", 2.0)], "id int, kind string, v double")
    assert [(r["item_count"], r["total_count"]) for r in running.running_count(df, "kind", ["id"]).orderBy("id").collect()] == [(1, 1), (1, 2), (2, 3)]
    assert [r["balance"] for r in running.running_balance(df, "v", F.col("kind") == "a", ["id"]).orderBy("id").collect()] == [5, 2, 4]
    assert [r["run_avg"] for r in running.running_stats(df, "v", ["id"]).orderBy("id").collect()] == [5, 4, 10 / 3]
    assert [r["id"] for r in running.milestones(df, "v", 8, ["id"]).collect()] == [2]
    assert [r["trend"] for r in running.moving_average(df, "v", 2, ["id"]).orderBy("id").collect()] == ["down", "down"]


def test_milestones_reach_exact_multiples(spark):
    """Ten times 0.1 is 1, as for 29.9 and 0.1 after it; values that are no short decimals add up as they are."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.1] * 10 + [29.0, 0.9, 0.1, None])], "id int, v double")
    got = running.milestones(df, "v", 1, ["id"]).orderBy("id").collect()
    assert [(r["id"], r["running_total"]) for r in got] == [(9, 1.0), (10, 30.0), (12, 31.0)] and got[0].asDict().keys() == {"id", "v", "running_total"}
    odd = spark.createDataFrame([(0, 0.5), (1, 1 / 3), (2, 0.25), (3, 1e30), (4, float("nan"))], "id int, v double")
    assert [r["id"] for r in running.milestones(odd.where("id < 3"), "v", 1, ["id"]).collect()] == [2]
    assert [r["id"] for r in running.milestones(odd.where("id in (0, 2, 3)"), "v", 1, ["id"]).collect()] == [3]
    assert [r["id"] for r in running.milestones(df.selectExpr("id", "id AS v"), "v", 10, ["id"]).orderBy("id").collect()][:2] == [4, 6]
    with pytest.raises(ValueError):
        running.milestones(df, "v", 0, ["id"])


def test_buffer_fold_adds_one_by_one(spark, tmp_path):
    """One by one these values pass 500 by a rounding, as in the SQL; a compensated sum is 500."""
    from rivulet.plans import catalogue

    values = [91.77, 24.19, 71.54, 83.62, 4.61, 35.24, 52.79, 136.24, 1.0]
    spark.createDataFrame([(i, 7, v) for i, v in enumerate(values)], "event_id long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = catalogue.queries()["buffer_fold"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(7, 0, 8, 7), (7, 1, 1, 8)]


def test_patterns(numbers):
    df = numbers(1, 2, 3, 1, 1, 2, 3).withColumn("k", F.lit(0))
    assert values(running.pattern_ends(df, "v", [1, 2, 3], ["ord"]), name="ord") == [2, 6]
    assert values(running.pattern_fold(df, "v", [1, 2, 3], ["ord"], ["k"]), name="ord") == [2, 6]
    with pytest.raises(ValueError):
        running.pattern_ends(df, "v", [1, 2, 1], ["ord"])


def test_first_of(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None)], "id int, k string")
    assert sorted(r["id"] for r in running.first_of(df, ["k"], ["id"]).collect()) == [1, 2, 4]


def test_result_does_not_depend_on_partitions(spark, numbers):
    df = numbers(*range(40))
    want = items(windows.count_window(df, 4, 3, ["ord"]), "window")
    assert items(windows.count_window(df.repartition(9), 4, 3, ["ord"]), "window") == want
