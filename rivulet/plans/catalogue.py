"""The query catalogue: every operator applied to the test tables, with an equivalent SQL text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markdown, text
from ..operators import errors, flow, order, retrieval, running, stats, windows
from ..operators.flow import Flow
from ..operators.state import shared_folder
from ..sources import corpus, sinks
from ..streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(c, digits: int):
    """Rounded after a nudge, so that exact halves don't depend on the last bit of a mean."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, digits)


#: Times are arguments, so that runs agree.
NOW = datetime(2024, 3, 1, tzinfo=timezone.utc)

# -- projections, filters, composition ----------------------------------------------------


@query("""SELECT event_type, CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'medium' ELSE 'high' END AS bucket, count(*) AS n, round(sum(value), 2) AS total
FROM events WHERE event_type <> 'error' GROUP BY ALL""")
def etl_bucket_summary(spark, d):
    f = Flow.start(_t(spark, d, "events"), ["event_id"]).filter("kept", F.col("event_type") != "error").map("bucketed", bucket=text.size_class("value"))
    return f.add("summary", lambda df: df.groupBy("event_type", "bucket").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))).build()


@query("""SELECT event_id, user_id, round(value * 10, 4) AS score FROM events WHERE event_type = 'purchase' AND value > 50 ORDER BY event_id LIMIT 10""")
def filter_map_take(spark, d):
    f = Flow.start(_t(spark, d, "events"), ["event_id"]).filter("critical", (F.col("event_type") == "purchase") & (F.col("value") > 50))
    return f.select("scored", "event_id", "user_id", F.round(F.col("value") * 10, 4).alias("score")).take("first", 10).build()


@query("""SELECT user_id, count(*) AS n, round(sum(value * 2), 2) AS total FROM events WHERE value > 100 GROUP BY user_id""")
def pipe_compose(spark, d):
    steps = (flow.lift_filter(F.col("value") > 100), flow.lift("value", F.col("value") * 2), flow.identity)
    return flow.pipe(*steps, lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")))(_t(spark, d, "events"))


@query("""SELECT l_returnflag, sum(l_quantity) AS total, 'large' AS side FROM lineitem WHERE (SELECT count(*) FROM lineitem) > 100 GROUP BY l_returnflag""")
def branch_by_scalar(spark, d):
    def summed(side: str):
        return lambda df: df.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("total")).withColumn("side", F.lit(side))

    return Flow.start(_t(spark, d, "lineitem")).branch("size", lambda df, _: df.count() > 100, summed("large"), summed("small")).build()


@query("""SELECT 'count' AS measure, count(*)::DOUBLE AS v FROM lineitem UNION ALL SELECT 'sum', sum(l_quantity) FROM lineitem UNION ALL SELECT 'max', max(l_extendedprice) FROM lineitem""")
def parallel_fanout(spark, d):
    one = lambda name, c: lambda df: df.agg(c.cast("double").alias("v")).select(F.lit(name).alias("measure"), "v")
    parts = flow.parallel(one("count", F.count("*")), one("sum", F.sum("l_quantity")), one("max", F.max("l_extendedprice")))(_t(spark, d, "lineitem"))
    return flow.merge(*parts)


@query("""SELECT event_type, CASE WHEN score > 400 THEN 'good' ELSE 'bad' END AS decision, score FROM (SELECT event_type, max(value) AS score FROM events GROUP BY event_type)""")
def decide_by_score(spark, d):
    best = _t(spark, d, "events").groupBy("event_type").agg(F.max("value").alias("score"))
    return best.select("event_type", F.when(F.col("score") > 400, "good").otherwise("bad").alias("decision"), "score")


@query("""SELECT doc_id, pos::INTEGER AS pos, w AS word FROM (SELECT doc_id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS w, generate_subscripts(list_filter(string_split(text, ' '), lambda x: x <> ''), 1) - 1 AS pos FROM documents)""")
def flat_words(spark, d):
    words = F.filter(F.split("text", " "), lambda w: w != "")
    f = Flow.start(_t(spark, d, "documents"), ["doc_id"]).flat_map("words", words, "word")
    return f.select("plain", "doc_id", "pos", "word").build()


@query("""SELECT o_custkey, l_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def nested_flatten(spark, d):
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines"))
    orders = _t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    nested = orders.groupBy("o_custkey").agg(F.collect_list(F.struct("l_orderkey", "lines")).alias("orders"))
    f = Flow.start(nested, ["o_custkey"]).flatten("orders_flat", "orders", "o", "opos").flatten("lines_flat", "o.lines", "l", "lpos")
    return f.select("plain", "o_custkey", F.col("o.l_orderkey").alias("l_orderkey"), F.col("l.l_linenumber").alias("l_linenumber"), F.col("l.l_quantity").alias("l_quantity")).build()


@query("""SELECT name, CASE WHEN name LIKE '%read%' OR name LIKE '%write%' OR name LIKE '%fetch%' OR name LIKE '%api%' OR name LIKE '%db%' OR name LIKE '%database%' THEN 'io_bound'
 WHEN name LIKE '%sort%' OR name LIKE '%group%' OR name LIKE '%aggregate%' OR name LIKE '%sum%' OR name LIKE '%count%' OR name LIKE '%statistics%' THEN 'aggregation'
 WHEN name LIKE '%split%' OR name LIKE '%chunk%' OR name LIKE '%expand%' OR name LIKE '%flatten%' OR name LIKE '%flatmap%' THEN 'expansion'
 WHEN name LIKE '%filter%' OR name LIKE '%dedupe%' OR name LIKE '%sample%' OR name LIKE '%limit%' OR name LIKE '%take%' THEN 'reduction'
 WHEN name LIKE '%cache%' OR name LIKE '%memo%' OR name LIKE '%state%' OR name LIKE '%rate%' OR name LIKE '%throttle%' THEN 'stateful' ELSE 'pure_transform' END AS category
FROM (SELECT DISTINCT lower(p_name) AS name FROM part)""")
def step_categories(spark, d):
    return _t(spark, d, "part").select(F.lower("p_name").alias("name")).distinct().select("name", flow.categorize(F.col("name")).alias("category"))


# -- order ---------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def page_skip_take(spark, d):
    return order.page(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), 2, 25, ["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 25")
def keyset_page(spark, d):
    return order.keyset_page(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 25)


@query("SELECT event_id, value FROM events ORDER BY event_id OFFSET 100")
def skip_rows(spark, d):
    return order.skip(_t(spark, d, "events").select("event_id", "value"), 100, ["event_id"])


@query("SELECT event_id, value FROM events WHERE event_id < (SELECT coalesce(min(event_id), 9223372036854775807) FROM events WHERE NOT value < 480)")
def take_while(spark, d):
    return order.take_while(_t(spark, d, "events").select("event_id", "value"), F.col("value") < 480, ["event_id"])


@query("SELECT event_id, value FROM events WHERE event_id >= (SELECT min(event_id) FROM events WHERE NOT value < 480)")
def skip_while(spark, d):
    return order.skip_while(_t(spark, d, "events").select("event_id", "value"), F.col("value") < 480, ["event_id"])


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS idx FROM events")
def dense_position(spark, d):
    """The distributed form, whatever the size."""
    return order.with_position(_t(spark, d, "events").select("event_id"), ["event_id"], distributed=True)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i % 7 = 3")
def indexed_filter(spark, d):
    return order.indexed_filter(_t(spark, d, "events").select("event_id"), lambda i: F.pmod(i, F.lit(7)) == 3, ["event_id"])


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3")
def top_per_user(spark, d):
    return order.top(_t(spark, d, "events").select("user_id", "event_id", "value"), 3, [F.desc("value"), "event_id"], ["user_id"])


# -- batches and windows ----------------------------------------------------------------------


@query("SELECT i // 64 AS batch, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) GROUP BY 1")
def batch_sizes(spark, d):
    f = Flow.start(_t(spark, d, "events").select("event_id", "value"), ["event_id"]).batch("batches", 64)
    return f.select("sized", "batch", F.size("items").cast("long").alias("n")).build()


@query("SELECT i // 10 AS batch, round(avg(value) + 1e-9, 6) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(DISTINCT user_id) AS users FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) GROUP BY 1")
def batch_stats(spark, d):
    rows = windows.with_batch(_t(spark, d, "events"), 10, ["event_id"])
    return rows.groupBy("batch").agg(_rounded(F.avg("value"), 6).alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count_distinct("user_id").alias("users"))


@query("SELECT event_id, value FROM events")
def batch_unbatch(spark, d):
    return windows.unbatch(windows.batch(_t(spark, d, "events").select("event_id", "value"), 50, ["event_id"]))


@query("""SELECT CASE WHEN i < 5 THEN 0 WHEN i < 15 THEN 1 WHEN i < 35 THEN 2 WHEN i < 55 THEN 3 ELSE 4 END::BIGINT AS batch, count(*) AS n, sum(event_id)::BIGINT AS ids
FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i < 65 GROUP BY 1""")
def variable_batches(spark, d):
    return windows.variable_batches(_t(spark, d, "events").select("event_id"), [5, 10, 20, 20, 10], ["event_id"]).groupBy("batch").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT conv_id, count(*) AS batches, max(n) AS largest FROM (SELECT conv_id, b, count(*) AS n FROM (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS b FROM conversations) GROUP BY 1, 2) GROUP BY conv_id")
def batch_items(spark, d):
    turns = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    cut = turns.select("conv_id", windows.batch_items(F.col("turns"), 3).alias("b"))
    return cut.select("conv_id", F.size("b").cast("long").alias("batches"), F.array_max(F.transform("b", F.size)).cast("long").alias("largest"))


def _window_sql(size: int, slide: int) -> str:
    return f"""WITH p AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events),
w AS (SELECT unnest(generate_series(0, (SELECT max(i) FROM p) // {slide})) AS "window")
SELECT "window", min(event_id) AS first_id, max(event_id) AS last_id, round(sum(value), 4) AS total FROM w JOIN p ON i >= "window" * {slide} AND i < "window" * {slide} + {size} GROUP BY 1 HAVING count(*) = {size}"""


def _window_query(spark, d, size, slide):
    rows = windows.count_window_rows(_t(spark, d, "events").select("event_id", "value"), size, slide, ["event_id"])
    full = rows.groupBy("window").agg(F.count("*").alias("c"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.round(F.sum("value"), 4).alias("total"))
    return full.where(F.col("c") == size).drop("c")


@query(_window_sql(16, 16))
def window_tumbling(spark, d):
    return _window_query(spark, d, 16, 16)


@query(_window_sql(12, 5))
def window_sliding(spark, d):
    return _window_query(spark, d, 12, 5)


@query(_window_sql(4, 9))
def window_gapped(spark, d):
    return _window_query(spark, d, 4, 9)


@query("""SELECT user_id, buffer, count(*) AS n, max(event_id) AS last_id FROM (SELECT user_id, event_id, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS buffer FROM events) GROUP BY 1, 2""")
def buffer_until_marker(spark, d):
    rows = windows.buffer_until(_t(spark, d, "events"), F.col("event_type") == "purchase", ["event_id"], ["user_id"])
    return rows.groupBy("user_id", "buffer").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, event_id, i, 0::BIGINT AS buffer, value AS held, value > 500 AS done FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, f.buffer + f.done::BIGINT, CASE WHEN f.done THEN e.value ELSE f.held + e.value END, (CASE WHEN f.done THEN e.value ELSE f.held + e.value END) > 500 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, buffer, count(*) AS n, max(event_id) AS last_id FROM f GROUP BY 1, 2""")
def buffer_fold(spark, d):
    """Buffers that close when their values pass 500: the predicate sees the buffer, and adds it up one by one (sum() of floats would compensate)."""
    passed = lambda held, row: reduce(add, [r["value"] for r in (*held, row)]) > 500
    rows = windows.buffer_fold(_t(spark, d, "events").select("event_id", "user_id", "value"), passed, ["event_id"], ["user_id"])
    return rows.groupBy("user_id", "buffer").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query("""WITH b AS (SELECT event_id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 3600000000 AS bucket FROM events),
n AS (SELECT bucket, (row_number() OVER (PARTITION BY bucket ORDER BY event_id) - 1) // 8 AS buffer FROM b)
SELECT bucket, buffer, count(*) AS n FROM n GROUP BY 1, 2""")
def buffer_time_replay(spark, d):
    rows = windows.buffer_time(_t(spark, d, "events"), 3600, "ts", ["event_id"], 8)
    return rows.groupBy("bucket", "buffer").agg(F.count("*").alias("n"))


# -- running state -----------------------------------------------------------------------------


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS item_count, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS total_count FROM events""")
def running_count(spark, d):
    return running.running_count(_t(spark, d, "events").select("event_id", "user_id", "event_type"), "event_type", ["event_id"], ["user_id"]).select("event_id", "item_count", "total_count")


@query("""SELECT event_id, count(value) OVER w AS run_count, round(sum(value) OVER w, 4) AS run_sum, round(avg(value) OVER w + 1e-9, 4) AS run_avg, min(value) OVER w AS run_min, max(value) OVER w AS run_max
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def user_running(spark, d):
    out = running.running_stats(_t(spark, d, "events").select("event_id", "user_id", "ts", "value"), "value", ["ts", "event_id"], ["user_id"])
    return out.select("event_id", "run_count", F.round("run_sum", 4).alias("run_sum"), _rounded("run_avg", 4).alias("run_avg"), "run_min", "run_max")


@query("""SELECT event_id, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE -value END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS balance FROM events""")
def running_balance(spark, d):
    out = running.running_balance(_t(spark, d, "events").select("event_id", "user_id", "event_type", "value"), "value", F.col("event_type") == "purchase", ["event_id"], ["user_id"])
    return out.select("event_id", F.round("balance", 4).alias("balance"))


@query("""SELECT event_id, count(*) FILTER (event_type = 'click') OVER w AS clicks, count(*) FILTER (value > 100) OVER w AS large FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def running_counters(spark, d):
    return running.running_counters(_t(spark, d, "events").select("event_id", "user_id", "event_type", "value"), {"clicks": F.col("event_type") == "click", "large": F.col("value") > 100}, ["event_id"], ["user_id"]).select("event_id", "clicks", "large")


@query("""SELECT event_id, round(t, 3) AS running_total FROM (SELECT event_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS t FROM events) WHERE floor(t / 1000) > floor((t - value) / 1000)""")
def milestones(spark, d):
    out = running.milestones(_t(spark, d, "events").select("event_id", "user_id", "value"), "value", 1000, ["event_id"], ["user_id"])
    return out.select("event_id", F.round("running_total", 3).alias("running_total"))


@query("""SELECT event_id, round(a + 1e-9, 4) AS moving_avg, CASE WHEN value > f THEN 'up' WHEN value < f THEN 'down' ELSE 'flat' END AS trend FROM (
SELECT event_id, value, count(*) OVER w AS n, avg(value) OVER w AS a, first(value) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n = 5""")
def moving_average(spark, d):
    out = running.moving_average(_t(spark, d, "events").select("event_id", "user_id", "value"), "value", 5, ["event_id"], ["user_id"])
    return out.select("event_id", _rounded("moving_avg", 4).alias("moving_avg"), "trend")


@query("""SELECT event_id, b AS bad_count FROM (SELECT event_id, count(*) OVER w AS n, count(*) FILTER (event_type = 'error') OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE n = 3 AND b >= 2""")
def error_spike(spark, d):
    return running.spikes(_t(spark, d, "events").select("event_id", "user_id", "event_type"), F.col("event_type") == "error", 3, 2, ["event_id"], ["user_id"]).select("event_id", "bad_count")


@query("""SELECT event_id FROM (SELECT event_id, event_type AS c, lag(event_type, 1) OVER w AS b, lag(event_type, 2) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE a = 'view' AND b = 'click' AND c = 'purchase'""")
def pattern_match(spark, d):
    return running.pattern_ends(_t(spark, d, "events").select("event_id", "user_id", "event_type"), "event_type", ["view", "click", "purchase"], ["event_id"], ["user_id"]).select("event_id")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, event_id, i, (t = 'view')::INT AS s FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN (f.s % 3 = 0 AND t = 'view') OR (f.s % 3 = 1 AND t = 'click') OR (f.s % 3 = 2 AND t = 'view') THEN f.s % 3 + 1 ELSE (t = 'view')::INT END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT event_id FROM f WHERE s = 3""")
def pattern_automaton(spark, d):
    return running.pattern_fold(_t(spark, d, "events").select("event_id", "user_id", "event_type"), "event_type", ["view", "click", "view"], ["event_id"], ["user_id"]).select("event_id")


@query("SELECT user_id, epoch_us(ts) // 86400000000 AS bucket, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1, 2")
def fixed_bucket_sessions(spark, d):
    return running.bucket_sessions(_t(spark, d, "events"), "user_id", "ts", 86400)


@query("""WITH g AS (SELECT user_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 7200000000)::INT AS fresh FROM events),
s AS (SELECT user_id, ts, sum(coalesce(fresh, 0)) OVER (PARTITION BY user_id ORDER BY ts)::BIGINT AS session FROM g)
SELECT user_id, session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2""")
def gap_sessions(spark, d):
    return running.gap_sessions(_t(spark, d, "events"), "user_id", "ts", 7200)


@query("SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_first(spark, d):
    return running.first_of(_t(spark, d, "documents").select("doc_id", "text"), ["text"], ["doc_id"])


# -- unions, lookups -----------------------------------------------------------------------------


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def merge_union(spark, d):
    e = _t(spark, d, "events").select("event_id", "event_type")
    return flow.merge(e.where("event_type = 'click'"), e.where("event_type = 'view'").select("event_type", "event_id"))


@query("""WITH p AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) AS i FROM documents), v AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) AS i FROM embeddings)
SELECT i AS idx, doc_id, vec_id, i // 50 AS batch FROM p JOIN v USING (i)""")
def zip_position(spark, d):
    left = order.with_position(_t(spark, d, "documents").select("doc_id"), ["doc_id"])
    right = order.with_position(_t(spark, d, "embeddings").select("vec_id"), ["vec_id"])
    return flow.zip_positions(left, right, ["idx"]).withColumn("batch", F.floor(F.col("idx") / 50).cast("long"))


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def state_lookup(spark, d):
    f = Flow.start(_t(spark, d, "customer")).select("customers", "c_custkey", "c_name", "c_mktsegment")
    f = f.add("orders", lambda df, state, _: _t(spark, d, "orders").where("o_totalprice > 200000").join(state["customers"], F.col("o_custkey") == F.col("c_custkey")))
    return f.select("named", "o_orderkey", "c_name", "c_mktsegment").build()


# -- statistics ---------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice) + 1e-9, 4) AS avg, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, quantile_disc(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1""")
def percentiles_exact(spark, d):
    return stats.timing_stats(_t(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"]).withColumn("avg", _rounded("avg", 4))


@query("SELECT l_returnflag, count(*) AS n, true AS close FROM lineitem GROUP BY 1")
def percentiles_approx(spark, d):
    """The sketch's percentiles, and whether each has a rank within a thousandth of the asked one."""
    lines = _t(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    found = stats.sketch_percentiles(lines, "l_extendedprice", by=["l_returnflag"])
    both = lines.join(F.broadcast(found), "l_returnflag")  # a row per flag
    share = lambda p: F.count_if(F.col("l_extendedprice") <= F.col(f"p{p}")) / F.count("*") - p / 100
    close = [F.abs(share(p)) <= 0.001 for p in stats.PERCENTILES]
    return both.groupBy("l_returnflag").agg(F.first("n").alias("n"), (close[0] & close[1] & close[2]).alias("close"))


@query("""SELECT count(*) AS total, count(*) FILTER (c_acctbal > 0) AS active, round(avg(c_acctbal) + 1e-9, 4) AS avg_value, count(*) FILTER (c_mktsegment = 'BUILDING') AS building FROM customer""")
def category_summary(spark, d):
    out = stats.category_summary(_t(spark, d, "customer"), F.col("c_mktsegment"), F.col("c_acctbal") > 0, "c_acctbal")
    return out.select("total", "active", _rounded("avg_value", 4).alias("avg_value"), F.coalesce(F.col("by_category")["BUILDING"], F.lit(0)).alias("building"))


@query("SELECT count(*) AS total, count(*) FILTER (value < 10) AS low, count(*) FILTER (value >= 10 AND value < 50) AS medium, count(*) FILTER (value >= 50) AS high FROM events")
def conditional_counts(spark, d):
    v = F.col("value")
    return stats.conditional_counts(_t(spark, d, "events"), {"low": v < 10, "medium": (v >= 10) & (v < 50), "high": v >= 50})


@query("SELECT event_type, count(value) AS count, round(sum(value), 2) AS sum, round(avg(value) + 1e-9, 4) AS avg, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def number_stats(spark, d):
    return stats.number_stats(_t(spark, d, "events"), "value", ["event_type"]).withColumns({"sum": F.round("sum", 2), "avg": _rounded("avg", 4)})


@query("SELECT l_shipdate, l_returnflag, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2")
def daily_quantity(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_shipdate", "l_returnflag").agg(F.sum("l_quantity").alias("qty"))


# -- vault questions: tags are a document's language, source and length class --------------------------


def _vault(spark, d) -> DataFrame:
    docs = _t(spark, d, "documents")
    kind = F.when(F.col("n_chars") < 500, "short").otherwise("long")
    day = F.timestamp_add("DAY", F.pmod("doc_id", F.lit(90)).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    path = F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/note-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select("doc_id", path.alias("path"), F.array(F.col("lang"), F.col("source"), kind).alias("tags"), F.when(F.pmod("doc_id", F.lit(11)) != 0, day).alias("modified"), F.col("text").alias("content"))


_VAULT_SQL = "vault AS (SELECT doc_id, lang || '/' || source || '/note-' || doc_id::VARCHAR || '.md' AS path, [lang, source, CASE WHEN n_chars < 500 THEN 'short' ELSE 'long' END] AS tags, CASE WHEN doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01' + to_days((doc_id % 90)::INTEGER) END AS modified, text AS content FROM documents)"


@query(f"WITH {_VAULT_SQL} SELECT tag, count(*) AS document_count FROM (SELECT unnest(list_distinct(tags)) AS tag FROM vault) GROUP BY 1 HAVING count(*) >= 5 ORDER BY 2 DESC, 1 LIMIT 500")
def list_tags(spark, d):
    return corpus.list_tags(_vault(spark, d), least=5)


@query(f"WITH {_VAULT_SQL} SELECT path, modified, 'Note ' || doc_id::VARCHAR AS title FROM vault WHERE list_has_any(tags, ['de', 'src3']) ORDER BY modified DESC NULLS LAST, path LIMIT 100")
def search_tags_or(spark, d):
    return corpus.search_tags(_vault(spark, d), ["#DE", "src3"], "or").select("path", "modified", "title")


@query(f"WITH {_VAULT_SQL} SELECT path, modified, 'Note ' || doc_id::VARCHAR AS title FROM vault WHERE list_has_all(tags, ['en', 'short']) ORDER BY modified DESC NULLS LAST, path LIMIT 100")
def search_tags_and(spark, d):
    return corpus.search_tags(_vault(spark, d), ["en", "#short"], "and").select("path", "modified", "title")


@query("SELECT lang || '/' || source AS folder, 2 AS depth, 'md' AS ext, count(*) AS n FROM documents GROUP BY 1")
def folder_tree(spark, d):
    return corpus.folder_tree(_vault(spark, d))


# -- errors ----------------------------------------------------------------------------------------------


def _parsed(spark, d) -> DataFrame:
    e = _t(spark, d, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    value = F.when(F.pmod(k, F.lit(7)) != 0, k * 2)
    return e.select("event_id", errors.wrap(value, F.col("event_id"), F.concat(F.lit("Failed on "), k.cast("string"))).alias("result"))


_PARSED_SQL = "p AS (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


@query(f"WITH {_PARSED_SQL} SELECT event_id, k * 2 AS data FROM p WHERE k % 7 <> 0")
def error_skip(spark, d):
    return errors.resolve(_parsed(spark, d), errors.Strategy.SKIP_FAILED).select("event_id", "result.data")


@query(f"WITH {_PARSED_SQL} SELECT event_id, coalesce(k % 7 <> 0, false) AS success, CASE WHEN k % 7 <> 0 THEN k * 2 END AS data, CASE WHEN NOT coalesce(k % 7 <> 0, false) THEN 'STREAM_ERROR' END AS code, CASE WHEN NOT coalesce(k % 7 <> 0, false) THEN 'Failed on ' || k::VARCHAR END AS message FROM p")
def error_wrap(spark, d):
    return _parsed(spark, d).select("event_id", "result.success", "result.data", "result.error.code", "result.error.message")


@query(f"WITH {_PARSED_SQL} SELECT count(*) AS total, count(*) FILTER (k % 7 <> 0) AS successful, count(*) - count(*) FILTER (k % 7 <> 0) AS failed FROM p")
def error_counts(spark, d):
    return stats.batch_report(_parsed(spark, d))


@query(f"WITH {_PARSED_SQL} SELECT event_id, k * 2 AS data FROM p WHERE event_id < (SELECT coalesce(min(event_id), 9223372036854775807) FROM p WHERE NOT coalesce(k % 7 <> 0, false))")
def error_ends_stream(spark, d):
    return errors.until_failure(_parsed(spark, d)).select("event_id", "result.data")


@query(f"WITH {_PARSED_SQL} SELECT source, count(*) AS n FROM (SELECT CASE WHEN k % 2 = 0 THEN 'primary' WHEN k % 3 = 0 THEN 'fallback' ELSE 'cache' END AS source FROM p) GROUP BY 1")
def fallback_histogram(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    tries = [F.when(k % 2 == 0, k), F.when(k % 3 == 0, k), F.lit(0)]
    return stats.histogram(_t(spark, d, "events").select(errors.fallback_source(["primary", "fallback", "cache"], tries).alias("source")), "source")


@query("""WITH l AS (SELECT event_id, user_id, (event_type = 'error') AS lost FROM events),
r AS (SELECT *, sum((NOT lost)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM l),
n AS (SELECT *, sum(lost::INT) OVER (PARTITION BY user_id, run ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS len FROM r)
SELECT event_id, coalesce(max((len >= 2)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS rejected FROM n""")
def circuit_breaker(spark, d):
    return errors.breaker(_t(spark, d, "events").select("event_id", "user_id", "event_type"), F.col("event_type") == "error", 2, ["event_id"], ["user_id"]).select("event_id", "rejected")


@query("""SELECT event_id, rate_window, (row_number() OVER (PARTITION BY rate_window ORDER BY event_id) - 1) // 5 AS delayed_windows FROM (SELECT event_id, epoch_us(ts) // 1800000000 AS rate_window FROM events)""")
def rate_limit_replay(spark, d):
    return errors.within_rate(_t(spark, d, "events").select("event_id", "ts"), "ts", 1800, 5, ["event_id"]).select("event_id", "rate_window", "delayed_windows")


@query("""SELECT event_id % 50 <> 0 AS success, CASE WHEN event_id % 50 = 0 THEN 'ETIMEDOUT' END AS code, (CASE WHEN event_id % 50 = 0 THEN 3 ELSE 1 END)::INTEGER AS attempts, count(*) AS n FROM events GROUP BY ALL""")
def retry_rows(spark, d):
    """An opaque function with retries inside the task: every row is tried up to three times."""

    def risky(row: dict) -> float:
        if row["event_id"] % 50 == 0:
            raise RuntimeError("ETIMEDOUT: no answer")
        return row["value"] * 2

    e = _t(spark, d, "events").select("event_id", "value")
    done = errors.attempt(e, risky, T.DoubleType(), "event_id", attempts=3)
    return done.groupBy(F.col("result.success").alias("success"), F.col("result.error.code").alias("code"), F.col("result.metadata.attempts").alias("attempts")).agg(F.count("*").alias("n"))


# -- text ------------------------------------------------------------------------------------------------


def _links(spark, d) -> DataFrame:
    pages = _t(spark, d, "pages").select("page_id", "url", F.explode(text.links_of("html", "url")).alias("l"))
    return pages.select("page_id", "url", "l.target_url", "l.text", "l.is_external")


_LINKS_SQL = r"""a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 2)) AS body FROM pages),
b AS (SELECT page_id, url, trim(href) AS href, trim(regexp_replace(regexp_replace(body, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS text, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host,
  regexp_replace(url, '[?#].*$', '') AS bare FROM a),
l AS (SELECT page_id, url, text, host, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN scheme || ':' || href WHEN href LIKE '/%' THEN scheme || '://' || host || href
  WHEN href LIKE '?%' OR href LIKE '#%' THEN bare || href ELSE regexp_replace(regexp_replace(bare, '(://[^/]*)$', '\1/'), '[^/]*$', '') || href END AS target_url FROM b),
links AS (SELECT page_id, url, target_url, text, lower(regexp_extract(target_url, '://([^/?#]*)', 1)) <> lower(host) AS is_external FROM l WHERE text <> '' AND regexp_matches(target_url, '^[A-Za-z][A-Za-z0-9+.-]*:'))"""


@query(f"WITH {_LINKS_SQL} SELECT * FROM links")
def link_extract(spark, d):
    return _links(spark, d)


@query(f"WITH {_LINKS_SQL} SELECT count(DISTINCT page_id) AS pages, count(*) AS links, count(*) FILTER (is_external) AS external_links, count(*) FILTER (NOT is_external) AS internal_links, count(DISTINCT regexp_extract(target_url, '://([^/?#]*)', 1)) AS domains FROM links")
def link_stats(spark, d):
    links = _links(spark, d)
    domain = F.regexp_extract("target_url", "://([^/?#]*)", 1)
    return links.agg(F.count_distinct("page_id").alias("pages"), F.count("*").alias("links"), F.count_if("is_external").alias("external_links"), F.count_if(~F.col("is_external")).alias("internal_links"), F.count_distinct(domain).alias("domains"))


@query("SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def distinct_domains(spark, d):
    return stats.histogram(_t(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")), "host")


@query("""SELECT doc_id, (p // 150)::INTEGER AS chunk_idx, substr(text, (p + 1)::INTEGER, 200) AS chunk FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 150)) AS p FROM documents WHERE length(text) > 0)""")
def char_chunks(spark, d):
    return text.exploded(_t(spark, d, "documents").select("doc_id", "text"), text.fixed_chunks("text"), "chunk_idx", "chunk").select("doc_id", "chunk_idx", "chunk")


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents),
c AS (SELECT doc_id, ws, unnest(generate_series(0, len(ws) - 1, 5)) AS p FROM w WHERE len(ws) > 0)
SELECT doc_id, (p // 5)::INTEGER AS chunk_idx, array_to_string(ws[p + 1 : p + 5], ' ') AS chunk FROM c WHERE length(array_to_string(ws[p + 1 : p + 5], ' ')) > 10""")
def word_chunks(spark, d):
    return text.exploded(_t(spark, d, "documents").select("doc_id", "text"), text.word_chunks("text"), "chunk_idx", "chunk").where(F.length("chunk") > 10).select("doc_id", "chunk_idx", "chunk")


@query("""WITH h AS (SELECT doc_id, doc_id % 256 AS n, sha256(source || '-' || doc_id::VARCHAR) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', (('0x' || substr(h, 17, 1))::INTEGER + 1), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 10) || lower(lpad(to_hex(n), 2, '0')) AS id FROM h""")
def chunk_uuid(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", text.chunk_uuid(F.concat_ws("-", "source", F.col("doc_id").cast("string")), F.pmod("doc_id", F.lit(256))).alias("id"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT doc_id, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM l)
SELECT doc_id, count(*) FILTER (NOT (line = '' OR line IN ('```', '~~~') OR regexp_full_match(line, '[^\\w\\s]+') OR regexp_full_match(line, '#{1,6}\\s+[^\\n]+'))) AS valid, count(*) AS lines FROM t GROUP BY 1""")
def valid_chunk(spark, d):
    lines = _t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(text.valid_chunk("line")).alias("valid"), F.count("*").alias("lines"))


@query("SELECT doc_id, 'Note ' || doc_id::VARCHAR AS title, text || '<|end|>' AS marked FROM documents")
def title_and_end_mark(spark, d):
    return _vault(spark, d).select("doc_id", text.title_of("path").alias("title"), text.add_end_mark("content", "<|end|>").alias("marked"))


@query("""SELECT doc_id, 'Title: Note ' || doc_id::VARCHAR || chr(10) || 'Date: ' || coalesce(strftime(modified, '%Y-%m-%d'), 'Unknown') || chr(10) || 'Tags: ' || array_to_string(tags, ', ') || chr(10) || chr(10) || 'Body:' || chr(10) || content AS document FROM (WITH """ + _VAULT_SQL + """ SELECT * FROM vault)""")
def rerank_documents(spark, d):
    v = _vault(spark, d)
    return v.select("doc_id", text.rerank_document(F.col("path"), F.date_format("modified", "yyyy-MM-dd"), F.col("tags"), F.col("content")).alias("document"))


@query("""WITH t AS (SELECT conv_id, (sum(4 + ceil(length(coalesce(text, '')) / 4.0)) + 3)::BIGINT AS estimated_tokens FROM conversations GROUP BY 1)
SELECT conv_id, estimated_tokens, CASE WHEN estimated_tokens * 4 < 1024 THEN (estimated_tokens * 4)::VARCHAR || 'B' WHEN estimated_tokens * 4 < 1048576 THEN printf('%.1fKB', floor(estimated_tokens * 4 / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.2fMB', floor(estimated_tokens * 4 / 1048576.0 * 100 + 0.5) / 100) END AS size,
  printf('%.2fMB', floor(estimated_tokens * 4000 / 1048576.0 * 100 + 0.5) / 100) AS thousandfold FROM t""")
def token_estimate(spark, d):
    out = text.conversation_tokens(_t(spark, d, "conversations"), "conv_id", "text")
    large = F.col("estimated_tokens") * 1000
    return out.select("conv_id", "estimated_tokens", text.byte_size("estimated_tokens").alias("size"), F.when(large * 4 >= 1024 * 1024, text.byte_size(large)).otherwise(F.format_string("%.2fMB", large * 4 / F.lit(1048576.0))).alias("thousandfold"))


@query("SELECT c_custkey, lower(regexp_extract(c_name, '^([A-Za-z]*)', 1)) AS word, CASE WHEN c_nationkey < 8 THEN 'low' WHEN c_nationkey < 16 THEN 'medium' ELSE 'high' END AS nation_class, CASE WHEN age < 30 THEN 'young' WHEN age < 60 THEN 'adult' ELSE 'senior' END AS age_class, 'mail.example' || (c_nationkey % 3)::VARCHAR AS domain FROM (SELECT *, 18 + c_custkey % 70 AS age FROM customer)")
def enrich_customers(spark, d):
    c = _t(spark, d, "customer").withColumn("age", 18 + F.pmod("c_custkey", F.lit(70)))
    mail = F.concat(F.lit("user@mail.example"), F.pmod("c_nationkey", F.lit(3)).cast("string"))
    return c.select("c_custkey", F.lower(F.regexp_extract("c_name", "^([A-Za-z]*)", 1)).alias("word"), text.size_class("c_nationkey", 8, 16).alias("nation_class"), text.age_group("age").alias("age_class"), text.email_domain(mail).alias("domain"))


@query("SELECT event_id, try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS number FROM events")
def parsed_numbers(spark, d):
    return _t(spark, d, "events").select("event_id", text.number_or_zero(F.regexp_extract("props", "([0-9]+.*)$", 1)).alias("number"))


@query()
def doc_clean_split(spark, d):
    """Front matter, headings and emphasis are put around each text first, as the table has none."""
    v = _vault(spark, d)
    page = F.concat(F.lit("---\ntags: "), F.array_join("tags", ", "), F.lit("\n---\n# "), text.title_of("path"), F.lit("\n\n**"), F.col("content"), F.lit("**\n\n## Task\n\n- [ ] gone\n\n## Kept\n\nlast words\n"))
    cleaned = markdown.clean_documents(v.select("doc_id", "path", page.alias("page")), "page")
    return markdown.split_documents(cleaned.select("doc_id", F.col("path").alias("source"), "content", "tags"), "content", "source")


# -- retrieval ---------------------------------------------------------------------------------------------


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, d, "embeddings")
    vectors = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


_COS_SQL = "cos AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings c JOIN embeddings q ON q.vec_id % 50 = 0)"


@query(f"WITH {_COS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM cos) SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 20")
def dense_topk(spark, d):
    return retrieval.dense_topk(*_vectors(spark, d), 20).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_COS_SQL} SELECT query_id, count(*) AS n FROM cos WHERE score >= 0.2 GROUP BY 1")
def score_threshold(spark, d):
    v, q = _vectors(spark, d)
    return retrieval.dense_topk(v, q, None, threshold=0.2).groupBy("query_id").agg(F.count("*").alias("n"))


def _modified(ident):
    return F.timestamp_add("DAY", F.pmod(ident, F.lit(60)).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))


@query(f"""WITH {_COS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM cos),
b AS (SELECT query_id, id, score * (1 + 0.3 * exp(ln(0.5) * abs(epoch(TIMESTAMP '2024-01-01' + to_days((id % 60)::INTEGER)) - epoch(TIMESTAMP '2024-03-01')) / 7776000.0) + CASE WHEN id % 3 = 0 THEN 0.25 ELSE 0.0 END) AS score FROM f WHERE n <= 40),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM b) SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 20""")
def decay_rescore(spark, d):
    hits = retrieval.dense_topk(*_vectors(spark, d), 40).drop("rank").withColumn("modified", _modified(F.col("id"))).withColumn("tags", F.when(F.pmod("id", F.lit(3)) == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")))
    formula = retrieval.boosted(F.col("score"), F.col("modified"), F.col("tags"), NOW, ["a"])
    return retrieval.rescored(hits, formula, 20).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("""SELECT id, round(exp(ln(0.5) * x * x), 9) AS closeness FROM (SELECT vec_id AS id, (epoch(TIMESTAMP '2024-01-01' + to_days((vec_id % 60)::INTEGER)) - epoch(TIMESTAMP '2024-01-16')) / 1296000.0 AS x FROM embeddings)""")
def gauss_window(spark, d):
    w = retrieval.decay_window("2024-01-01T00:00:00Z", "2024-01-31T00:00:00Z")
    away = F.unix_micros(_modified(F.col("vec_id")).cast("timestamp")) / 1e6 - F.lit(w["target"].timestamp())
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(retrieval.gauss_decay(away, w["scale"]), 9).alias("closeness"))


_TERMS_SQL = "terms AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^0-9a-zà-ÿœß]+'), lambda w: w <> '')) AS term FROM documents) GROUP BY ALL)"
_SPARSE_SQL = f"{_TERMS_SQL}, sp AS (SELECT q.doc_id AS query_id, c.doc_id AS id, sum(c.tf * q.tf)::DOUBLE AS score FROM terms c JOIN terms q USING (term) WHERE q.doc_id % 50 = 0 GROUP BY ALL)"


def _sparse(spark, d, k):
    docs = _t(spark, d, "documents")
    return retrieval.sparse_topk(docs.select(F.col("doc_id").alias("id"), "text"), retrieval.sparse_rows(docs.where("doc_id % 50 = 0"), "doc_id", "text", "query_id"), k)


@query(f"WITH {_SPARSE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM sp) SELECT * FROM r WHERE rank <= 20")
def sparse_topk(spark, d):
    return _sparse(spark, d, 20).select("query_id", "id", "score", "rank")


_BRANCHES_SQL = f"""{_COS_SQL}, {_SPARSE_SQL}, dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cos), sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sp),
u AS (SELECT query_id, id, score, rank, 1 AS b FROM dr WHERE rank <= 40 UNION ALL SELECT query_id, id, score, rank, 2 FROM sr WHERE rank <= 40)"""


@query(f"""WITH {_BRANCHES_SQL}, f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60.0 + rank)), 12) AS score FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM f)
SELECT query_id, id, rank, round(score, 9) AS score FROM r WHERE rank <= 40""")
def rrf_fusion(spark, d):
    dense, sparse = retrieval.dense_topk(*_vectors(spark, d), 40), _sparse(spark, d, 40)
    return retrieval.hybrid(dense, sparse, None, 10).select("query_id", "id", "rank", F.round("score", 9).alias("score"))


@query(f"""WITH {_BRANCHES_SQL}, s AS (SELECT query_id, id, b, score, avg(score) OVER (PARTITION BY query_id, b) - 3 * stddev_pop(score) OVER (PARTITION BY query_id, b) AS low, 6 * stddev_pop(score) OVER (PARTITION BY query_id, b) AS width FROM u),
f AS (SELECT query_id, id, round(sum(CASE WHEN width > 0 THEN greatest(0, least(1, (score - low) / width)) ELSE 0.5 END), 6) AS score FROM s GROUP BY 1, 2)
SELECT query_id, id, round(score + 1e-9, 5) AS score FROM f""")
def dbsf_fusion(spark, d):
    dense, sparse = retrieval.dense_topk(*_vectors(spark, d), 40), _sparse(spark, d, 40)
    return retrieval.dbsf([dense, sparse], 80, 6).select("query_id", "id", _rounded("score", 5).alias("score"))


@query()
def hybrid_search(spark, d):
    """Branches with boosts, fusion, reranking and merged chunks, over hashed embeddings of chunks."""
    docs = _vault(spark, d)
    # a file may be one task's: its texts are dealt to all
    dealt = docs.repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")
    chunks = text.exploded(dealt, text.fixed_chunks("content", 400, 50), "idx", "piece")
    rows = chunks.select(F.concat_ws("#", "path", F.col("idx").cast("string")).alias("id"), F.col("piece").alias("content"), F.col("path").alias("source"), "idx", "tags", "modified")
    vectors = retrieval.embed(rows, "content")
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").cast("string").alias("query_id"), F.col("content").alias("query_text"))
    queries_ = retrieval.embed(asked, "query_text", name="query_vector")
    return retrieval.search(vectors, queries_, 10, NOW, vectors, ["en"], retrieval.decay_window("2024-01-01", "2024-02-01"), retrieval.lexical_score)


def _hits(spark, d) -> DataFrame:
    """All chunks of every document, each overlapping the next."""
    docs = _t(spark, d, "documents")
    pieces = text.exploded(docs.select("doc_id", "text"), text.fixed_chunks("text"), "idx", "content")
    return pieces.select(F.col("doc_id").alias("source"), "idx", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("idx").cast("string")).alias("id"), "content", (1.0 / (1 + F.col("idx"))).alias("score"))


@query("""WITH c AS (SELECT doc_id AS source, unnest(generate_series(0, (length(text) - 1) // 150)) AS idx FROM documents WHERE length(text) > 0),
h AS (SELECT * FROM c WHERE (idx * 7 + source) % 5 < 2),
g AS (SELECT *, coalesce((NOT (idx - lag(idx) OVER (PARTITION BY source ORDER BY idx) BETWEEN 1 AND 2))::INT, 1) AS fresh FROM h),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY idx ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM g)
SELECT source, run, min(idx)::INTEGER AS first_idx, max(idx)::INTEGER AS last_idx, count(*) AS merged_count, max(1.0::DOUBLE / (1 + idx)) AS best_score FROM r GROUP BY 1, 2""")
def chunk_islands(spark, d):
    """Runs with gaps: the hits are those that the SQL picks; chunk_runs has all chunks."""
    return retrieval.islands(_hits(spark, d).where(F.pmod(F.col("idx") * 7 + F.col("source"), F.lit(5)) < 2))


@query("""SELECT doc_id AS source, 1::BIGINT AS run, 0 AS first_idx, ((length(text) - 1) // 150)::INTEGER AS last_idx, (length(text) - 1) // 150 + 1 AS merged_count, 1.0::DOUBLE AS best_score FROM documents WHERE length(text) > 0""")
def chunk_runs(spark, d):
    return retrieval.islands(_hits(spark, d))


@query()
def merge_chunks(spark, d):
    return retrieval.merge_consecutive(_hits(spark, d))


@query()
def embed_documents(spark, d):
    """The ingest flow: clean, split, end marks, embeddings in batches of 50."""
    chunks = doc_clean_split(spark, d).withColumn("chunk", text.add_end_mark("chunk", "<|end|>"))
    return retrieval.embed(chunks, "chunk").select("chunk_id", "source", "chunk_idx", "length", "tags", "vector")


# -- streams -------------------------------------------------------------------------------------------------


def _stream(spark, d) -> DataFrame:
    schema = _t(spark, d, "events").schema
    return streams.event_time(streams.parquet_stream(spark, d, schema, "events.parquet"), "ts", "1 day")


def _sink(name: str) -> str:
    import uuid

    return f"{name}_{uuid.uuid4().hex[:8]}"


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    out = streams.time_windows(_stream(spark, d), "ts", "1 day", by=["event_type"], n=F.count("*"))
    return streams.to_memory(out, _sink("windows"), "complete").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id, count(*) AS kinds FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def stream_distinct(spark, d):
    first = streams.event_time(streams.parquet_stream(spark, d, _t(spark, d, "events").schema, "events.parquet"), "ts", "365 days")
    return streams.to_memory(streams.distinct_within(first, ["user_id", "event_type"]).select("user_id", "event_type"), _sink("distinct")).groupBy("user_id").agg(F.count("*").alias("kinds"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")
def stream_state(spark, d):
    out = streams.running_counts(_stream(spark, d), "user_id", "value", "ts")
    got = streams.to_memory(out, _sink("state"), "update")
    last = Window.partitionBy("user_id").orderBy(F.desc("n"))
    return got.withColumn("r", F.row_number().over(last)).where("r = 1").select("user_id", "n", F.round("total", 3).alias("total"))


@query("SELECT user_id, (count(*) // 8)::BIGINT AS batches FROM events GROUP BY 1 HAVING count(*) >= 8")
def stream_batches(spark, d):
    out = streams.count_buffers(_stream(spark, d), "user_id", 8, "event_id")
    return streams.to_folder(out).groupBy("user_id").agg(F.count("*").alias("batches"))


# -- sources, sinks and whole results -----------------------------------------------------------------


def _some(spark, d) -> Flow:
    return Flow.start(_t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"])


@query("SELECT i AS _ord, i::INTEGER + 1 AS v, (i::INTEGER + 1) * (i::INTEGER + 1) AS square FROM range(10) t(i)")
def rows_in_order(spark, d):
    return corpus.from_rows(spark, range(1, 11), "v int").withColumn("square", F.col("v") * F.col("v"))


@query("SELECT n_nationkey, n_name, n_regionkey, (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS at FROM nation")
def sink_for_each(spark, d):
    """Rows as a driver function gets them, with their index."""
    got: list = []
    _some(spark, d).for_each(lambda row, i: got.append((*row, i)))
    return spark.createDataFrame(got, "n_nationkey int, n_name string, n_regionkey int, at long")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_nationkey DESC LIMIT 7")
def sink_to_array(spark, d):
    f = Flow.start(_some(spark, d).df, [F.desc("n_nationkey")]).take("seven", 7)
    return spark.createDataFrame(f.to_array(), "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT event_id, value * 2 AS twice, true AS success, (SELECT count(*) FROM events WHERE value > 100) AS n FROM events WHERE value > 100")
def sink_execute(spark, d):
    result = Flow.start(_t(spark, d, "events"), ["event_id"]).filter("large", F.col("value") > 100).select("twice", "event_id", (F.col("value") * 2).alias("twice")).execute()
    return result.data.select("event_id", "twice", F.lit(result.success).alias("success"), F.lit(result.metadata["rows"]).cast("long").alias("n"))


@query("""SELECT count(*) AS n, sum(n_nationkey)::BIGINT AS total, (SELECT string_agg(n_name, '>' ORDER BY n_nationkey) FROM nation) AS chain FROM nation""")
def sink_reduce(spark, d):
    """An algebraic fold, and one that depends on the order."""
    f = _some(spark, d)
    sums = f.reduce(F.count("*").alias("n"), F.sum("n_nationkey").alias("total"))
    chain = f.fold(F.lit(""), lambda done, row: F.when(done == "", row["n_name"]).otherwise(F.concat(done, F.lit(">"), row["n_name"])), ["n_name"])
    return spark.createDataFrame([(sums["n"], sums["total"], chain)], "n long, total long, chain string")


@query("SELECT n_name AS answer, n_regionkey AS usage FROM nation")
def sink_answer(spark, d):
    return sinks.answer_output(_some(spark, d).df, "n_name", "n_regionkey")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sink_table(spark, d):
    """Written by region, and read back."""
    path = _folder(spark, "table")
    sinks.write_table(_some(spark, d).df, path, ["n_regionkey"])
    return spark.read.parquet(path).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY 1")
def compose_hybrid(spark, d):
    """Right to left; a step that has a body of its own for static frames; a tap lets rows pass."""
    static = flow.hybrid(lambda df: df.groupBy("n_regionkey").agg(F.count("*").alias("n")), lambda df: df)
    f = _some(spark, d).tap("seen", rows=F.count("*")).add("counted", flow.compose(static, flow.lift_filter(F.col("n_nationkey") > 3)))
    return f.build()


@query("SELECT name, ok FROM (VALUES ('size 0', true), ('size -1', true), ('slide 0', true), ('buffer 0 s', true), ('page 0', true), ('skip -1', true)) t(name, ok)")
def invalid_sizes(spark, d):
    """Sizes that must be refused, and whether they were."""
    e = _t(spark, d, "events")
    calls = {
        "size 0": lambda: windows.batch(e, 0, ["event_id"]),
        "size -1": lambda: windows.count_window(e, -1, None, ["event_id"]),
        "slide 0": lambda: windows.count_window(e, 3, 0, ["event_id"]),
        "buffer 0 s": lambda: windows.buffer_time(e, 0, "ts", ["event_id"]),
        "page 0": lambda: order.page(e, 0, 0, ["event_id"]),
        "skip -1": lambda: order.skip(e, -1, ["event_id"]),
    }

    def refused(call) -> bool:
        try:
            call()
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(name, refused(call)) for name, call in calls.items()], "name string, ok boolean")


def _folder(spark, name: str) -> str:
    """A new folder in the shared one; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/{_sink(name)}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def _notes(spark, d) -> str:
    """The five regions as Markdown files in folders, beside a file of another kind."""
    root, jvm = _folder(spark, "notes"), spark.sparkContext._jvm
    for r in _t(spark, d, "region").collect():  # five rows
        for name in (f"a/r{r['r_regionkey']}/{r['r_name']}.md", f"a/{r['r_name']}.txt"):
            path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
            out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
            out.write(bytearray(f"# {r['r_name']}\nline {r['r_regionkey']}\n".encode()))
            out.close()
    return root


@query("SELECT 'a/r' || r_regionkey::VARCHAR || '/' || r_name || '.md' AS file, r_name || '.md' AS name FROM region")
def discover_files(spark, d):
    root = _notes(spark, d)
    return corpus.discover_files(spark, root).select(F.substring("path", len(root) + 2, 10_000).alias("file"), "name")


@query("SELECT r_name || '.md' AS name, '# ' || r_name || chr(10) || 'line ' || r_regionkey::VARCHAR || chr(10) AS content FROM region")
def read_files(spark, d):
    return corpus.read_files(spark, _notes(spark, d), skip_bad=True).select(text.base_name("source").alias("name"), "content")


@query("SELECT r_name AS name, '# ' || r_name || chr(10) || 'line ' || r_regionkey::VARCHAR || chr(10) AS content FROM region WHERE r_regionkey = 1")
def read_one_file(spark, d):
    name = _t(spark, d, "region").where("r_regionkey = 1").first()["r_name"]
    return corpus.read_file(spark, f"{_notes(spark, d)}/a/r1/{name}.md").select(F.lit(name).alias("name"), "content")


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation")
def extract_files(spark, d):
    """Rows of an array of files, as a form upload gives them."""
    uploads = _some(spark, d).df.groupBy("n_regionkey").agg(F.collect_list(F.struct("n_regionkey", "n_nationkey", "n_name")).alias("files"))
    return corpus.extract_files(uploads)


@query(f"WITH {_VAULT_SQL} SELECT path FROM vault WHERE path LIKE 'en/%'")
def list_files(spark, d):
    return corpus.list_files(_vault(spark, d), "en").select("path")


@query(f"WITH {_VAULT_SQL}, one AS (SELECT path, content FROM vault WHERE doc_id = (SELECT min(doc_id) FROM documents)) SELECT 'success' AS status, path, content FROM one UNION ALL VALUES ('not_found', 'no/such.md', NULL), ('invalid_path', '../x.md', NULL), ('invalid_path', '/x.md', NULL)")
def file_read(spark, d):
    v = _vault(spark, d)
    first = v.orderBy("doc_id").select("path").first()["path"]
    out = []
    for path in (first, "no/such.md", "../x.md", "/x.md"):
        got = corpus.file_at(v.select("path", "content"), path)
        out.append((got["status"], path, got["row"] and got["row"]["content"]))
    return spark.createDataFrame(out, "status string, path string, content string")


@query("""WITH p AS (SELECT p_partkey, length(to_json({p_partkey: p_partkey, p_name: p_name})) + 1 AS n, row_number() OVER (ORDER BY p_partkey) AS i FROM part),
u AS (SELECT *, sum(n) OVER (ORDER BY i) + 1 AS upto, (SELECT count(*) FROM part) AS total FROM p),
k AS (SELECT greatest(20, total // pow(2, s)::BIGINT) AS k FROM (SELECT DISTINCT total FROM u), range(30) t(s)),
fit AS (SELECT max(k) AS k FROM k WHERE k = 20 OR (SELECT upto FROM u WHERE i = k) <= 4096)
SELECT p_partkey FROM u WHERE i <= (SELECT k FROM fit)""")
def halved_answer(spark, d):
    return order.halve_to_bytes(_t(spark, d, "part").select("p_partkey", "p_name"), ["p_partkey"], 4096, 20).select("p_partkey")


@query(f"""WITH {_PARSED_SQL}, bad AS (SELECT event_id, k FROM p WHERE NOT coalesce(k % 7 <> 0, false))
SELECT 'fail_fast' AS strategy, 'STREAM_ERROR' AS code, 'Failed on ' || (SELECT k FROM bad ORDER BY event_id LIMIT 1)::VARCHAR AS message, false AS retryable, (SELECT min(event_id) FROM bad) AS first_index, (SELECT count(*) FROM bad) AS failed
UNION ALL SELECT 'collect_errors', 'LIST_PROCESSING_ERRORS', (SELECT count(*) FROM bad)::VARCHAR || ' of ' || (SELECT count(*) FROM p)::VARCHAR || ' items failed', false, (SELECT min(event_id) FROM bad), (SELECT count(*) FROM bad)""")
def error_strategies(spark, d):
    """What the strategies that fail as a whole raise."""
    out = []
    for strategy in (errors.Strategy.FAIL_FAST, errors.Strategy.COLLECT_ERRORS):
        try:
            errors.resolve(_parsed(spark, d), strategy)
        except errors.ProcessingError as e:
            out.append((strategy.value, e.code, str(e), e.retryable, e.errors[0][0], e.total))
    return spark.createDataFrame(out, "strategy string, code string, message string, retryable boolean, first_index long, failed long")


@query("SELECT 'found' AS name, true AS success, NULL AS code, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS n UNION ALL VALUES ('missing', false, 'NOT_FOUND', 0), ('misfit', false, 'INVALID_INPUT', 0)")
def tool_lookup(spark, d):
    """Flows looked up by name, with what is answered where there is none or the input doesn't fit."""
    registry = flow.Registry()
    asked = T.StructType([T.StructField("n_regionkey", T.IntegerType())])
    registry.register("found", lambda df: df.where("n_regionkey = 1"), asked, tags=["nations"])
    registry.register("misfit", lambda df: df, T.StructType([T.StructField("no_such", T.LongType())]))
    out = []
    for name in ("found", "missing", "misfit"):
        r = registry.execute(name, _some(spark, d).df)
        out.append((name, r.success, r.error and r.error["code"], r.data.count() if r.success else 0))
    return spark.createDataFrame(out, "name string, success boolean, code string, n long")


# -- texts and retrieval, on inputs whose results SQL can tell ---------------------------------------------


@query("""SELECT p_partkey, '# ' || p_name || chr(10) || chr(10) || p_type || ' and ' || p_brand || ' or gone `**code**` [l](a_b_c)' || chr(10) || chr(10) || '## Kept' || chr(10) || chr(10) || 'last words' AS content, [p_brand, 'x y'] AS tags, p_brand || ', x y' AS raw FROM part""")
def clean_markdown(spark, d):
    """Front matter, removed sections and emphasis around plain texts."""
    p = _t(spark, d, "part")
    page = F.concat(F.lit("---\ntags: "), "p_brand", F.lit(", x y\nother: [1, 2]\n---\n# "), "p_name", F.lit("\n\n**"), "p_type", F.lit("** and _"), "p_brand", F.lit("_ or ~~gone~~ `**code**` [l](a_b_c)\n\n## Task\n\n- [ ] gone\n\n### Deeper\n\ngone\n\n## Kept\n\nlast words\n"))
    out = markdown.clean_documents(p.select("p_partkey", page.alias("page")), "page")
    return out.select("p_partkey", "content", "tags", F.col("frontmatter")["tags"].alias("raw"))


@query("""WITH t AS (SELECT p_partkey, p_size * 100 + p_partkey % 100 AS n FROM part),
b AS (SELECT p_partkey, k * 2000 AS start, least(2000, n - k * 2000) AS len FROM t, range(3) r(k) WHERE k * 2000 < n),
c AS (SELECT p_partkey, start, start + j * 900 AS first, least(1000, len - j * 900) AS size FROM b, range(3) r(j) WHERE j = 0 OR (len > 1000 AND j * 900 + 100 < len))
SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY start, first) - 1) AS chunk_idx, size::BIGINT AS length, substr(repeat('0123456789', 600), first::INTEGER + 1, size::INTEGER) AS chunk FROM c""")
def split_markdown(spark, d):
    """Texts without a separator: pieces of 2,000, cut again into 1,000 with an overlap of 100."""
    size = F.col("p_size") * 100 + F.pmod("p_partkey", F.lit(100)).cast("int")
    # a few bytes a row become thousands, so more tasks than the table has parts
    parts = _t(spark, d, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    texts = parts.select("p_partkey", F.substring(F.repeat(F.lit("0123456789"), 600), F.lit(1), size).alias("content"))
    return markdown.split_documents(texts, "content", "p_partkey").select("p_partkey", "chunk_idx", "length", "chunk")


@query("""WITH c AS (SELECT c_custkey, string_agg(md5(c_custkey::VARCHAR || '-' || i::VARCHAR), '' ORDER BY i) AS content FROM customer, range(9) t(i) GROUP BY 1)
SELECT c_custkey AS source, 1 AS first_idx, 5 AS last_idx, 5::BIGINT AS merged_count, left(content, 280) AS content, 0.5::DOUBLE AS score FROM c
UNION ALL SELECT c_custkey, 9, 11, 2, substr(content, 201, 40) || ' ' || substr(content, 249, 40), 0.5 FROM c""")
def merge_runs(spark, d):
    """Two runs a source: five chunks of 80 with overlaps of 30, and two without one, two apart."""
    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit("-"), i.cast("string")))), "")
    texts = _t(spark, d, "customer").select(F.col("c_custkey").alias("source"), whole.alias("t"))
    cut = lambda idx, start, size: F.struct(F.lit(idx).alias("idx"), F.substring("t", start, size).alias("content"))
    chunks = texts.select("source", F.inline(F.array(*(cut(1 + k, 1 + 50 * k, 80) for k in range(5)), cut(9, 201, 40), cut(11, 249, 40))))
    hits = chunks.withColumn("id", F.concat_ws("#", "source", "idx")).withColumn("score", F.lit(0.5))
    return retrieval.merge_consecutive(hits).select("source", "first_idx", "last_idx", "merged_count", "content", F.round("score", 9).alias("score"))


@query("""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^0-9a-zà-ÿœß]+'), lambda x: x <> '')) AS w FROM documents)
SELECT q.doc_id AS query_id, c.doc_id AS id, 1::INTEGER AS rank, 1.0::DOUBLE AS vector_score, round(CASE WHEN len(q.w) > 0 THEN len(list_intersect(q.w, c.w)) / len(q.w)::DOUBLE ELSE 0 END, 9) AS score
FROM w q JOIN w c ON c.doc_id = q.doc_id + 1""")
def rerank_lexical(spark, d):
    """Each text as a query that its successor answers."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    hits = docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("q")).join(docs.select((F.col("doc_id") - 1).alias("query_id"), F.col("doc_id").alias("id"), F.col("text").alias("body")), "query_id").withColumn("score", F.lit(1.0))
    out = retrieval.rerank(hits.withColumn("rank", F.lit(1)), F.col("q"), F.col("body"), 5)
    return out.select("query_id", "id", "rank", "vector_score", F.round("score", 9).alias("score"))


@query(f"WITH {_VAULT_SQL}, h AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id)::INTEGER AS rank FROM vault WHERE list_has_any(tags, ['de', 'short'])) SELECT q.doc_id AS query_id, id, rank, 1.0::DOUBLE AS score FROM h, documents q WHERE rank <= 25 AND q.doc_id % 50 = 0")
def tag_prefilter(spark, d):
    v = _vault(spark, d)
    return retrieval.tag_branch(v.select(F.col("doc_id").alias("id"), "tags"), ["de", "short"], v.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id")), 25).select("query_id", "id", "rank", "score")


@query("SELECT query_id, index, name, score FROM (SELECT n_regionkey AS query_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS index, n_name AS name, 1.0::DOUBLE / (1 + n_nationkey) AS score FROM nation) WHERE index < 3")
def rank_to_hit(spark, d):
    """Positions that a reranker answers with, back to their hits; those that no hit has vanish."""
    n = order.with_position(_some(spark, d).df, ["n_nationkey"], "index", ["n_regionkey"]).select(F.col("n_regionkey").alias("query_id"), "index", F.col("n_name").alias("name"), F.lit(0.0).alias("score"), "n_nationkey")
    ranks = n.where("index < 3").select("query_id", "index", (1.0 / (1 + F.col("n_nationkey"))).alias("score"))
    ranks = ranks.union(ranks.select("query_id", F.col("index") + 1000, "score"))
    return retrieval.zip_by_rank(n.drop("n_nationkey"), ranks).select("query_id", "index", "name", "score")


@query("SELECT p_partkey, '<Instruct>: Find parts. Current date: 2024-03-01' || chr(10) || '<Query>: ' || p_brand AS query, '<Document>: ' || p_name AS document FROM part")
def instructed(spark, d):
    q, doc = text.instruction("Find parts.", retrieval.today(NOW), F.col("p_brand"), F.col("p_name"))
    return _t(spark, d, "part").select("p_partkey", q.alias("query"), doc.alias("document"))


@query("SELECT p_partkey, [length(p_name)::DOUBLE, 1.0::DOUBLE] AS vector FROM part")
def embed_in_batches(spark, d):
    """An embedder that gets 50 texts at a time."""
    return retrieval.embed_batches(_t(spark, d, "part").select("p_partkey", "p_name"), "p_name", lambda texts: [[float(len(t)), float(len(texts) <= 50)] for t in texts]).select("p_partkey", "vector")


@query("""WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part), c AS (SELECT p_partkey, w, count(*) AS n FROM t GROUP BY 1, 2)
SELECT p_partkey, count(*) AS terms, sum(n)::DOUBLE AS total, max(n)::DOUBLE AS largest, true AS rising FROM c GROUP BY 1""")
def sparse_vectors(spark, d):
    v = _t(spark, d, "part").select("p_partkey", retrieval.sparse_vector(F.split("p_name", " ")).alias("v"))
    return v.select("p_partkey", F.size("v.indices").cast("long").alias("terms"), F.aggregate("v.values", F.lit(0.0), lambda a, x: a + x).alias("total"), F.array_max("v.values").alias("largest"), (F.array_sort("v.indices") == F.col("v.indices")).alias("rising"))


@query("""SELECT * FROM (VALUES ('both', TIMESTAMP '2024-01-16', 1296000::BIGINT), ('start only', TIMESTAMP '2024-01-31', 2592000), ('end only', TIMESTAMP '2020-01-16', 1296000),
('last_7_days', TIMESTAMP '2024-02-26 12:00:00', 302400), ('last_14_days', TIMESTAMP '2024-02-23 00:00:00', 604800), ('this_week', TIMESTAMP '2024-02-28 00:00:00', 172800), ('this_month', NULL, NULL)) t(name, target, scale)""")
def date_windows(spark, d):
    """Decay windows of given dates and of named ranges; a range that has not begun is none."""
    asked = {"both": ("2024-01-01", "2024-01-31"), "start only": ("2024-01-01", None), "end only": (None, "2020-01-31")}
    out = []
    for name, (start, end) in asked.items():
        w = retrieval.date_range(start, end, NOW)
        out.append((name, w["target"].replace(tzinfo=None), w["scale"]))
    for name in ("last_7_days", "last_14_days", "this_week", "this_month"):
        try:
            w = retrieval.decay_window(*retrieval.preset_range(name, NOW))
            out.append((name, w["target"].replace(tzinfo=None), w["scale"]))
        except ValueError:
            out.append((name, None, None))
    return spark.createDataFrame(out, "name string, target timestamp_ntz, scale long")


# -- logs and outputs ------------------------------------------------------------------------------------------


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) > 1 AS repeated,
coalesce(lag(event_type, 1) OVER w = event_type, false) AND coalesce(lag(event_type, 2) OVER w = event_type, false) AS stuck FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def tool_loop_detection(spark, d):
    calls = _t(spark, d, "events").select("event_id", "user_id", "event_type", "props")
    return running.tool_loops(calls, "event_type", "props", ["event_id"], ["user_id"]).select("event_id", "repeated", "stuck")


@query("""SELECT vec_id, len(embedding) AS dims, 0::BIGINT AS n_tags, (SELECT count(*) FROM documents) AS total_files, (SELECT count(*) FROM embeddings) AS total_chunks FROM embeddings""")
def embedded_output(spark, d):
    chunks = _t(spark, d, "embeddings").withColumn("tags", F.lit(None).cast("array<string>"))
    out = sinks.embedded_output(chunks, _t(spark, d, "documents").select("doc_id"))
    return out.select("vec_id", F.size("vector").cast("long").alias("dims"), F.size("tags").cast("long").alias("n_tags"), "total_files", "total_chunks")


@query("""SELECT count(*) AS items, count(*) FILTER (json_extract_string(j, '$.event_type') = 'click') AS clicks FROM (SELECT to_json({event_id: event_id, event_type: event_type}) AS j FROM events)""")
def json_output(spark, d):
    rows = sinks.json_rows(_t(spark, d, "events").select("event_id", "event_type"))
    return rows.agg(F.count("*").alias("items"), F.count_if(F.get_json_object("json", "$.event_type") == "click").alias("clicks"))
