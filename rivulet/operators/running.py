"""Running state over ordered rows, as window frames."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import Order


def so_far(order: Order, by: Sequence[str] = ()):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_count(df: DataFrame, item: str, order: Order, by: Sequence[str] = ()) -> DataFrame:
    """How often the row's item came so far, and all items so far, within ``by``."""
    return df.withColumn("item_count", F.count("*").over(so_far(order, [*by, item]))).withColumn("total_count", F.count("*").over(so_far(order, by)))


def running_stats(df: DataFrame, value: str, order: Order, by: Sequence[str] = ()) -> DataFrame:
    w = so_far(order, by)
    return df.select("*", F.count(value).over(w).alias("run_count"), F.sum(value).over(w).alias("run_sum"), F.avg(value).over(w).alias("run_avg"), F.min(value).over(w).alias("run_min"), F.max(value).over(w).alias("run_max"))


def running_balance(df: DataFrame, amount: str, credit: Column, order: Order, by: Sequence[str] = ()) -> DataFrame:
    """Credits add, all other rows subtract."""
    return df.withColumn("balance", F.sum(F.when(credit, F.col(amount)).otherwise(-F.col(amount))).over(so_far(order, by)))


def running_counters(df: DataFrame, counters: dict[str, Column], order: Order, by: Sequence[str] = ()) -> DataFrame:
    w = so_far(order, by)
    return df.select("*", *(F.count_if(c).over(w).alias(name) for name, c in counters.items()))


def milestones(df: DataFrame, value: str, every: float, order: Order, by: Sequence[str] = ()) -> DataFrame:
    """Rows at which the running total passes a multiple of ``every``, or reaches it from below.

    Floating-point values add up as the decimals of up to 9 places that they print as, so a total
    that is a multiple counts as one whatever the rounding of sums; from a value that is no such decimal on
    (more places, 1e19 or more, NaN) the total is a floating-point sum.
    """
    if every <= 0:
        raise ValueError("every must be positive")
    w, step = so_far(order, by), Decimal(str(every))
    if df.schema[value].dataType.typeName() not in ("double", "float") or step.as_tuple().exponent < -9 or step >= 10**19:
        out = df.withColumn("running_total", F.sum(value).over(w))
        return out.where(F.floor(F.col("running_total") / every) > F.floor((F.col("running_total") - F.col(value)) / every))
    plain, exact = F.col(value).cast("double"), F.col(value).try_cast("decimal(28,9)")
    odd = F.count_if(plain.isNotNull() & ~F.coalesce(exact.cast("double") == plain, F.lit(False)))
    out = df.withColumn("_exact", F.sum(exact).over(w)).withColumn("_plain", F.sum(plain).over(w)).withColumn("_odd", odd.over(w) > 0)
    last = lambda total: total - F.pmod(total, F.lit(f"{step:f}").cast("decimal(28,9)"))  # noqa: E731  the last multiple: a division would round
    double = F.floor(F.col("_plain") / every) > F.floor((F.col("_plain") - plain) / every)
    out = out.where(F.when(F.col("_odd"), double).otherwise(last(F.col("_exact")) > last(F.col("_exact") - exact)))
    return out.withColumn("running_total", F.when(F.col("_odd"), F.col("_plain")).otherwise(F.col("_exact").cast("double"))).drop("_exact", "_plain", "_odd")


def moving_average(df: DataFrame, value: str, size: int, order: Order, by: Sequence[str] = ()) -> DataFrame:
    """Mean of each full frame of ``size`` rows, and its trend from first to last."""
    if size <= 0:
        raise ValueError("size must be positive")
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(size - 1), 0)
    out = df.select("*", F.count("*").over(w).alias("_n"), F.avg(value).over(w).alias("moving_avg"), (F.col(value) - F.first(value).over(w)).alias("_change"))
    trend = F.when(F.col("_change") > 0, "up").when(F.col("_change") < 0, "down").otherwise("flat")
    return out.where(F.col("_n") == size).withColumn("trend", trend).drop("_n", "_change")


def spikes(df: DataFrame, bad: Column, size: int, least: int, order: Order, by: Sequence[str] = ()) -> DataFrame:
    """Full frames of ``size`` rows that hold ``least`` bad ones or more."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(size - 1), 0)
    out = df.select("*", F.count("*").over(w).alias("_n"), F.count_if(bad).over(w).alias("bad_count"))
    return out.where((F.col("_n") == size) & (F.col("bad_count") >= least)).drop("_n")


def pattern_ends(df: DataFrame, value: str, pattern: Sequence, order: Order, by: Sequence[str] = ()) -> DataFrame:
    """Rows that end an occurrence of ``pattern`` in consecutive rows.

    Exact for patterns that cannot overlap themselves; others need pattern_fold().
    """
    n = len(pattern)
    if any(list(pattern[:k]) == list(pattern[n - k :]) for k in range(1, n)):
        raise ValueError("this pattern overlaps itself; use pattern_fold")
    w = Window.partitionBy(*by).orderBy(*order)
    hit = F.col(value) == F.lit(pattern[-1])
    for back, v in enumerate(reversed(pattern[:-1]), start=1):
        hit &= F.coalesce(F.lag(value, back).over(w) == F.lit(v), F.lit(False))
    return df.withColumn("_hit", hit).where("_hit").drop("_hit")


def pattern_fold(df: DataFrame, value: str, pattern: Sequence, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Rows that complete ``pattern`` in an automaton that starts over on a mismatch (and tries the row as a first)."""
    import pyarrow as pa

    def run(batches):
        key, state = None, 0
        for rows in batches:
            keep = []
            for *mine, v in zip(*(rows.column(rows.schema.get_field_index(c)).to_pylist() for c in (*by, value))):
                if mine != key:
                    key, state = mine, 0
                state = state + 1 if v == pattern[state] else int(v == pattern[0])
                keep.append(state == len(pattern))
                state %= len(pattern)
            yield rows.filter(pa.array(keep, pa.bool_()))

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, df.schema)


def bucket_sessions(df: DataFrame, user: str, time_col: str, seconds: int) -> DataFrame:
    """Fixed buckets of time per user: their rows, first and last time."""
    bucket = F.floor(F.unix_micros(F.col(time_col).cast("timestamp")) / (seconds * 1_000_000)).cast("long")
    return df.groupBy(user, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min(time_col).alias("first_ts"), F.max(time_col).alias("last_ts"))


def gap_sessions(df: DataFrame, user: str, time_col: str, seconds: int) -> DataFrame:
    """Sessions parted by more than ``seconds`` without a row."""
    t = F.unix_micros(F.col(time_col).cast("timestamp"))
    w = Window.partitionBy(user).orderBy(time_col)
    fresh = (t - F.lag(t).over(w) > seconds * 1_000_000).cast("long")
    numbered = df.withColumn("session", F.coalesce(F.sum(F.coalesce(fresh, F.lit(0))).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return numbered.groupBy(user, "session").agg(F.count("*").alias("n"), F.min(time_col).alias("first_ts"), F.max(time_col).alias("last_ts"))


def first_of(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """The first row of each key.

    The order's columns are aggregated with the row, so partial aggregation
    keeps one row per key and task and a hot key never meets in one task.
    """
    row = F.struct(*df.columns)
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*columns)).alias("_row")).select("_row.*")


def tool_loops(calls: DataFrame, tool: str, arguments: str, order: Order, by: Sequence[str], most: int = 3) -> DataFrame:
    """Calls with ``repeated`` (the same tool and arguments came before) and ``stuck`` (``most`` calls of one tool in a row)."""
    w = Window.partitionBy(*by).orderBy(*order)
    repeated = F.row_number().over(Window.partitionBy(*by, tool, arguments).orderBy(*order)) > 1
    same = [F.coalesce(F.lag(tool, back).over(w) == F.col(tool), F.lit(False)) for back in range(1, most)]
    stuck = F.lit(True)
    for s in same:
        stuck = stuck & s
    return calls.withColumn("repeated", repeated).withColumn("stuck", stuck)
