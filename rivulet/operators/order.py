"""Positions and prefixes of ordered data.

A DataFrame has no order of its own, so every positional operator takes an
explicit one (``order``: column names or sort columns, ending in a unique key).
take, skip and page use sort-limit plans and never number all rows.  Operators
that need a dense position get it from ``with_position``: within a key by a
window, globally by a range partitioning whose per-partition counts are
added up, so that no step runs on one partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import cut_lineage

Order = Sequence[str | Column]

#: Plans estimated below this many bytes number their rows in one window.
SMALL_BYTES = 64 << 20


def _checked(order: Order) -> list[str | Column]:
    order = [order] if isinstance(order, (str, Column)) else list(order)
    if not order:
        raise ValueError("a positional operator needs an order")
    return order


def _estimate(df: DataFrame) -> int:
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except AttributeError:  # a client without a JVM
        return SMALL_BYTES


def with_position(df: DataFrame, order: Order, name: str = "idx", by: Sequence[str] = (), distributed: bool | None = None) -> DataFrame:
    """``df`` with its dense 0-based position, within ``by`` if given."""
    order = _checked(order)
    if by:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    if distributed is None:
        distributed = _estimate(df) > SMALL_BYTES
    if not distributed:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    part, here, before = "_pos_part", "_pos_here", "_pos_before"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # range bounds are sampled: fix them before counting
    ranged = cut_lineage(ranged.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(here)))
    counts = ranged.groupBy(part).agg(F.count("*").alias("_pos_n"))
    offsets = counts.select(F.col(part).alias("_pos_of"), (F.sum("_pos_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_pos_n")).alias(before))
    # one row per partition, so its size is bounded by the partitioning
    placed = ranged.join(F.broadcast(offsets), F.col(part) == F.col("_pos_of"))
    return placed.select(*df.columns, (F.col(before) + F.col(here)).cast("long").alias(name))


def take(df: DataFrame, n: int, order: Order) -> DataFrame:
    """The first n rows; none for n <= 0."""
    return df.orderBy(*_checked(order)).limit(max(n, 0))


def skip(df: DataFrame, n: int, order: Order) -> DataFrame:
    """All but the first n rows; a negative n is an error."""
    if n < 0:
        raise ValueError(f"skip count must not be negative: {n}")
    return df.orderBy(*_checked(order)).offset(n)


def skip_step(df: DataFrame, n: int, order: Order) -> DataFrame:
    """As skip(), but a negative n skips nothing."""
    return skip(df, max(n, 0), order)


def page(df: DataFrame, number: int, size: int, order: Order) -> DataFrame:
    """Page ``number`` (from 0); empty beyond the end."""
    if size <= 0:
        raise ValueError("page size must be positive")
    return df.orderBy(*_checked(order)).offset(number * size).limit(size)


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next rows by a unique key; the filter reaches the scan."""
    return df.where(F.col(key) > F.lit(after)).orderBy(key).limit(size)


def _edge(df: DataFrame, predicate: Column, order: list) -> DataFrame:
    """One row: the order key of the first row that fails the predicate (null keys included), or none."""
    keys = [o if isinstance(o, Column) else F.col(o) for o in order]
    return df.where(~F.coalesce(predicate, F.lit(False))).select(F.min(F.struct(*keys)).alias("_edge"))


def take_while(df: DataFrame, predicate: Column, order: Order) -> DataFrame:
    """Rows before the first that fails ``predicate``.  ``order`` is ascending columns."""
    order = _checked(order)
    key = F.struct(*order)
    return df.crossJoin(F.broadcast(_edge(df, predicate, order))).where(F.col("_edge").isNull() | (key < F.col("_edge"))).drop("_edge")


def skip_while(df: DataFrame, predicate: Column, order: Order) -> DataFrame:
    """Rows from the first that fails ``predicate`` on."""
    order = _checked(order)
    key = F.struct(*order)
    return df.crossJoin(F.broadcast(_edge(df, predicate, order))).where(F.col("_edge").isNotNull() & (key >= F.col("_edge"))).drop("_edge")


def indexed_filter(df: DataFrame, predicate: Callable[[Column], Column], order: Order) -> DataFrame:
    """Filter by a predicate of the row's position."""
    return with_position(df, order, "_at").where(predicate(F.col("_at"))).drop("_at")


def top(df: DataFrame, n: int, by: Order, per: Sequence[str] = ()) -> DataFrame:
    """The first n rows by ``by``, of each ``per`` if given (pruned before the shuffle by WindowGroupLimit)."""
    if not per:
        return df.orderBy(*by).limit(n)
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*per).orderBy(*by))).where(F.col("_rank") <= n).drop("_rank")


def halve_to_bytes(df: DataFrame, order: Order, most_bytes: int, least_rows: int) -> DataFrame:
    """The longest prefix, got by halving the row count, whose JSON rows fit ``most_bytes``; never under ``least_rows``.

    Sizes are measured by a running sum over the (already limited) rows.
    """
    order = _checked(order)
    sized = with_position(df, order, "_at").withColumn("_upto", F.sum(F.octet_length(F.to_json(F.struct(*df.columns))) + 1).over(Window.orderBy("_at")) + 1)
    n = sized.count()
    while n > least_rows:
        upto = sized.where(F.col("_at") == n - 1).select("_upto").first()
        if upto is None or upto[0] <= most_bytes:
            break
        n = max(least_rows, n // 2)
    return sized.where(F.col("_at") < n).drop("_at", "_upto")
