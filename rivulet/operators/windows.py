"""Batches and windows over item counts, predicates and times.

Batches keep a partial last group, count windows drop it.  A slide beyond the
size leaves gaps.  Group numbers come from position arithmetic, so grouping is
one shuffle on the group number; nothing depends on arrival order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import Order, with_position


def _positive(**values: int | float | None) -> None:
    for name, v in values.items():
        if v is not None and v <= 0:
            raise ValueError(f"{name} must be positive: {v}")


def _items(columns: Sequence[str]) -> Column:
    """Rows of a group as an array in position order."""
    ordered = F.array_sort(F.collect_list(F.struct("_at", F.struct(*columns).alias("item"))))
    return F.transform(ordered, lambda x: x["item"])


def with_batch(df: DataFrame, size: int, order: Order, name: str = "batch", by: Sequence[str] = ()) -> DataFrame:
    """Rows with the number of their batch of ``size``."""
    _positive(size=size)
    return with_position(df, order, "_at", by).withColumn(name, F.floor(F.col("_at") / size).cast("long")).drop("_at")


def batch(df: DataFrame, size: int, order: Order, by: Sequence[str] = (), name: str = "batch") -> DataFrame:
    """One row per batch: its number and ``items``; the last may be smaller."""
    _positive(size=size)
    placed = with_position(df, order, "_at", by).withColumn(name, F.floor(F.col("_at") / size).cast("long"))
    return placed.groupBy(*by, name).agg(_items(df.columns).alias("items"))


def unbatch(df: DataFrame, items: str = "items") -> DataFrame:
    """Arrays back to rows, in order of (batch, position): columns of the items."""
    return df.select(F.inline(items))


def batch_items(items: Column, size: int) -> Column:
    """An array cut into arrays of ``size``, inside the row; an empty array gives none."""
    _positive(size=size)
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(items, s, F.lit(size)))


def variable_batches(df: DataFrame, sizes: Sequence[int], order: Order, name: str = "batch") -> DataFrame:
    """Rows of consecutive batches of the given sizes; rows beyond the last are left out."""
    _positive(**{f"size {i}": s for i, s in enumerate(sizes)})
    placed, upto, number = with_position(df, order, "_at"), 0, None
    for i, s in enumerate(sizes):
        upto += s
        cond = F.col("_at") < upto
        number = F.when(cond, i) if number is None else number.when(cond, i)
    return placed.where(F.col("_at") < upto).withColumn(name, number.cast("long")).drop("_at")


def count_window(df: DataFrame, size: int, slide: int | None = None, order: Order = (), by: Sequence[str] = (), name: str = "window") -> DataFrame:
    """One row per full window of ``size`` items, a new one every ``slide`` items (default: size)."""
    slide = size if slide is None else slide
    _positive(size=size, slide=slide)
    placed = count_window_rows(df, size, slide, order, by, name)
    return placed.groupBy(*by, name).agg(F.count("*").alias("_n"), _items(df.columns).alias("items")).where(F.col("_n") == size).drop("_n")


def count_window_rows(df: DataFrame, size: int, slide: int, order: Order, by: Sequence[str] = (), name: str = "window") -> DataFrame:
    """Rows with each window they fall in (``_at`` is their position), before incomplete windows are dropped."""
    _positive(size=size, slide=slide)
    placed = with_position(df, order, "_at", by)
    if slide >= size:
        return placed.where(F.pmod("_at", F.lit(slide)) < size).withColumn(name, F.floor(F.col("_at") / slide).cast("long"))
    first = F.greatest(F.lit(0), F.ceil((F.col("_at") - (size - 1)) / slide)).cast("long")
    last = F.floor(F.col("_at") / slide).cast("long")
    return placed.where(first <= last).withColumn(name, F.explode(F.sequence(first, last)))


def buffer_until(df: DataFrame, trigger: Column, order: Order, by: Sequence[str] = (), name: str = "buffer") -> DataFrame:
    """Rows with the number of their buffer; a row that triggers ends its buffer and belongs to it."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(F.coalesce(trigger, F.lit(False)).cast("long")).over(before), F.lit(0)).cast("long"))


def buffer_fold(df: DataFrame, closes, order: Sequence[str], by: Sequence[str], name: str = "buffer") -> DataFrame:
    """As buffer_until(), where ``closes(buffer, row)`` sees the rows buffered so far (dicts).

    Such a predicate is sequential by nature: each key is folded by itself, streaming through its
    sorted partition, and only the open buffer is held.
    """
    import pyarrow as pa

    schema = df.schema

    def run(batches):
        key, buffer, number = None, [], 0
        for rows in batches:
            numbers = []
            for row in rows.to_pylist():
                mine = tuple(row[c] for c in by)
                if mine != key:
                    key, buffer, number = mine, [], 0
                done = closes(buffer, row)
                numbers.append(number)
                buffer.append(row)
                if done:
                    buffer, number = [], number + 1
            yield rows.append_column(name, pa.array(numbers, pa.int64()))

    ddl = schema.add(name, "long") if name not in schema.names else schema
    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, ddl)


def buffer_time(df: DataFrame, seconds: float, time_col: str, order: Order, most: int | None = None, by: Sequence[str] = (), name: str = "buffer") -> DataFrame:
    """Replay of time buffers over event time: buckets of ``seconds`` from the first row (of each key), cut at ``most`` rows.

    The wall-clock form exists on streams only (streaming.micro_batches).
    """
    _positive(seconds=seconds, most=most)
    micros = F.unix_micros(F.col(time_col).cast("timestamp"))
    start = F.min(micros).over(Window.partitionBy(*by)) if by else None
    if start is None:
        first = df.select(F.min(micros).alias("_t0"))
        df2 = df.crossJoin(F.broadcast(first))
        start = F.col("_t0")
    else:
        df2 = df.withColumn("_t0", start)
        start = F.col("_t0")
    out = df2.withColumn("bucket", F.floor((micros - start) / F.lit(int(seconds * 1_000_000))).cast("long")).drop("_t0")
    if most is None:
        return out.withColumn(name, F.lit(0).cast("long"))
    return with_batch(out, most, order, name, [*by, "bucket"])
