"""Structured Streaming: sources, time windows, deduplication, buffers and custom state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import shared_folder


def parquet_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder as they come; the schema is given, never inferred.  ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def event_time(df: DataFrame, column: str, late: str) -> DataFrame:
    """``column`` as a timestamp (zone-less ones are cast) with a watermark."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def distinct_within(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first row of each key within the watermark; state is bounded by it."""
    return df.dropDuplicatesWithinWatermark(list(keys))


def time_windows(df: DataFrame, column: str, size: str, slide: str | None = None, by: Sequence[str] = (), **aggregates) -> DataFrame:
    """Tumbling or sliding windows of event time (a superset of count windows)."""
    window = F.window(column, size, slide) if slide else F.window(column, size)
    return df.groupBy(*by, window.alias("w")).agg(*(c.alias(n) for n, c in (aggregates or {"n": F.count("*")}).items())).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(aggregates or {"n": None}))


def sessions(df: DataFrame, column: str, gap: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, F.session_window(column, gap).alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def micro_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Wall-clock buffers: a micro-batch per trigger (or all there is, once) goes to ``handle(batch, id)``."""
    writer = df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def running_counts(df: DataFrame, key: str, value: str, time_col: str, key_type: str = "long") -> DataFrame:
    """(key, n, total, last) after each micro-batch, from per-key state that forgets nothing."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, last = state.get if state.exists else (0, 0.0, 0)
        for frame in frames:
            n += len(frame)
            total += float(frame[value].sum())
            last = max(last, int(frame[time_col].max().value // 1000))
        state.update((n, total, last))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total], "last_micros": [last]})

    return df.groupBy(key).applyInPandasWithState(update, f"{key} {key_type}, n long, total double, last_micros long", "n long, total double, last_micros long", "update", GroupStateTimeout.NoTimeout)


def count_buffers(df: DataFrame, key: str, size: int, order: str, key_type: str = "long") -> DataFrame:
    """Per-key batches of ``size`` rows across micro-batches: (key, batch, items as JSON); a partial one waits in state.

    Within a micro-batch rows are taken in ``order``.
    """
    if size <= 0:
        raise ValueError("size must be positive")

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, held = state.get if state.exists else (0, [])
        rows = pd.concat(list(frames)).sort_values(order)
        held = [*held, *rows.to_json(orient="records", lines=True, date_format="iso").splitlines()]
        full = len(held) // size
        out = [(k[0], done + i, held[i * size : (i + 1) * size]) for i in range(full)]
        state.update((done + full, held[full * size :]))
        if out:
            yield pd.DataFrame(out, columns=[key, "batch", "items"])

    return df.groupBy(key).applyInPandasWithState(update, f"{key} {key_type}, batch long, items array<string>", "done long, held array<string>", "append", GroupStateTimeout.NoTimeout)


def to_folder(df: DataFrame) -> DataFrame:
    """Runs a bounded stream that appends to its end and returns what it gave, kept in the shared folder: nothing passes through the driver."""
    folder = f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = df.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")


def to_memory(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a bounded stream to its end and returns what it gave: for tests and small replays."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
