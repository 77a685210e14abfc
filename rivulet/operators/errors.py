"""Per-row results and errors.

A result is a struct {success, data, error {code, message, retryable}, metadata
{item_index, attempts}}.  Column expressions that can fail use Spark's try_*
functions; ``attempt`` runs any Python function in Arrow batches, with retries
inside the task (functions must be idempotent, as Spark may run a task again).
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from enum import Enum

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .state import cut_lineage

# What makes an error worth another try, and codes recognised in messages.
RETRYABLE = ("ECONNRESET", "ETIMEDOUT", "ECONNREFUSED", "fetch failed", "rate limit")
CODES = ("ECONNRESET", "ETIMEDOUT", "ECONNREFUSED")

#: Errors that a raised error holds; their number is always exact.
MOST_ERRORS = 1000

ERROR = T.StructType([T.StructField("code", T.StringType()), T.StructField("message", T.StringType()), T.StructField("retryable", T.BooleanType())])
METADATA = T.StructType([T.StructField("item_index", T.LongType()), T.StructField("attempts", T.IntegerType()), T.StructField("errors", T.ArrayType(T.StringType()))])


class Strategy(Enum):
    FAIL_FAST = "fail_fast"
    COLLECT_ERRORS = "collect_errors"
    SKIP_FAILED = "skip_failed"
    WRAP_ERRORS = "wrap_errors"


class ProcessingError(RuntimeError):
    """Rows failed: a code, whether any is worth another try, how many failed, and the first errors with their indexes."""

    def __init__(self, message: str, code: str, retryable: bool, errors: Sequence = (), total: int | None = None):
        super().__init__(message)
        self.code, self.retryable, self.errors = code, retryable, list(errors)
        self.total = len(self.errors) if total is None else total


def result_type(data: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("success", T.BooleanType()), T.StructField("data", data), T.StructField("error", ERROR), T.StructField("metadata", METADATA)])


def retryable(message: str) -> bool:
    return any(x.lower() in message.lower() for x in RETRYABLE)


def retryable_column(message: Column) -> Column:
    return F.lower(message).rlike("|".join(re.escape(x.lower()) for x in RETRYABLE))


def error_code(message: str, default: str = "STREAM_ERROR", code: str | None = None) -> str:
    return code or next((c for c in CODES if c in message), default)


def error_code_column(message: Column, default: str = "STREAM_ERROR") -> Column:
    out = None
    for c in CODES:
        out = F.when(message.contains(c), c) if out is None else out.when(message.contains(c), c)
    return out.otherwise(default)


def wrap(data: Column, index: Column, message: Column, default_code: str = "STREAM_ERROR") -> Column:
    """A result struct of a value that is null where it failed."""
    error = F.struct(error_code_column(message, default_code).alias("code"), message.alias("message"), retryable_column(message).alias("retryable"))
    meta = F.struct(index.cast("long").alias("item_index"), F.lit(1).alias("attempts"), F.when(data.isNull(), F.array(message)).otherwise(F.array().cast("array<string>")).alias("errors"))
    return F.struct(data.isNotNull().alias("success"), data.alias("data"), F.when(data.isNull(), error).alias("error"), meta.alias("metadata"))


def try_call(function: Callable, row: dict, attempts: int = 1, backoff_ms: float = 0, codes: Sequence[str] | None = None, default_code: str = "STREAM_ERROR", sleep: Callable[[float], None] = time.sleep) -> tuple:
    """(success, value, code, message, retryable, tries, messages); waits backoff * try between tries that are worth it."""
    messages: list[str] = []
    for n in range(1, attempts + 1):
        try:
            return True, function(row), None, None, None, n, messages
        except Exception as e:  # any error of the function becomes a row
            text = str(e)
            code, again = error_code(text, default_code, getattr(e, "code", None)), bool(getattr(e, "retryable", None) or retryable(text))
            messages.append(text)
            if n == attempts or not again or (codes is not None and code not in codes):
                return False, None, code, text, again, n, messages
            if backoff_ms:
                sleep(backoff_ms * n / 1000)
    raise ValueError("attempts must be positive")


def attempt(df: DataFrame, function: Callable[[dict], object], data: T.DataType, index: str, attempts: int = 1, backoff_ms: float = 0, codes: Sequence[str] | None = None, default_code: str = "STREAM_ERROR") -> DataFrame:
    """``df`` with a column ``result`` of function(row); failures are rows, and a value of None is a success."""
    if attempts <= 0:
        raise ValueError("attempts must be positive")
    kind = result_type(data)
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ok, value, code, message, again, tries, messages = try_call(function, row, attempts, backoff_ms, codes, default_code)
                out.append({"success": ok, "data": value, "error": None if ok else {"code": code, "message": message, "retryable": again}, "metadata": {"item_index": row[index], "attempts": tries, "errors": messages}})
            yield batch.append_column("result", pa.array(out, arrow))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("result", kind)]))


def successes(results: DataFrame) -> DataFrame:
    return results.where("result.success")


def failures(results: DataFrame) -> DataFrame:
    return results.where("not result.success")


def resolve(results: DataFrame, strategy: Strategy) -> DataFrame:
    """Applies a strategy to result rows; FAIL_FAST and COLLECT_ERRORS raise at this point if any row failed.

    These two fix the results first, so that a row's function is called once
    and not again by what follows.  A stage that collects errors still fails as a whole; the raised error
    holds the number of failed rows, and index and message of the first ``MOST_ERRORS``.
    """
    if strategy is Strategy.WRAP_ERRORS:
        return results
    if strategy is Strategy.SKIP_FAILED:
        return successes(results)
    results = cut_lineage(results)
    total = results.agg(F.count("*").alias("n"), F.count_if(~F.col("result.success")).alias("failed"), F.min(F.when(~F.col("result.success"), F.struct("result.metadata.item_index", "result.error.code", "result.error.message", "result.error.retryable"))).alias("first"), F.max(F.coalesce("result.error.retryable", F.lit(False))).alias("again")).first()
    if not total["failed"]:
        return results
    if strategy is Strategy.FAIL_FAST:
        first = total["first"]
        raise ProcessingError(first["message"], first["code"], bool(first["retryable"]), [(first["item_index"], first["message"])], total["failed"])
    errors = failures(results).select("result.metadata.item_index", "result.error.message").orderBy("item_index").limit(MOST_ERRORS)
    raise ProcessingError(f"{total['failed']} of {total['n']} items failed", "LIST_PROCESSING_ERRORS", bool(total["again"]), [tuple(r) for r in errors.collect()], total["failed"])


def until_failure(results: DataFrame) -> DataFrame:
    """Successes before the first failure, in item order (strategies that end the stream there)."""
    first = failures(results).select(F.min("result.metadata.item_index").alias("_stop"))
    return results.crossJoin(F.broadcast(first)).where(F.col("_stop").isNull() | (F.col("result.metadata.item_index") < F.col("_stop"))).drop("_stop")


def fallback(*tries: Column) -> Column:
    """The first try that gives a value."""
    return F.coalesce(*tries)


def fallback_source(names: Sequence[str], tries: Sequence[Column]) -> Column:
    out = None
    for name, t in zip(names, tries):
        out = F.when(t.isNotNull(), name) if out is None else out.when(t.isNotNull(), name)
    return out.otherwise("none")


def breaker(df: DataFrame, failed: Column, limit: int, order, by: Sequence[str] = ()) -> DataFrame:
    """Marks rows that an open circuit would reject: any earlier ``limit`` consecutive failures open it for good."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(*order)
    lost = F.coalesce(failed, F.lit(False))
    runs = df.withColumn("_lost", lost).withColumn("_run", F.sum((~F.col("_lost")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.sum(F.col("_lost").cast("int")).over(Window.partitionBy(*by, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    opened = F.max((F.col("_length") >= limit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("_length", length).withColumn("rejected", F.coalesce(opened, F.lit(0)) == 1).drop("_lost", "_run", "_length")


def within_rate(df: DataFrame, time_col: str, seconds: int, most: int, order, by: Sequence[str] = ()) -> DataFrame:
    """Rows with the delay (in windows) that a limit of ``most`` rows per fixed window of ``seconds`` would give them."""
    from pyspark.sql import Window

    window = F.floor(F.unix_micros(F.col(time_col).cast("timestamp")) / (seconds * 1_000_000)).cast("long")
    out = df.withColumn("rate_window", window)
    return out.withColumn("delayed_windows", F.floor((F.row_number().over(Window.partitionBy(*by, "rate_window").orderBy(*order)) - 1) / most).cast("long"))
