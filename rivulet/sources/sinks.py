"""Outputs: schema checks, final shapes, JSON answers, tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checked(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` if it has every field of ``schema`` with its type; the plan fails before any job otherwise."""
    have = {f.name: f.dataType for f in df.schema.fields}
    bad = [f"{f.name} {f.dataType.simpleString()}" for f in schema.fields if have.get(f.name) != f.dataType]
    if bad:
        raise TypeError(f"missing or of another type: {', '.join(bad)}")
    return df


def embedded_output(chunks: DataFrame, total_files: DataFrame, embedding: str = "embedding", tags: str = "tags") -> DataFrame:
    """The embedded documents' final shape: vector, tags (none as an empty array), and the totals of files and chunks."""
    totals = total_files.agg(F.count("*").alias("total_files")).crossJoin(chunks.agg(F.count("*").alias("total_chunks")))
    shaped = chunks.withColumnRenamed(embedding, "vector").withColumn("tags", F.coalesce(tags, F.array().cast("array<string>")))
    return shaped.crossJoin(F.broadcast(totals))  # one row


def answer_output(df: DataFrame, answer: str = "answer", usage: str = "usage") -> DataFrame:
    return df.select(F.col(answer).alias("answer"), F.col(usage).alias("usage"))


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    df.write.partitionBy(*partition_by).mode(mode).parquet(path) if partition_by else df.write.mode(mode).parquet(path)
