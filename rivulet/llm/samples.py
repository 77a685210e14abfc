"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, at most (those of the least hashes of their ids).
SAMPLE_ROWS = 16_000


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, text, y): at most ``rows`` labelled documents of ``docs``, y being 0 or 1; all of them if there are no more.

    Ids are picked before any text is read: labels without a document and
    documents without a label don't count.  Ids with both labels are left out; of the texts
    that share an id the one with the least hash stands for it; null ids
    have no label.  Reruns and other partitionings pick the same rows.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.where("id is not null").groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("id", "y")
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    picked = known.join(texts.select("id").where("id is not null").distinct(), "id").orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(rows)
    found = texts.join(F.broadcast(picked), "id")  # at most ``rows`` ids
    first = found.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return first.select("id", "t.text", "y")
