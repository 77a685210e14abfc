"""A corpus pipeline of five of the llm operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes as Parquet in the shared folder and reads again as the next stage's
documents, so no stage recomputes another and a lost executor costs one stage.
A stage's table is removed once the next one is written, the last when the driver ends.

Defined results: an empty table gives an empty result with the last stage's
columns; null and letterless texts go in the first stage; of rows that repeat
an id or a text one stays (see each stage); null ids are ids like any other; columns beside
those of documents, whatever their names, are kept; ``lang`` is what the first stage identified.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import decontaminate, jaccard, langid, mixing, sharding
from rivulet.llm.common import discard, keep_until_end, shared_folder, table
from rivulet.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (``und``) go; every text with letters stays, and its ``lang`` becomes the language identified."""
    ship(spark)
    return langid.keep_identified(docs, langid.train(docs))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-gram Jaccard links stays: that of the least non-null id; repeated rows stay once."""
    ship(spark)
    return jaccard.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark passages go; without items all stay."""
    ship(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, by source weight; whole documents only, a null source being a source."""
    return mixing.mix(docs, cut=False)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with slot and shard (named slot_ and shard_ where these are taken); null ids share a slot."""
    return sharding.shard(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_near_duplicates),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: Language ID is a trained model, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    last = None
    for k, (name, stage) in enumerate(STAGES):
        docs = keep_until_end(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
        if last is not None:
            discard(last)
        last = docs
    return docs
