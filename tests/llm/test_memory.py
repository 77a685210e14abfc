"""What the pipeline's stages hold on an executor beside the JVM: few workers, small temporaries."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from rivulet.llm import jaccard, langid, sharding


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.fixture(scope="module")
def texts():
    """Two megabytes."""
    rng = np.random.default_rng(1)
    return pa.array([" ".join(f"word{w}" for w in rng.integers(0, 5000, 250)) for _ in range(1000)])


def test_language_features_are_made_in_small_blocks(texts):
    def run():
        for _ in langid.vectors(texts):
            pass

    run()
    assert peak_mb(run) < 20  # it was 46


def test_grams_are_counted_in_small_chunks(texts):
    total = np.zeros(1 << jaccard.SKETCH_BITS, np.int64)
    jaccard._count_grams(total, texts)
    assert total.sum() == len(texts) * (250 - jaccard.SHINGLE + 1)
    assert peak_mb(lambda: jaccard._count_grams(total, texts)) < 15


def test_shard_table_starts_no_python_worker(spark):
    """A list of rows comes as an RDD that Python workers pickle anew: a second set of workers on each executor."""
    out = sharding.shard(spark.range(100).withColumnRenamed("id", "doc_id"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan
    table = sharding.lookup_table([f"shard-{i:05d}" for i in range(sharding.SHARDS)])
    assert all(r["shard"] == table[r["slot"]] for r in out.collect())
