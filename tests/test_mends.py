"""Functions are called once, results stay off the driver, odd values are defined."""

import pytest
from pyspark.sql import types as T

from rivulet.operators import errors, retrieval, stats
from rivulet.operators.flow import Flow


@pytest.mark.parametrize("strategy", [errors.Strategy.FAIL_FAST, errors.Strategy.COLLECT_ERRORS])
def test_functions_are_called_once(spark, numbers, strategy):
    calls = spark.sparkContext.accumulator(0)

    def counted(row):
        calls.add(1)
        return row["v"] * 2

    f = Flow.start(numbers(*range(10)), ["ord"]).map_rows("twice", counted, T.IntegerType(), "ord", strategy)
    assert [r["result"]["data"] for r in f.to_array()] == [2 * i for i in range(10)] and f.execute().metadata["rows"] == 10
    assert calls.value == 10


def test_collected_errors_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(errors, "MOST_ERRORS", 3)
    df = spark.range(50).withColumnRenamed("id", "ord")
    with pytest.raises(errors.ProcessingError) as e:
        errors.resolve(errors.attempt(df, lambda r: 1 // 0, T.LongType(), "ord"), errors.Strategy.COLLECT_ERRORS)
    assert e.value.total == 50 and [i for i, _ in e.value.errors] == [0, 1, 2]


def test_percentiles_leave_nan_out(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (float("nan"), "a"), (None, "a"), (float("nan"), "b")], "v double, k string")
    row = stats.nearest_ranks(df, "v", (50, 100)).first()
    assert (row["n"], row["p50"], row["p100"]) == (2, 1.0, 2.0)
    assert [(r["k"], r["n"], r["p50"]) for r in stats.nearest_ranks(df, "v", (50,), ["k"]).collect()] == [("a", 2, 1.0)]
    assert stats.nearest_ranks(df.limit(0), "v", (50,)).first()["p50"] is None


def test_percentiles_against_sorting(spark):
    import math
    import random

    draw = random.Random(3)
    values = [draw.choice([draw.random(), float(draw.randrange(5)), 1e9 * draw.random()]) for _ in range(30_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    percents = (1, 25, 50, 95, 99, 99.9, 100)
    row = stats.nearest_ranks(df, "v", percents, accuracy=200).first()
    ordered = sorted(values)
    assert [row[f"p{p:g}"] for p in percents] == [ordered[max(math.ceil(round(p / 100 * len(ordered), 9)) - 1, 0)] for p in percents]


def test_empty_chunks_average_their_scores(spark):
    hits = spark.createDataFrame([("s", 1, "a", "", 2.0), ("s", 2, "b", "", 4.0)], "source string, idx int, id string, content string, score double")
    assert retrieval.merge_consecutive(hits).first()["score"] == 3.0


def test_sparse_search_in_passes(spark, monkeypatch):
    import random

    monkeypatch.setattr(retrieval, "TERM_PASS", 40)
    draw = random.Random(1)
    texts = [(i, " ".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 12)))) for i in range(300)]
    df = spark.createDataFrame(texts, "id long, t string").repartition(5)
    queries = df.where("id % 10 = 0").selectExpr("id AS query_id", "t")
    from pyspark.sql import functions as F

    got = retrieval.sparse_topk(df.select("id", retrieval.words_of(F.col("t")).alias("terms")), retrieval.sparse_rows(queries, "query_id", "t", "query_id"), 7)
    want = []
    for q, t in texts:
        if q % 10 == 0:
            scores = [(-sum(t.split().count(w) * u.split().count(w) for w in set(t.split())), i) for i, u in texts]
            want += [(q, i, -s, k + 1) for k, (s, i) in enumerate(sorted(x for x in scores if x[0])[:7])]
    assert sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in got.collect()) == sorted(want)


def test_sparse_search_scores_what_can_reach_a_floor(spark):
    """Short texts after long ones are not scored, those that reach a floor are: texts and word lists, with copies, odd letters and nulls."""
    import random

    from pyspark.sql import functions as F

    draw = random.Random(2)
    texts = [(i, " ".join(draw.choice(["ab", "C", "d1", "Éa", "œ", "f-g", "h"]) for _ in range(draw.choice([0, 1, 5, 5, 200])))) for i in range(400)]
    texts += [(400 + i, t) for i, t in texts[:50]] + [(900, None), (901, "zz " * 300)]
    df = spark.createDataFrame(texts, "id long, text string").repartition(6)
    queries = retrieval.sparse_rows(df.where("id % 40 = 0"), "id", "text", "query_id")
    brute = df.select("id", F.explode(retrieval.words_of(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n")).join(queries, "term").groupBy("query_id", "id").agg(F.sum(F.col("n") * F.col("tf")).cast("double").alias("score"))
    want = sorted(tuple(r) for r in retrieval.ranked(brute, 3, ["query_id"]).select("query_id", "id", "score", "rank").collect())
    scored = []
    real = retrieval.ranked
    retrieval.ranked = lambda rows, *a, **k: scored.append(rows) or real(rows, *a, **k)
    try:
        for documents in (df, df.select("id", retrieval.words_of(F.col("text")).alias("terms"))):
            assert sorted(tuple(r) for r in retrieval.sparse_topk(documents, queries, 3).select("query_id", "id", "score", "rank").collect()) == want
    finally:
        retrieval.ranked = real
    lengths = {i: len(t or "") for i, t in texts}
    sent = [r["id"] for r in scored[-1].collect()]
    assert sent and sum(lengths[i] < 30 for i in sent) <= len(sent) / 10


def test_dense_search_sends_what_can_reach_a_floor(spark, monkeypatch):
    """Of many rows few are sent on, not the k best of every block; ties, zeros and vectors of other lengths count as before."""
    import random

    draw = random.Random(4)
    rows = [(i, [draw.gauss(0, 1) for _ in range(8)]) for i in range(6000)]
    rows += [(6000 + i, v) for i, (_, v) in enumerate(rows[:20])] + [(7000, [0.0] * 8), (7001, None), (7002, rows[3][1] + [1.0]), (7003, rows[3][1][:5])]
    v = spark.createDataFrame(rows, "id long, vector array<double>").repartition(12)
    q = v.where("id < 20").selectExpr("id AS query_id", "vector AS query_vector")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    scored = []
    real = retrieval.ranked
    monkeypatch.setattr(retrieval, "ranked", lambda found, *a, **k: scored.append(found) or real(found, *a, **k))
    try:
        key = ["query_id", "id", "score", "rank"]
        want = sorted(tuple(r) for r in retrieval.dense_topk(v, q, 10).select(*key).collect())
        monkeypatch.setattr(retrieval, "MANY_PAIRS", 0)
        assert sorted(tuple(r) for r in retrieval.dense_topk(v, q, 10).select(*key).collect()) == want
        assert len(want) == 200 and scored[-1].count() < scored[-2].count() / 5 and scored[-1].count() <= 20 * 10 * 2 * retrieval.DENSE_SEEDS
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    vectors = {i: x for i, x in rows if x}
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / max((sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 1e-300), 9)
    for query in (0, 3, 19):
        brute = sorted((-cosine(vectors[query], x), i) for i, x in vectors.items())[:10]
        assert [r[1] for r in want if r[0] == query] == sorted(i for _, i in brute)


def test_sparse_search_adds_up_few_pairs(spark):
    """Chunks are all of about one length, so lengths leave none out: still few pairs are sent on."""
    import random

    draw = random.Random(9)
    texts = [(i, " ".join(draw.choice("the of and a to in".split()) if draw.random() < 0.6 else f"w{int(draw.expovariate(0.05))}" for _ in range(60))) for i in range(3000)]
    df = spark.createDataFrame(texts, "id long, text string").repartition(6)
    queries = retrieval.sparse_rows(df.where("id % 100 = 0"), "id", "text", "query_id")
    from pyspark.sql import functions as F

    brute = df.select("id", F.explode(retrieval.words_of(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n")).join(queries, "term").groupBy("query_id", "id").agg(F.sum(F.col("n") * F.col("tf")).cast("double").alias("score"))
    want = sorted(tuple(r) for r in retrieval.ranked(brute, 20, ["query_id"]).select("query_id", "id", "score", "rank").collect())
    scored, real, own = [], retrieval.ranked, retrieval.OWN_TERMS
    retrieval.ranked = lambda rows, *a, **k: scored.append(rows) or real(rows, *a, **k)
    try:
        for retrieval.OWN_TERMS in (own, 4):  # most terms have dimensions of their own, and most share them
            assert sorted(tuple(r) for r in retrieval.sparse_topk(df, queries, 20).select("query_id", "id", "score", "rank").collect()) == want
            assert retrieval.OWN_TERMS != own or scored[-1].count() < 30 * 3000 / 5
    finally:
        retrieval.ranked, retrieval.OWN_TERMS = real, own


def test_tree_answer(spark):
    from rivulet.sources import corpus

    files = spark.createDataFrame([("work/a.md",), ("work/deep/b.md",), ("home/c.txt",)], "path string")
    whole = corpus.tree_answer(files)
    assert whole["status"] == "success" and not whole["truncated"]
    assert whole["tree"]["sub_folders"]["work"]["files"] == ["a.md"]
    assert corpus.tree_answer(files, "/work")["status"] == "invalid_path"
    assert corpus.tree_answer(files, "none") == {"status": "not_found", "tree": None, "truncated": False}
    assert corpus.tree_answer(files.limit(0))["status"] == "success"
    many = spark.range(20_000).selectExpr("concat('work/', lpad(id, 40, '0'), '.md') as path")
    large = corpus.tree_answer(many, "work")
    assert large["truncated"] and large["tree"]["sub_folders"]["work"] == {"files": [], "sub_folders": {}, "extension_counts": {"md": 20_000}}
