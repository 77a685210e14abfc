import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from rivulet.operators import retrieval as R
from rivulet.sources import config, corpus


def test_merge_two_chunks(spark):
    df = spark.createDataFrame([("s", 0, "a", "Short", 1.0), ("s", 1, "b", "This is a much longer chunk", 0.5)], "source string, idx int, id string, content string, score double")
    r = R.merge_consecutive(df).first()
    assert r["content"] == "Short This is a much longer chunk" and r["id"] == "a" and abs(r["score"] - 18.5 / 32) < 1e-9


def test_merge_runs(spark):
    rows = [("s", i, f"s{i}", f"text {i}", 0.1 * i) for i in (0, 2, 5, 5, 6)] + [("t", 1, "t1", "other", 0.9), ("t", None, "t2", "lost", 0.9)]
    df = spark.createDataFrame(rows, "source string, idx int, id string, content string, score double")
    got = sorted((r["source"], r["first_idx"], r["last_idx"], r["merged_count"]) for r in R.merge_consecutive(df).collect())
    assert got == [("s", 0, 2, 2), ("s", 5, 5, 1), ("s", 5, 6, 2), ("t", 1, 1, 1)]


def test_overlaps(spark):
    shared = "0123456789abcdefghij"
    df = spark.createDataFrame([("left " + shared, shared + " right"), ("x", "y"), ("ab", "abc")], "a string, b string")
    assert [r[0] for r in df.select(R.overlap_length(F.col("a"), F.col("b"))).collect()] == [20, 0, 0]
    merged = R.merge_consecutive(df.limit(1).select(F.lit("s").alias("source"), F.explode(F.array(F.struct(F.lit(0).alias("idx"), F.col("a").alias("content")), F.struct(F.lit(1).alias("idx"), F.col("b").alias("content")))).alias("p")).select("source", "p.*", F.col("p.idx").cast("string").alias("id"), F.lit(1.0).alias("score"))).first()
    assert merged["content"] == f"left {shared} right"


def test_overlap_is_the_longest_end(spark):
    draw = random.Random(5)
    pairs = [("".join(draw.choice("ab") for _ in range(draw.randint(0, 40))), "".join(draw.choice("ab") for _ in range(draw.randint(0, 40)))) for _ in range(300)]
    pairs += [(a, a[-draw.randint(1, 30) :] + b) for a, b in pairs if a] + [("a" * 600, "a" * 700), (None, "a" * 30)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for least, most in ((3, 25), (20, 500)):
        want = [next((k for k in range(min(len(a), len(b), most), least - 1, -1) if a[-k:] == b[:k]), 0) if a else 0 for a, b in pairs]
        assert [r[0] for r in df.orderBy("i").select(R.overlap_length(F.col("a"), F.col("b"), least, most)).collect()] == want


def test_merged_chunks_are_whole_documents(spark, tmp_path):
    from rivulet.plans import catalogue

    draw = random.Random(6)
    texts = ["".join(draw.choice("abcdefghij ") for _ in range(n)) for n in (30, 200, 340, 1000, 20_000)]
    texts = [t.replace("  ", "ab").strip() + "." for t in texts]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["source"]: r for r in catalogue.queries()["merge_chunks"](spark, str(tmp_path)).collect()}
    assert {i: (r["merged_count"], r["last_idx"]) for i, r in got.items()} == {i: ((len(t) - 1) // 150 + 1, (len(t) - 1) // 150) for i, t in enumerate(texts)}
    for i, t in enumerate(texts):
        if (len(t) - 1) % 150 >= 20:  # a last piece under 20 characters has no overlap to find
            assert got[i]["content"] == t
    runs = {r["source"]: r["merged_count"] for r in catalogue.queries()["chunk_runs"](spark, str(tmp_path)).collect()}
    assert runs == {i: r["merged_count"] for i, r in got.items()}


def test_date_windows():
    w = R.decay_window("2024-01-01T00:00:00Z", "2024-01-31T00:00:00Z")
    assert w["target"] == datetime(2024, 1, 16, tzinfo=timezone.utc) and w["scale"] == 1_296_000
    assert R.decay_window("2024-01-01", "2024-01-31", 2)["scale"] == 2_592_000
    for end in ("2024-01-01T00:00:00Z", "2023-01-01"):
        with pytest.raises(ValueError):
            R.decay_window("2024-01-01T00:00:00Z", end)
    now = datetime(2024, 3, 6, 12, tzinfo=timezone.utc)
    assert R.date_range(None, None, now) is None
    assert R.date_range(None, "2024-01-01", now)["start"].year == 2020 and R.date_range("2024-01-01", None, now)["end"] == now
    assert R.preset_range("this_week", now)[0] == datetime(2024, 3, 4, tzinfo=timezone.utc)
    assert R.preset_range("this_month", now)[0] == datetime(2024, 3, 1, tzinfo=timezone.utc)
    with pytest.raises(ValueError):
        R.preset_range("someday", now)


def test_decay(spark):
    r = spark.range(1).select(R.exp_decay(F.lit(100.0), 100).alias("a"), R.gauss_decay(F.lit(-100.0), 100).alias("b"), R.exp_decay(F.lit(None).cast("double"), 100).alias("c"), R.gauss_decay(F.lit(0.0), 5).alias("d")).first()
    assert [round(x, 9) for x in r] == [0.5, 0.5, 0.0, 1.0]


def test_search_branches(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "id int, vector array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, query_vector array<double>")
    dense = R.dense_topk(v, q, 3)
    assert [r["id"] for r in dense.orderBy("rank").collect()] == [0, 1, 2]
    assert R.dense_topk(v, q, 9, threshold=0.7).count() == 2
    t = spark.createDataFrame([(1, "a b b"), (2, "c"), (3, "B a")], "id int, t string")
    rows = R.sparse_rows(t, "id", "t")
    sparse = R.sparse_topk(rows, R.sparse_rows(spark.createDataFrame([(0, "b")], "query_id int, t string"), "query_id", "t", "query_id"), 5)
    assert [(r["id"], r["score"]) for r in sparse.orderBy("rank").collect()] == [(1, 2.0), (3, 1.0)]
    fused = R.hybrid(dense, sparse, None, 2)
    assert fused.orderBy("rank").first()["id"] == 1
    assert abs(fused.orderBy("rank").first()["score"] - (1 / 62 + 1 / 61)) < 1e-9
    assert R.fuse([dense, sparse], 9, "dbsf").count() == 4
    with pytest.raises(ValueError):
        R.fuse([dense], 1, "other")


def test_threshold_search_has_no_limit(spark, monkeypatch):
    from rivulet.plans import catalogue

    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "id int, vector array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, query_vector array<double>")
    assert sorted(r["id"] for r in R.dense_topk(v, q, None, threshold=0.2).collect()) == [0, 1, 2, 3, 4]
    monkeypatch.setattr(R, "ranked", lambda *a: pytest.fail("ranked"))
    monkeypatch.setattr(catalogue, "_vectors", lambda *a: (v, q))
    assert catalogue.queries()["score_threshold"](spark, "").first()["n"] == 5


def test_vectors_of_unequal_length(spark, monkeypatch):
    v = spark.createDataFrame([(1, [3.0, 0.0, 4.0]), (2, [1.0])], "id int, vector array<double>")
    q = spark.createDataFrame([(0, [1.0]), (1, [1.0, 0.0, 0.0])], "query_id int, query_vector array<double>")
    want = [(0, 1, 0.6), (0, 2, 1.0), (1, 1, 0.6), (1, 2, 1.0)]
    for numbers in (100, 1):  # one pass, and several
        monkeypatch.setattr(R, "QUERY_PASS", numbers)
        assert sorted((r["query_id"], r["id"], r["score"]) for r in R.dense_topk(v, q, 5).collect()) == want


def test_rerank(spark):
    hits = spark.createDataFrame([(0, 1, 0.9, "red fox", "blue fox"), (0, 2, 0.1, "red fox", "a red fox")], "query_id int, id int, score double, q string, d string")
    got = R.rerank(hits, F.col("q"), F.col("d"), 2).orderBy("rank").collect()
    assert [(r["id"], r["score"], r["vector_score"]) for r in got] == [(2, 1.0, 0.1), (1, 0.5, 0.9)]


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "")], "id int, t string")
    got = R.embed(df, "t", 8).orderBy("id").collect()
    assert abs(sum(x * x for x in got[0]["vector"]) - 1) < 1e-9 and set(got[1]["vector"]) == {0.0}
    lost = R.embed_batches(df, "t", lambda texts: [[1.0]] * (len(texts) + 1))
    assert lost.count() == 0


def test_search_writes_little(spark, monkeypatch):
    """Vectors are kept as a table by columns, and tagged documents are boosted once, before they meet the queries."""
    v = spark.createDataFrame([(i, [1.0, float(i)], "a b", "s", i, ["t"], datetime(2024, 1, 1 + i)) for i in range(9)], "id int, vector array<double>, content string, source string, idx int, tags array<string>, modified timestamp")
    q = spark.createDataFrame([(i, [1.0, 0.0], "a") for i in range(5)], "query_id int, query_vector array<double>, query_text string")
    monkeypatch.setattr(type(v), "checkpoint", lambda *a, **k: pytest.fail("checkpoint"))
    boosted, real = [], R.rescored
    monkeypatch.setattr(R, "rescored", lambda hits, *a: boosted.append(hits) or real(hits, *a))
    got = R.search(v, q, 1, datetime(2024, 3, 1, tzinfo=timezone.utc), None, ["t"])
    assert sorted((r["query_id"], r["id"]) for r in got.collect()) == sorted((i, r) for i in range(5) for r in {x["id"] for x in got.where("query_id = 0").collect()})
    assert boosted[1].count() == 9


def test_vault(spark):
    files = spark.createDataFrame([("work/a.md", ["work", "Test"], "2024-01-02"), ("work/sub/b.md", ["#work"], None), ("c.txt", ["home"], "2024-01-03")], "path string, tags array<string>, modified string")
    assert [r["path"] for r in corpus.search_tags(files, ["#Work"]).collect()] == ["work/a.md", "work/sub/b.md"]
    assert [r["path"] for r in corpus.search_tags(files, ["work", "test"], "and").collect()] == ["work/a.md"]
    assert corpus.answer(corpus.search_tags(files, ["zzz"]), ["path"], 20)["status"] == "no_matches"
    assert corpus.answer(corpus.search_tags(files, ["work"]), ["path"], 20)["total"] == 2
    assert corpus.list_tags(files.select(F.array(F.lit("x"), F.lit("x")).alias("tags"))).first().asDict() == {"tag": "x", "document_count": 3}
    tree = corpus.nested_tree(files)
    assert tree["files"] == ["c.txt"] and tree["sub_folders"]["work"]["files"] == ["a.md"] and tree["sub_folders"]["work"]["extension_counts"] == {"md": 1}
    assert corpus.list_files(files, "work").count() == 2
    assert corpus.file_at(files, "c.txt")["status"] == "success" and corpus.file_at(files, "x")["status"] == "not_found" and corpus.file_at(files, "/c.txt")["status"] == "invalid_path"
    for bad in ({"tags": []}, {"tags": ["a"], "operator": "xor"}, {"tags": ["a"], "limit": 0}):
        with pytest.raises(ValueError):
            corpus.search_tags(files, **bad)
    with pytest.raises(ValueError):
        corpus.list_files(files, "/work")


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("one.md", "two.md", "three.md", "sub/four.md", "five.txt"):
        (tmp_path / name).write_text(f"text of {name}")
    found = corpus.discover_files(spark, str(tmp_path)).orderBy("path").collect()
    assert [r["name"] for r in found] == ["one.md", "four.md", "three.md", "two.md"]
    assert {r["name"] for r in corpus.discover_files(spark, str(tmp_path), "sub/*.md").collect()} == {"four.md"}
    assert {r["content"] for r in corpus.read_files(spark, str(tmp_path), "*.txt", skip_bad=True).collect()} == {"text of five.txt"}
    assert corpus.read_file(spark, str(tmp_path / "one.md")).first()["content"] == "text of one.md"
    with pytest.raises(FileNotFoundError):
        corpus.read_file(spark, str(tmp_path / "none.md"))
    assert corpus.from_rows(spark, ["a", "b"], "v string").orderBy("_ord").collect()[1]["v"] == "b"


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"retrieval": {"limit": 5}}')
    assert config.load(str(path), {"RIVULET_RETRIEVAL_FUSION": "dbsf"}).retrieval == config.Retrieval(5, "dbsf", False)
    for env in ({"RIVULET_RETRIEVAL_LIMIT": "x"}, {"RIVULET_RETRIEVAL_FUSION": "no"}, {"RIVULET_CHUNKING_MOST": "0"}):
        with pytest.raises(ValueError):
            config.load(None, env)
