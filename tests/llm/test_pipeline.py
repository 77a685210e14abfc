import hashlib
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from test_decontaminate import brute as contaminated
from test_jaccard import brute as linked
from test_mixing_sharding import water

from rivulet.llm import langid

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def check_mix(before, source_of, got):
    """Whole documents in key order: each source's words come as near its target as whole documents allow."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in before.items()}
    sources = sorted(set(source_of[i] for i in before))
    total = {s: sum(size[i] for i in before if source_of[i] == s) for s in sources}
    aims = water(total, {s: [1, 2, 3][k % 3] for k, s in enumerate(sources)}, 3)
    times = Counter(got)
    key = {i: int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:15], 16) for i in before}
    for s in sources:
        epochs, left = divmod(int(aims[s] + 1e-9), total[s])
        want, upto = {}, 0
        for i in sorted((i for i in before if source_of[i] == s), key=lambda i: (key[i], i)):
            want[i] = epochs + (upto + size[i] <= left or upto < left and 2 * (left - upto) >= size[i])
            upto += size[i]
        # at the very end of a budget a document without words may go either way
        assert {i: times[i] for i in want if size[i]} == {i: n for i, n in want.items() if size[i]}
        assert abs(sum(size[i] * times[i] for i in want) - aims[s]) <= max(size[i] for i in want) / 2 + 1


def test_stages_against_brute_force(spark, corpus, tmp_path):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(corpus)]
    items = [(1, corpus[3]), (2, "never seen")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {i: t for i, t, *_ in rows}
    for name, stage in corpus_pipeline.STAGES:
        before, columns = dict(left), docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns if name != "sharding" else docs.columns == [*columns, "slot", "shard"]
        out = str(tmp_path / name)
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        got = sorted(r["doc_id"] for r in docs.collect())
        assert all(r["text"] == before[r["doc_id"]] for r in docs.collect())
        if name == "language_id":
            want = sorted(i for i, t in before.items() if re.search(r"[^\W\d_]", t or ""))
        elif name == "ngram_jaccard_join":
            want = sorted(i for i, (_, c) in linked(sorted(before.items())).items() if c == i)
        elif name == "decontamination":
            order = sorted(before)
            want = [i for i, c in zip(order, contaminated([before[i] for i in order], items)) if not c[3]]
        elif name == "mixing":
            check_mix(before, {i: s for i, _, _, s, _ in rows}, got)
            left = {i: before[i] for i in set(got)}
            mixed = got
            continue
        else:
            want = mixed
        assert got == want, name
        left = {i: before[i] for i in set(got)}


def test_language_stage_drops_only_what_op5_calls_und(spark, monkeypatch):
    """Five families with equal margins: every score is 0.2, but every text with letters has a language."""
    names = [f"x{k}" for k in range(5)]
    model = {"families": names, "outer": [(np.zeros(langid.DIMS), 0.0, 1.0)] * 5, "inner": {v: ([v], {}) for v in names}}
    monkeypatch.setattr(langid, "train", lambda *a, **k: model)
    docs = spark.createDataFrame(list(enumerate(["the thing", "слово", None, "12 34", "qzx"])), "doc_id long, text string")
    named = langid.identify(docs, model).where("lang_pred <> 'und'").collect()
    assert [round(r["score"], 6) for r in named] == [0.2] * 3
    assert sorted(r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == sorted(r["doc_id"] for r in named)


def test_language_stage_writes_what_it_identifies(spark):
    """Missing and wrong languages become those that op5's method gives."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "if(doc_id % 9 = 0, null, if(doc_id % 10 = 1, 'xx', lang)) AS lang", "text", "source")
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    want = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.train(docs)).where("lang_pred <> 'und'").collect()}
    assert got == want and None not in got.values()


def test_run_over_a_small_table(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "text", "shard"} <= set(out.columns)


def written(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "never seen")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_over_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, slot int, shard string"
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    empty = corpus_pipeline.run(spark, written(spark, tmp_path / "a", [], schema))
    assert empty.collect() == [] and empty.columns[-4:] == ["slot", "shard", "slot_", "shard_"]
    one, two = "the first text of seven words here", "another text with other words in it"
    rows = [(1, one, "en", "a", 9, 5, "x"), (1, one, "en", "a", 9, 5, "x"), (2, one, None, "b", 9, 5, "x"), (None, two, "en", None, 9, None, None), (None, two, "en", None, 9, None, None), (4, None, "en", "a", 0, 5, "x"), (5, " 12 ", "en", "b", 4, 5, "x")]
    got = corpus_pipeline.run(spark, written(spark, tmp_path / "b", rows, schema)).collect()
    assert {(r["doc_id"], r["text"]) for r in got} <= {(1, one), (None, two)} and got
    assert all(r["slot"] in (5, None) and 0 <= r["shard_"] < 64 for r in got)


def test_stage_tables_are_removed(spark):
    from rivulet.llm.common import shared_folder

    before = set(Path(shared_folder(spark)).glob("pipeline-*"))
    corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    (folder,) = set(Path(shared_folder(spark)).glob("pipeline-*")) - before
    assert [p.name for p in folder.iterdir() if p.is_dir()] == ["4-sharding"]
