import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import lower
from pyspark.sql import functions as F

from rivulet.llm import jaccard


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """{position: (n, component id)} of (id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in holders[g] if j > i)
        for j, o in shared.items():
            if 100 * o >= 80 * (len(s) + len(sets[j]) - o):
                root[find(j)] = find(i)
    least = {}
    for i, (ident, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), ident), ident)
    return {ident: (len(sets[i]), least[find(i)] if sets[i] else ident) for i, (ident, _) in enumerate(rows)}


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, **options).collect()}


def test_against_brute_force(spark, corpus):
    rows = list(enumerate(corpus))
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chains_and_hot_groups(spark, seed):
    """Chains of edits (ends not linked to each other), many near copies that link through their base only, and many equal ones."""
    draw = random.Random(seed)
    word = lambda: f"v{draw.randrange(3000)}"
    rows = []
    for _ in range(4):
        w = [word() for _ in range(draw.randint(30, 150))]
        for _ in range(25):
            rows.append(" ".join(w))
            w = list(w)
            for _ in range(draw.randint(1, 2)):
                w[draw.randrange(len(w))] = word()
    base = [word() for _ in range(140)]
    for _ in range(150):
        w = list(base)
        for _ in range(draw.randint(0, 6)):
            w[draw.randrange(len(w))] = word()
        rows.append(" ".join(w))
    rows += [" ".join(base)] * 80
    draw.shuffle(rows)
    rows = list(enumerate(rows))
    assert run(spark, rows) == brute(rows)


def test_partner_filter_against_all_pairs():
    draw = np.random.default_rng(4)
    for _ in range(300):
        m = draw.integers(2, 12)
        n = draw.integers(1, 40, m)
        pos = np.array([draw.integers(0, x // 5 + 1) for x in n])
        want = [any(jaccard._could_link(n[i], pos[i], n[j], pos[j]) for j in range(m) if j != i) for i in range(m)]
        assert jaccard._partnered(n, pos).tolist() == want


def test_parity_never_exceeds_the_difference():
    draw = np.random.default_rng(5)
    for _ in range(50):
        pool = draw.integers(0, 2**63, 300, dtype=np.uint64)
        x, y = (np.unique(draw.choice(pool, draw.integers(1, 250))) for _ in range(2))
        px, py = (jaccard._parity(s, jaccard._wide_words(len(s))).view(np.uint64) for s in (x, y))
        size = min(len(px), len(py))
        far = np.bitwise_count(np.bitwise_xor.reduce(px.reshape(-1, size)) ^ np.bitwise_xor.reduce(py.reshape(-1, size))).sum()
        assert far <= len(np.setxor1d(x, y))


def test_empty_repeated_and_clashing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(empty).collect() == [] and jaccard.keep_one(empty).collect() == []
    text = "a b c d e f g h"
    df = spark.createDataFrame([(4, text, "x", 1), (4, text, "x", 1), (2, text, "y", 2), (None, text, "z", 3), (None, None, "n", 4), (7, "", "e", 5)], "doc_id long, text string, cid string, n int")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.jaccard_components(df).collect())
    assert got == sorted([("4", 4, "2"), ("4", 4, "2"), ("2", 4, "2"), ("None", 4, "2"), ("None", 0, "None"), ("7", 0, "7")])
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["cid"] for r in kept.collect()) == ["e", "n", "y"]
    twice = spark.createDataFrame([(4, text), (4, text), (9, text)], "doc_id long, text string")
    assert [r["doc_id"] for r in jaccard.keep_one(twice).collect()] == [4]


def test_keep_one_keeps_whole_rows(spark, corpus):
    rows = list(enumerate(corpus))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(i for i, (_, c) in brute(rows).items() if c == i)
    got = jaccard.keep_one(df)
    assert sorted(r["doc_id"] for r in got.collect()) == want
    assert got.join(df.withColumnRenamed("text", "t"), "doc_id").where(~F.col("text").eqNullSafe(F.col("t"))).isEmpty()


def test_keep_one_keeps_the_least_known_id(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(None, text), (5, text), (9, text), (None, "p q r s t u"), (None, "p q r s t u"), (None, None), (3, "")], "doc_id long, text string")
    assert sorted(((str(r["doc_id"]), r["text"]) for r in jaccard.keep_one(df).collect()), key=str) == sorted([("5", text), ("None", "p q r s t u"), ("None", None), ("3", "")], key=str)


def test_keep_one_with_clashing_names_and_maps(spark):
    text = "a b c d e f g h"
    names = ["kept_id", "kept_hash", "kept_nth", "a.b", "key", "part", "x`y"]
    rows = [(4, text, {"k": 1}, *range(7)), (4, text, {"k": 1}, *range(7)), (6, text, {"k": 2}, *range(7)), (8, "other words in a row here", None, *range(7))]
    df = spark.createDataFrame(rows, ["doc_id", "text", "m", *names])
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 8]
    dotted = df.withColumnsRenamed({"doc_id": "doc.id", "text": "te.xt"})
    assert sorted(r[0] for r in jaccard.keep_one(dotted, "doc.id", "te.xt").collect()) == [4, 8]


def test_long_lists_in_blocks(spark, monkeypatch):
    """Lists of common grams dealt by parts, and pairs by blocks of a few members."""
    monkeypatch.setattr(jaccard, "_BLOCK", 4)
    monkeypatch.setattr(jaccard, "COMMON_RANK", 0)
    monkeypatch.setattr(jaccard, "_SEEN", 3)
    draw = random.Random(9)
    word = lambda: f"v{draw.randrange(3000)}"
    rows = []
    for _ in range(5):
        base = [word() for _ in range(40)]
        for _ in range(40):
            w = list(base)
            for _ in range(draw.randint(0, 3)):
                w[draw.randrange(len(w))] = word()
            rows += [" ".join(w)] * draw.randint(1, 2)
    rows = list(enumerate(rows))
    assert run(spark, rows) == brute(rows)
