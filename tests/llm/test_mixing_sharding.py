import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rivulet.llm import mixing, sharding


def water(sizes, weights, cap):
    """Targets by sharing again and again."""
    active, left, out = dict(weights), sum(sizes.values()), {}
    while active:
        total = sum(active.values())
        over = [s for s in active if left * active[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * w / total for s, w in active.items()}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        active = {s: w for s, w in active.items() if s not in over}
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def check(spark, rows, df=None):
    got = mixing.mix_plan(df if df is not None else table(spark, rows)).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    aims = water(sizes, {s: [1, 2, 3][i % 3] for i, s in enumerate(order)}, 3)
    of = {r[0]: r[2] for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - aims[s]) <= 1e-6 * max(1, aims[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert taken[s] == int(aims[s] + 1e-9) or abs(taken[s] - aims[s]) <= 1
    return got


def rows_of(seed, sources, n):
    draw = random.Random(seed)
    return [(i, " ".join("x" * draw.randint(1, 5) for _ in range(int(draw.paretovariate(1.0)) % 400)) or None, draw.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("sources", [["a"] * 9 + ["b", "c", None], ["a", "b"], ["z"], [None]])
def test_targets_and_cut(spark, sources):
    check(spark, rows_of(1, sources, 300))


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rows = rows_of(2, ["a"] * 5 + ["b", "c", "d"], 900)
    many = check(spark, rows)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4096)
    assert sorted(many) == sorted(check(spark, rows, table(spark, rows).repartition(11)))


def test_mix_takes_what_the_plan_says(spark):
    rows = rows_of(3, ["a", "a", "a", "b", "c"], 200)
    df = table(spark, rows).withColumn("plan_times", F.lit("extra"))
    plan = {r["doc_id"]: r for r in mixing.mix_plan(df).collect()}
    out = mixing.mix(df)
    assert out.columns == df.columns
    words, texts = Counter(), {r[0]: r[1] for r in rows}
    for r in out.collect():
        assert (texts[r["doc_id"]] or "").startswith(r["text"] or "")
        words[r["doc_id"]] += len((r["text"] or "").split())
    assert all(words[i] == p["taken"] for i, p in plan.items())
    whole = Counter(r["doc_id"] for r in mixing.mix(df, cut=False).collect())
    assert all(set([r["text"] for r in mixing.mix(df, cut=False).where(F.col("doc_id") == i).collect()]) <= {texts[i]} for i in list(whole)[:3])
    assert max(whole.values()) <= 3


def test_odd_tables(spark):
    assert mixing.mix_plan(table(spark, [])).collect() == [] and mixing.mix(table(spark, [])).collect() == []
    empty = table(spark, [(1, None, "a"), (2, " ", None)])
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.mix_plan(empty).collect()} == {(0, 0.0, 0)}
    repeated = table(spark, [(1, "a b c", "s")] * 4 + [(None, "d", "s"), (None, "e f", "t"), (3, "g h i j k l", "t")])
    got = mixing.mix_plan(repeated)
    assert got.count() == 7 and got.agg(F.sum("taken")).first()[0] >= 10
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, mixing.mix_plan(repeated.repartition(3)).collect()), key=str)


def test_table_is_balanced_and_stable():
    names = [f"n{i}" for i in range(7)]
    full = sharding.lookup_table(names, 1009)
    counts = Counter(full)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    less = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(full, less) if a != 6)
    assert moved < 0.35 * 1009
    for bad in (([], 11), (["a", "a"], 11), (["a"], 12), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_table_against_turns():
    """The same table from whole preference lists."""
    names, slots = ["x", "y", "z"], 31
    prefs = []
    for name in names:
        offset, skip = sharding._preference(name, slots)
        prefs.append([(offset + j * skip) % slots for j in range(slots)])
        assert sorted(prefs[-1]) == list(range(slots))
    want = {}
    while len(want) < slots:
        for i, p in enumerate(prefs):
            if len(want) < slots:
                want[next(s for s in p if s not in want)] = i
    assert sharding.lookup_table(names, slots) == [want[s] for s in range(slots)]


def test_sharding_rows(spark):
    import hashlib

    df = spark.createDataFrame([(i if i % 50 else None, "x", i) for i in range(2000)], "doc_id long, shard string, SLOT int")
    out = sharding.shard(df, shards=["a", "b", "c"], slots=1009)
    assert out.columns == ["doc_id", "shard", "SLOT", "slot_", "shard_"] and out.count() == 2000
    lookup = sharding.lookup_table(["a", "b", "c"], 1009)
    for r in out.collect():
        name = "null" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(name.encode()).hexdigest()[:15], 16) % 1009
        assert (r["slot_"], r["shard_"]) == (slot, lookup[slot])
    assert sharding.shard(df.limit(0)).collect() == []
    plan = sharding.shard(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan


def test_sharding_with_clashing_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], ["doc.id", "_slot_key", "_shard_value", "key", "a`b"])
    out = sharding.shard(df, "doc.id")
    assert out.columns == [*df.columns, "slot", "shard"] and tuple(out.first()[:5]) == (1, 2, 3, 4, 5)
    plain = spark.createDataFrame([(1,)], ["doc_id"])
    assert tuple(out.first()[5:]) == tuple(sharding.shard(plain).first()[1:])


def test_mix_with_clashing_names(spark):
    rows = rows_of(5, ["a", "a", "b"], 60)
    df = table(spark, rows)
    odd = df.toDF("doc.id", "te.xt", "so.urce").withColumns({n: F.lit(1) for n in ("row", "times", "plan_times", "epoch", "x.y")})
    want = sorted(map(str, mixing.mix(df).collect()))
    got = mixing.mix(odd, "doc.id", "te.xt", "so.urce")
    assert got.columns == odd.columns
    assert sorted(map(str, got.toDF(*(f"c{i}" for i in range(8))).select("c0", "c1", "c2").toDF("doc_id", "text", "source").collect())) == want
