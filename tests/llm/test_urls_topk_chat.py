import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rivulet.llm import chat, topk, urls
from rivulet.llm.queries import URL_RULES

# -- urls ----------------------------------------------------------------------------


def judged(rules, url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:cut].translate(str.maketrans(urls.UPPER, urls.LOWERED))
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


def test_urls_against_loops(spark):
    draw = random.Random(1)
    hosts = ["com", "example.com", "a.example.com", "Example.COM", "net", "x.example.net", "example.net", "org", "badexample.com", "com.example", ""]
    paths = ["", "/", "/en/", "/en/7", "/en/77/x", "/de/8", "/de/9?x=/en/", "/es/#a", "?/en/", "/EN/"]
    given = [f"{draw.choice(['http', 'https', 'HTTP'])}://{draw.choice(hosts)}{draw.choice(paths)}" for _ in range(400)]
    given += [None, "", "no scheme/en/", "://", "http://", "a://b://c/en/", "http://" + ".".join(["x"] * 3000) + ".com/en/", "http://com/en/" + "y" * 50_000, "http://ü.com/en/\n?x"]
    pages = spark.createDataFrame([(i, u, "t") for i, u in enumerate(given + given[:9])], "page_id long, url string, host string").repartition(3)
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, rules).collect()}
    assert [got[i] for i in range(len(got))] == [judged(URL_RULES, u) for u in given + given[:9]]


def test_many_rules_and_none(spark):
    rules = [(f"h{i}.com", f"/p{i % 7}", "block") for i in range(3000)] + [("h5.com", "/p5", "allow")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://w.h{i}.com/p{i % 5}x") for i in range(2000)] + [(None, None)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, table).collect()}
    assert all(v == ("block" if i is not None and i % 7 == i % 5 else "allow") for i, v in got.items())
    assert {r["verdict"] for r in urls.judge(pages, table.limit(0)).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), table).collect() == []


def test_bloom_filter_has_no_false_negative(spark):
    rules = spark.range(5000).select(F.concat(F.lit("h"), "id").alias("host"), F.concat(F.lit("k"), "id").alias("key"))
    bits = urls.bloom_filter(rules)
    for kind, letter in ((urls._HOST, "h"), (urls._KEY, "k")):
        inside, outside = (np.concatenate(list(urls._hashes(pa.array([f"{c}{i}" for i in range(5000)]), kind))) for c in (letter, "q"))
        assert urls._listed(bits, inside).all() and urls._listed(bits, outside).mean() < 0.01


# -- top-k -----------------------------------------------------------------------------


def best(rows, k, scale=64.0):
    whole = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole[n] = (i, [int(np.floor(x * scale)) for x in v])
    out = []
    for n, (i, q) in whole.items():
        if i % 20 == 0:
            found = sorted(((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in whole.values() if j != i))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def searched(spark, rows, k, schema="vec_id long, embedding array<float>"):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(df, df.where("vec_id % 20 = 0"), k).collect())


@pytest.mark.parametrize(("n", "dims", "k"), [(300, 64, 20), (90, 7, 5), (8, 3, 20), (260, 33, 1)])
def test_topk_against_all_pairs(spark, monkeypatch, n, dims, k):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    draw = np.random.default_rng(n)
    rows = [(i, [float(x) for x in draw.normal(0, 0.2, dims).astype(np.float32)]) for i in range(n)]
    rows[1:6] = [(i, rows[0][1]) for i in range(1, 6)]
    assert searched(spark, rows, k) == best(rows, k)


def test_topk_ties_and_odd_vectors(spark):
    same = [(i, [0.5, 0.25]) for i in range(60)]
    odd = [(60, None), (61, [1.0, None]), (62, [float("nan"), 1.0]), (63, [float("inf"), 1.0]), (None, [9.0, 9.0]), (64, [1.0]), (65, []), (66, [1.0, 1.0, 1.0])]
    rows = same + odd
    assert searched(spark, rows, 20) == best(rows, 20)
    assert searched(spark, rows[:0], 20) == []
    large = [(i, [1e9 * (i + 1), -3.0]) for i in range(21)]
    assert searched(spark, large, 20, "vec_id long, embedding array<double>") == best(large, 20)


# -- chat --------------------------------------------------------------------------------


def turns_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_escaping_round_trip():
    draw = random.Random(4)
    parts = [*chat.CONTROL, chat.ESCAPE, chat.ESCAPE * 2, "<", "|", "[", "x", " ", "\n", "é"]
    for _ in range(500):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not any(c in escaped for c in chat.CONTROL)


def test_chats_read_back(spark):
    draw = random.Random(5)
    parts = [*chat.CONTROL, chat.ESCAPE, "hello", " ", "wörld", "\n", "日本", "🙂"]
    said = lambda: "".join(draw.choice(parts) for _ in range(draw.randint(0, 30)))
    rows = [(c, t, draw.choice(["user", "assistant", "system", "", "assistant"]), said()) for c in range(40) for t in range(draw.randint(1, 9))]
    rows += [(100, 0, None, None), (100, 1, "assistant", None), (None, 1, "assistant", "a"), (None, 0, "user", "b"), (101, 0, "assistant", "long " * 50_000), (102, 0, "assistant", "same"), (102, 0, "assistant", "same"), (103, None, "user", "first"), (103, 0, "<|end|>", "last")]
    vocabulary = chat.load_vocabulary()
    df = turns_of(spark, rows).repartition(5).withColumn("n_turns", F.lit("extra"))
    formatted = chat.format_chat(df, vocabulary)
    got = {r["conv_id"]: r for r in chat.digests(formatted, vocabulary).collect()}
    chats: dict = {}
    for c, t, role, text in rows:
        chats.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(chats)
    for c, turns in chats.items():
        turns.sort(key=lambda x: x[0])
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        learned = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(chat.escape(role)) + len(chat.escape(t)) + sum(map(len, chat.MARKS.values())) for _, role, t in turns)
    row = formatted.where("conv_id = 100").first()
    assert sum(row["loss_mask"]) == 0 and len(row["input_ids"]) == len(row["loss_mask"])
    assert chat.digests(chat.format_chat(df.limit(0), vocabulary), vocabulary).collect() == []


def test_texts_never_encode_to_marks(spark):
    vocabulary = chat.load_vocabulary()
    ids = chat.encoding(vocabulary).encode_ordinary("".join(chat.CONTROL) * 3)
    assert max(ids) < chat.TURN
