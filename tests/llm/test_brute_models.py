"""op1, op5 and op10 over whole tables against plain loops: features, and what the fitted models make of them."""

import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from rivulet.llm import kernel as K
from rivulet.llm import langid, quality, queries, samples, toxicity
from rivulet.llm.common import remainder, table

D = "/root/testdata/sf0.001"
ALL = (1 << 64) - 1


def mix(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & ALL
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & ALL
    return h ^ h >> 31


def span_hash(raw):
    h = sum(int(K._BYTE_VALUE[c]) * pow(int(K._BASE), i, 1 << 64) for i, c in enumerate(raw)) & ALL
    return mix(h ^ len(raw) * int(K._GRAM) & ALL)


_hashes: dict = {}


def hashed(raw):
    if raw not in _hashes:
        _hashes[raw] = span_hash(raw)
    return _hashes[raw]


def low(raw):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in raw)


def sigmoid(x):
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def texts(spark):
    return {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, D, "documents").collect()}


# -- op1 ------------------------------------------------------------------------------


def tokens(raw):
    out = []
    for w in re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z\x80-\xff0-9\x00-\x20\x7f]+", raw):
        word = w[:1].isalpha() or w[0] >= 128
        shape = min(sum(65 <= c <= 90 for c in w), 2) if word else 3
        out.append((mix((hashed(low(w)) + shape) & ALL) >> 64 - quality.HASH_BITS, shape))
    return out


def test_quality_against_loops(spark):
    docs = {i: tokens(t) for i, t in texts(spark).items()}
    sums: dict = {}
    for doc in docs.values():
        for i, (w, _) in enumerate(doc):
            for j in range(max(0, i - quality.NEIGHBOURS), min(len(doc), i + quality.NEIGHBOURS + 1)):
                if i != j:
                    v = sums.setdefault(w, [0] * quality.DIMS)
                    for k in range(2):
                        v[quality._PLACES[k][doc[j][0]]] += int(quality._SIGNS[k][doc[j][0]])
    vectors = {}
    for w, v in sums.items():
        damped = [math.copysign(math.sqrt(abs(x)), x) for x in v]
        size = math.sqrt(sum(x * x for x in damped)) or 1.0
        vectors[w] = [x / size for x in damped]
    whole = table(spark, D, "documents")
    model = quality.train(whole.where(remainder("doc_id", 5) != 0), table(spark, D, "labels"), "quality", quality.word_vectors(whole.select("text")))
    zero, n_dims = [0.0] * quality.DIMS, range(quality.DIMS)
    got = {r["doc_id"]: r for r in queries.op1_quality(spark, D).collect()}
    assert set(got) == set(docs)
    for i, doc in docs.items():
        n = max(len(doc), 1)
        v = [vectors.get(w, zero) for w, _ in doc]
        mean = [sum(x[d] for x in v) / n for d in n_dims]
        spread = [math.sqrt(max(sum(x[d] ** 2 for x in v) / n - mean[d] ** 2, 0)) for d in n_dims]
        beside = sum(sum(a * b for a, b in zip(x, y)) for x, y in zip(v, v[1:])) / n
        same = sum(a[0] == b[0] for a, b in zip(doc, doc[1:])) / n
        x = [*mean, *spread, beside, same, math.sqrt(sum(m * m for m in mean)), math.log1p(len(doc)), *(sum(s == k for _, s in doc) / n for k in range(4))]
        x = [(a - c) / s for a, c, s in zip(x, model["centre"], model["scale"])]
        w1, b1, w2, b2 = model["p"]
        hidden = [math.tanh(sum(a * w1[d][h] for d, a in enumerate(x)) + b1[h]) for h in range(len(b1))]
        score = sigmoid((sum(a * b for a, b in zip(hidden, w2)) + b2[0]) / model["temperature"])
        assert got[i]["score"] == pytest.approx(score, abs=2e-4)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


# -- op5 ------------------------------------------------------------------------------


def test_languages_against_loops(spark):
    whole = table(spark, D, "documents")
    model = langid.train(whole.where(remainder("doc_id", 4) != 2))
    got = {r["doc_id"]: r for r in queries.op5_langid(spark, D).collect()}
    dot = lambda x, w: sum(v * w[k] for k, v in x.items())
    for i, raw in texts(spark).items():
        plain = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in low(raw))
        x: dict = {}
        for a, b, c in zip(plain, plain[1:], plain[2:]):
            g = (a * 0x9E3779B1 + b * 0x85EBCA6B & 0xFFFFFFFF) ^ c * 0xC2B2AE35 & 0xFFFFFFFF
            g = (g ^ g >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
            x[g >> 21] = x.get(g >> 21, 0) + 1
        for w in plain.split(b" "):
            if w:
                k = langid.HALF + (hashed(w) >> 53)
                x[k] = x.get(k, 0) + 1
        size = math.sqrt(sum(x.values())) or 1.0
        x = {k: math.sqrt(v) / size for k, v in x.items()}
        if not any(c.isalpha() for c in raw.decode()):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        margins = [dot(x, w) + b for w, b, _ in model["outer"]] or [0.0]
        best = max(range(len(margins)), key=lambda k: margins[k])
        p = [sigmoid(s * m) for (_, _, s), m in zip(model["outer"], margins)]
        score = p[best] / sum(p) if p else 1.0
        own, machines = model["inner"][model["families"][best]]
        votes, sums, prob = ({v: 0.0 for v in own} for _ in range(3))
        for (a, b), (w, bias, slope) in machines.items():
            m = dot(x, w) + bias
            votes[a], votes[b] = votes[a] + (m > 0), votes[b] + (m < 0)
            sums[a], sums[b] = sums[a] + m, sums[b] - m
            prob[a], prob[b] = prob[a] + sigmoid(slope * m), prob[b] + 1 - sigmoid(slope * m)
        lang = max(own, key=lambda v: (votes[v], sums[v], v))
        assert got[i]["lang_pred"] == lang
        assert got[i]["score"] == pytest.approx(score * (prob[lang] / (len(own) - 1) if len(own) > 1 else 1), abs=2e-4)


# -- op10 -----------------------------------------------------------------------------

LETTERS = rb"[a-z\x80-\xff]+"


def slots(word):
    h = hashed(word)
    return [h >> 64 - toxicity.TERM_BITS] + [mix((hashed(word[:n]) + n) & ALL) >> 64 - toxicity.TERM_BITS for n in toxicity.BEGINNINGS if len(word) > n]


def undone(raw):
    """(token, changed) with substitutes undone."""
    out = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", raw):
        solid = [i for i, c in enumerate(low(w)) if 97 <= c <= 122 or c >= 128 or 48 <= c <= 57 or chr(c) in "@$"]
        if solid:
            w = w[solid[0] : solid[-1] + 1]
            letters = sum(97 <= c <= 122 or c >= 128 for c in low(w))
            if letters:
                clear = b"".join(toxicity.SUBSTITUTES.get(chr(c), chr(c)).encode("latin-1") for c in low(w))
                out.append((b"".join(re.findall(LETTERS, clear)), letters < len(w)))
    return out


def toxic_features(raw, weights):
    listed, second = ({w.encode() for w in words.split()} for words in (toxicity.ABUSIVE, toxicity.SECOND_PERSON))

    def weigh(words):
        best = []
        for w in words:
            v = max(weights[s] for s in slots(w))
            best.append(max(v, toxicity.LISTED_WEIGHT) if w in listed else v)
        return best

    spans = [m.span() for m in re.finditer(LETTERS, low(raw))]
    words = [low(raw)[a:b] for a, b in spans]
    weight = weigh(words)
    n = max(len(words), 1)
    x = [math.log1p(len(words))]
    for k in toxicity.LEVELS:
        x += [sum(w > k for w in weight) / n, float(sum(w > k for w in weight))]
    ordered = sorted(weight, reverse=True)
    x += [ordered[k] if k < len(ordered) else -9.0 for k in toxicity.HIGHEST]
    excess = sum(max(w - 1, 0) ** 2 for w in weight)
    count: dict = {}
    for w in words:
        for kind, s in enumerate(slots(w)):
            kind = 0 if kind == 0 else toxicity.BEGINNINGS[kind - 1]
            count[kind, s] = count.get((kind, s), 0) + 1
    x += [sum(max(w, 0) for w in weight) / n, excess, excess / n]
    x.append(max([0.0, *(weights[s] * (min(c, toxicity.MOST_COUNTED) - 1) / (toxicity.MOST_COUNTED - 1) for (_, s), c in count.items() if weights[s] > 1)]))
    you = [i for i, w in enumerate(words) if w in second]
    near = 0.0
    for i in range(len(words)):
        gap = min((abs(i - j) for j in you), default=99)
        near += (1 / (1 + gap) if gap <= toxicity.NEAR else 0.0) * (weight[i] > 1.5)
    x += [len(you) / n, near]
    shout = [i for i, (a, b) in enumerate(spans) if b - a > 1 and all(65 <= c <= 90 for c in raw[a:b])]
    size = max(len(raw), 1)
    x += [sum(65 <= c <= 90 for c in raw) / size, len(shout) / n, float(sum(weight[i] > 1.5 for i in shout))]
    x += [raw.count(c) / size for c in (b"!", b"?")]
    x.append(sum(c > 32 and c != 127 and not (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) for c in low(raw)) / size)
    tokens = undone(raw)
    n2 = max(len(tokens), 1)
    hidden = sum(c and weigh([w])[0] > 2 for w, c in tokens)
    runs = sum(len(a[0]) == 1 and len(b[0]) == 1 for a, b in zip(tokens, tokens[1:]))
    return [*x, sum(c for _, c in tokens) / n2, float(hidden), runs / n2]


def test_toxicity_against_loops(spark):
    docs = table(spark, D, "documents")
    model = toxicity.train(docs.where(remainder("doc_id", 4) != 2), table(spark, D, "labels"), "toxic")
    weights = model["lexicon"]["weights"].astype(float).tolist()
    got = {r["doc_id"]: r for r in queries.op10_toxicity(spark, D).collect()}
    xs, ys = (v.tolist() for v in model["knots"])
    assert ys == sorted(ys)
    cuts = {(f, c) for splits, _ in model["trees"]["trees"] for f, c in splits}
    close = 0
    for i, raw in texts(spark).items():
        x = toxic_features(raw, weights)
        if any(abs(x[f] - c) < 1e-5 * max(1, abs(c)) for f, c in cuts if math.isfinite(c)):
            close += 1  # sums in another order may fall on the other side of a cut
            continue
        f = model["trees"]["prior"]
        for splits, leaves in model["trees"]["trees"]:
            node = base = 0
            for level in range(model["trees"]["depth"]):
                feature, cut = splits[base + node]
                base += 1 << level
                node = 2 * node + (x[feature] > cut)
            f += leaves[node]
        if f <= xs[0] or f >= xs[-1]:
            want = ys[0] if f <= xs[0] else ys[-1]
        else:
            k = max(j for j in range(len(xs)) if xs[j] <= f)
            want = ys[k] + (ys[k + 1] - ys[k]) * (f - xs[k]) / (xs[k + 1] - xs[k])
        assert got[i]["score"] == pytest.approx(want, abs=1e-4)
    assert close < len(got) / 4


def test_isotonic_map_against_min_max_means():
    """Pooled values are max over starts of min over ends of block means, drawn to the base rate by one row."""
    import random

    from rivulet.llm import learn
    import numpy as np

    draw = random.Random(2)
    score = [draw.random() for _ in range(60)]
    y = [float(draw.random() < s) for s in score]
    order = sorted(range(60), key=lambda i: score[i])
    v = [y[i] for i in order]
    fitted = [max(min(sum(v[a:b]) / (b - a) for b in range(i + 1, 61)) for a in range(i + 1)) for i in range(60)]
    knots = learn.fit_isotonic(np.array(score), np.array(y))
    base, rows = sum(y) / 60, [fitted.count(f) for f in fitted]
    want = [(f * n + base) / (n + 1) for f, n in zip(fitted, rows)]
    want = [max(want[: i + 1]) for i in range(60)]
    assert learn.isotonic_scores(knots, np.array(sorted(score))) == pytest.approx(want)


# -- samples ----------------------------------------------------------------------------


def sampled(docs, labels, **options):
    return samples.labelled_texts(docs, labels, "y", **options).collect()


def test_sample_counts_only_labels_that_have_a_document(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = spark.range(20_000_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("y"))
    assert len(sampled(docs, labels)) == 2000


def test_sample_is_bounded_and_well_defined(spark):
    same = spark.range(50_000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    label = spark.createDataFrame([(7, 1), (7, 1), (8, 0), (8, 1), (9, None), (None, 1)], "doc_id long, y int")
    assert [(r["id"], r["y"]) for r in sampled(same, label)] == [("7", 1)]
    assert sampled(same, label) == sampled(same.repartition(9), label)
    other = spark.createDataFrame([(8, "conflict"), (9, "no label"), (None, "no id")], "doc_id long, text string")
    assert sampled(other, label) == []
    many = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    drawn = sampled(many, many.select("doc_id", F.lit(1).alias("y")))
    assert len(drawn) == samples.SAMPLE_ROWS == len({r["id"] for r in drawn})


def test_language_sample_is_bounded(spark, monkeypatch):
    docs = spark.range(30_000).select((F.col("id") % 2).alias("doc_id"), F.lit("the same words").alias("text"), F.concat(F.lit("l"), F.col("id") % 9000).alias("lang"))
    seen = []
    monkeypatch.setattr(langid, "_machines", lambda x, y: seen.append(len(y)))
    langid.train(docs)
    assert seen == [langid.MAX_ROWS]
