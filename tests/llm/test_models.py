import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import langid, learn, quality, toxicity
from rivulet.llm.common import remainder

LETTERS = {"en": ["the", "and", "thing", "with", "was", "other", "shell"], "de": ["der", "und", "schon", "nicht", "über", "ungern", "eicht"], "fr": ["les", "des", "une", "être", "eaux", "çon", "queue"], "es": ["el", "los", "ción", "año", "llama", "ñandú", "que"]}


def prose(draw, lang, n):
    return " ".join(draw.choice(LETTERS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    """(docs, labels): languages, junk (quality 0) and abuse (toxic 1), by fixed rules."""
    draw = random.Random(8)
    rows, labels = [], []
    for i in range(700):
        lang = draw.choice(list(LETTERS))
        words = prose(draw, lang, draw.randint(5, 80)).split()
        bad, rude = draw.random() < 0.2, draw.random() < 0.2
        if bad:
            words = [w + draw.choice(["$$$", "***", "%%%"]) for w in words] if draw.random() < 0.5 else [words[0]] * len(words)
        if rude:
            for _ in range(3):
                words.insert(draw.randrange(len(words)), draw.choice(["idiot", "zorkface", "you moron", "zorkhead"]))
        rows.append((i, " ".join(words), lang, "s"))
        labels.append((i, int(not bad), int(rude)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


ODD = [(1000, None), (1001, ""), (1002, "12 34 !!"), (1003, "日本"), (1003, "日本"), (None, "the thing"), (1004, "x" * 200_000), (1005, "the " * 30_000), (1006, "\u0663\u0664")]


def odd(spark):
    return spark.createDataFrame([(i, t, "lang", 0.5) for i, t in ODD], "doc_id long, text string, lang_pred string, score double")


def accuracy(scored, labels, column, mod, rest):
    held = scored.join(labels, "doc_id").where(remainder("doc_id", mod) == rest)
    return held.agg(F.avg(((F.col("score") >= 0.3).cast("int") == F.col(column)).cast("double"))).first()[0]


def test_remainder_is_crc32_of_the_text(spark):
    got = spark.range(50).select("id", remainder("id", 5).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


def test_languages(spark, labelled):
    docs, _ = labelled
    model = langid.train(docs.where(remainder("doc_id", 4) != 2), "doc_id", "text", "lang")
    got = langid.identify(docs, model).join(docs, "doc_id").where(remainder("doc_id", 4) == 2)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    assert got.where("score < 0 or score > 1 or lang_pred = 'und'").isEmpty()
    rows = langid.identify(odd(spark), model).collect()
    assert len(rows) == len(ODD)
    of = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert all(of[i] == ("und", 0.0) for i in (1000, 1001, 1002, 1006)) and of[1003][0] in LETTERS and of[1005][0] == "en" and of[None][0] == "en"
    kept = langid.keep_identified(odd(spark), model)
    assert kept.columns == odd(spark).columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1003, 1003, 1004, 1005]


def test_languages_without_training_rows(spark, labelled):
    docs, _ = labelled
    assert langid.train(docs.limit(0), "doc_id", "text", "lang") is None
    assert langid.train(docs.withColumn("lang", F.lit(None).cast("string")), "doc_id", "text", "lang") is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    single = langid.train(docs.where("lang = 'fr'"), "doc_id", "text", "lang")
    assert {r["lang_pred"] for r in langid.identify(docs, single).collect()} == {"fr"}
    assert langid.identify(docs.limit(0), single).collect() == []


def test_language_does_not_depend_on_batches(spark, labelled):
    docs, _ = labelled
    a = langid.train(docs, "doc_id", "text", "lang")
    b = langid.train(docs.repartition(7), "doc_id", "text", "lang")
    assert sorted(langid.identify(docs, a).collect()) == sorted(langid.identify(docs.coalesce(1), b).collect())


def test_language_sample_has_the_documented_size(spark, monkeypatch):
    docs = spark.range(4800).select(F.col("id").alias("doc_id"), F.lit("the thing was with other").alias("text"), F.element_at(F.array(*map(F.lit, LETTERS)), (F.col("id") % 4 + 1).cast("int")).alias("lang"))
    seen = []
    monkeypatch.setattr(langid, "_machines", lambda x, y: seen.append(x.shape))
    langid.train(docs, "doc_id", "text", "lang")
    assert 3800 < seen[0][0] < 4200 and seen[0][1] == langid.DIMS  # 1,000 a language, drawn by a hash


def test_quality(spark, labelled):
    docs, labels = labelled
    scored = quality.quality_scores(docs, docs.where(remainder("doc_id", 5) != 0), labels)
    assert accuracy(scored, labels, "quality", 5, 0) > 0.95
    vectors = quality.word_vectors(docs)
    model = quality.train(docs, labels, "quality", vectors)
    rows = quality.score(odd(spark), model, vectors).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)


def test_word_vectors_against_loops(spark):
    df = spark.createDataFrame([("a b a",), ("B c",), (None,)], "text string")
    word, row, _ = quality.tokens(*_bytes("a b a"))
    assert len(word) == 3 and word[0] == word[2] and row.tolist() == [0, 0, 0]
    sums = np.zeros((quality.ROWS, quality.DIMS))
    for text in ("a b a", "B c"):
        w, _, _ = quality.tokens(*_bytes(text))
        for i in range(len(w)):
            for j in range(len(w)):
                if 0 < abs(i - j) <= quality.NEIGHBOURS:
                    for p, s in zip(quality._PLACES, quality._SIGNS):
                        sums[w[i], p[w[j]]] += s[w[j]]
    damped = np.sign(sums) * np.sqrt(np.abs(sums))
    want = damped / np.maximum(np.linalg.norm(damped, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.word_vectors(df)[np.arange(quality.ROWS)], want, atol=1e-6)


def _bytes(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)])


def test_toxicity(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs.where(remainder("doc_id", 4) != 2), labels, "toxic")
    assert accuracy(toxicity.score(docs, model), labels, "toxic", 4, 2) > 0.95
    rows = toxicity.score(odd(spark), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    said = spark.createDataFrame([(1, "the thing was with you moron and the 1d!0t idiot"), (2, "the thing was with other shell and the thing")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score(said, model).collect()}
    assert score[1] > 0.3 > score[2]


def test_obfuscated_words_are_undone():
    raw, offsets = _bytes("an 1d!0t m.o-r*on (idiot!) plain 123")
    clear, start, stop, _, changed = toxicity._undone(raw, offsets)
    words = [clear[a:b].tobytes().decode() for a, b in zip(start, stop)]
    assert words == ["an", "idiot", "moron", "idiot", "plain"] and changed.tolist() == [False, True, True, False, False]


@pytest.mark.parametrize("rows", [[], [(1, 1, 1)], [(1, None, None)]])
def test_without_both_labels(spark, labelled, rows):
    docs, _ = labelled
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    want = 1.0 if rows and rows[0][1] is not None else 0.5
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels, "toxic")).collect()} == {want}
    assert {r["score"] for r in quality.quality_scores(docs, docs, labels).collect()} == {want}
    assert quality.quality_scores(docs.limit(0), docs.limit(0), labels).collect() == []


def test_isotonic_is_monotonic_and_calibrated():
    draw = np.random.default_rng(1)
    s = draw.normal(size=4000)
    y = (draw.random(4000) < learn.sigmoid(2 * s)).astype(float)
    knots = learn.fit_isotonic(s, y)
    assert (np.diff(knots[1]) >= 0).all()
    grid = np.linspace(-2, 2, 9)
    assert np.abs(learn.isotonic_scores(knots, grid) - learn.sigmoid(2 * grid)).max() < 0.12


def test_trees_learn_an_interaction():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = learn.fit_trees(x[:1500], y[:1500])
    assert ((learn.tree_logits(model, x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.93


def test_network_is_calibrated():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(3000, 5))
    p = learn.sigmoid(2 * x[:, 0])
    y = (draw.random(3000) < p).astype(float)
    scores = learn.network_scores(learn.fit_network(x, y), x)
    assert np.abs(scores - p).mean() < 0.08
