"""Language identification in two steps: family first, then languages within it.

A text is a vector of hashed byte trigrams and hashed words (square roots of
counts, unit length).  Linear support vector machines, one per family against the
rest, choose the family; within it one-versus-one machines vote, ties going to the
larger sum of margins, and then to the language that is last in alphabetical order.  The score is the family's probability times the mean
probability of the winner against its neighbours.

Training uses at most ``PER_LANGUAGE`` texts of each language and ``MAX_ROWS`` in
all, those of the least hashes of id and text, and of as many languages as possible; repeated
rows count once.  Scoring is one pass over all texts.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and so is everything where nothing could be learned; with a single learned language each text
with letters is that language; repeated rows and null ids give a row each;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from . import learn

PER_LANGUAGE = 1000
MAX_ROWS = 6000
#: Hashes of a language are counted in 2 to this power ranges.
PART_BITS = 12
HALF = 2048
DIMS = 2 * HALF
#: Rows of a block of features (1 MB in single, 2 MB in double precision).
_ROWS = 64

# Families of ISO 639-1 codes; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tt",
    "indic": "hi bn ur mr gu pa ne",
    "semitic": "ar he am mt",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Bytes that are not part of a word become spaces, so punctuation and digits don't count.
_LETTERS = K.byte_set((0x61, 0x7A), (0x80, 0xFF))
_PLAIN = np.where(_LETTERS, np.arange(256), 0x20).astype(np.uint8)


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang, lang)


def vectors(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, feature matrix, has a letter) of blocks of rows."""
    for low, high, buf, offsets in K.text_chunks(column, K.SMALL_BYTES):
        low_buf = _PLAIN[K.LOWER[buf]]
        ascii_letters = np.concatenate([[0], np.cumsum((low_buf >= 0x61) & (low_buf <= 0x7A))])
        other = np.concatenate([[0], np.cumsum(low_buf >= 0x80)])
        has = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
        for r in np.flatnonzero(~has & (other[offsets[1:]] > other[offsets[:-1]])):
            has[r] = any(c.isalpha() for c in buf[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace"))
        wide = low_buf.astype(np.uint32)
        grams = ((wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA6B)) ^ (wide[2:] * np.uint32(0xC2B2AE35))) if len(wide) > 2 else np.zeros(0, np.uint32)
        grams = ((grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - 11)).astype(np.int64)
        words = K.Words(low_buf, offsets, _LETTERS[low_buf])
        marks = (K.span_hashes(low_buf, words.start, words.stop) >> np.uint64(64 - 11)).astype(np.int64)
        for a in range(0, high - low, _ROWS):
            b = min(a + _ROWS, high - low)
            lengths = np.maximum(offsets[a + 1 : b + 1] - offsets[a:b] - 2, 0)
            row = np.repeat(np.arange(b - a), lengths)
            first = np.repeat(offsets[a:b] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
            x = np.bincount(row * DIMS + grams[first + np.arange(len(row))], minlength=(b - a) * DIMS)
            w = slice(words.first[a], words.first[b])
            x = x + np.bincount((words.row[w] - a) * DIMS + HALF + marks[w], minlength=(b - a) * DIMS)
            x = np.sqrt(x.reshape(b - a, DIMS).astype(np.float32))
            norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
            yield low + a, low + b, x / np.maximum(norm, 1e-6), has[a:b]


def _machines(x: np.ndarray, y: np.ndarray) -> dict:
    langs = sorted(set(y.tolist()))
    families = sorted({family_of(v) for v in langs})
    kin = np.array([family_of(v) for v in y.tolist()])
    outer = [learn.fit_svm(x, kin == f) for f in families] if len(families) > 1 else []
    inner = {}
    for f in families:
        own = [v for v in langs if family_of(v) == f]
        inner[f] = (own, {(a, b): learn.fit_svm(x[(y == a) | (y == b)], y[(y == a) | (y == b)] == a) for i, a in enumerate(own) for b in own[i + 1 :]})
    return {"families": families, "outer": outer, "inner": inner}


def _predict(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(x)
    if model["outer"]:
        margins = np.stack([x @ w + b for w, b, _ in model["outer"]], axis=1)
        chosen = margins.argmax(axis=1)
        p = np.stack([learn.sigmoid(s * margins[:, i]) for i, (_, _, s) in enumerate(model["outer"])], axis=1) + 1e-9
        score = p[np.arange(n), chosen] / p.sum(axis=1)
    else:
        chosen, score = np.zeros(n, dtype=np.int64), np.ones(n)
    lang = np.empty(n, dtype=object)
    for i, f in enumerate(model["families"]):
        at = np.flatnonzero(chosen == i)
        own, machines = model["inner"][f]
        if not len(at):
            continue
        votes, sums, prob = (np.zeros((len(at), len(own))) for _ in range(3))
        for (a, b), (w, bias, slope) in machines.items():
            m = x[at] @ w + bias
            p = learn.sigmoid(slope * m)
            for k, sign, q in ((own.index(a), 1, p), (own.index(b), -1, 1 - p)):
                votes[:, k] += sign * m > 0
                sums[:, k] += sign * m
                prob[:, k] += q
        best = np.lexsort((sums, votes), axis=1)[:, -1] if len(own) > 1 else np.zeros(len(at), dtype=np.int64)
        lang[at] = np.array(own, dtype=object)[best]
        if len(own) > 1:
            score[at] *= prob[np.arange(len(at)), best] / (len(own) - 1)
    return lang, np.clip(score, 0.0, 1.0)


def _sample(rows: DataFrame, per_language: int, max_rows: int) -> DataFrame:
    """(lang, text) of at most ``max_rows`` rows of (id, text, lang).

    Hashes are drawn first, and texts are read for the hashes drawn alone.  Of a language,
    counts by ranges of hashes tell which ranges hold its least ones, so that one
    task ranks little more than ``per_language`` hashes, however many the language has.
    """
    hashed = rows.withColumn("h", F.xxhash64(F.lit("langid"), "id", "text"))
    keys = hashed.select("lang", "h").distinct().withColumn("part", F.shiftright("h", 64 - PART_BITS))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    least = keys.groupBy("lang", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < per_language)
    number = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    drawn = keys.join(least.select("lang", "part"), ["lang", "part"]).withColumn("n", number).where(F.col("n") <= per_language)
    drawn = drawn.orderBy("n", "h", "lang").limit(max_rows).select("lang", "h")
    return hashed.join(F.broadcast(drawn), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")  # at most ``max_rows``


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS) -> dict | None:
    """The model; None where nothing can be learned."""
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sample = _sample(rows, per_language, max_rows)

    def run(batches):
        for batch in batches:
            for low, high, x, has in vectors(batch.column(1)):
                at = np.flatnonzero(has)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low).take(pa.array(at)), pa.array([zlib.compress(v.astype(np.float16).tobytes(), 1) for v in x[at]], pa.binary())], ["lang", "x"])

    got = sorted((r["lang"], bytes(r["x"])) for r in sample.mapInArrow(run, "lang string, x binary").collect())  # at most max_rows
    if not got:
        return None
    y = np.array([g[0] for g in got], dtype=object)
    x = np.empty((len(got), DIMS), np.float32)
    for i in range(len(got)):
        x[i], got[i] = np.frombuffer(zlib.decompress(got[i][1]), np.float16), None
    return _machines(x, y)


def identify(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for low, high, x, has in vectors(batch.column(1)):
                lang, score = (np.full(high - low, "und", dtype=object), np.zeros(high - low)) if model is None else _predict(model, x)
                lang[~has], score[~has] = "und", 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(lang, pa.string()), pa.array(score.astype(np.float64))], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: dict | None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` whose language is known, with the language identified in ``lang_col`` (a string column, if there is one); other columns as they were.

    Without a model nothing is identified, and ``lang_col`` stays too.
    """
    names = docs.columns
    at = names.index(text_col)
    to = names.index(lang_col) if model is not None and lang_col in names and docs.schema[lang_col].dataType.simpleString() == "string" else None

    def run(batches):
        for batch in batches:
            keep, langs = [], []
            for _, _, x, has in vectors(batch.column(at)):
                keep.append(has)
                if to is not None:
                    langs.append(_predict(model, x)[0])
            if keep:
                if to is not None:
                    field = batch.schema.field(to)
                    batch = batch.set_column(to, field, pa.array(np.concatenate(langs), pa.string()).cast(field.type))
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
