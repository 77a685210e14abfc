"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities and highest weights of lexicon words, learned
ones (whole words and word beginnings, hashed, weighted by smoothed log odds of their
counts) and a short list of abusive words; how near they are to
second-person pronouns; capitals; punctuation; and signs of obfuscation (words
whose letters are replaced or parted by symbols, and lexicon words found only
after that is undone).

Lexicon, trees and calibration are fitted on a bounded sample of labelled rows
(samples.SAMPLE_ROWS).  While fitting, a document's own counts are taken out of
the lexicon, so training features look like those of unseen texts.  The isotonic map is
fitted on out-of-fold logits, the trees on all rows.  The lexicon's table has a fixed
size (``TERMS`` numbers); one pass scores all texts.

Defined results: a null or empty text has the score of a document without
words; without labelled rows, or with one label only, every score is the mean label (0.5 without
labels); ids with two different labels are not learned from; repeated rows and null ids
give a row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from . import learn
from .common import materialize
from .samples import labelled_texts

TERM_BITS = 18
TERMS = 1 << TERM_BITS
_CHUNKS = 8
BEGINNINGS = (3, 4, 5, 6, 7, 8)
NEAR = 5
PRIOR_ROWS = 4.0
#: A document counts at most this often for a term, so long texts don't decide alone.
MOST_COUNTED = 5
#: Words of the short list weigh at least this.
LISTED_WEIGHT = 3.0
LEVELS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0)
HIGHEST = (0, 1, 2, 4)
ROUNDS, DEPTH, FOLDS, SPLITS = 60, 2, 5, 4

# Common abusive words, and second-person pronouns of four languages.
ABUSIVE = "idiot moron stupid dumb loser trash scum pathetic worthless disgusting clown imbecile fool ugly hate kill idiota imbécil estúpido basura idiote imbécile stupide crétin ordure dumm idiotisch abschaum arschloch"
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te ti tus tuyo usted ustedes vosotros vous votre vos toi ton ta tes"
# Symbols that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}

_PLAIN_LETTER = K.byte_set((0x61, 0x7A), (0x80, 0xFF))
_UNDONE = K.LOWER.copy()
for _symbol, _letter in SUBSTITUTES.items():
    _UNDONE[ord(_symbol)] = ord(_letter)


def _hash_list(words: str) -> np.ndarray:
    column = pa.array(words.split())
    _, _, buf, offsets = next(K.text_chunks(column))
    return np.sort(K.span_hashes(buf, offsets[:-1], offsets[1:]))


_ABUSIVE, _SECOND = _hash_list(ABUSIVE), _hash_list(SECOND_PERSON)


def _among(h: np.ndarray, listed: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(listed, h), len(listed) - 1)
    return listed[at] == h


def _terms(buf: np.ndarray, start: np.ndarray, stop: np.ndarray, whole: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, lexicon slots): whole words, and then the beginnings of words that are longer."""
    shift = np.uint64(64 - TERM_BITS)
    yield np.arange(len(whole)), (whole >> shift).astype(np.int64)
    size, total = stop - start, K.prefix_sums(buf)
    for n in BEGINNINGS:
        at = np.flatnonzero(size > n)
        yield at, (K.mix(K.span_hashes(buf, start[at], start[at] + n, total) + np.uint64(n)) >> shift).astype(np.int64)


def _undone(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with substitutions undone: (bytes, start, stop, row, changed).

    Punctuation around a token is cut off; symbols inside are replaced by the letter
    they stand for, or left out.  Only tokens that hold a letter count.
    """
    low = K.LOWER[buf]
    w = K.Words(buf, offsets, K.NON_SPACE[buf])
    solid = K.ALNUM[low] | (buf == ord("@")) | (buf == ord("$"))
    place = np.arange(len(buf))
    last = np.maximum.accumulate(np.where(solid, place, -1)) if len(buf) else place
    following = np.minimum.accumulate(np.where(solid, place, len(buf))[::-1])[::-1] if len(buf) else place
    start, stop = following[w.start], last[w.stop - 1] + 1
    letters = np.concatenate([[0], np.cumsum(_PLAIN_LETTER[low])])
    good = (start < stop) & (start >= w.start) & (stop <= w.stop)
    start, stop, row = start[good], stop[good], w.row[good]
    some = letters[stop] > letters[start]
    start, stop, row = start[some], stop[some], row[some]
    changed = letters[stop] - letters[start] < stop - start
    undone = _UNDONE[buf]
    stays = _PLAIN_LETTER[undone]
    moved = np.concatenate([[0], np.cumsum(stays)])
    return undone[stays], moved[start], moved[stop], row, changed


def _rate(flag: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(flag, dtype=float)])
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)


def _odds(counts: np.ndarray, rate: float) -> np.ndarray:
    """Smoothed log odds of label 1 over those of ``rate``, from counts under label 0 and label 1."""
    return np.log((counts[1] + PRIOR_ROWS * rate) / (counts[0] + PRIOR_ROWS * (1 - rate))) - np.log(rate / (1 - rate))


def _weights(buf: np.ndarray, start: np.ndarray, stop: np.ndarray, h: np.ndarray, row: np.ndarray, rows: int, lexicon: dict, labels: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The highest weight of each word's terms, and for each row that of a repeated term times its share of MOST_COUNTED.

    With labels, a row's own counts are taken out of the lexicon first.
    """
    best, repeated = np.full(len(h), -9.0), np.zeros(rows)
    for at, slot in _terms(buf, start, stop, h):
        weight = lexicon["weights"][slot]
        if labels is None:
            best[at] = np.maximum(best[at], weight)
            strong = np.flatnonzero(weight > 1)
            at, slot = at[strong], slot[strong]
        key, own, count = np.unique(row[at] * TERMS + slot, return_inverse=True, return_counts=True)
        r, slot, count = key >> TERM_BITS, key & (TERMS - 1), np.minimum(count, MOST_COUNTED)
        weight = lexicon["weights"][slot]
        if labels is not None:
            weight = _odds(np.maximum(lexicon["counts"][:, slot] - count * np.stack([labels[r] == 0, labels[r] == 1]), 0), lexicon["rate"])
            best[at] = np.maximum(best[at], weight[own])
        np.maximum.at(repeated, r, np.where(weight > 1, weight * (count - 1) / (MOST_COUNTED - 1), 0.0))
    return np.where(_among(h, _ABUSIVE), np.maximum(best, LISTED_WEIGHT), best), repeated


def features(column: pa.Array, lexicon: dict, labels: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, features) of a column of texts."""
    for low, high, raw, offsets in K.text_chunks(column, 1 << 19):
        rows = high - low
        buf = K.LOWER[raw]
        w = K.Words(buf, offsets, _PLAIN_LETTER[buf])
        first, n = w.first, np.diff(w.first)
        h = K.span_hashes(buf, w.start, w.stop)
        own = None if labels is None else labels[low:high]
        weight, repeated = _weights(buf, w.start, w.stop, h, w.row, rows, lexicon, own)
        second = _among(h, _SECOND)
        strong = weight > 1.5
        out = [np.log1p(n)]
        for k in LEVELS:
            rate = _rate(weight > k, first, n)
            out += [rate, rate * n]
        # the highest weights, and what is above 1 of all of them
        order = np.lexsort((-weight, w.row))
        place = np.arange(len(order)) - first[w.row[order]]
        for k in HIGHEST:
            top, at = np.full(rows, -9.0), order[place == k]
            top[w.row[at]] = weight[at]
            out.append(top)
        excess = np.bincount(w.row, np.maximum(weight - 1, 0) ** 2, rows)
        out += [_rate(np.maximum(weight, 0), first, n), excess, excess / np.maximum(n, 1), repeated]
        # lexicon words near a second-person pronoun of the same row
        where = np.flatnonzero(second)
        near = np.zeros(len(h))
        if len(where):
            at = np.searchsorted(where, np.arange(len(h)))
            for side in (np.minimum(at, len(where) - 1), np.maximum(at - 1, 0)):
                gap = np.abs(where[side] - np.arange(len(h)))
                near = np.maximum(near, np.where((gap <= NEAR) & (w.row[where[side]] == w.row), 1.0 / (1 + gap), 0.0))
        out += [_rate(second, first, n), _rate(near * strong, first, n) * n]
        # capitals and punctuation, by bytes and by words
        size = np.diff(offsets)
        caps = (raw >= 65) & (raw <= 90)
        upto = np.concatenate([[0], np.cumsum(caps)])
        shout = (upto[w.stop] - upto[w.start] == w.stop - w.start) & (w.stop - w.start > 1)
        out += [_rate(caps, offsets, size), _rate(shout, first, n), _rate(shout & strong, first, n) * n]
        out += [_rate(raw == ord(c), offsets, size) for c in "!?"]
        punct = ~K.ALNUM[buf] & (raw > 32) & (raw != 127)
        out.append(_rate(punct, offsets, size))
        # obfuscation: only words that were changed can hide another
        clear, start, stop, row, changed = _undone(raw, offsets)
        f2 = np.searchsorted(row, np.arange(rows + 1))
        n2 = np.diff(f2)
        hidden = np.zeros(len(row), dtype=bool)
        at = np.flatnonzero(changed)
        hidden[at] = _weights(clear, start[at], stop[at], K.span_hashes(clear, start[at], stop[at]), row[at], rows, lexicon, own)[0] > 2.0
        single = stop - start == 1
        runs = single.copy()
        if len(single) > 2:
            runs[1:] &= single[:-1] & (row[1:] == row[:-1])
            runs[0] = False
        out += [_rate(changed, f2, n2), _rate(hidden, f2, n2) * n2, _rate(runs, f2, n2)]
        yield low, high, np.stack(out, axis=1).astype(float)


def lexicon_of(sample: DataFrame) -> dict:
    """counts (2, TERMS) of terms under both labels, a document counting at most MOST_COUNTED of each; rate of label 1; weights."""

    def count(batches):
        total = np.zeros(2 * TERMS, dtype=np.int64)
        for batch in batches:
            y = batch.column(0).to_numpy().astype(np.int64)
            for low, high, raw, offsets in K.text_chunks(batch.column(1), 1 << 19):
                buf = K.LOWER[raw]
                w = K.Words(buf, offsets, _PLAIN_LETTER[buf])
                h = K.span_hashes(buf, w.start, w.stop)
                for at, slot in _terms(buf, w.start, w.stop, h):
                    key, times = np.unique(w.row[at] * TERMS + slot, return_counts=True)
                    np.add.at(total, y[low:high][key >> TERM_BITS] * TERMS + (key & (TERMS - 1)), np.minimum(times, MOST_COUNTED))
        yield from K.emit_parts(total, _CHUNKS)

    counts = K.collect_sums(sample.select("y", "text").mapInArrow(count, "chunk int, data binary"), "<i8", 2 * TERMS, _CHUNKS).reshape(2, TERMS).astype(float)
    rate = _base_rate(sample)
    return {"counts": counts, "rate": rate, "weights": _odds(counts, rate)}


def _base_rate(sample: DataFrame) -> float:
    mean = sample.agg(F.avg("y")).first()[0]
    return min(max(mean if mean is not None else 0.5, 1e-3), 1 - 1e-3)


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Trees of all rows, and an isotonic map of out-of-fold logits (means over SPLITS divisions into FOLDS).

    A division is by place in a fixed random order, at every size; a fold whose rest has one label only gives the logits of that label's rate.
    """
    held = np.zeros(len(y))
    for seed in range(SPLITS):
        fold = np.random.default_rng(seed).permutation(len(y)) % FOLDS
        for k in set(fold.tolist()):
            held[fold == k] += learn.tree_logits(learn.fit_trees(x[fold != k], y[fold != k], ROUNDS, DEPTH), x[fold == k]) / SPLITS
    return {"trees": learn.fit_trees(x, y, ROUNDS, DEPTH), "knots": learn.fit_isotonic(held, y)}


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text") -> dict:
    sample = materialize(labelled_texts(docs, labels, label_col, id_col, text_col))
    seen = [r["y"] for r in sample.select("y").distinct().collect()]
    if len(seen) < 2:
        return {"constant": float(seen[0]) if seen else 0.5}
    lexicon = lexicon_of(sample)

    def run(batches):
        for batch in batches:
            for low, high, x in features(batch.column(2), lexicon, batch.column(1).to_numpy().astype(np.int64)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"])

    got = sorted((r["id"], r["y"], bytes(r["x"])) for r in sample.select("id", "y", "text").mapInArrow(run, "id string, y int, x binary").collect())  # at most samples.SAMPLE_ROWS
    x, y = np.stack([np.frombuffer(g[2]) for g in got]), np.array([g[1] for g in got], dtype=float)
    return fit(x, y) | {"lexicon": {"weights": lexicon["weights"].astype(np.float32)}}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if "constant" in model:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, model["constant"]))], ["id", "score"])
                continue
            for low, high, x in features(batch.column(1), model["lexicon"]):
                p = learn.isotonic_scores(model["knots"], learn.tree_logits(model["trees"], x))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.clip(p, 0.0, 1.0))], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
