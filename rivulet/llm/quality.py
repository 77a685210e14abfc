"""Document quality: random-indexing word vectors, pooled, and a two-layer network.

Tokens are runs of letters, of digits or of punctuation.  A token's row in the
vocabulary is a hash of its shape (lower case, capitalised, upper case, other) and
its letters.  Each row has a fixed sparse index vector; a row's word vector is the sum of the index
vectors of its neighbours (two on either side) over *all* documents, with
damped and normalised length.  A document is the mean, spread and neighbour
similarity of its tokens' vectors.  The network is fitted on a bounded sample of labelled rows
(samples.SAMPLE_ROWS), its temperature on out-of-fold logits of these.

There are at most ``ROWS`` x ``DIMS`` sums (67 MB as floats, 34 MB as they are broadcast),
however many words a corpus has; a million words make four share a row.  Tasks send the
sums that are not zero, which are added up by ranges of rows as they stream; only rows that
occur come to the driver and go to the tasks.  Then one pass scores all texts.

Defined results: a null or empty text has the score of a document without
tokens; without any labelled row, or with one label only, every score is the mean label
(0.5 without labels); ids with two different labels are not learned from; repeated rows
and null ids give a row each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from . import learn
from .samples import labelled_texts

HASH_BITS = 18
ROWS = 1 << HASH_BITS
DIMS = 64
NEIGHBOURS = 2
#: Rows of the vocabulary that are added up together.
RANGE = 4096
SHAPES = 4
_STEP = np.float32(1 / 32767)
#: Texts that are pooled together: their tokens' vectors stay in the processor's cache.
_POOL_BYTES = 1 << 16

_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[K.byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))] = 1
_CLASS[K.byte_set((0x30, 0x39))] = 2
_CLASS[K.byte_set((0x00, 0x20), (0x7F, 0x7F))] = 0

_rng = np.random.default_rng(41)
#: Index vectors: two places and signs for each vocabulary row.
_PLACES = _rng.integers(0, DIMS, (2, ROWS))
_SIGNS = _rng.choice(np.array([-1, 1], dtype=np.int32), (2, ROWS))


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vocabulary row, document row, shape) of each token of a chunk."""
    kind = _CLASS[buf]
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    edge = np.ones(len(buf) + 1, dtype=bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    start, stop = cuts[:-1], cuts[1:]
    solid = kind[start] > 0
    start, stop = start[solid], stop[solid]
    upper = np.concatenate([[0], np.cumsum((buf >= 65) & (buf <= 90))])
    caps = upper[stop] - upper[start]
    shape = np.where(kind[start] != 1, 3, np.minimum(caps, 2)).astype(np.int64)
    h = K.mix(K.span_hashes(K.LOWER[buf], start, stop) + shape.astype(np.uint64)) >> np.uint64(64 - HASH_BITS)
    return h.astype(np.int64), np.searchsorted(offsets, start, "right") - 1, shape


class Vectors:
    """Word vectors of the rows that occur, after a first vector of zeros that all others have."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray):
        self.place = np.zeros(ROWS, dtype=np.int32)
        self.place[rows] = np.arange(1, len(rows) + 1)
        self.vectors = vectors
        self._sent = None

    def __getitem__(self, words: np.ndarray) -> np.ndarray:
        found = self.vectors[self.place[words]]
        return found if found.dtype == np.float32 else found.astype(np.float32) * _STEP

    def sent(self, spark: SparkSession) -> Broadcast:
        """What tasks read them from, made once: components in steps of 1 / 32767, two bytes each, here too from then on."""
        if self._sent is None:
            steps = np.empty(self.vectors.shape, np.int16)
            for k in range(0, len(steps), RANGE):
                steps[k : k + RANGE] = np.rint(self.vectors[k : k + RANGE] / _STEP)
            self.vectors = steps
            self._sent = spark.sparkContext.broadcast(self)
        return self._sent


def word_vectors(docs: DataFrame) -> Vectors:
    """From all texts of the column ``text``."""

    def count(batches):
        total = np.zeros(ROWS * DIMS, dtype=np.int32)
        for batch in batches:
            for _, _, buf, offsets in K.text_chunks(batch.column(0)):
                word, row, _ = tokens(buf, offsets)
                for far in range(1, NEIGHBOURS + 1):
                    near = row[far:] == row[:-far]
                    left, right = word[:-far][near], word[far:][near]
                    for places, signs in zip(_PLACES, _SIGNS):
                        np.add.at(total, left * DIMS + places[right], signs[right])
                        np.add.at(total, right * DIMS + places[left], signs[left])
        # a rare word has a few sums only: places and values of those that are not zero
        for k, part in enumerate(np.split(total, ROWS // RANGE)):
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([zlib.compress(v.astype(np.int32).tobytes(), 1)]) for v in (np.diff(at, prepend=0), part[at]))], ["range", "steps", "sums"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, steps, sums in zip(*batch.columns):
                steps, sums = (np.frombuffer(zlib.decompress(v.as_buffer()), np.int32) for v in (steps, sums))
                total.setdefault(k.as_py(), np.zeros((RANGE, DIMS), np.int64)).ravel()[np.cumsum(steps)] += sums
        for k, sums in total.items():
            damped = np.sign(sums) * np.sqrt(np.abs(sums))
            used = np.flatnonzero(sums.any(axis=1))
            unit = (damped[used] / np.linalg.norm(damped[used], axis=1, keepdims=True)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([(used + k * RANGE).astype(np.int32).tobytes()]), pa.array([unit.tobytes()])], ["words", "vectors"])

    parts = docs.select("text").mapInArrow(count, "range int, steps binary, sums binary")
    got = parts.repartition(16, "range").mapInArrow(add, "words binary, vectors binary").collect()  # at most ROWS vectors
    rows = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(r["words"], np.int32) for r in got)])
    vectors = np.zeros((len(rows) + 1, DIMS), np.float32)
    end = len(vectors)
    while got:  # from the last, so that each part is freed once copied
        part = np.frombuffer(got.pop()["vectors"], np.float32).reshape(-1, DIMS)
        vectors[end - len(part) : end] = part
        end -= len(part)
    return Vectors(rows, vectors)


def _mean(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.zeros((len(n), *values.shape[1:]))
    full = n > 0
    if full.any():
        total[full] = np.add.reduceat(values, first[:-1][full], axis=0)
    return total / np.maximum(n, 1).reshape(-1, *[1] * (values.ndim - 1))


def pooled(column: pa.Array, vectors: Vectors) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, features) of a column of texts."""
    for low, high, buf, offsets in K.text_chunks(column, _POOL_BYTES):
        word, row, shape = tokens(buf, offsets)
        first = np.searchsorted(row, np.arange(high - low + 1))
        n = np.diff(first)
        v = vectors[word]
        mean = _mean(v, first, n)
        spread = np.sqrt(np.maximum(_mean(v * v, first, n) - mean**2, 0))
        beside = np.zeros(len(word))
        same = np.zeros(len(word))
        if len(word) > 1:
            near = row[1:] == row[:-1]
            beside[1:] = np.einsum("ij,ij->i", v[1:], v[:-1]) * near
            same[1:] = (word[1:] == word[:-1]) & near
        shapes = np.stack([_mean((shape == k).astype(float), first, n) for k in range(SHAPES)], axis=1)
        extra = np.stack([_mean(beside, first, n), _mean(same, first, n), np.linalg.norm(mean, axis=1), np.log1p(n)], axis=1)
        yield low, high, np.hstack([mean, spread, extra, shapes])


def train(docs: DataFrame, labels: DataFrame, label_col: str, vectors: Vectors, id_col: str = "doc_id", text_col: str = "text") -> dict:
    sent = vectors.sent(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for low, high, x in pooled(batch.column(1), sent.value):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary())], ["y", "x"])

    sample = labelled_texts(docs, labels, label_col, id_col, text_col).select("y", "text")
    got = sorted((r["y"], bytes(r["x"])) for r in sample.mapInArrow(run, "y int, x binary").collect())  # at most samples.SAMPLE_ROWS
    y = np.array([g[0] for g in got], dtype=float)
    if len(set(y.tolist())) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.5}
    return learn.fit_network(np.stack([np.frombuffer(g[1], np.float32) for g in got]).astype(float), y)


def score(docs: DataFrame, model: dict, vectors: Vectors, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score."""
    kind = docs.schema[id_col].dataType.simpleString()

    sent = vectors.sent(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for low, high, x in pooled(batch.column(1), sent.value):
                p = np.full(len(x), model["constant"]) if "constant" in model else learn.network_scores(model, x)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.clip(p, 0.0, 1.0))], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def quality_scores(docs: DataFrame, learnable: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Vectors from all of ``docs``, the network from ``learnable`` with ``labels``, scores for ``docs``."""
    vectors = word_vectors(docs.select(F.col(text_col).cast("string").alias("text")))
    return score(docs, train(learnable, labels, label_col, vectors, id_col, text_col), vectors, id_col, text_col)
