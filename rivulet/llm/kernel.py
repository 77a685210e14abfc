"""Vectorised text kernels shared by the operators that run in Arrow batches.

Everything here works on whole Arrow string columns at once: the UTF-8 bytes of
many documents lie in one buffer, words are found by comparing neighbouring
bytes, and hashes come from prefix sums modulo 2**64.  Work is cut into chunks
of about half a megabyte of text (never inside a document), which bounds memory
whatever the batch size is; kernels that hold many numbers for a byte take chunks of
a quarter of that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 19
#: For kernels with a dozen 8-byte temporaries for each byte of text: their peak is some 10 MB.
SMALL_BYTES = 1 << 17

_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_GRAM = U64(0xC2B2AE3D27D4EB4F)

#: ASCII lower-casing of single bytes; bytes of multi-byte characters stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)

_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(n + n // 4 + 4096, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of a hash may be used alone."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Digits, a-z and every byte of a non-ASCII character (text already lower-cased).
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Everything but space, tab, line feed, vertical tab, form feed, carriage return.
NON_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for each chunk of whole rows; null is empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        stop = min(stop, n)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


class Words:
    """Words of one chunk: byte spans, row of each, and where each row's words begin."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        n = len(buf)
        self.rows = len(offsets) - 1
        flag = np.zeros(n + 1, dtype=bool)
        flag[:n] = inside
        before = np.zeros(n + 1, dtype=bool)
        before[1:] = flag[:-1]
        border = offsets[(offsets >= 0) & (offsets <= n)]
        cut = before.copy()
        cut[border] = False
        starts = np.flatnonzero(flag & ~cut)
        after = flag.copy()
        after[border] = False
        # a word ends at i when byte i-1 is inside and byte i (same row) is not
        self.start = starts
        self.stop = np.flatnonzero(before & ~after)
        self.row = np.searchsorted(offsets, starts, "right") - 1
        self.first = np.searchsorted(starts, offsets, "left")

    def __len__(self) -> int:
        return len(self.start)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers before each byte: what span_hashes() needs of ``values``."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[values] * _power(_BASE, len(values)), out=total[1:])
    return total


def span_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of byte spans; ``total`` is prefix_sums(values), for callers that hash several spans of one buffer."""
    if total is None:
        total = prefix_sums(values)
    h = (total[stop] - total[start]) * _power(_INVERSE, len(values) + 1)[start]
    return mix(h ^ ((stop - start).astype(np.uint64) * _GRAM))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbouring word hashes (row borders are the caller's)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = h * _GRAM + words[j : j + n]
    return mix(h + U64(k))


def add_binary_sums(df, dtype: str, partitions: int = 16):
    """Adds up rows (chunk int, data binary) of equal-length arrays by chunk.

    Each task adds as it reads, so memory is one array per chunk, however many
    tasks wrote parts.  The result has one row a chunk.
    """

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, d in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(d.as_buffer(), dtype=dtype)
                if c in total:
                    total[c] += part
                else:
                    total[c] = part.copy()
        for c, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["chunk", "data"])

    return df.repartition(partitions, "chunk").mapInArrow(add, "chunk int, data binary")


def collect_sums(df, dtype: str, size: int, chunks: int) -> np.ndarray:
    """The summed array on the driver; its size is fixed by the caller, not by the data."""
    total = np.zeros(size, dtype=dtype)
    width = size // chunks
    for r in add_binary_sums(df, dtype, min(chunks, 16)).collect():
        total[r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(r["data"], dtype=dtype)
    return total


def emit_parts(total: np.ndarray, chunks: int) -> Iterator[pa.RecordBatch]:
    """One task's array as chunk rows for collect_sums()."""
    for c, part in enumerate(np.split(total, chunks)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["chunk", "data"])
