"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and split into words of digits, letters and
non-ASCII characters.  Of every ``SPAN - GRAM + 1`` neighbouring word k-grams
the one with the least hash is kept as a fingerprint; two texts that share
``SPAN`` words therefore keep the same fingerprint inside the shared words.
Fingerprints of documents and test items are joined, each hit is extended by
comparing the words themselves, and runs of ``SPAN`` words or more count.  Items
shorter than ``SPAN`` words have one fingerprint, all their words; documents then
give all their grams of that length.

Plan: one pass over the documents.  A bit map of fixed size (``BITMAP_BITS``)
over the test fingerprints goes to all tasks and drops nearly all document
fingerprints before anything is shuffled; what passes is joined exactly, so
a full bit map costs time, not results.  Neither side is collected.

Defined results: a null text has no words and is never contaminated; an item
without words never occurs; repeated rows and repeated or null ids give a row
each; items with the same id count once; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import counted, materialize

SPAN = 13
GRAM = 8
BITMAP_BITS = 1 << 24
_SHIFT = np.uint64(64 - 24)

_PRINT = pa.struct([("hash", pa.int64()), ("pos", pa.int32()), ("k", pa.int32()), ("off", pa.int32()), ("words", pa.list_(pa.string()))])
_PRINT_DDL = "array<struct<hash:bigint,pos:int,k:int,off:int,words:array<string>>>"


def winnow(hashes: np.ndarray, rows: np.ndarray, width: int, k: int) -> np.ndarray:
    """Positions of the least hash (the last of equals) of each window of ``width`` grams inside one row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at = hashes[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, width):
        later = hashes[j : j + n]
        less = later <= best
        best[less] = later[less]
        at[less] = j
    inside = rows[:n] == rows[width + k - 2 : width + k - 2 + n]
    return np.unique((at + np.arange(n))[inside])


def fingerprints(buf: np.ndarray, offsets: np.ndarray, lengths: list[int], items: bool, bitmap: np.ndarray | None) -> tuple[np.ndarray, dict[int, list]]:
    """Words of each row, and for rows that have any the fingerprints that pass the bit map."""
    buf = K.LOWER[buf]
    w = K.Words(buf, offsets, K.ALNUM[buf])
    count = np.diff(w.first)
    found: dict[int, list] = {}
    if not len(w):
        return count, found
    h = K.span_hashes(buf, w.start, w.stop)
    picked = []
    grams = K.gram_hashes(h, GRAM)
    at = winnow(grams, w.row, SPAN - GRAM + 1, GRAM)
    picked.append((GRAM, SPAN - GRAM, at, grams[at]))
    for k in lengths:
        grams = K.gram_hashes(h, k)
        at = np.arange(len(grams))
        at = at[w.row[at] == w.row[at + k - 1]]
        if items:
            at = at[count[w.row[at]] == k]
        picked.append((-k, 0, at, grams[at] ^ np.uint64(0xA5A5A5A5)))
    raw = None
    for k, around, at, hashes in picked:
        if bitmap is not None:
            bit = (hashes >> _SHIFT).astype(np.int64)
            passed = (bitmap[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) != 0
            at, hashes = at[passed], hashes[passed]
        if len(at) and raw is None:
            raw = buf.tobytes()
        for p, x in zip(at.tolist(), hashes.view(np.int64).tolist()):
            r = int(w.row[p])
            low, high = max(p - around, int(w.first[r])), min(p + abs(k) + around, int(w.first[r + 1]))
            words = [raw[w.start[i] : w.stop[i]].decode("utf-8", "replace") for i in range(low, high)]
            found.setdefault(r, []).append({"hash": x, "pos": p - int(w.first[r]), "k": k, "off": p - low, "words": words})
    return count, found


def _print_rows(df: DataFrame, lengths: list[int], items: bool, bitmap: np.ndarray | None) -> DataFrame:
    """(rid, id, n_words, prints) of (rid, id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, buf, offsets in K.text_chunks(batch.column(2), K.SMALL_BYTES):
                count, found = fingerprints(buf, offsets, lengths, items, bitmap)
                prints = pa.array([found.get(r, []) for r in range(high - low)], pa.list_(_PRINT))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(count, pa.int64()), prints], ["rid", "id", "n_words", "prints"])

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"rid bigint, id {kind}, n_words bigint, prints {_PRINT_DDL}")


def _item_lengths(items: DataFrame) -> list[int]:
    """The distinct word counts below SPAN: at most SPAN - 1 numbers."""

    def run(batches):
        for batch in batches:
            seen: set[int] = set()
            for _, _, buf, offsets in K.text_chunks(batch.column(0)):
                buf = K.LOWER[buf]
                seen |= set(np.diff(K.Words(buf, offsets, K.ALNUM[buf]).first).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(sorted(x for x in seen if 0 < x < SPAN), pa.int32())], ["n"])

    return sorted(r["n"] for r in items.select("text").mapInArrow(run, "n int").distinct().collect())


def _bitmap(prints: DataFrame) -> np.ndarray:
    """Bits of all test fingerprints: at most BITMAP_BITS / 64 rows come to the driver."""
    bit = F.shiftrightunsigned("hash", int(_SHIFT))
    words = prints.select(F.shiftright(bit, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {int(_SHIFT)}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    bitmap = np.zeros(BITMAP_BITS // 64, dtype=np.uint64)
    for r in words.collect():
        bitmap[r["w"]] = np.uint64(r["b"] & (2**64 - 1))
    return bitmap


def _extended(pairs: DataFrame) -> DataFrame:
    """Spans (rid, item, start, stop) of shared runs that are long enough."""

    def run(batches):
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            out = ([], [], [], [])
            for rid, pos, off, words, item, k, item_off, item_words in zip(*cols):
                size = abs(k)
                if words[off : off + size] != item_words[item_off : item_off + size]:
                    continue
                left = right = 0
                if k > 0:
                    while left < min(off, item_off) and words[off - left - 1] == item_words[item_off - left - 1]:
                        left += 1
                    while off + size + right < len(words) and item_off + size + right < len(item_words) and words[off + size + right] == item_words[item_off + size + right]:
                        right += 1
                    if left + size + right < SPAN:
                        continue
                for o, v in zip(out, (rid, item, pos - left, pos + size + right)):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], ["rid", "item", "start", "stop"])

    return pairs.select("rid", "pos", "off", "words", "item", "k", "item_off", "item_words").mapInArrow(run, "rid bigint, item string, start int, stop int")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items (sorted strings), contaminated."""
    items = items.select(F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("id"), F.col(item_text_col).cast("string").alias("text"))
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    lengths = _item_lengths(items)
    tests = materialize(_print_rows(items, lengths, True, None).select(F.col("id").alias("item"), F.explode("prints").alias("p")).select("item", F.col("p.hash").alias("hash"), F.col("p.k").alias("k"), F.col("p.off").alias("item_off"), F.col("p.words").alias("item_words")).distinct())
    base = materialize(_print_rows(docs, lengths, False, _bitmap(tests)))
    mine = base.select("rid", F.explode("prints").alias("p")).select("rid", *(F.col(f"p.{c}").alias(c) for c in ("hash", "pos", "off", "words")))
    spans = _extended(mine.join(tests, "hash"))
    hits = spans.groupBy("rid").agg(F.collect_set(F.struct("start", "stop")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["stop"] - 1)))))
    out = base.select("rid", "id", "n_words").join(hits.select("rid", covered.cast("long").alias("n_hit"), "items"), "rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    names = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), names.alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated documents; columns as they were.

    Documents are found again by id and text, so a row with another text under
    the same or a null id stays.
    """
    keyed = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).alias("text"))
    bad = counted(contamination(keyed.select(F.struct("id", "h").alias("key"), "text"), items, "key", "text").where("contaminated").select(F.col("key.id").alias("_bad_id"), F.col("key.h").alias("_bad_h")).distinct())
    here = (F.coalesce(docs[id_col].cast("string"), F.lit("null")) == bad["_bad_id"]) & (F.xxhash64(docs[text_col].cast("string")) == bad["_bad_h"])
    return docs.join(bad, here, "left_anti")
