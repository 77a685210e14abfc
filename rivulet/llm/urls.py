"""URL filtering: a blocked Bloom filter in front of an exact hash join.

A rule is (host, path, verdict); it fits its host and all subdomains if the
url's path starts with the rule's.  Rules are listed under canonical keys,
host (A-Z lower-cased) followed by path.  One pass over the pages looks up the
host endings (of at most as many labels as a rule has) in a blocked Bloom
filter of fixed size (each key sets its bits within one 512-bit block); only for those that
pass are the path beginnings of the lengths that rules have looked up as canonical keys, as
hashes of spans of the url's bytes.  What passes becomes a string and is
joined exactly with the rules, which removes false positives.  Of the rules that
fit, the one with the longest key wins.

Defined results: a null url or one without ``://`` has an empty host and path
and fits only a rule with an empty host and path; pages without a rule are
allowed; a key listed with both verdicts blocks; repeated pages give a row
each; an empty page table gives an empty result, an empty rule table allows
everything; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import column, counted, materialize

#: 2**15 blocks of 512 bits: 2 MB, whatever the number of rules.
BLOCK_BITS = 15
PROBES = 6

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Hosts and whole keys are told apart by what is added to their hashes.
_HOST, _KEY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0)
_DOT = ord(".")


def _probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bit) arrays of shape (hashes, PROBES)."""
    block = (h >> np.uint64(64 - BLOCK_BITS)).astype(np.int64)
    inner = K.mix(h)[:, None] >> np.arange(0, 9 * PROBES, 9, dtype=np.uint64) & np.uint64(511)
    return block[:, None] * 8 + (inner >> np.uint64(6)).astype(np.int64), inner & np.uint64(63)


def _listed(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    word, bit = _probes(h)
    return ((bits[word] >> bit) & np.uint64(1)).astype(bool).all(axis=1)


def _hashes(keys: pa.Array, kind: np.uint64) -> Iterator[np.ndarray]:
    for _, _, buf, offsets in K.text_chunks(keys):
        yield K.mix(K.span_hashes(buf, offsets[:-1], offsets[1:]) + kind)


def bloom_filter(rules: DataFrame) -> np.ndarray:
    """The filter over the columns ``host`` and ``key``: at most 2**18 words come to the driver."""

    def run(batches):
        for batch in batches:
            for i, kind in enumerate((_HOST, _KEY)):
                for h in _hashes(batch.column(i), kind):
                    word, bit = _probes(h)
                    yield pa.RecordBatch.from_arrays([pa.array(word.ravel().astype(np.int32)), pa.array((np.uint64(1) << bit).ravel().view(np.int64))], ["word", "bits"])

    found = rules.select("host", "key").mapInArrow(run, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bits = np.zeros(8 << BLOCK_BITS, dtype=np.uint64)
    for r in found.collect():
        bits[r["word"]] = np.uint64(r["bits"] & (2**64 - 1))
    return bits


def _passed(pages: DataFrame, bits: np.ndarray, labels: int, lengths: np.ndarray) -> DataFrame:
    """``pages`` (rid, id, host, path) with ``keys``: those canonical keys that the filter passes.

    lengths: of the rules' paths in bytes, rising.
    """

    def endings(host: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, first byte) of each host's endings of 1 to ``labels`` labels."""
        rows = np.arange(len(offsets) - 1)
        dot = np.flatnonzero(host == _DOT)
        row = np.searchsorted(offsets, dot, "right") - 1
        after = np.searchsorted(dot, offsets[1:])[row] - np.arange(len(dot))  # dots of the row from this one on
        near = after <= labels
        whole = np.diff(np.searchsorted(dot, offsets)) < labels
        return np.concatenate([row[near], rows[whole]]), np.concatenate([dot[near] + 1, offsets[:-1][whole]])

    def run(batches):
        for batch in batches:
            whole = pc.binary_join_element_wise(batch.column(2), batch.column(3), "")
            size = pc.binary_length(batch.column(2)).to_numpy()
            out: list[list[str]] = []
            for low, high, buf, offsets in K.text_chunks(whole):
                end = offsets[:-1] + size[low:high]
                within = np.repeat(np.arange(high - low), np.diff(offsets))
                hosts = buf[np.arange(len(buf)) < end[within]] if len(buf) else buf
                host_offsets = np.concatenate([[0], np.cumsum(size[low:high])]).astype(np.int64)
                row, start = endings(hosts, host_offsets)
                start = start - host_offsets[row] + offsets[row]
                total = K.prefix_sums(buf)
                ok = _listed(bits, K.mix(K.span_hashes(buf, start, end[row], total) + _HOST))
                row, start = row[ok], start[ok]
                keys: list[list[str]] = [[] for _ in range(high - low)]
                raw = buf.tobytes()
                for at in range(0, len(row), 4096):
                    r, s = row[at : at + 4096], start[at : at + 4096]
                    stop = end[r][:, None] + lengths[None, :]
                    i, j = np.nonzero(stop <= offsets[r + 1][:, None])
                    ok = _listed(bits, K.mix(K.span_hashes(buf, s[i], stop[i, j], total) + _KEY))
                    for a, b in zip(i[ok].tolist(), j[ok].tolist()):
                        keys[r[a]].append(raw[s[a] : stop[a, b]].decode("utf-8", "ignore"))
                out += keys
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.string()))], [*batch.schema.names, "keys"])

    kind = pages.schema["id"].dataType.simpleString()
    return pages.mapInArrow(run, f"rid bigint, id {kind}, host string, path string, keys array<string>")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule (or null), verdict.  ``rules`` has host, path, verdict."""
    listed = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWERED).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    listed = listed.select("host", F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.octet_length("path").alias("n"), "verdict")
    shape = listed.agg(F.max("labels").alias("labels"), F.array_sort(F.collect_set("n")).alias("lengths")).first()
    bits = bloom_filter(listed)
    listed = counted(listed.groupBy("key").agg(F.max("verdict").alias("rule_verdict")))  # 'block' comes after 'allow'

    url = F.coalesce(column(url_col).cast("string"), F.lit(""))
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    parts = pages.select(F.monotonically_increasing_id().alias("rid"), column(id_col).alias("id"), F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWERED).alias("host"), F.regexp_extract(url, pattern, 2).alias("path"))
    # pages are read once; what has hits is a part of this table
    parts = materialize(_passed(parts, bits, shape["labels"] or 1, np.array(shape["lengths"] or [0], dtype=np.int64)))

    clear = parts.where(F.size("keys") == 0).select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    likely = parts.where(F.size("keys") > 0).select("rid", "id", "host", "path", F.explode("keys").alias("key"))
    best = F.max(F.when(F.col("rule_verdict").isNotNull(), F.struct(F.length("key").alias("n"), F.col("key").alias("rule"), F.col("rule_verdict").alias("verdict"))))
    hits = likely.join(listed, "key", "left").groupBy("rid", "id", "host", "path").agg(best.alias("best"))
    hits = hits.select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
    return clear.union(hits).withColumnRenamed("id", id_col)
