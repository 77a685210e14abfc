"""N-gram Jaccard self-join by grouped prefixes, and the groups of linked documents.

A document is the set of its distinct word 5-grams (64-bit hashes; a text of
fewer words is one gram).  Two documents link when 100 * |x & y| >= 80 * |x | y|.

1. Equal sets collapse into one *class*; nothing is ever paired inside a class.
2. All grams are put in one order, common ones last (common by a count sketch
   of fixed size over all documents), then by hash.  Linked sets share a gram
   among their first n // 5 + 1.  Classes with the same prefix and size are one
   *group* (a hash names it), and only groups' prefix grams are shuffled.
3. Grams in the prefixes of several groups give posting lists of those members that
   could link with another by the size and position filters; lists are then expanded
   to the groups' classes.
4. Round one compares each member of a list with the list's most central class
   only, which is linear in the list, and links are contracted to components.
   Round two compares the members that are still apart, in pairs of blocks of at most
   256 members, so a long list is dealt over many tasks.  In both rounds a parity filter
   comes before sets are fetched: the Hamming distance of parity vectors never exceeds the symmetric
   difference.  All filters are exact, so no link is lost, and no pair inside a
   component is made.
5. Pairs are verified on whole sets, which are made again for these classes only.
   Components come from hooking and halving trees of parents; all tables stay
   distributed.

Defined results: null and empty texts (no words) have no grams, link with
nothing and are their own component; repeated rows share a class; a component
takes the least non-null id of its rows (null where all are null); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import column, counted, discard, fresh, materialize

SHINGLE = 5
SKETCH_BITS = 20
_SKETCH_CHUNKS = 16
FILTER_BITS = 24
PARITY_WORDS = 16
#: Members of a list that are compared in one task: longer lists are dealt by pairs of blocks of this size.
_BLOCK = 256
#: Parts that the lists of very common grams, and the totals of any list, are dealt by.
PARTS = 64
#: Rank (see _ranks) from which a gram's list is dealt by parts: 64 times the mean count of a sketch bucket.
COMMON_RANK = 6
#: Texts that a task remembers so as not to send their sets again.
_SEEN = 1 << 16


def linked(n_x, n_y, overlap):
    """|x & y| * 9 >= 4 * (|x| + |y|), which is 100 * |x & y| >= 80 * |x | y|."""
    return 9 * overlap >= 4 * (n_x + n_y)


def _word_grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[K.Words, np.ndarray, np.ndarray]:
    buf = K.LOWER[buf]
    w = K.Words(buf, offsets, K.NON_SPACE[buf])
    h = K.span_hashes(buf, w.start, w.stop)
    return w, h, K.gram_hashes(h, SHINGLE)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row that has words."""
    w, h, grams = _word_grams(buf, offsets)
    for r in np.flatnonzero(np.diff(w.first)).tolist():
        low, high = int(w.first[r]), int(w.first[r + 1])
        if high - low >= SHINGLE:
            s = np.sort(grams[low : high - SHINGLE + 1])
            new = np.ones(len(s), dtype=bool)
            np.not_equal(s[1:], s[:-1], out=new[1:])
            yield r, s[new]
        else:
            yield r, K.gram_hashes(h[low:high], high - low)


def _set_key(s: np.ndarray) -> tuple[int, int]:
    m = K.mix(s + np.uint64(0x5851F42D4C957F2D))
    a = np.bitwise_xor.reduce(m, keepdims=True) ^ np.uint64(len(s))
    b = np.add.reduce(m, keepdims=True) + np.bitwise_xor.reduce(s * np.uint64(0xD6E8FEB86659FD93), keepdims=True)
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def _parity(s: np.ndarray, words: int) -> np.ndarray:
    bit = ((s >> np.uint64(8)) & np.uint64(64 * words - 1)).astype(np.int64)
    odd = (np.bincount(bit, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _wide_words(n: int) -> int:
    """A power of two with two bits for each gram; vectors of neighbouring lengths fold onto each other."""
    return 1 << max(0, (n // 32 - 1).bit_length())


def _count_grams(total: np.ndarray, column: pa.Array) -> None:
    """Adds the texts' grams to the sketch ``total``."""
    for _, _, buf, offsets in K.text_chunks(column, K.SMALL_BYTES):
        w, _, grams = _word_grams(buf, offsets)
        whole = w.row[: len(grams)] == w.row[SHINGLE - 1 :]
        np.add.at(total, (grams[whole] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)


def _ranks(docs: DataFrame) -> np.ndarray:
    """How common the grams of each sketch bucket are: 0, or the power of two over twice the mean."""
    size = 1 << SKETCH_BITS

    def count(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            _count_grams(total, batch.column(0))
        yield from K.emit_parts(total, _SKETCH_CHUNKS)

    total = K.collect_sums(docs.select("text").mapInArrow(count, "chunk int, data binary"), "<i8", size, _SKETCH_CHUNKS)
    over = total / (2 * max(total.mean(), 4.0))
    return np.where(over >= 1, 1 + np.log2(np.maximum(over, 1)), 0).astype(np.uint8)


def _prefixes(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """(id, n, a, b, th, p, parity, wide, prefix): set size, set key, text hash, group, parity vectors, prefix grams.

    Of equal sets only the first in a task (of the last ``_SEEN``) carries its prefix grams and parity vectors.
    """

    def run(batches):
        seen: set = set()
        for batch in batches:
            for low, high, buf, offsets in K.text_chunks(batch.column(1), K.SMALL_BYTES):
                n, a, b, p = (np.zeros(high - low, np.int64) for _ in range(4))
                prefix: list = [None] * (high - low)
                parity: list = [None] * (high - low)
                wide: list = [None] * (high - low)
                for r, s in shingle_sets(buf, offsets):
                    key = _set_key(s)
                    n[r], (a[r], b[r]) = len(s), key
                    rank = ranks[s >> np.uint64(64 - SKETCH_BITS)]
                    size = len(s) // 5 + 1
                    first = s[np.argsort(rank, kind="stable")[:size]] if rank.any() else s[:size]
                    p[r] = (np.add.reduce(K.mix(first), keepdims=True) * np.uint64(3) + np.uint64(len(s))).view(np.int64)[0]
                    if key not in seen:
                        if len(seen) >= _SEEN:
                            seen.clear()
                        seen.add(key)
                        prefix[r] = first.tobytes()
                        parity[r] = _parity(s, PARITY_WORDS)
                        wide[r] = _parity(s, _wide_words(len(s))).tobytes()
                rows = high - low
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, rows), pa.array(n), pa.array(a), pa.array(b), batch.column(2).slice(low, rows), pa.array(p), pa.array(parity, pa.list_(pa.int64())), pa.array(wide, pa.binary()), pa.array(prefix, pa.binary())], ["id", "n", "a", "b", "th", "p", "parity", "wide", "prefix"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", "th").mapInArrow(run, f"id {kind}, n bigint, a bigint, b bigint, th bigint, p bigint, parity array<bigint>, wide binary, prefix binary")


def _whole_lists(function: Callable[[pa.Table], Iterator[pa.RecordBatch]], keys: int) -> Callable:
    """A mapInArrow function over batches sorted by their first ``keys`` columns: calls function with tables that end where a list ends."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            if held and any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(keys)):
                yield from function(pa.Table.from_batches(held))
                held = []
            if len(change):
                yield from function(pa.Table.from_batches([*held, batch.slice(0, change[-1])]))
                held = [batch.slice(change[-1])]
            else:
                held.append(batch)
        if held:
            yield from function(pa.Table.from_batches(held))

    return run


def _by_list(function: Callable[[dict], dict | None], keys: int) -> Callable:
    """As _whole_lists(), with a call for each list of two rows or more."""
    return _whole_lists(lambda rows: _called(function, rows, keys), keys)


def _called(function: Callable, rows: pa.Table, keys: int) -> Iterator[pa.RecordBatch]:
    names = rows.schema.names
    columns = {}
    for name in names:
        column = rows.column(name).combine_chunks()
        if pa.types.is_list(column.type):
            columns[name] = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        else:
            columns[name] = column.to_numpy(zero_copy_only=False)
    key = [columns[name] for name in names[:keys]]
    cuts = np.concatenate([[0], np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1, [rows.num_rows]])
    out: list[dict] = []
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if high - low > 1:
            found = function({name: c[low:high] for name, c in columns.items()})
            if found is not None:
                out.append(found)
    if out:
        yield pa.RecordBatch.from_pydict({name: np.concatenate([o[name] for o in out]) for name in out[0]})


def _could_link(n_x, pos_x, n_y, pos_y):
    """The position filter at the first common gram; it holds the size filter as well."""
    return 9 * np.minimum(n_x - pos_x, n_y - pos_y) >= 4 * (n_x + n_y)


def _partnered(n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Members of a list that pass the position filter with some other member, in n log n.

    x and y pass if n_y <= reach_x and n_x <= reach_y, reach being 9/4 * (n - pos) - n.
    """
    reach = 9 * (n - pos) - 4 * n  # four times
    order = np.argsort(n, kind="stable")
    best, second = np.full(len(n), -1), np.full(len(n), -1)
    ordered = reach[order]
    best = np.maximum.accumulate(ordered)
    holder = np.maximum.accumulate(np.where(ordered == best, np.arange(len(n)), -1))
    rest = ordered.copy()
    # the best of the others: where the best is the member itself, take the runner-up before or after it
    lead = np.concatenate([[np.iinfo(np.int64).min], best[:-1]])
    second = np.maximum.accumulate(np.minimum(lead, rest))
    upto = np.searchsorted(4 * n[order], reach, "right") - 1
    own = np.empty(len(n), dtype=np.int64)
    own[order] = np.arange(len(n))
    ok = upto >= 0
    at = np.maximum(upto, 0)
    other = np.where(holder[at] == own, second[at], best[at])
    return ok & (other >= 4 * n)


def _postings(base: DataFrame, ranks: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(gram, p, n, pos, m) of groups' prefix grams in lists of two groups or more, m being the list's length; and the table it reads.

    Lists of very common grams are dealt by parts of their groups and put together by
    counts only; all others are filtered by position at once.
    """

    def explode(batches):
        for batch in batches:
            p, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for low in range(0, len(p), 256):
                part = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)[low : low + 256]]
                size = np.array([len(x) for x in part])
                pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                gram, of = np.concatenate(part), np.repeat(p[low : low + 256], size)
                common = ranks[gram.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)] >= COMMON_RANK
                dealt = np.where(common, 1 + (K.mix(of.view(np.uint64)) % np.uint64(PARTS)).astype(np.int32), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(dealt), pa.array(of), pa.array(np.repeat(n[low : low + 256], size).astype(np.int32)), pa.array(pos.astype(np.int32))], ["gram", "part", "p", "n", "pos"])

    def shared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        c = {name: rows.column(name).to_numpy() for name in rows.schema.names}
        new = np.ones(len(c["gram"]), dtype=bool)
        new[1:] = np.any([v[1:] != v[:-1] for v in c.values()], axis=0)
        c = {k: v[new] for k, v in c.items()}
        n, pos = c["n"].astype(np.int64), c["pos"].astype(np.int64)
        change = (c["gram"][1:] != c["gram"][:-1]) | (c["part"][1:] != c["part"][:-1])
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(n)]])
        size, keep = np.diff(cuts), c["part"] > 0
        two = cuts[:-1][size == 2]
        two = two[c["part"][two] == 0]
        keep[two] = keep[two + 1] = _could_link(n[two], pos[two], n[two + 1], pos[two + 1])
        for k in np.flatnonzero(size > 2).tolist():
            at = slice(cuts[k], cuts[k + 1])
            if not keep[cuts[k]]:
                keep[at] = _partnered(n[at], pos[at])
        kept = np.repeat(np.add.reduceat(keep, cuts[:-1], dtype=np.int32), size)
        if keep.any():
            yield pa.RecordBatch.from_pydict({k: v[keep] for k, v in c.items()} | {"m": kept[keep]})

    rows = base.where("prefix is not null").select("p", "n", "prefix").mapInArrow(explode, "gram bigint, part int, p bigint, n int, pos int")
    rows = rows.repartition("gram", "part").sortWithinPartitions("gram", "part", "p", "n", "pos").mapInArrow(_whole_lists(shared, 2), "gram bigint, part int, p bigint, n int, pos int, m int")
    rows = materialize(rows)
    total = Window.partitionBy("gram")
    lengths = rows.where("part > 0").select("gram", "part", "m").distinct().select("gram", "part", F.sum("m").over(total).cast("int").alias("m")).where("m > 1")
    common = rows.where("part > 0").drop("m").join(lengths, ["gram", "part"])
    return rows.where("part = 0").select("gram", "p", "n", "pos", "m").union(common.select("gram", "p", "n", "pos", "m")), rows


def _centred(lists: DataFrame, weight: DataFrame) -> DataFrame:
    """``lists`` with ``centre``, the class of the highest weight of each list, and its ``size``; lists of one row go."""

    weighed = lists.join(weight, "cid").select("gram", "own", "cid", "n", "pos", "weight")
    parts = weighed.withColumn("part", F.pmod(F.xxhash64("cid"), F.lit(PARTS)).cast("int"))
    of_part = parts.groupBy("gram", "own", "part").agg(F.count("*").alias("rows"), F.max(F.struct("weight", (-F.col("cid")).alias("id"))).alias("top"))
    whole = Window.partitionBy("gram", "own")
    of_list = of_part.select("gram", "own", "part", F.sum("rows").over(whole).alias("size"), F.max("top").over(whole).alias("top")).where("size > 1")
    return parts.join(of_list.select("gram", "own", "part", (-F.col("top.id")).alias("centre")), ["gram", "own", "part"]).select("gram", "own", "cid", "n", "pos", "centre")


def _apart(centred: DataFrame, labels: DataFrame, parity: DataFrame) -> DataFrame:
    """(x, y): pairs of a list in different components that pass the position and parity filters; centres were compared before.

    A list is cut into blocks by hash, and each pair of its blocks is a key of
    its own, so a task compares at most two blocks at a time, however long the list is.
    """

    def compared(rows: dict, with_parity: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, pos, label = rows["n"].astype(np.int64), rows["pos"].astype(np.int64), rows["label"]
        same = rows["i"][0] == rows["j"][0]
        here = np.arange(len(n)) if same else np.flatnonzero(rows["block"] == rows["i"])
        there = here if same else np.flatnonzero(rows["block"] == rows["j"])
        for low in range(0, len(here), _BLOCK):
            x = here[low : low + _BLOCK]
            for at in range(low if same else 0, len(there), _BLOCK):
                y = there[at : at + _BLOCK]
                good = (label[x, None] != label[None, y]) & _could_link(n[x, None], pos[x, None], n[None, y], pos[None, y])
                if same and at == low:
                    good = np.triu(good, 1)
                a, b = np.nonzero(good)
                a, b = x[a], y[b]
                if with_parity and len(a):
                    far = np.zeros(len(a), dtype=np.int64)
                    for k in range(PARITY_WORDS):
                        far += np.bitwise_count((rows["parity"][a, k] ^ rows["parity"][b, k]).view(np.uint64)).astype(np.int64)
                    near = 9 * far <= n[a] + n[b]
                    a, b = a[near], b[near]
                yield a, b

    def partnered(rows: dict) -> dict | None:
        if (rows["label"] == rows["label"][0]).all():
            return None
        keep = np.zeros(len(rows["cid"]), dtype=bool)
        for a, b in compared(rows, False):
            keep[a] = keep[b] = True
        return {k: v[keep] for k, v in rows.items()} if keep.any() else None

    def pairs(rows: dict) -> dict | None:
        found = [(rows["cid"][a], rows["cid"][b]) for a, b in compared(rows, True) if len(a)]
        if not found:
            return None
        x, y = (np.concatenate(c) for c in zip(*found))
        return {"x": np.minimum(x, y), "y": np.maximum(x, y)}

    rest = centred.where("cid <> centre").join(labels.withColumnRenamed("v", "cid"), "cid", "left").select("gram", "own", "cid", "n", "pos", F.coalesce("label", "cid").alias("label"))
    # lists of several components, with their lengths
    parts = rest.withColumn("part", F.pmod(F.xxhash64("cid"), F.lit(PARTS)).cast("int"))
    of_part = parts.groupBy("gram", "own", "part").agg(F.count("*").alias("rows"), F.min("label").alias("low"), F.max("label").alias("high"))
    whole = Window.partitionBy("gram", "own")
    of_list = of_part.select("gram", "own", "part", F.sum("rows").over(whole).alias("rows"), F.min("low").over(whole).alias("low"), F.max("high").over(whole).alias("high")).where("low < high")
    rest = parts.join(of_list.select("gram", "own", "part", F.ceil(F.col("rows") / F.lit(_BLOCK)).cast("int").alias("blocks")), ["gram", "own", "part"])
    rest = rest.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["gram", "own", "i", "j"]
    rest = rest.select("gram", "own", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cid", "n", "pos", "label", "block")
    ddl = "gram bigint, own int, i int, j int, cid bigint, n int, pos int, label bigint, block int"
    rest = rest.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_by_list(partnered, 4), ddl)
    rest = rest.join(parity, "cid").select(*keys, "cid", "n", "pos", "label", "block", "parity")
    return rest.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_by_list(pairs, 4), "x bigint, y bigint").distinct()


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, n, grams) of the classes ``wanted`` (cid, a, b, th).

    Texts are read again; a bit map of fixed size over the text hashes wanted
    passes nearly only these, and the join by set key makes it exact.
    """
    mask = (1 << FILTER_BITS) - 1
    bits = wanted.select(F.expr(f"cast(th & {mask} as int)").alias("bit")).select(F.shiftright("bit", 6).alias("w"), F.expr("shiftleft(1L, bit & 63)").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))
    bitmap = np.zeros((mask + 1) // 64, dtype=np.uint64)
    for r in bits.collect():  # at most 2**18 rows
        bitmap[r["w"]] = np.uint64(r["v"] & (2**64 - 1))

    def run(batches):
        seen: set = set()  # a text that is copied gives its set once a task
        for batch in batches:
            th = batch.column(1).to_numpy()
            bit = th & mask
            passed = np.flatnonzero((bitmap[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).tolist()
            passed = [i for i in passed if th[i] not in seen and not seen.add(th[i])]
            if len(seen) >= _SEEN:
                seen.clear()
            for at in range(0, len(passed), 256):
                a, b, grams = [], [], []
                for _, _, buf, offsets in K.text_chunks(batch.column(0).take(pa.array(passed[at : at + 256])), K.SMALL_BYTES):
                    for _, s in shingle_sets(buf, offsets):
                        key = _set_key(s)
                        a.append(key[0])
                        b.append(key[1])
                        grams.append(s.view(np.int64))
                if a:
                    offsets = np.concatenate([[0], np.cumsum([len(v) for v in grams])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(grams)))], ["a", "b", "grams"])

    found = docs.select("text", "th").mapInArrow(run, "a bigint, b bigint, grams array<bigint>")
    return found.join(wanted.select("cid", "a", "b"), ["a", "b"]).dropDuplicates(["a", "b"]).select("cid", F.size("grams").alias("n"), "grams")


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(x, y) of ``pairs`` that the wide parity vectors pass."""

    def run(batches):
        for batch in batches:
            nx, ny = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (wx, wy) in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = np.frombuffer(wx.as_buffer(), np.uint64), np.frombuffer(wy.as_buffer(), np.uint64)
                size = min(len(x), len(y))
                far = np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, size)) ^ np.bitwise_xor.reduce(y.reshape(-1, size))).sum(dtype=np.int64)
                keep[i] = 9 * far <= nx[i] + ny[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(keep))

    one = classes.select(F.col("cid").alias("x"), F.col("n").alias("nx"), F.col("wide").alias("wx"))
    two = classes.select(F.col("cid").alias("y"), F.col("n").alias("ny"), F.col("wide").alias("wy"))
    return pairs.join(one, "x").join(two, "y").select("x", "y", "nx", "ny", "wx", "wy").mapInArrow(run, "x bigint, y bigint")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The linked among (x, y), on whole sets."""
    pairs = materialize(_near(pairs, classes))
    if pairs.isEmpty():
        return pairs
    in_pairs = pairs.select(F.explode(F.array("x", "y")).alias("cid")).distinct()
    sets = materialize(_sets(docs, classes.select("cid", "a", "b", "th").join(in_pairs, "cid")))
    one = sets.select(F.col("cid").alias("x"), F.col("n").alias("nx"), F.col("grams").alias("gx"))
    two = sets.select(F.col("cid").alias("y"), F.col("n").alias("ny"), F.col("grams").alias("gy"))
    both = pairs.join(one, "x").join(two, "y")
    found = materialize(both.where(linked(F.col("nx"), F.col("ny"), F.size(F.array_intersect("gx", "gy")))).select("x", "y"))
    discard(pairs, sets)
    return found


def components(links: DataFrame) -> DataFrame:
    """(v, label): the least vertex reachable, for the vertices of the links (x, y).

    Trees of parents are hooked onto the least grandparent beside them, at
    vertices and at their parents, and halved in depth each round, so rounds
    grow with the logarithm of a component's diameter.
    """
    edges = materialize(links.select("x", "y").union(links.select(F.col("y"), F.col("x"))).distinct())
    state = materialize(edges.select(F.col("x").alias("v")).distinct().select("v", F.col("v").alias("up"), F.col("v").alias("top"), F.lit(True).alias("new")))
    while True:
        beside = edges.join(state.select(F.col("v").alias("y"), "top"), "y").groupBy(F.col("x").alias("v")).agg(F.min("top").alias("beside"))
        seen = state.join(beside, "v")
        hook = seen.groupBy(F.col("up").alias("v")).agg(F.min("beside").alias("hook"))
        parents = seen.join(hook, "v", "left").select("v", "top", F.least("up", "top", "beside", F.coalesce("hook", "beside")).alias("next"))
        above = parents.select(F.col("v").alias("next"), F.col("next").alias("after"))
        last, state = state, materialize(parents.join(above, "next").select("v", F.col("next").alias("up"), F.col("after").alias("top"), ((F.col("after") != F.col("top")) | (F.col("next") != F.col("top"))).alias("new")))
        discard(last)
        if state.where("new").isEmpty():
            discard(edges)
            return state.select("v", F.col("top").alias("label"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles, component_id (as the id column)."""
    text = column(text_col).cast("string")
    docs = docs.select(column(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    ranks = _ranks(docs)
    base = materialize(_prefixes(docs, ranks))
    # classes: equal sets
    classes = base.where("n > 0").groupBy("a", "b", "n").agg(F.min("th").alias("th"), F.min("p").alias("p"), F.min("id").alias("least"), F.count("*").alias("copies"), F.max("parity").alias("parity"), F.max("wide").alias("wide"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cid"), "*"))
    # lists: classes that share a prefix gram, or a whole prefix
    posted, table = _postings(base, ranks)
    outer = posted.join(classes.select("p", "n", "cid"), ["p", "n"]).select("gram", F.lit(0).alias("own"), "cid", F.col("n").cast("int").alias("n"), "pos", "m")
    groups = classes.groupBy("p", "n").agg(F.count("*").cast("int").alias("m")).where("m > 1")
    inner = classes.join(groups, ["p", "n"]).select(F.col("p").alias("gram"), F.lit(1).alias("own"), "cid", F.col("n").cast("int").alias("n"), F.lit(0).alias("pos"), "m")
    lists = materialize(outer.union(inner))
    discard(table)

    # round one: the most central class of each list
    weight = lists.groupBy("cid").agg(F.sum("m").alias("weight")).join(classes.select("cid", "copies"), "cid").select("cid", (F.col("weight") * 8 + F.least(F.col("copies"), F.lit(7))).alias("weight"))
    centred = materialize(_centred(lists, weight))
    discard(lists)
    stars = centred.where("cid <> centre").select(F.least("cid", "centre").alias("x"), F.greatest("cid", "centre").alias("y")).distinct()
    one = classes.select(F.col("cid").alias("x"), F.col("n").alias("nx"), F.col("parity").alias("px"))
    two = classes.select(F.col("cid").alias("y"), F.col("n").alias("ny"), F.col("parity").alias("py"))
    far = sum((F.bit_count(F.col("px")[i].bitwiseXOR(F.col("py")[i])) for i in range(PARITY_WORDS)), F.lit(0))
    size = F.col("nx") + F.col("ny")
    near = (9 * F.least("nx", "ny") >= 4 * size) & (9 * far <= size)
    links = _verified(stars.join(one, "x").join(two, "y").where(near).select("x", "y"), docs, classes)
    labels = components(links)

    # round two: members still apart
    more = _verified(_apart(centred, labels, classes.select("cid", "parity")), docs, classes)
    discard(centred)
    if not more.isEmpty():
        labels = components(links.union(more))

    placed = classes.select("cid", "a", "b", "n", "least").join(labels.withColumnRenamed("v", "cid"), "cid", "left").select("a", "b", "n", "least", F.coalesce("label", "cid").alias("label"))
    least = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    known = placed.join(least, "label").select("a", "b", "n", "component_id")
    out = base.select("id", "a", "b", "n").join(known, ["a", "b", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of rows with words: that of the least non-null id; columns as they were.

    Rows that repeat the kept id count as one more copy: of these the one with
    the least text hash stays, and of rows with the same text, too, the first by the JSON form of
    all columns.  Where all ids of a component are null, one row stays by the same
    rule.  Rows without words link with nothing and all stay.
    """
    names = docs.columns
    ident, hashed, nth = (fresh(names, name) for name in ("kept_id", "kept_hash", "kept_nth"))
    h = F.xxhash64(column(text_col).cast("string"))
    key = F.struct(column(id_col).isNull().alias("unknown"), column(id_col).alias("id"), h.alias("h"))
    found = materialize(jaccard_components(docs.select(key.alias("key"), column(text_col).alias("text")), "key", "text")).where("n_shingles > 0")
    drop = counted(found.where(~F.col("key").eqNullSafe(F.col("component_id"))).select(F.col("key.id").alias(ident), F.col("key.h").alias(hashed)).distinct())
    left = docs.join(drop, column(id_col).eqNullSafe(drop[ident]) & (h == drop[hashed]), "left_anti")
    again = found.where(F.col("key").eqNullSafe(F.col("component_id"))).groupBy("key").count().where("count > 1").select(F.col("key.id").alias(ident), F.col("key.h").alias(hashed))
    again = counted(again)
    same = column(id_col).eqNullSafe(again[ident]) & (h == again[hashed])
    number = Window.partitionBy(column(id_col), h).orderBy(F.to_json(F.struct(*map(column, names))))
    single, double = left.join(again, same, "left_anti"), left.join(again, same, "left_semi")
    first = double.select(*map(column, names), F.row_number().over(number).alias(nth)).where(column(nth) == 1)
    return single.select(*map(column, names)).union(first.select(*map(column, names)))
