"""Exact top-k inner-product search by columnar branch and bound.

Vectors become integers, floor(scale * x).  Candidates are packed once into
blocks of bounded size where they lie, without a shuffle, and written.  Queries go
round in passes of at most ``PASS_NUMBERS`` numbers, which every task holds.  In a block the
candidates lie in vertical layout (one array per dimension,
largest norms first).  Scores are accumulated for a block of dimensions at a
time; after each, a candidate stays only if its partial score plus the product of the
remaining norms (Cauchy-Schwarz) can reach the query's floor, and the survivors are compacted.

The floor is the k-th best score known: of the blocks a task has read so far, and of a first round
over one block in ``FIRST`` (all tasks' blocks put together).  A second round over the other
blocks therefore sends about ``FIRST`` * k candidates a query, however many tasks there
are.  The best k of both rounds are the answer; ties go to the smaller id everywhere, so it is exact.

Defined results: vectors that are null or hold a null or non-finite component
take no part, nor do null ids; missing dimensions of shorter vectors count as
0; a candidate with the query's id is its own row; ids that repeat are
candidates once a row and queries once a row; scores beyond 64 bits are
clipped; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, discard, materialize

CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 1024
DIM_BLOCK = 16
#: One block in so many is searched first.
FIRST = 16
#: Numbers of query vectors that go to all tasks at once, about: 16 MB.
PASS_NUMBERS = 2 << 20
#: Sums below this are exact in doubles.
_EXACT = float(1 << 53)


def _pack(df: DataFrame, size: int) -> DataFrame:
    """Blocks (ids, rows, dims, data) of (id, row, v), of rows of one partition each."""

    def block(rows: list) -> pa.RecordBatch:
        dims = max(len(v) for _, _, v in rows)
        m = np.zeros((len(rows), dims))
        for i, (_, _, v) in enumerate(rows):
            m[i, : len(v)] = v
        return pa.RecordBatch.from_arrays([pa.array([np.array([r[c] for r in rows], np.int64).tobytes()]) for c in (0, 1)] + [pa.array([dims], pa.int32()), pa.array([m.tobytes()])], ["ids", "rows", "dims", "data"])

    def run(batches):
        held: list = []
        for batch in batches:
            offsets, values = np.asarray(batch.column(2).offsets), np.asarray(batch.column(2).values)
            for i, (ident, row) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                held.append((ident, row, values[offsets[i] : offsets[i + 1]].copy()))
                if len(held) == size:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    return df.select("id", "row", "v").mapInArrow(run, "ids binary, rows binary, dims int, data binary")


def _unpacked(ids, dims, data) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(data, np.float64).reshape(len(ids), dims)


def _tail_norms(m: np.ndarray, cuts: range) -> np.ndarray:
    """Norms of the dimensions from each cut on: shape (cuts + 1, vectors)."""
    parts = np.array([(m[:, c : c + DIM_BLOCK] ** 2).sum(axis=1) for c in cuts] + [np.zeros(len(m))])
    return np.sqrt(parts[::-1].cumsum(axis=0)[::-1]) * (1 + 1e-12)


def best_of_cell(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query index, candidate ids, scores) of the k best candidates of each query, by score and then id; those below its floor may be left out."""
    dims = max(q.shape[1], x.shape[1], 1)
    q, x = (np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in (q, x))
    out = []
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * dims >= _EXACT:
        whole = [[int(v) for v in row] for row in x]
        for i in range(len(q)):
            a = [int(v) for v in q[i]]
            scores = np.array([max(-(2**63), min(2**63 - 1, sum(s * t for s, t in zip(a, b)))) for b in whole], dtype=np.int64)
            out.append((i, *_first(ids, scores, np.flatnonzero(ids != qids[i]), k)))
        return out
    order = np.argsort(-(x**2).sum(axis=1), kind="stable")
    ids, x = ids[order], x[order]
    columns = np.ascontiguousarray(x.T)
    cuts = range(0, dims, DIM_BLOCK)
    xs, qs = _tail_norms(x, cuts), _tail_norms(q, cuts)
    lead = min(len(ids), 8 * k)
    for low in range(0, len(q), 128):
        tile = q[low : low + 128]
        ahead = tile @ columns[:, :lead]
        partial = tile[:, :DIM_BLOCK] @ columns[:DIM_BLOCK]
        for t in range(len(tile)):
            i = low + t
            mine = ids[:lead] != qids[i]
            known = ahead[t][mine]
            floor = np.partition(known, len(known) - k)[len(known) - k] if len(known) >= k else -math.inf
            if floors is not None:
                floor = max(floor, floors[i])
            alive = np.flatnonzero((partial[t] + qs[1, i] * xs[1] >= floor - 0.5) & (ids != qids[i]))
            score = partial[t][alive]
            for b, c in enumerate(cuts[1:], start=1):
                score = score + q[i, c : c + DIM_BLOCK] @ columns[c : c + DIM_BLOCK, alive]
                stays = score + qs[b + 1, i] * xs[b + 1][alive] >= floor - 0.5
                alive, score = alive[stays], score[stays]
            full = np.zeros(len(ids), dtype=np.int64)
            full[alive] = np.rint(score).astype(np.int64)
            out.append((i, *_first(ids, full, alive, k)))
    return out


def _first(ids: np.ndarray, scores: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    at = at[np.lexsort((ids[at], -scores[at].astype(object) if len(at) and scores[at].min() == -(2**63) else -scores[at]))][:k]
    return ids[at], scores[at]


class _Best:
    """The k best of each query so far, over the blocks of a task."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int, floors: np.ndarray):
        self.qids, self.q, self.k, self.floors = qids, q, k, floors.copy()
        self.found: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(qids)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        for i, new_ids, new in best_of_cell(self.qids, self.q, ids, x, self.k, self.floors):
            if len(new) and new[0] >= self.floors[i]:
                ids_i, scores = (np.concatenate(c) for c in zip(self.found[i], (new_ids, new)))
                self.found[i] = ids_i, scores = _first(ids_i, scores, np.arange(len(ids_i)), self.k)
                if len(scores) == self.k:
                    self.floors[i] = max(self.floors[i], float(scores[-1]))

    def rows(self, numbers: np.ndarray, floors: np.ndarray) -> pa.RecordBatch:
        kept = [(ids[s >= f], s[s >= f]) for (ids, s), f in zip(self.found, floors)]
        size = [len(ids) for ids, _ in kept]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, size)), pa.array(np.repeat(self.qids, size)), pa.array(np.concatenate([c[0] for c in kept])), pa.array(np.concatenate([c[1] for c in kept]))], ["row", "query_id", "vec_id", "score"])


def _searched(blocks: DataFrame, asked: list, k: int, floors: dict[int, int]) -> DataFrame:
    """(row, query_id, vec_id, score): each task's k best of its blocks for the queries ``asked``, floors or more."""

    def run(batches):
        queries = [(*_unpacked(ids, dims, data), np.frombuffer(rows, np.int64)) for ids, rows, dims, data in asked]
        given = [np.array([floors.get(r, -math.inf) for r in rows.tolist()]) for _, _, rows in queries]
        best = [_Best(ids, q, k, f) for (ids, q, _), f in zip(queries, given)]
        for batch in batches:
            for ids, dims, data in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                ids, x = _unpacked(ids.as_buffer(), dims, data.as_buffer())
                for b in best:
                    b.add(ids, x)
        for b, (_, _, rows), f in zip(best, queries, given):
            yield b.rows(rows, f)

    return blocks.select("ids", "dims", "data").mapInArrow(run, "row bigint, query_id bigint, vec_id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("row", "query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of ``vectors`` with the highest scores for each row of ``queries``."""

    def usable(df: DataFrame) -> DataFrame:
        v = column(vector_col).cast("array<double>")
        good = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < F.lit(math.inf))), F.lit(False))
        # rint stays a double where floor would become a long and overflow
        whole = F.transform(v, lambda c: F.rint(c * scale) - F.when(F.rint(c * scale) > c * scale, 1.0).otherwise(0.0))
        return df.select(column(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), whole.alias("v"), good.alias("good")).where("id is not null and good")

    turn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(FIRST))
    blocks = materialize(_pack(usable(vectors), CANDIDATE_BLOCK).withColumn("turn", turn))
    asked = materialize(usable(queries))
    numbers = asked.agg(F.sum(F.size("v"))).first()[0] or 0
    passes = math.ceil(numbers / PASS_NUMBERS) or 1
    asked = materialize(_pack(asked.repartition(passes), QUERY_BLOCK).withColumn("pass", F.spark_partition_id()))
    found = None
    for p in range(passes):
        mine = [(bytes(r["ids"]), bytes(r["rows"]), r["dims"], bytes(r["data"])) for r in asked.where(F.col("pass") == p).collect()]  # PASS_NUMBERS numbers, about
        first = materialize(_ranked(_searched(blocks.where("turn = 0"), mine, k, {}), k))
        floors = {r["row"]: r["score"] for r in first.where(F.col("rank") == k).select("row", "score").collect()}  # a row per query of the pass
        rest = _searched(blocks.where("turn > 0"), mine, k, floors)
        part = materialize(_ranked(rest.union(first.drop("rank")), k))
        discard(first)
        found = part if found is None else found.union(part)
    return found.select("query_id", "rank", "vec_id", "score")
