"""Retrieval: dense and sparse search, boosts, fusion, reranking and chunk merging.

Queries are broadcast only behind a check of their size: beyond ``QUERY_BYTES``
term joins shuffle, and dense search goes in passes.  Per-query top-k is
``row_number() <= k``, which Spark prunes before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .state import fixed

#: Fixed values of the search: per-branch limits, decay scale (90 days) and weights.
DENSE_LIMIT, SPARSE_LIMIT, TAG_LIMIT, BRANCH_FACTOR = 100, 100, 1000, 4
DECAY_SECONDS, DECAY_WEIGHT, TAG_WEIGHT, MIDPOINT = 7_776_000, 0.3, 0.25, 0.5
#: The usual constant of reciprocal rank fusion.
RRF_CONSTANT = 60
MIN_OVERLAP, MAX_OVERLAP, MAX_GAP = 20, 500, 2
QUERY_BYTES = 8 << 20
#: Numbers of query vectors that a task holds at once: 16 MB.
QUERY_PASS = 2 << 20
#: Rows of query terms that a task holds at once, and queries that have them.
TERM_PASS, ASKED_PASS = 2 << 20, 8192
#: Pairs of rows and queries that a task scores at once: 4 MB.
BLOCK = 1 << 20
#: Pairs beyond which a search first looks for floors.
MANY_PAIRS = 1 << 26
#: Terms of queries with a dimension of their own in a sparse search, and dimensions that the others share.
OWN_TERMS, SHARED_DIMS = 192, 64
#: A word of a lower-cased text, in Java's regular expressions as in Python's.
WORD = "[0-9a-zà-ÿœß]+"
#: One row in so many gives the floors: of a dense search any, of a sparse one the longest.
DENSE_SEEDS, SPARSE_SEEDS = 4, 8


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def _small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if its plan is estimated small enough."""
    from .order import _estimate

    return F.broadcast(df) if _estimate(df) <= QUERY_BYTES else df


def ranked(df: DataFrame, k: int, per: Sequence[str], score: str = "score", tie: str = "id") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(F.desc(score), tie))).where(F.col("rank") <= k)


def _reports(best, low: int = 0):
    """What a task tells of its k best scores of each query: (query, score, more), ``more`` being the rows that reach this score and no higher one told."""
    import numpy as np
    import pyarrow as pa

    k = best.shape[1]
    ranks = [1, 2]
    while ranks[-1] < k:
        ranks.append(ranks[-1] + ranks[-2])
    ranks = np.array(sorted({min(r, k) for r in ranks}))
    for low in range(0, len(best), 4096):
        told = -np.sort(-best[low : low + 4096], axis=1)[:, ranks - 1].astype(float)
        query, more = np.repeat(np.arange(low, low + len(told)), len(ranks)), np.tile(np.diff(ranks, prepend=0), len(told))
        known = np.isfinite(told.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(query[known]), pa.array(told.ravel()[known]), pa.array(more[known])], ["query", "score", "more"])


def _seen(best, low: int, scores) -> None:
    """Puts the scores (rows by queries, from query ``low`` on) among the k best of each query."""
    import numpy as np

    mine, k = best[low : low + scores.shape[1]], best.shape[1]
    all_ = np.concatenate([mine, np.nan_to_num(scores.T, nan=-np.inf)], axis=1)
    mine[:] = np.partition(all_, all_.shape[1] - k, axis=1)[:, -k:]


def _floors(reports: DataFrame, n: int, k: int):
    """A score of each of n queries that k rows are known to reach; -inf if there is none."""
    import numpy as np

    told = Window.partitionBy("query").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    found = reports.withColumn("reached", F.sum("more").over(told)).where(F.col("reached") >= k).groupBy("query").agg(F.max("score").alias("score")).toArrow()  # a row per query of the pass
    out = np.full(n, -np.inf)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def _local_floors(floor, scores, k: int | None):
    """``floor``, and where it is -inf the k-th best of these scores (rows by queries)."""
    import numpy as np

    bare = np.isneginf(floor)
    if k is None or len(scores) <= k or not bare.any():
        return floor
    out = floor.copy()
    out[bare] = np.partition(np.nan_to_num(scores[:, bare], nan=-np.inf), len(scores) - k, axis=0)[len(scores) - k]
    return out


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int | None, digits: int = 9, threshold: float | None = None) -> DataFrame:
    """(query_id, id, score, rank) by cosine similarity.  vectors: id, vector, ...; queries: query_id, query_vector.

    With ``k=None`` every hit of the threshold comes, unranked: (query_id, id, score).

    Query vectors go to all tasks in passes of at most ``QUERY_PASS`` numbers,
    so their size there is bounded whatever their count.  Of large tables one row in ``DENSE_SEEDS`` is scored first: a
    score that k of these reach is a floor of the query's results.  A task multiplies matrices in single precision,
    and scores in double precision, and sends on, what comes near the floor (without one: near a block's k-th best).  This leaves no result out.
    Scores are rounded to ``digits``, so ties don't depend on the order of sums; a vector of zeros scores 0,
    and the shorter of two vectors counts as filled up with zeros.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    shape = queries.agg(F.count("*").alias("n"), F.max(F.size("query_vector")).alias("dims")).first()
    passes = max(1, math.ceil((shape["n"] or 0) * max(shape["dims"] or 1, 1) / QUERY_PASS))
    kinds = vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    asked_type = to_arrow_type(queries.schema["query_id"].dataType)
    usable = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    many = k is not None and (shape["n"] or 0) * vectors.count() > MANY_PAIRS
    near = 1e-5 + 10.0**-digits  # of a score of unit vectors in single precision, and of its rounding

    def unit(rows, dims):
        m = np.zeros((len(rows), dims))
        for i, r in enumerate(rows):
            m[i, : min(len(r), dims)] = r[:dims]
        length = np.array([np.linalg.norm(r) for r in rows]).reshape(-1, 1)  # of whole vectors, also those longer than all queries
        return m / np.where(length > 0, length, 1)

    def one_pass(part: DataFrame) -> DataFrame:
        rows = part.select("query_id", "query_vector").collect()  # at most QUERY_PASS numbers, about
        dims = max((len(r["query_vector"]) for r in rows), default=1)
        names, q = pa.array([r["query_id"] for r in rows], asked_type), unit([r["query_vector"] for r in rows], dims)
        n, single = len(q), q.astype("f4")

        def blocks(batches):
            """(ids, unit vectors) of at most 1,024 rows."""
            for batch in batches:
                for low in range(0, batch.num_rows, 1024):
                    some = batch.slice(low, 1024)
                    lists = some.column(1)
                    offsets, values = np.asarray(lists.offsets), np.asarray(lists.values, dtype=float)
                    if (np.diff(offsets) == dims).all():
                        x = values[offsets[0] : offsets[-1]].reshape(-1, dims)
                        length = np.sqrt(np.einsum("ij,ij->i", x, x)).reshape(-1, 1)
                        yield some.column(0), x / np.where(length > 0, length, 1)
                    else:
                        yield some.column(0), unit([values[a:b] for a, b in zip(offsets[:-1], offsets[1:])], dims)

        def scores(x):
            """(first query, scores) in single precision."""
            x, width = x.astype("f4"), max(BLOCK // max(len(x), 1), 1)
            for low in range(0, n, width):
                yield low, x @ single[low : low + width].T

        def learn(batches):
            best = np.full((n, k), -np.inf, "f4")
            for _, x in blocks(batches):
                for low, s in scores(x):
                    _seen(best, low, s)
            yield from _reports(best)

        def search(floors):
            def run(batches):
                for ids, x in blocks(batches):
                    for low, s in scores(x):
                        least = _local_floors(floors[low : low + s.shape[1]], s, k) - near
                        at, of = np.nonzero(s >= least.astype("f4"))
                        for i in range(0, len(at), 65536):
                            a, o = at[i : i + 65536], of[i : i + 65536] + low
                            exact = np.einsum("ij,ij->i", x[a], q[o])
                            if threshold is not None:
                                sure = exact >= threshold - 10.0**-digits
                                a, o, exact = a[sure], o[sure], exact[sure]
                            yield pa.RecordBatch.from_arrays([names.take(pa.array(o)), ids.take(pa.array(a)), pa.array(exact)], ["query_id", "id", "score"])

            return usable.mapInArrow(run, f"query_id {kinds[1]}, id {kinds[0]}, score double")

        floors = np.full(n, -np.inf)
        if many and n:
            floors = _floors(usable.where(F.pmod(F.xxhash64("id"), F.lit(DENSE_SEEDS)) == 0).mapInArrow(learn, "query long, score double, more long"), n, k)
        return search(floors if threshold is None else np.maximum(floors, threshold))

    parts = [one_pass(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i) if passes > 1 else queries) for i in range(passes)]
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    scored = scored.withColumn("score", F.round("score", digits))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored if k is None else ranked(scored, k, ["query_id"])


def sparse_vector(tokens: Column) -> Column:
    """{indices, values}: term frequencies under hashed term numbers, in order."""
    terms = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(1 << 31)).cast("long"))
    index = F.array_sort(F.array_distinct(terms))
    return F.struct(index.alias("indices"), F.transform(index, lambda i: F.size(F.filter(terms, lambda t: t == i)).cast("double")).alias("values"))


def sparse_rows(df: DataFrame, id_col: str, text_col: str, name: str = "id") -> DataFrame:
    """(id, term, tf): words of letters and digits, lower-cased, with their counts."""
    return df.select(F.col(id_col).alias(name), F.explode(words_of(F.col(text_col))).alias("term")).groupBy(name, "term").agg(F.count("*").alias("tf"))


def words_of(text: Column) -> Column:
    """Words of letters and digits, lower-cased, as an array."""
    return F.filter(F.split(F.lower(text), WORD.replace("[", "[^", 1)), lambda w: w != "")


def sparse_topk(documents: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): sums of products over shared terms.  documents: id, text (or terms, an array of words; or a row per term, with tf); queries: query_id, term, tf (counts).

    Query terms go to all tasks in passes of at most about ``TERM_PASS`` rows of ``ASKED_PASS`` queries.  The terms that
    weigh most in the queries have a dimension each, and the others share some, with the length of their counts as the number there.
    So the product of two such vectors is never below the score, and over the terms' own dimensions never above it: tasks
    multiply matrices, and add up exactly only the pairs that can reach the query's floor, and send on those that do.

    A floor is a score that k documents are known to reach, from the longest of each batch, one in ``SPARSE_SEEDS``.  No score exceeds
    the product of the two lengths (as vectors of counts), so documents too short for every floor are not looked at. This leaves no result out.
    """
    import re

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_type

    if "text" in documents.columns:
        documents = documents.select("id", F.lower("text").alias("body"), F.length("text").alias("size")).where("body is not null")
    else:
        if "terms" not in documents.columns:  # rows of (id, term, tf)
            documents = documents.groupBy("id").agg(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf").cast("int")))).alias("terms"))
        documents = documents.select("id", F.col("terms").alias("body"), F.size("terms").alias("size")).where("body is not null")
    kinds = documents.schema["id"].dataType, queries.schema["query_id"].dataType
    arrow = [to_arrow_type(t) for t in kinds]
    asked = queries.agg(F.count("*"), F.count_distinct("query_id")).first()
    passes = max(1, math.ceil(asked[0] / TERM_PASS), math.ceil(asked[1] / ASKED_PASS))
    word = WORD

    def words_in(body) -> tuple[np.ndarray, pa.Array]:
        """(offsets, words) of texts or of lists of words."""
        if pa.types.is_list(body.type):
            return np.asarray(body.offsets).astype(int) - body.offsets[0].as_py(), body.flatten()
        found = [re.findall(word, t) for t in body.to_pylist()]
        return np.cumsum([0, *map(len, found)]), pa.array([w for f in found for w in f], pa.string())

    def counts(offsets: np.ndarray, rows: np.ndarray, at: np.ndarray):
        """(place in ``rows``, term, times) of the words of some rows; -1 is no term."""
        size = offsets[rows + 1] - offsets[rows]
        doc = np.repeat(np.arange(len(rows)), size)
        t = at[np.repeat(offsets[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        doc, t = doc[t >= 0], t[t >= 0]
        width = int(t.max(initial=0)) + 1
        key, times = np.unique(doc * width + t, return_counts=True)
        return *np.divmod(key, width), times

    def one_pass(part: DataFrame) -> DataFrame:
        rows = part.select("query_id", "term", F.col("tf").cast("double").alias("tf")).toArrow()  # TERM_PASS rows, about
        coded = [pc.dictionary_encode(rows.column(i).combine_chunks()) for i in (0, 1)]
        names, words = (c.dictionary for c in coded)
        query, term = (c.indices.to_numpy().astype(int) for c in coded)
        tf, n, v = rows.column(2).to_numpy(), len(names), len(words)
        reach = np.maximum(np.sqrt(np.bincount(query, tf * tf, n)) * (1 + 1e-9), 1e-300)  # lengths of the queries
        place = np.empty(v, int)  # own dimensions first, then the shared ones
        by_weight = np.argsort(-np.bincount(term, (tf / reach[query]) ** 2, v), kind="stable")
        own = min(OWN_TERMS, v)
        place[by_weight] = np.where(np.arange(v) < own, np.arange(v), own + (np.arange(v) - own) % SHARED_DIMS)
        mine = place[term] < own
        key = query[~mine] * v + term[~mine]
        order = np.argsort(key)
        key, key_tf = key[order], tf[~mine][order]
        whole = bool((tf == np.rint(tf)).all())
        asked_own = np.bincount(query[mine] * own + place[term[mine]], tf[mine], n * own).reshape(n, own).astype("f4" if whole else "f8")
        asked_shared = np.sqrt(np.bincount(query[~mine] * SHARED_DIMS + place[term[~mine]] - own, tf[~mine] ** 2, n * SHARED_DIMS)).reshape(n, SHARED_DIMS).astype("f4")
        asked_both = np.hstack([asked_own.astype("f4"), asked_shared])

        def blocks(batches, able, choose):
            """(ids, places of the documents, document, term, times, lengths) of at most 1,024 documents that ``able`` and ``choose`` leave."""
            for batch in batches:
                total, batch = batch.num_rows, able(batch)
                if not batch.num_rows:
                    continue
                offsets, flat = words_in(batch.column(1))
                at = pc.index_in(flat, value_set=words).fill_null(-1).to_numpy()
                parts = []
                for low in range(0, batch.num_rows, 1024):
                    rows = np.arange(low, min(low + 1024, batch.num_rows))
                    doc, t, times = counts(offsets, rows, at)
                    parts.append((rows, doc, t, times, np.sqrt(np.bincount(doc, times.astype(float) ** 2, len(rows)))))
                for (rows, doc, t, times, length), stay in zip(parts, choose([p[-1] for p in parts], total)):
                    if stay.any():
                        to, held = np.cumsum(stay) - 1, stay[doc]
                        yield batch.column(0), rows[stay], to[doc[held]], t[held], times[held], length[stay]

        def vectors(size: int, doc, t, times, longest: float):
            """(numbers of own terms, of shared dimensions)."""
            kind = "f4" if whole and longest * reach.max() < 2**24 else "f8"  # whole numbers below that are exact in single precision
            at = place[t]
            mine = at < own
            x = np.zeros((size, own), kind)
            x[doc[mine], at[mine]] = times[mine]
            return x, np.sqrt(np.bincount(doc[~mine] * SHARED_DIMS + at[~mine] - own, times[~mine].astype(float) ** 2, size * SHARED_DIMS)).reshape(size, SHARED_DIMS).astype("f4")

        def longest(lengths, total):
            every = np.sort(np.concatenate(lengths))
            least = every[-min(math.ceil(total / SPARSE_SEEDS), len(every))]
            return [x >= max(least, 1e-9) for x in lengths]

        def large(batch):
            sizes = np.sort(batch.column(2).to_numpy())
            return batch.filter(pc.greater_equal(batch.column(2), int(sizes[-math.ceil(len(sizes) / SPARSE_SEEDS)]))) if len(sizes) else batch

        def learn(batches):
            best = np.full((n, k), -np.inf, "f4")
            for _, rows, doc, t, times, length in blocks(batches, large, longest):
                x, _ = vectors(len(rows), doc, t, times, length.max())
                width = max(BLOCK // len(x), 1)
                for low in range(0, n, width):
                    s = x @ asked_own[low : low + width].astype(x.dtype, copy=False).T
                    _seen(best, low, np.where(s > 0, s, -np.inf))
            yield from _reports(best)

        def search(floors: np.ndarray):
            """Scores the documents that can reach the floor of a query."""
            needed = float((floors / reach).min(initial=np.inf))
            least = np.maximum(floors * (1 - 1e-5), 1e-30)

            def able(batch):
                # a text of so many letters has at most half as many words, and a length of at most its number of words
                each = 2 if pa.types.is_string(batch.column(1).type) else 1
                return batch.filter(pc.greater_equal(pc.add(batch.column(2), each - 1), max(each * needed, 1.0))) if needed < np.inf else batch.slice(0, 0)

            def exact(d, q, doc, t, times):
                """Sums over the terms without own dimensions, for some pairs."""
                rest = place[t] >= own
                doc, t, times = doc[rest], t[rest], times[rest]
                first = np.searchsorted(doc, np.arange(d.max(initial=0) + 2))
                size = first[d + 1] - first[d]
                pair = np.repeat(np.arange(len(d)), size)
                at = np.repeat(first[d] - np.cumsum(size) + size, size) + np.arange(size.sum())
                wanted = q[pair] * v + t[at]
                found = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
                hit = np.flatnonzero(key[found] == wanted) if len(key) else np.zeros(0, int)
                return np.bincount(pair[hit], times[at[hit]] * key_tf[found[hit]], len(d))

            def run(batches):
                for ids, rows, doc, t, times, length in blocks(batches, able, lambda lengths, _: [x >= max(needed, 1e-9) for x in lengths]):
                    x, shared = vectors(len(rows), doc, t, times, length.max())
                    width = max(BLOCK // len(x), 1)
                    both = np.hstack([x.astype("f4", copy=False), shared])
                    for low in range(0, n, width):
                        bound = both @ asked_both[low : low + width].T
                        floor = least[low : low + width]
                        if np.isneginf(floors[low : low + width]).any():
                            s = x @ asked_own[low : low + width].astype(x.dtype, copy=False).T
                            floor = np.maximum(_local_floors(floors[low : low + width], s, k) * (1 - 1e-5), floor)
                        at = np.flatnonzero(bound >= (floor * (1 - 1e-5)).astype("f4"))
                        d, q = np.divmod(at, bound.shape[1])
                        for i in range(0, len(d), 16384):
                            a, o = d[i : i + 16384], q[i : i + 16384]
                            score = np.einsum("ij,ij->i", x[a], asked_own[o + low]) + exact(a, o + low, doc, t, times)
                            stay = score >= floor[o]
                            yield pa.RecordBatch.from_arrays([names.take(pa.array(o[stay] + low)).cast(arrow[1]), ids.take(pa.array(rows[a[stay]])).cast(arrow[0]), pa.array(score[stay])], ["query_id", "id", "score"])

            return documents.mapInArrow(run, f"query_id {kinds[1].simpleString()}, id {kinds[0].simpleString()}, score double")

        floors = np.full(n, -np.inf)
        if n:
            floors = _floors(documents.select("id", "body", "size").mapInArrow(learn, "query long, score double, more long"), n, k)
        return search(floors)

    scored = None
    for i in range(passes):
        part = one_pass(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i) if passes > 1 else queries)
        scored = part if scored is None else scored.unionByName(part)
    return ranked(scored, k, ["query_id"])


# -- scoring -----------------------------------------------------------------------


def exp_decay(seconds_away: Column, scale: float, midpoint: float = MIDPOINT) -> Column:
    """``midpoint`` at a distance of ``scale``; 0 where the time is unknown."""
    return F.coalesce(F.exp(F.lit(math.log(midpoint)) * F.abs(seconds_away) / F.lit(float(scale))), F.lit(0.0))


def gauss_decay(seconds_away: Column, scale: float, midpoint: float = MIDPOINT) -> Column:
    x = seconds_away / F.lit(float(scale))
    return F.coalesce(F.exp(F.lit(math.log(midpoint)) * x * x), F.lit(0.0))


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def boosted(score: Column, modified: Column, tags: Column, now: datetime, wanted: Sequence[str] = (), window: dict | None = None) -> Column:
    """score * (1 + 0.3 * recency + 0.25 per wanted tag + closeness to the asked window)."""
    total = F.lit(1.0) + DECAY_WEIGHT * exp_decay(_seconds(modified) - F.lit(now.timestamp()), DECAY_SECONDS)
    for tag in wanted:
        total += F.when(F.array_contains(tags, tag), TAG_WEIGHT).otherwise(0.0)
    if window:
        total += gauss_decay(_seconds(modified) - F.lit(window["target"].timestamp()), window["scale"])
    return score * total


def rescored(hits: DataFrame, formula: Column, k: int) -> DataFrame:
    """Of the first 2k hits by score, the k best by ``formula``."""
    first = ranked(hits.drop("rank"), 2 * k, ["query_id"]).drop("rank")
    return ranked(first.withColumn("score", formula), k, ["query_id"])


def _time(value: str | datetime) -> datetime:
    t = datetime.fromisoformat(value.replace("Z", "+00:00")) if isinstance(value, str) else value
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def decay_window(start: str | datetime, end: str | datetime, multiplier: float = 1.0) -> dict:
    """target: the middle; scale: half the range in whole seconds, times ``multiplier``."""
    a, b = _time(start), _time(end)
    if b <= a:
        raise ValueError("the end must come after the start")
    span = (b - a).total_seconds()
    return {"target": a + timedelta(seconds=span / 2), "scale": math.floor(span / 2 * multiplier), "start": a, "end": b}


def date_range(start: str | None, end: str | None, now: datetime) -> dict | None:
    """A decay window, with 2020 and ``now`` for a missing start or end; None without both."""
    if not start and not end:
        return None
    return decay_window(start or "2020-01-01T00:00:00Z", end or now)


def preset_range(name: str, now: datetime) -> tuple[datetime, datetime]:
    """last_7_days, last_14_days, this_week (from Monday), this_month."""
    today = now.replace(hour=0, minute=0, second=0, microsecond=0)
    starts = {"last_7_days": now - timedelta(days=7), "last_14_days": now - timedelta(days=14), "this_week": today - timedelta(days=now.weekday()), "this_month": today.replace(day=1)}
    if name not in starts:
        raise ValueError(f"no such range: {name}; there are {', '.join(starts)}")
    return starts[name], now


# -- fusion ----------------------------------------------------------------------------


def rrf(branches: Sequence[DataFrame], k: int, constant: int = RRF_CONSTANT, digits: int = 12) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, rank) branches."""
    union = None
    for b in branches:
        rows = b.select("query_id", "id", "rank")
        union = rows if union is None else union.unionByName(rows)
    fused = union.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (F.lit(float(constant)) + F.col("rank"))), digits).alias("score"))
    return ranked(fused, k, ["query_id"])


def dbsf(branches: Sequence[DataFrame], k: int, digits: int = 9) -> DataFrame:
    """Distribution-based fusion: scores scaled so that mean -/+ 3 deviations become 0 and 1, clipped, and summed."""
    union = None
    for b in branches:
        w = Window.partitionBy("query_id")
        low, width = F.avg("score").over(w) - 3 * F.stddev_pop("score").over(w), 6 * F.stddev_pop("score").over(w)
        part = b.select("query_id", "id", F.when(width > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") - low) / width))).otherwise(0.5).alias("part"))
        union = part if union is None else union.unionByName(part)
    fused = union.groupBy("query_id", "id").agg(F.round(F.sum("part"), digits).alias("score"))
    return ranked(fused, k, ["query_id"])


def fuse(branches: Sequence[DataFrame], k: int, method: str = "rrf") -> DataFrame:
    if method not in ("rrf", "dbsf"):
        raise ValueError(f"no such fusion: {method}")
    return rrf(branches, k) if method == "rrf" else dbsf(branches, k)


def tag_branch(documents: DataFrame, tags: Sequence[str], queries: DataFrame, k: int = TAG_LIMIT) -> DataFrame:
    """Documents with any of the tags, at a base score of 1 (our choice: there is no query vector to score by)."""
    # scores are equal, so the same first k documents serve every query
    first = documents.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))).select("id").orderBy("id").limit(k)
    placed = first.withColumn("rank", F.row_number().over(Window.orderBy("id")))  # k rows
    return queries.select("query_id").crossJoin(F.broadcast(placed)).select("query_id", "id", F.lit(1.0).alias("score"), "rank")


def hybrid(dense: DataFrame, sparse: DataFrame | None, tagged: DataFrame | None, limit: int, method: str = "rrf") -> DataFrame:
    """Fuses the branches that there are, each cut to its limit and to 4 * limit; up to 4 * limit rows a query."""
    branches = []
    for b, most in ((dense, DENSE_LIMIT), (sparse, SPARSE_LIMIT), (tagged, TAG_LIMIT)):
        if b is not None:
            branches.append(b.where(F.col("rank") <= min(most, BRANCH_FACTOR * limit)))
    return fuse(branches, BRANCH_FACTOR * limit, method)


# -- reranking -----------------------------------------------------------------------------


def lexical_score(query: Column, document: Column) -> Column:
    """Our default reranker: the share of the query's distinct words that the document holds."""
    return word_share(F.array_distinct(words_of(query)), document)


def word_share(words: Column, document: Column) -> Column:
    """lexical_score() of a query's distinct words."""
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, F.array_distinct(words_of(document)))) / F.size(words)).otherwise(0.0)


def rerank(hits: DataFrame, query: Column, document: Column, top: int, scorer: Callable[[Column, Column], Column] = lexical_score) -> DataFrame:
    """The ``top`` hits by the reranker's score; the search score stays as vector_score."""
    scored = hits.withColumn("vector_score", F.col("score")).withColumn("score", scorer(query, document)).drop("rank")
    return ranked(scored, top, ["query_id"])


def zip_by_rank(hits: DataFrame, ranks: DataFrame) -> DataFrame:
    """Reranked positions (query_id, index, score) back to their hits (query_id, index, ...); unknown indexes vanish."""
    return hits.drop("score").join(ranks, ["query_id", "index"])


# -- merging chunks ---------------------------------------------------------------------------


def overlap_length(a: Column, b: Column, least: int = MIN_OVERLAP, most: int = MAX_OVERLAP) -> Column:
    """Length of the longest end of a that begins b, from ``least`` to ``most``; 0 if there is none."""
    longest = F.least(F.length(a), F.length(b), F.lit(most))
    # an end that begins b starts where b's first letters are found; the first such place has the longest end
    place = F.call_function("locate", F.left(b, F.lit(least)), F.right(a, longest))
    first = longest - place + 1
    sizes = F.when(first > least, F.sequence(first - 1, F.lit(least), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    shorter = F.get(F.filter(sizes, lambda k: F.right(a, k) == F.left(b, k)), F.lit(0))
    found = F.when((longest < least) | (place == 0), 0).when(F.right(a, first) == F.left(b, first), first).otherwise(shorter)
    return F.coalesce(found, F.lit(0))


def merge_consecutive(hits: DataFrame, gap: int = MAX_GAP, per: Sequence[str] = ()) -> DataFrame:
    """Runs of hits of one source whose chunk numbers differ by 1 to ``gap``, merged.

    hits: source, idx, id, content, score (rows without idx are dropped).  Texts are
    joined without their overlap, or with a space; the id is the first's; the score is weighted pairwise
    by lengths, the merged text so far against the next chunk.  A repeated number
    starts a run of its own.
    """
    w = Window.partitionBy(*per, "source").orderBy("idx", "id")
    apart = F.col("idx") - F.lag("idx").over(w)
    fresh = F.coalesce((~apart.between(1, gap)).cast("int"), F.lit(1))
    runs = hits.where("idx is not null").withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = runs.groupBy(*per, "source", "run").agg(F.array_sort(F.collect_list(F.struct("idx", "id", "content", F.col("score").cast("double").alias("score")))).alias("parts"))
    first = F.col("parts")[0]
    # the end is carried along: only it can overlap, and the text so far may be long
    start = F.struct(first["content"].alias("content"), first["score"].alias("score"), F.right(first["content"], F.lit(MAX_OVERLAP)).alias("end"))

    def step(done: Column, part: Column) -> Column:
        rest = lambda shared: F.when(shared > 0, part["content"].substr(shared + 1, F.length(part["content"]))).otherwise(F.concat(F.lit(" "), part["content"]))
        # an array of one, so that the rest is computed once
        rests = F.transform(F.transform(F.array(overlap_length(done["end"], part["content"])), rest), lambda more: F.struct(F.concat(done["content"], more).alias("content"), weighted(done, part).alias("score"), F.right(F.concat(done["end"], more), F.lit(MAX_OVERLAP)).alias("end")))
        return F.get(rests, F.lit(0))

    def weighted(done: Column, part: Column) -> Column:
        a, b = F.length(done["content"]), F.length(part["content"])
        return F.when(a + b > 0, (done["score"] * a + part["score"] * b) / (a + b)).otherwise((done["score"] + part["score"]) / 2)

    merged = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), start, step)
    out = rows.withColumn("_m", merged)
    return out.select(*per, first["id"].alias("id"), "source", first["idx"].alias("first_idx"), F.element_at("parts", -1)["idx"].alias("last_idx"), F.size("parts").cast("long").alias("merged_count"), F.col("_m.content").alias("content"), F.col("_m.score").alias("score"))


def islands(hits: DataFrame, gap: int = MAX_GAP, per: Sequence[str] = ()) -> DataFrame:
    """The runs alone: source, first_idx, last_idx, merged_count, best score."""
    w = Window.partitionBy(*per, "source").orderBy("idx", "id")
    apart = F.col("idx") - F.lag("idx").over(w)
    runs = hits.where("idx is not null").withColumn("_fresh", F.coalesce((~apart.between(1, gap)).cast("int"), F.lit(1))).withColumn("run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*per, "source", "run").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("merged_count"), F.max("score").alias("best_score"))


def search(vectors: DataFrame, queries: DataFrame, limit: int, now: datetime, texts: DataFrame | None = None, tags: Sequence[str] = (), window: dict | None = None, reranker: Callable[[Column, Column], Column] | None = None, method: str = "rrf") -> DataFrame:
    """The whole search: branches with boosts, fusion, and with a reranker its order and merged chunks.

    vectors: id, vector, content, source, idx, tags, modified; queries: query_id, query_vector, query_text; texts: id, content (may be ``vectors`` itself).
    Without a reranker up to 4 * limit unmerged rows a query come back.
    """
    same = texts is vectors
    vectors = fixed(vectors)  # read by every branch: embedded once
    texts, queries = vectors if same else texts, fixed(queries)
    attributes = vectors.drop("vector")
    boost = boosted(F.col("score"), F.col("modified"), F.col("tags"), now, tags, window)

    def raised(hits: DataFrame, most: int) -> DataFrame:
        return rescored(hits.select("query_id", "id", "score").join(attributes.select("id", "modified", "tags"), "id"), boost, most)

    branches = [raised(dense_topk(vectors.select("id", "vector"), queries.select("query_id", "query_vector"), 2 * DENSE_LIMIT), DENSE_LIMIT)]
    sparse = tagged = None
    if texts is not None:
        words = sparse_rows(queries, "query_id", "query_text", "query_id")
        sparse = raised(sparse_topk(texts.select("id", F.col("content").alias("text")), words, 2 * SPARSE_LIMIT), SPARSE_LIMIT)
    if tags:
        # equal scores for every query: one query's hits are boosted, and their first rows given to all
        one = tag_branch(vectors, tags, queries.sparkSession.range(1).select(F.col("id").alias("query_id")), 2 * TAG_LIMIT)
        first = raised(one, TAG_LIMIT).drop("query_id").where(F.col("rank") <= min(TAG_LIMIT, BRANCH_FACTOR * limit))
        tagged = queries.select("query_id").crossJoin(F.broadcast(first))
    hits = hybrid(branches[0], sparse, tagged, limit, method)
    asked = queries.select("query_id", "query_text")
    if reranker is lexical_score:  # a query's words are found once, not for each of its hits
        asked, reranker = asked.withColumn("query_text", F.array_distinct(words_of(F.col("query_text")))), word_share
    full = hits.join(attributes, "id").join(_small(asked), "query_id")
    if reranker is None:
        return full
    document = T.rerank_document(F.col("id").cast("string"), F.col("modified").cast("string"), F.col("tags"), F.col("content"))
    top = rerank(full, F.col("query_text"), document, limit, reranker)
    return merge_consecutive(top.withColumn("source", F.coalesce("source", F.col("id").cast("string"))), per=["query_id"])


# -- embedding ------------------------------------------------------------------------------------


def embed(df: DataFrame, text: str, dims: int = 64, name: str = "vector") -> DataFrame:
    """Hashed embeddings by Arrow batches (one pass over each text); a model's embedder has the same shape."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        import re
        import zlib

        class Hashes(dict):
            def __missing__(self, word: str) -> int:
                return self.setdefault(word, zlib.crc32(word.encode()))

        hashes = Hashes()
        for batch in batches:
            found = [re.findall(r"\w+", (t or "").lower()) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            if len(hashes) > 1 << 18:
                hashes.clear()
            h = np.array([hashes[w] for f in found for w in f], np.int64)
            row = np.repeat(np.arange(len(found)), np.array([len(f) for f in found], int))
            out = np.bincount(row * dims + h % dims, np.where(h >> 31, 1.0, -1.0), len(found) * dims).astype(float).reshape(-1, dims)
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
            yield batch.append_column(name, pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * dims, pa.int32()), pa.array(out.ravel())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{name}` array<double>")


def embed_batches(df: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], size: int = 50, name: str = "vector") -> DataFrame:
    """Calls ``embedder`` with up to ``size`` texts at a time; a batch that fails or gives another number of vectors is dropped."""
    import pyarrow as pa

    def run(batches):
        for rows in batches:
            for low in range(0, rows.num_rows, size):
                part = rows.slice(low, size)
                try:
                    vectors = embedder(part.column(part.schema.get_field_index(text)).to_pylist())
                except Exception:  # a failed call loses its batch, by definition
                    continue
                if len(vectors) == part.num_rows:
                    yield part.append_column(name, pa.array(vectors, pa.list_(pa.float64())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{name}` array<double>")


def today(now: datetime) -> str:
    return date(now.year, now.month, now.day).isoformat()
