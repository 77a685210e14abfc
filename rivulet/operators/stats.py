"""Statistics: exact and approximate percentiles, timings, conditional counts, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (50, 95, 99)


def nearest_ranks(df: DataFrame, value: str, percents: Sequence[float] = PERCENTILES, by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """Exact nearest-rank percentiles, sorted[ceil(p/100 * n) - 1], with n, min, max and avg: a row per group.

    Mergeable sketches give a bracket for each percentile; a second pass counts the
    values below it and orders those inside, a few in ten thousand.  No
    task ever holds a group.  Nulls and NaN are left out.  A bracket without
    the wanted rank is an error, never another value.  Without ``by`` there is one row, of nulls if there are no values.
    """
    at = [p / 100 for p in percents]
    edges = [q for x in at for q in (max(0.0, x - 2 / accuracy), min(1.0, x + 2 / accuracy))]
    keys = [f"_by{i}" for i in range(len(by))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.avg("_v").alias("avg"), F.percentile_approx("_v", edges, accuracy).alias("_edges"))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        """Left joined with right by the keys, nulls being equal."""
        named = right.select(*(F.col(k).alias(f"_r{k}") for k in keys), *(c for c in right.columns if c not in keys))
        if not keys:
            return left.crossJoin(F.broadcast(named))  # one row
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_r{k}"))
        return left.join(named, same).drop(*(f"_r{k}" for k in keys))

    placed = beside(rows, groups.select(*keys, "_edges"))
    inside = [F.col("_v").between(F.col("_edges")[2 * i], F.col("_edges")[2 * i + 1]) for i in range(len(at))]
    any_inside = inside[0]
    for c in inside[1:]:
        any_inside = any_inside | c
    # one row for all values outside the brackets, and one per value inside
    counts = placed.groupBy(*keys, F.when(any_inside, F.col("_v")).alias("_x")).agg(
        F.count("*").alias("_c"), F.first("_edges").alias("_edges"), *(F.count_if(F.col("_v") < F.col("_edges")[2 * i]).alias(f"_under{i}") for i in range(len(at)))
    )
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    hits = []
    for i, x in enumerate(at):
        within = F.col("_x").between(F.col("_edges")[2 * i], F.col("_edges")[2 * i + 1])
        rank = F.greatest(F.ceil(F.round(F.lit(x) * F.sum("_c").over(whole), 9)), F.lit(1))
        below, run = F.sum(f"_under{i}").over(whole), F.sum(F.when(within, F.col("_c")).otherwise(0)).over(upto)
        hits += [F.when(within & (below < rank) & (below + run >= rank), F.col("_x")).alias(f"_hit{i}")]
    found = counts.select(*keys, *hits).groupBy(*keys).agg(*(F.coalesce(F.min(f"_hit{i}"), F.when(F.count("*") > 0, F.raise_error(F.lit(f"no bracket for percentile {p:g}")).cast("double"))).alias(f"p{p:g}") for i, p in enumerate(percents)))
    summary = groups.drop("_edges")
    if not keys:
        return summary.crossJoin(F.broadcast(found))
    return beside(summary, found).select(*(F.col(k).alias(c) for c, k in zip(by, keys)), "n", "min", "max", "avg", *(f"p{p:g}" for p in percents))


def timing_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """min, max, avg and nearest-rank percentiles; all 0 of nothing."""
    names = ["min", "max", "avg", *(f"p{p}" for p in PERCENTILES)]
    return nearest_ranks(df, value, PERCENTILES, by).select(*by, *(F.coalesce(n, F.lit(0.0)).alias(n) for n in names))


def sketch_percentiles(df: DataFrame, value: str, percents: Sequence[float] = PERCENTILES, accuracy: int = 10_000, by: Sequence[str] = ()) -> DataFrame:
    """Approximate percentiles from mergeable sketches of bounded size."""
    found = F.percentile_approx(value, [p / 100 for p in percents], accuracy)
    return df.groupBy(*by).agg(F.count(value).alias("n"), found.alias("_p")).select(*by, "n", *(F.col("_p")[i].alias(f"p{p:g}") for i, p in enumerate(percents)))


def conditional_counts(df: DataFrame, conditions: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(c).alias(name) for name, c in conditions.items()))


def number_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"))


def category_summary(df: DataFrame, category: Column, active: Column, value: str) -> DataFrame:
    """One row: total, active, mean value, and a map of counts by category (as JSON-friendly sorted entries)."""
    by_category = df.groupBy(category.alias("category")).agg(F.count("*").alias("n"), F.count_if(active).alias("active"), F.sum(value).alias("sum"), F.count(value).alias("values"))
    return by_category.agg(
        F.sum("n").alias("total"),
        F.sum("active").alias("active"),
        (F.sum("sum") / F.sum("values")).alias("avg_value"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_category"),
    )


def histogram(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def batch_report(results: DataFrame, dims: str | None = None) -> DataFrame:
    """Totals of a result-struct column: all, ok, failed = all - ok, and the mean vector size of the ok."""
    ok = F.count_if(F.col("result.success"))
    out = [F.count("*").alias("total"), ok.alias("successful"), (F.count("*") - ok).alias("failed")]
    if dims:
        out.append(F.avg(F.when(F.col("result.success"), F.size(dims))).alias("avg_dims"))
    return results.agg(*out)
