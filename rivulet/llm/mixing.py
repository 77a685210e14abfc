"""Mixing sources to target weights (DataFrame functions only).

Each document gets a hash-random key.  Within a source documents are taken in
key order; ranges of keys (buckets) take the part of a range sort, since keys
are uniform: sizes are summed by source and bucket with partial aggregation,
prefix sums over buckets find the one bucket in which a source's budget ends,
and only that bucket's rows are sorted, in a window of bounded size, for the
exact cut.  The number of buckets follows the rows of the source, so a hot
source is spread like any other.  A target over the source's size repeats
whole epochs first.

The cut is a key per source, so that the mix itself is a map over the
documents joined with one small row per source.  That table is broadcast if it is counted
to be small; texts are shuffled by source only beyond that (and AQE splits hot sources).

The target of a source is its share of all sizes by weight, at most ``cap``
times its size; what that leaves is shared again by weight until no target is
above.  The document at the end of a budget is cut after its last word taken
(``cut=True``), or taken whole if that comes nearer to the budget than leaving it.

Defined results: null and empty texts have size 0 and follow their place in
key order; a null source is a source, last in order; a source without words
has target 0 and is not taken; rows that repeat an id are taken, left or cut
together; an empty table gives an empty result; other columns don't matter, whatever their names.

Targets are windows over one row per source, and prefix sums over one row per
bucket of ``BUCKET_ROWS`` documents of a source: a task holds a source's buckets, a
four-thousandth of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, counted, materialize, quoted

WEIGHTS = (1.0, 2.0, 3.0)
CAP = 3
BUCKET_ROWS = 4096
#: Keys are 60 random bits.
KEY_BITS = 60
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_col: Column, seed: str) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, ...) with weight and target; one row per source.

    Capped sources are those with the least cap per weight, so the level that
    the others reach comes from sums in that order.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    rows = sizes.withColumn("weight", turn).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_level = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("source_size").over(everything))
    rows = rows.withColumn("left_size", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    rows = rows.withColumn("left_weight", F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("level", F.col("left_size") / F.col("left_weight"))
    rows = rows.withColumn("level", F.max(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))).over(everything))
    return rows.withColumn("target", F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most"))).select(*sizes.columns, "weight", "target")


def plan(slim: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per source of (source, id, size, key): source_size, target, epochs, and the last key and id of the cut."""
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rows = targets(sizes, weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("epochs", epochs).withColumn("budget", F.when(F.col("source_size") > 0, F.floor("target") - F.col("epochs") * F.col("source_size")).otherwise(0).cast("long"))
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("n") / F.lit(float(BUCKET_ROWS)))), F.lit(0)), F.lit(40)).cast("int")
    rows = counted(rows.withColumn("width", F.pow(F.lit(2.0), F.lit(KEY_BITS) - bits).cast("long")))
    by_source = rows.select(F.col("source").alias("of"), "width", "budget").where("budget > 0")
    keyed = slim.join(by_source, F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", F.floor(F.col("key") / F.col("width"))).drop("of")
    by_bucket = keyed.groupBy("source", "bucket", "budget", "width").agg(F.sum("size").alias("words"))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = by_bucket.withColumn("upto", F.sum("words").over(along)).withColumn("before", F.col("upto") - F.col("words"))
    last = ends.where("before < budget and budget <= upto").select(F.col("source").alias("of"), F.col("bucket").alias("in_bucket"), "before")
    inside = keyed.join(last, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in_bucket")))
    one = inside.groupBy("source", "key", "id", "budget", "before").agg(F.sum("size").alias("size"))
    w = Window.partitionBy("source").orderBy("key", F.col("id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("upto", F.sum("size").over(w) + F.col("before")).withColumn("part", F.col("budget") - F.col("upto") + F.col("size"))
    end = one.where("0 < part and part <= size").select(F.col("source").alias("of"), F.col("key").alias("end_key"), F.col("id").alias("end_id"), F.col("part").alias("end_part"), F.col("size").alias("end_size"))
    out = rows.join(end, F.col("source").eqNullSafe(F.col("of")), "left")
    return out.select("source", "source_size", "target", "epochs", F.coalesce("end_key", F.lit(-1)).alias("end_key"), "end_id", "end_part", "end_size")


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    return docs.select(column(source_col).cast("string").alias("source"), column(id_col).alias("id"), size_of(column(text_col)).alias("size"), random_key(column(id_col), seed).alias("key"))


def _taken(key: Column, ident: Column, size: Column, cut: bool) -> tuple[Column, Column]:
    """Whole epochs of a row, and words of one more, beside its source's plan (columns plan_*)."""
    end_key, end_id = F.col("plan_end_key"), F.col("plan_end_id")
    inside = (key < end_key) | ((key == end_key) & end_id.isNotNull() & F.coalesce(ident < end_id, F.lit(True)))
    at_end = (key == end_key) & ident.eqNullSafe(end_id)
    if not cut:
        inside |= at_end & (2 * F.col("plan_end_part") >= F.col("plan_end_size"))
    part = F.floor(F.col("plan_end_part") * size / F.col("plan_end_size")) if cut else F.lit(0)
    return (F.col("plan_epochs") + F.when(inside, 1).otherwise(0)).cast("long"), F.when(at_end, part).otherwise(0).cast("long")


def _planned(docs: DataFrame, slim: DataFrame, source: Column, weights: tuple[float, ...], cap: float) -> DataFrame:
    sources = counted(plan(slim, weights, cap))
    return docs.join(sources.select(*(F.col(c).alias(f"plan_{c}") for c in sources.columns)), source.eqNullSafe(F.col("plan_source")))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: str = "mix", cut: bool = True) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words), times (whole epochs)."""
    slim = materialize(_slim(docs, id_col, text_col, source_col, seed))
    out = _planned(slim, slim, F.col("source"), weights, cap)
    times, part = _taken(F.col("key"), F.col("id"), F.col("size"), cut)
    return out.select(F.col("id").alias(id_col), "size", F.col("plan_source_size").alias("source_size"), F.col("plan_target").alias("target"), (F.col("size") * times + part).alias("taken"), times.alias("times"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: str = "mix", cut: bool = True) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as its source's plan takes it; columns as they were.

    With ``cut``, the document at the end of a source's budget comes once more,
    cut after its last word taken.
    """
    slim = materialize(_slim(docs, id_col, text_col, source_col, seed))
    whole = docs.select(F.struct(*map(column, docs.columns)).alias("row"))
    out = _planned(whole, slim, F.col(f"row.{quoted(source_col)}").cast("string"), weights, cap)
    ident, text = F.col(f"row.{quoted(id_col)}"), F.col(f"row.{quoted(text_col)}")
    times, part = _taken(random_key(ident, seed), ident, size_of(text) if cut else F.lit(0), cut)
    out = out.select("row", times.alias("times"), part.alias("part")).where("times > 0 or part > 0")
    out = out.select("row", "times", "part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times") + F.when(F.col("part") > 0, 1).otherwise(0))).alias("epoch"))
    if cut:
        head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, F.col("part").cast("int")), "")
        out = out.withColumn("row", F.when(F.col("epoch") > F.col("times"), F.col("row").withField(quoted(text_col), head)).otherwise(F.col("row")))
    return out.select("row.*")
