"""Exact ranks and quantiles of groups of any size.

Spark's exact ``percentile`` keeps all distinct values of a group in one task, and a ranking window
sorts a whole group in one task. Here values are counted (combining equal ones on the map side), range
partitioned by group and value, and ranked within each range; range totals then give global positions.
A group with most of the rows is spread over most of the ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from blockreach.session import cut_lineage

# Accuracy of the first pass of ``quantiles``, and how many of its errors a bracket reaches to each side.
# A group of at most ``ACCURACY`` values is its own bracket, as neighbouring ranks lie further apart there.
ACCURACY, MARGIN = 10_000, 4
FEW_GROUPS = 10_000  # groups whose brackets are sent to all tasks


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys meet null keys; the columns of ``left``, then the others of ``right``."""
    named = right.withColumnsRenamed({c: f"__{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & left[c].eqNullSafe(named[f"__{c}"])
    return left.join(named, same, how).drop(*[f"__{c}" for c in on])


def value_positions(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """``(by..., value, ties, before)``: copies of each distinct value and the rows below it in its group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    ranged = counts.repartitionByRange(*by, value).withColumn("range", F.spark_partition_id())
    ranged = cut_lineage(ranged)  # pins the sampled range borders
    sizes = ranged.groupBy(*by, "range").agg(F.sum("ties").alias("n"))
    earlier = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*by, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("ties").over(inside), F.lit(0)))
    return join_null_safe(placed, offsets, [*by, "range"], "inner").select(*by, value, "ties", (F.col("offset") + F.col("inside")).alias("before"))


def tied_ranks(df: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """Add the 1-based rank of ``value`` in its group, ties sharing their average rank; a null value has a null rank."""
    ranks = value_positions(df, value, by).select(*by, value, (F.col("before") + (F.col("ties") + 1) / 2.0).alias(out))
    return join_null_safe(df, ranks, [*by, value])


def ranks_together(df: DataFrame, columns: dict[str, str], by: Sequence[str]) -> DataFrame:
    """Add :func:`tied_ranks` of several double columns (``{column: name of its rank}``), placing all their values in one pass."""
    named = [F.struct(F.lit(i).alias("which_"), F.col(c).cast("double").alias("value_")) for i, c in enumerate(columns)]
    long = df.select(*by, F.explode(F.array(*named)).alias("s_")).select(*by, "s_.*")
    placed = value_positions(long, "value_", [*by, "which_"])
    for i, (c, out) in enumerate(columns.items()):
        ranks = placed.where(F.col("which_") == i).select(*by, F.col("value_").alias(c), (F.col("before") + (F.col("ties") + 1) / 2.0).alias(out))
        df = join_null_safe(df, ranks, [*by, c])
    return df


def percentile_rank(df: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """Add the average rank divided by the number of values in the group; null for a null value."""
    sizes = df.groupBy(*by).agg(F.count(value).alias("size_"))
    ranked = join_null_safe(tied_ranks(df, value, by, "rank_"), sizes, by)
    return ranked.withColumn(out, F.col("rank_") / F.col("size_")).drop("rank_", "size_")


def quantiles(df: DataFrame, value: str, by: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Linearly interpolated quantiles: one row ``(by..., q)`` per group, ``q`` an array in the given order.

    A first pass brackets every quantile by two values with ``percentile_approx``, whose error in rank is at
    most ``1 / ACCURACY``; a second pass counts the values below each bracket and the distinct values inside
    it, about one row in a thousand. Neither pass shuffles the values. A rank outside its bracket is an error.
    """
    keys = list(by) or ["all_"]
    work = df if by else df.withColumn("all_", F.lit(0))
    work = work.select(*keys, F.col(value).cast("double").alias("v")).where("v is not null")
    slack = MARGIN / ACCURACY
    ends = [e for p in probabilities for e in (max(0.0, p - slack), min(1.0, p + slack))]
    found = work.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", ends, ACCURACY).alias("e"), F.min("v").alias("least"), F.max("v").alias("most"))
    small = F.col("n") <= ACCURACY
    spots = F.array(*[
        F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("n") - 1)).alias("h"), F.when(small, F.col("least")).otherwise(F.col("e")[2 * i]).alias("low"), F.when(small, F.col("most")).otherwise(F.col("e")[2 * i + 1]).alias("high"))
        for i, p in enumerate(probabilities)
    ])
    # The size check takes exploded arrays for one element, so it would send the values to the driver rather than the
    # brackets. Few brackets are sent without asking it; of many, an outer join leaves the values where they are.
    brackets = cut_lineage(found.select(*keys, spots.alias("spots")))
    few = brackets.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    met = join_null_safe(work, F.broadcast(brackets) if few else brackets, keys, "left")
    # A value below a bracket counts without its value, so it combines on the map side.
    seen = F.transform(F.filter("spots", lambda s: F.col("v") <= s.high), lambda s: F.struct(s.i.alias("i"), s.h.alias("h"), F.when(F.col("v") >= s.low, F.col("v")).alias("v")))
    counts = met.select(*keys, F.explode(seen).alias("s")).groupBy(*keys, "s.i", "s.h", "s.v").agg(F.count(F.lit(1)).alias("ties"))
    earlier = Window.partitionBy(*keys, "i").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.coalesce(F.sum("ties").over(earlier), F.lit(0)))
    low, high = F.floor("h"), F.ceil("h")
    hits = lambda at: F.col("v").isNotNull() & (F.col("before") <= at) & (at < F.col("before") + F.col("ties"))
    ranked = placed.groupBy(*keys, "i", "h").agg(F.max(F.when(hits(low), F.col("v"))).alias("a"), F.max(F.when(hits(high), F.col("v"))).alias("b"))
    q = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("A quantile lies outside its bracket."))).otherwise(
        F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("h") - low) * (F.col("b") - F.col("a"))))
    out = ranked.withColumn("q", q).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("q"))
    return out.select(*by, F.transform("q", lambda s: s.q).alias("q"))


def medians(df: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """Median per group."""
    return quantiles(df, value, by, [0.5]).select(*by, F.get("q", F.lit(0)).alias(out))
