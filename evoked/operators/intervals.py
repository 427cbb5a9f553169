"""Interval operators: merging, joins of points and intervals by buckets, compaction of gaps.

A range condition alone becomes a nested loop. Here intervals are cut at a coarse grid, both sides meet by
equality on keys and grid cell, and the exact condition is a residual filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def cells(lo: Column, hi: Column, width: int) -> Column:
    """Grid cells that the half-open interval [lo, hi) touches."""
    return F.sequence(F.floor(lo / width).cast("long"), F.greatest(F.floor(lo / width), F.ceil(hi / width) - 1).cast("long"))


def merge_intervals(df: DataFrame, keys: list[str], lo: str = "s", hi: str = "e") -> DataFrame:
    """Disjoint unions of intervals within keys; touching ones merge, empty or NULL ones go."""
    w = W.partitionBy(*keys).orderBy(lo, hi)
    rows = df.filter(F.col(hi) > F.col(lo)).select(*keys, lo, hi)
    reach = F.max(hi).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("__new", F.when(reach.isNull() | (F.col(lo) > reach), 1).otherwise(0))
    rows = rows.withColumn("__island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("__island")


#: Pairs that a task of dense_join should get at most, unless one cell has more, and points whose pairs with one window follow each other.
PAIRS, TILE = 1 << 24, 256


def interval_join(points: DataFrame, windows: DataFrame, keys: list[str], t: str, lo: str, hi: str, width: int) -> DataFrame:
    """Rows of points with each window [lo, hi) of the same keys that holds t; a pair occurs once."""
    left = points.withColumn("__cell", F.floor(F.col(t) / width).cast("long"))
    right = windows.filter(F.col(hi) > F.col(lo)).withColumn("__cell", F.explode(cells(F.col(lo), F.col(hi), width)))
    return left.join(right, [*keys, "__cell"]).filter((F.col(t) >= F.col(lo)) & (F.col(t) < F.col(hi))).drop("__cell")


def dense_join(points: DataFrame, windows: DataFrame, keys: list[str], t: str, lo: str, hi: str, width: int) -> DataFrame:
    """interval_join where pairs may outgrow both tables by far; the points' columns must be orderable.

    Partitions made by the size of the tables would then hold ever more pairs, so pairs are estimated by counts in cells, in a job of its own, and both sides
    are dealt to a partition for PAIRS of them, or to four partitions a cell; a cell stays in one. Points are joined as tiles, arrays of TILE neighbours in a cell:
    a merge join streams tiles, so the rows of a tile come window by window, and a column file stores what is equal or comes again in little space.
    """
    left = points.filter(F.col(t).isNotNull()).withColumn("__cell", F.floor(F.col(t) / width).cast("long"))
    right = windows.filter(F.col(hi) > F.col(lo)).withColumn("__cell", F.explode(cells(F.col(lo), F.col(hi), width)))
    a, b = (x.groupBy(*keys, "__cell").agg(F.count(F.lit(1)).cast("double").alias(n)) for x, n in ((left, "a"), (right, "b")))
    n, pairs = a.join(b, [*keys, "__cell"]).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0))).first()
    dealt = min(4 * n, math.ceil(pairs / PAIRS))
    if dealt > int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        left, right = (x.repartition(dealt, *keys, "__cell") for x in (left, right))
    cell, rest = [*keys, "__cell"], [c for c in points.columns if c not in (*keys, t)]
    left = left.withColumn("__tile", F.floor((F.row_number().over(W.partitionBy(*cell).orderBy(t)) - 1) / TILE))
    left = left.groupBy(*cell, "__tile").agg(F.min(t).alias("__first"), F.max(t).alias("__last"), F.sort_array(F.collect_list(F.struct(t, *rest))).alias("__points"))
    both = left.join(right.sortWithinPartitions(*cell, lo).hint("merge"), cell).filter((F.col("__last") >= F.col(lo)) & (F.col("__first") < F.col(hi)))
    own = [c for c in windows.columns if c not in keys]
    both = both.select(*keys, *own, F.explode("__points").alias("__p")).select(*keys, "__p.*", *own)
    return both.filter((F.col(t) >= F.col(lo)) & (F.col(t) < F.col(hi)))


def outside(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, lo: str, hi: str, width: int) -> DataFrame:
    """Points in none of the intervals [lo, hi) of their keys."""
    left = points.withColumn("__cell", F.floor(F.col(t) / width).cast("long")).alias("l")
    right = intervals.filter(F.col(hi) > F.col(lo)).select(*keys, F.col(lo).alias("__lo"), F.col(hi).alias("__hi"), F.explode(cells(F.col(lo), F.col(hi), width)).alias("__cell")).alias("r")
    cond = (F.col("l.__cell") == F.col("r.__cell")) & (F.col(f"l.{t}") >= F.col("r.__lo")) & (F.col(f"l.{t}") < F.col("r.__hi"))
    for k in keys:
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return left.join(right, cond, "left_anti").drop("__cell")


def overlap(windows: DataFrame, intervals: DataFrame, keys: list[str], lo: str, hi: str, s: str, e: str, width: int) -> DataFrame:
    """Each window with each interval it overlaps, and the clipped length `overlap`.

    Both sides are cut at the grid; a pair is kept in its first shared cell only, so nothing has to be made distinct.
    """
    left = windows.filter(F.col(hi) > F.col(lo)).withColumn("__cell", F.explode(cells(F.col(lo), F.col(hi), width)))
    right = intervals.filter(F.col(e) > F.col(s)).withColumn("__cell", F.explode(cells(F.col(s), F.col(e), width)))
    both = left.join(right, [*keys, "__cell"]).filter((F.col(s) < F.col(hi)) & (F.col(e) > F.col(lo)))
    both = both.filter(F.col("__cell") == F.floor(F.greatest(F.col(lo), F.col(s)) / width))
    return both.withColumn("overlap", F.least(F.col(hi), F.col(e)) - F.greatest(F.col(lo), F.col(s))).drop("__cell")


def running_at(points: DataFrame, steps: DataFrame, keys: list[str], at: str, amounts: list[str], width: int) -> DataFrame:
    """points with each of the amounts summed over the steps of their keys at or before them; 0 without any.

    One ordered pass over the union of both tables within a grid cell, and running sums of whole cells; so work grows with
    points plus steps, however many steps lie before a point.
    """
    own = points.columns
    cell = F.floor(F.col(at) / width).cast("long").alias("__cell")
    s = steps.filter(F.col(at).isNotNull()).groupBy(*keys, at).agg(*(F.sum(a).cast("long").alias(a) for a in amounts))
    s = s.select(F.lit(None).alias("row"), *keys, at, F.lit(0).alias("kind"), *amounts)
    p = points.select(F.struct(*own).alias("row"), *keys, at, F.lit(1).alias("kind"), *(F.lit(0).cast("long").alias(a) for a in amounts))
    both = p.unionByName(s).select("*", cell)
    sums = both.groupBy(*keys, "__cell").agg(*(F.sum(a).alias(a) for a in amounts))
    before = W.partitionBy(*keys).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(*keys, "__cell", *(F.sum(a).over(before).alias(f"__{a}") for a in amounts))
    within = W.partitionBy(*keys, "__cell").orderBy(at, "kind").rowsBetween(W.unboundedPreceding, 0)
    rows = both.select("row", *keys, "__cell", "kind", *(F.sum(a).over(within).alias(a) for a in amounts)).filter("kind = 1")
    rows = rows.join(carried, [*keys, "__cell"], "left")
    return rows.select("row.*", *((F.col(a) + F.coalesce(f"__{a}", F.lit(0))).alias(a) for a in amounts))


def crossing(pairs: DataFrame, merged: DataFrame, keys: list[str], lo: str, hi: str, s: str = "s", e: str = "e") -> DataFrame:
    """pairs with `crosses`: does some interval start before hi and end after lo. merged must be disjoint.

    As-of: the last interval that starts before hi has the greatest end of all that do, so one ordered pass over
    the union of both tables answers for every pair.
    """
    own = pairs.columns
    a = pairs.select(F.struct(*own).alias("row"), *keys, F.col(hi).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("end"))
    b = merged.select(F.lit(None).alias("row"), *keys, F.col(s).alias("at"), F.lit(1).alias("kind"), F.col(e).alias("end"))
    both = a.unionByName(b)
    w = W.partitionBy(*keys).orderBy("at", "kind").rowsBetween(W.unboundedPreceding, -1)
    both = both.withColumn("__end", F.last("end", ignorenulls=True).over(w)).filter("kind = 0")
    return both.select("row.*", F.coalesce(F.col("__end") > F.col(f"row.{lo}"), F.lit(False)).alias("crosses"))


def good_chunks(dead: DataFrame, extent: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi, origin): what of [0, duration) is left of merged dead intervals, and where it starts once joined."""
    clipped = dead.join(extent, keys).select(*keys, F.greatest("s", F.lit(0)).alias("s"), F.least("e", "duration").alias("e")).filter("e > s")
    ends = extent.select(*keys, F.col("duration").alias("s"), F.col("duration").alias("e"))
    w = W.partitionBy(*keys).orderBy("s", "e")
    gaps = clipped.unionByName(ends).withColumn("lo", F.coalesce(F.lag("e").over(w), F.lit(0))).withColumnRenamed("s", "hi")
    gaps = gaps.select(*keys, "lo", "hi").filter("hi > lo")
    before = W.partitionBy(*keys).orderBy("lo").rowsBetween(W.unboundedPreceding, -1)
    return gaps.withColumn("origin", F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(before), F.lit(0)))


def compact(points: DataFrame, chunks: DataFrame, keys: list[str], t: str, width: int) -> DataFrame:
    """Points in good chunks, with `t_compact` on the joined time axis; points in gaps go."""
    return interval_join(points, chunks, keys, t, "lo", "hi", width).withColumn("t_compact", F.col(t) - F.col("lo") + F.col("origin")).drop("lo", "hi", "origin")
