"""Descriptive tables: quantile bins, five numbers, densities, averages."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoked.operators.order import met, quantiles


def quantile_bins(df: DataFrame, x: str, n: int) -> DataFrame:
    """Adds bin (from 1): n equal-frequency bins, right-closed, the lowest value included; equal edges merge."""
    names = {f"e{i}": i / n for i in range(n + 1)}
    edges = quantiles(df, [], x, names).select(F.array_sort(F.array_distinct(F.array(*names))).alias("__edges"))
    rows = df.join(F.broadcast(edges))
    return rows.withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("__edges", lambda e: e < F.col(x))))).drop("__edges")


def five_numbers(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, n, lo, q25, med, q75, hi) of x, exact in groups of any size."""
    return quantiles(df, keys, x, {"q25": 0.25, "med": 0.5, "q75": 0.75}).select(*keys, "n", "lo", "q25", "med", "q75", "hi")


def display_limits(df: DataFrame, keys: list[str], x: str, symmetric: float = 0.98, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(keys, symmetric, lo, hi): a quantile of abs(x), and a low and a high one of x."""
    rows = df.select(*keys, F.col(x).alias("__x"), F.abs(F.col(x)).alias("__a"))
    ends = quantiles(rows, keys, "__x", {"__low": low, "__high": high}).select(*keys, F.col("__low").alias("lo"), F.col("__high").alias("hi"))
    return met(quantiles(rows, keys, "__a", {"symmetric": symmetric}).select(*keys, "symmetric"), ends, keys)


def joint_limits(df: DataFrame, keys: list[str], channel: list[str], x: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(keys, lo, hi) that all channels are drawn in: the least of their low quantiles and the greatest of their high ones."""
    each = quantiles(df, [*keys, *channel], x, {"__low": low, "__high": high})
    return each.groupBy(*keys).agg(F.min("__low").alias("lo"), F.max("__high").alias("hi"))


def robust_scale(df: DataFrame, keys: list[str], index: str, x: str, stride: int, q: float = 0.99) -> DataFrame:
    """(keys, n, scale): a quantile of abs(x) over every stride-th sample, index counted from 0, as a scale that single peaks don't set."""
    rows = df.filter(F.col(index) % stride == 0).withColumn("__a", F.abs(F.col(x)))
    return quantiles(rows, keys, "__a", {"scale": q}).select(*keys, "n", "scale")


def kernel_density(df: DataFrame, keys: list[str], x: str, steps: int) -> DataFrame:
    """(keys, i, point, density) at steps + 1 even points from min to max; Gaussian kernel, Scott's bandwidth.

    Values are spread over the points in one pass and summed map-side. A group without spread has no density.
    """
    s = df.filter(F.col(x).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.stddev_samp(x) * F.pow(F.count(F.lit(1)), F.lit(-0.2))).alias("h"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    rows = df.join(F.broadcast(s.filter("h > 0")), keys).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    rows = rows.withColumn("point", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / float(steps))
    u = (F.col("point") - F.col(x)) / F.col("h")
    return rows.groupBy(*keys, "i", "point").agg((F.sum(F.exp(-0.5 * u * u)) / (F.first("n") * F.first("h") * math.sqrt(2 * math.pi))).alias("density"))


def grand_average(df: DataFrame, first: list[str], keys: list[str], x: str) -> DataFrame:
    """Mean of first-level means, their sd, number and standard error."""
    means = df.groupBy(*first).agg(F.avg(x).alias("m"))
    out = means.groupBy(*keys).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("sem", F.col("sd") / F.sqrt("n"))
