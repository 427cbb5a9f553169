"""Relative bins, baseline normalisation, smoothing, firing-rate and power bins, condition expansion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evoked.operators import intervals as iv


def relative_bins(spark: SparkSession, pre: float, post: float, width: float, partial: bool = False) -> DataFrame:
    """(window, bin, start, end): whole bins of [-pre, 0) and [0, post), never across 0; a rest bin only if partial."""
    rows = []
    for name, first, span in (("pre", -pre, pre), ("post", 0.0, post)):
        n = math.floor(span / width + 1e-9)
        edges = [first + i * width for i in range(n + 1)]
        rows += [(name, a, b) for a, b in zip(edges, edges[1:])]
        if partial and span - n * width > 1e-9:
            rows.append((name, edges[-1], first + span))
    return spark.createDataFrame([(w, i, float(a), float(b)) for i, (w, a, b) in enumerate(rows)], "window string, bin int, start double, end double")


def baseline_normalise(df: DataFrame, keys: list[str], value: str, is_pre: Column, modes: list[str], eps: float = 0.1, ddof: int = 1, prefix: str = "") -> DataFrame:
    """Adds value normalised by its baseline within keys, one column a mode.

    raw; subtract: x - m; percent: 100 (x - m) / (m + eps); logratio: ln((x + eps) / (m + eps)); zscore: (x - m) / sd,
    NULL if sd is 0 or there is one baseline row; mean100: 100 x / m, NULL if m is 0.
    """
    w = W.partitionBy(*keys)
    x = F.col(value)
    m = F.avg(F.when(is_pre, x)).over(w)
    sd = (F.stddev_samp if ddof else F.stddev_pop)(F.when(is_pre, x)).over(w)
    rows = df.withColumns({"__m": m, "__sd": sd})
    m, sd = F.col("__m"), F.col("__sd")
    forms = {
        "raw": x,
        "subtract": x - m,
        "percent": 100 * (x - m) / F.nullif(m + eps, F.lit(0.0)),
        "logratio": F.when((x + eps > 0) & (m + eps > 0), F.log((x + eps) / (m + eps))),
        "zscore": F.when(sd > 0, (x - m) / sd),
        "mean100": 100 * x / F.nullif(m, F.lit(0.0)),
    }
    return rows.withColumns({f"{prefix}{k}": forms[k] for k in modes}).drop("__m", "__sd")


def smooth(df: DataFrame, keys: list[str], at: str, value: str, sigma: float, out: str = "smooth") -> DataFrame:
    """Gaussian smoothing along integer positions within keys; NULLs are filled from neighbours, weights renormalised.

    Each row is sent to the positions within the radius ceil(4 sigma), so it is one aggregation for any length of series.
    """
    radius = math.ceil(4 * sigma)
    kernel = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(math.exp(-0.5 * (k / sigma) ** 2)).alias("g")) for k in range(-radius, radius + 1)))
    spread = df.select(*keys, at, value).withColumn("__w", F.explode(kernel))
    spread = spread.select(*keys, (F.col(at) + F.col("__w.k")).cast(dict(df.dtypes)[at]).alias(at), (F.col(value) * F.col("__w.g")).alias("v"), F.when(F.col(value).isNotNull(), F.col("__w.g")).alias("g"))
    sums = spread.groupBy(*keys, at).agg(F.sum("v").alias("v"), F.sum("g").alias("g"))
    return df.join(sums.select(*keys, at, (F.col("v") / F.col("g")).alias(out)), [*keys, at], "left")


def decimate(df: DataFrame, at: str, step: int) -> DataFrame:
    return df.filter(F.col(at) % step == 0)


def expand_conditions(df: DataFrame, group: str = "group_label", locality: str = "locality", tags: str = "cog_labels") -> DataFrame:
    """Each row once for every condition it belongs to: all, its group, its locality, group x locality, each tag, tag x locality.

    Only rows of group cog+ expand their tags. One pass: the array of (grouping, condition) is exploded.
    """
    g, p = F.col(group), F.col(locality)
    one = lambda kind, c: F.struct(F.lit(kind).alias("grouping"), c.alias("condition"))
    fixed = F.array(one("all", F.lit("all")), one("group", g), one("locality", p), one("group_locality", F.concat_ws("::", g, p)))
    own = F.when(g == "cog+", F.coalesce(F.col(tags), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    by_tag = F.transform(own, lambda t: F.struct(F.lit("tag").alias("grouping"), F.concat(F.lit("cog::"), t).alias("condition")))
    by_both = F.transform(own, lambda t: F.struct(F.lit("tag_locality").alias("grouping"), F.concat(F.lit("cog::"), t, F.lit("::"), p).alias("condition")))
    return df.withColumn("__c", F.explode(F.concat(fixed, by_tag, by_both))).select("*", "__c.*").drop("__c")


def fitting(trials: DataFrame, extent: DataFrame, keys: list[str], lo: Column, hi: Column) -> DataFrame:
    """Trials whose window [lo, hi] lies in [0, duration] of their keys' recording."""
    return trials.join(extent.select(*keys, "duration"), keys).filter((lo >= 0) & (hi <= F.col("duration"))).drop("duration")


def allowed(df: DataFrame, column: str, names: list[str] | None = None, table: DataFrame | None = None) -> DataFrame:
    """Rows whose column is in an allow-list, a short list or a one-column table; no list allows everything."""
    if names is not None:
        df = df.filter(F.col(column).isin(names))
    return df if table is None else df.join(table.select(F.col(table.columns[0]).alias(column)).distinct(), column, "left_semi")


def bin_validity(windows: DataFrame, dead: DataFrame, keys: list[str], dead_keys: list[str], width: int, min_live: float = 0.8) -> DataFrame:
    """(windows' keys, dead_keys, dead, strict_valid, valid) of windows [lo, hi) that dead time touches; all others are valid.

    strict_valid: no overlap at all; valid: a share of min_live or more is live. Dead intervals must be disjoint.
    """
    shared = [k for k in dead_keys if k in windows.columns]
    both = iv.overlap(windows, dead, shared, "lo", "hi", "s", "e", width)
    per = both.groupBy(*dict.fromkeys([*keys, *dead_keys]), "lo", "hi").agg(F.sum("overlap").alias("dead"))
    live = F.col("hi") - F.col("lo") - F.col("dead")
    return per.select(*dict.fromkeys([*keys, *dead_keys]), "dead", (F.col("dead") <= 0).alias("strict_valid"), (live >= min_live * (F.col("hi") - F.col("lo"))).alias("valid"))


def same_axis(df: DataFrame, session: str, by: list[str], axis: str) -> DataFrame:
    """(by, n_sessions, n_axes, same): do all sessions have the same set of axis values. Sets are compared by count and hash sum."""
    h = F.xxhash64(axis).cast("decimal(38,0)")
    per = df.select(session, *by, axis).distinct().groupBy(session, *by).agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h"))
    out = per.groupBy(*by).agg(F.count(F.lit(1)).alias("n_sessions"), F.countDistinct("n", "h").alias("n_axes"))
    return out.withColumn("same", F.col("n_axes") == 1)


def min_trials(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows of the groups that have n rows or more."""
    return df.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*keys))).filter(F.col("__n") >= n).drop("__n")


def locality(channel_shaft: Column, stim_shaft: Column) -> Column:
    return F.when(channel_shaft.isNull() | stim_shaft.isNull(), "unknown").when(channel_shaft == stim_shaft, "local").otherwise("distant")
