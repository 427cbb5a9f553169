"""Order statistics of groups of any size: running folds, ranks, quantiles and steps of ordered values, without a window over a group.

Values are counted first, by map-side sums, so that ties are one row however many they are. The order-preserving code of a value, 64 bits,
is read as four digits of 16 bits. Folds are taken over each digit among rows that share the digits before it, and carried down from
one digit to the next by equality. So a window holds 65536 rows at most, whatever the size of the group and the spread of its values; nothing is
sampled and no split depends on the data.

Quantiles and `ranked_by_range` deal counted values by ranges of key and code, as a sort is, and checkpoint them. Folds are taken within each
range and joined to those of the ranges before it. A window holds a partition of the sort; where ranges are cut is sampled, and no result depends on it.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

DIGIT = 16


@F.pandas_udf(T.LongType())
def _double_code(x: pd.Series) -> pd.Series:
    """Longs in the order of the doubles; -0.0 and 0.0 are one, NaN is the largest."""
    bits = (x.to_numpy(np.float64, na_value=np.nan) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))


def code(df: DataFrame, value: str) -> Column:
    """Order-preserving long of a column that isn't NULL: integers as they are, other numbers as doubles."""
    kind = df.schema[value].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(value).cast("long")
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"{value} is no number")
    return _double_code(F.col(value).cast("double"))


def met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left with right's other columns where the columns `on` are equal or both NULL."""
    own = right.select(*(F.col(k).alias(f"__on_{k}") for k in on), *(c for c in right.columns if c not in on))
    cond = F.lit(True)
    for k in on:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__on_{k}"))
    return left.join(own, cond, how).drop(*(f"__on_{k}" for k in on))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share: the session's spark.checkpoint.dir, or in a local session without one a new folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: driver and executors need a shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read back from the checkpoint folder.

    Counted values are used at every digit; without the cut the plan behind them would be planned, and may be run, as often.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def running(table: DataFrame, keys: list[str], value: str, amount: str, out: str, fold: Callable[[str], Column] = F.sum, merge: Callable[..., Column] | None = None, down: bool = False) -> DataFrame:
    """table with out, the fold of amount over the rows of keys whose value is smaller (greater, if down); NULL for the first.

    One row a (keys, value), values not NULL. fold is an aggregate, and merge joins two of its results of which either may be NULL; without merge they are added.
    """
    if merge is None:
        merge = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    names = [f"__p{i}" for i in range(4)]
    rows = cut(table.withColumn("__p3", code(table, value)))
    levels = [rows]
    for i in (2, 1, 0):
        below = levels[0]
        up = below.groupBy(*keys, F.shiftright(names[i + 1], DIGIT).alias(names[i])).agg(fold(amount).alias(amount))
        levels.insert(0, up)
    carried = None
    for i, level in enumerate(levels):
        head = [*keys, names[i - 1]] if i else keys
        if i:
            level = level.withColumn(names[i - 1], F.shiftright(names[i], DIGIT))
        order = F.col(names[i]).desc() if down else F.col(names[i]).asc()
        level = level.withColumn("__own", fold(amount).over(W.partitionBy(*head).orderBy(order).rowsBetween(W.unboundedPreceding, -1)))
        if carried is None:
            level = level.withColumnRenamed("__own", out)
        else:
            level = met(level, carried, head).withColumn(out, merge(F.col("__own"), F.col("__carried"))).drop("__own", "__carried", names[i - 1])
        carried = level.select(*keys, names[i], F.col(out).alias("__carried"))
    return level.drop("__p3")


def ranked(counted: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """counted, one row a (keys, value) of n rows, with before, the number of rows of smaller values, and rank, the mean rank of its rows."""
    out = running(counted, keys, value, n, "before").withColumn("before", F.coalesce("before", F.lit(0)))
    return out.withColumn("rank", F.col("before") + (F.col(n) + 1) / 2.0)


def spread(table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """table cut after it is dealt by ranges of keys and value: __code orders the values, __part numbers the ranges in their order."""
    rows = table.withColumn("__code", code(table, value)).repartitionByRange(*(F.col(k) for k in keys), F.col("__code"))
    return cut(rows.withColumn("__part", F.spark_partition_id()))


def summed_before(rows: DataFrame, keys: list[str], amount: str, out: str) -> DataFrame:
    """rows of `spread` with out, the sum of amount over the rows of keys before: within its range, and in the ranges before it; 0 for the first."""
    before = lambda by, at: W.partitionBy(*by).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy(*keys, "__part").agg(F.sum(amount).alias("__sum"))
    parts = parts.select(*keys, "__part", F.sum("__sum").over(before(keys, "__part")).alias("__carried"))
    own = rows.withColumn("__own", F.sum(amount).over(before([*keys, "__part"], "__code")))
    total = F.coalesce("__own", F.lit(0)) + F.coalesce("__carried", F.lit(0))
    return met(own, parts, [*keys, "__part"]).withColumn(out, total).drop("__own", "__carried", "__part", "__code")


def ranked_by_range(counted: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """`ranked` by ranges in place of digits: one pass over the counted values in place of four, in windows of a partition of the sort."""
    out = summed_before(spread(counted, keys, value), keys, n, "before")
    return out.withColumn("rank", F.col("before") + (F.col(n) + 1) / 2.0)


def quantiles(df: DataFrame, keys: list[str], x: str, wanted: dict[str, float]) -> DataFrame:
    """(keys, n, lo, hi, one column a name of wanted): exact quantiles of x by linear interpolation, NULL left out.

    The two ranks on either side of a quantile are found among the counted values, so what is summed up in the end is two rows a
    quantile and group. A group without values has n 0 and NULL.
    """
    own = [f"__k{i}" for i in range(len(keys))] or ["__k"]
    rows = df.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=False)), *([] if keys else [F.lit(0).alias("__k")]), F.col(x).alias("__x"))
    values = spread(rows.groupBy(*own, "__x").agg(F.count("__x").alias("__c")), own, "__x")  # NULL counts 0
    sizes = values.groupBy(*own).agg(F.sum("__c").alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    counted = summed_before(values, own, "__c", "before").filter(F.col("__c") > 0)
    at = met(counted, sizes.select(*own, "__n"), own)
    place = lambda q: F.lit(float(q)) * (F.col("__n") - 1)
    ends = F.array(*(F.struct(F.lit(i).alias("i"), place(q).alias("at"), f(place(q)).alias("k")) for i, q in enumerate(wanted.values()) for f in (F.floor, F.ceil)))
    here = F.filter(ends, lambda e: (e["k"] >= F.col("before")) & (e["k"] < F.col("before") + F.col("__c")))
    found = at.select(*own, F.col("__x").cast("double").alias("x"), F.explode(here).alias("e")).select(*own, "x", "e.*")
    pairs = found.groupBy(*own, "i").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.first("at").alias("at"))
    between = (F.floor("at") + 1 - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b")
    pairs = pairs.withColumn("v", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between))
    flat = pairs.groupBy(*own).agg(*(F.max(F.when(F.col("i") == i, F.col("v"))).alias(name) for i, name in enumerate(wanted)))
    out = met(sizes, flat, own, "left")
    return out.select(*(F.col(o).alias(k) for k, o in zip(keys, own, strict=False)), F.col("__n").alias("n"), F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), *wanted)
