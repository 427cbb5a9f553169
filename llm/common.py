"""Helpers that the operators share: reading, checkpoints, salted ranks, grouped batches, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and drops its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def versions(docs: DataFrame) -> DataFrame:
    """(id, t, text) of docs (id, text): t is 0, but a hash of the text where one id has different texts, so (id, t) names a text."""
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    clash = docs.groupBy("id").agg(F.min(h).alias("a"), F.max(h).alias("b")).filter("a <> b").select(F.col("id").alias("clash"), F.lit(True).alias("many"))
    clash = cut(clash)
    if clash.isEmpty():
        return docs.select("id", F.lit(0).cast("long").alias("t"), "text")
    return docs.join(clash, F.col("id").eqNullSafe(F.col("clash")), "left").select("id", F.when(F.col("many"), h).otherwise(0).alias("t"), "text")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Words of a text, unchanged; NULL gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")


def salted_rank(df: DataFrame, keys: list[str], order: list[Column], salt: Column, out: str) -> DataFrame:
    """Adds out = rank from 0 within keys by (salt, order); salt is an int column.

    A key that holds a third of all rows is spread over its salts: ranks within (keys, salt) are offset by the
    counts of the salts before, which are one row for each key and salt.
    """
    at = df.withColumn("__salt", salt)
    counts = at.groupBy(*keys, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)
    named = [F.col(k).alias(f"__{k}") for k in [*keys, "__salt"]]
    offsets = counts.select(*named, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    cond = F.col("__salt").eqNullSafe(F.col("____salt"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = at.join(offsets, cond).drop(*(f"__{k}" for k in [*keys, "__salt"]))
    within = W.partitionBy(*keys, "__salt").orderBy(*order)
    return joined.withColumn(out, F.col("__before") + F.row_number().over(within) - 1).drop("__salt", "__before")


def key_runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, from batches that are sorted by key; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        if held and held[-1].column(key)[0].as_py() == k[-1]:
            held.append(b)
            continue
        last = int(np.searchsorted(k != k[-1], False)) if k[0] == k[-1] else int(np.flatnonzero(k != k[-1])[-1]) + 1
        if last or held:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """Connected components of undirected links (a, b): one row (node, root) for each node, root the smallest node.

    Alternating large-star and small-star steps until the links are stars; each step is a shuffle of the links, each
    round is checkpointed, and nothing but the answer whether it is done goes to the driver. A hub with a third of all nodes
    is safe: the steps need each node's smallest neighbour, a map-side combined minimum, and a join that Spark can split.
    """
    links = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    for _ in range(rounds):
        ends = links.select(F.col("a").alias("x"), F.lit(1).alias("up")).union(links.select(F.col("b").alias("x"), F.lit(0).alias("up")))
        ends = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("lo"), F.max("up").alias("hi"))
        if ends.filter("ups > 1 OR lo <> hi").isEmpty():
            break
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        links = cut(small.filter("a <> b").distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
