"""Runs by session: rules instead of exceptions, outputs replaced by session, finished sessions reused, a ledger of what happened."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evoked.operators.order import cut, met
from evoked.operators.reconcile import ledger

ERROR = "error"


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with error: the first of the messages whose condition holds, NULL for a good row. A condition that is NULL doesn't hold."""
    found = [F.when(bad, F.lit(message)) for message, bad in rules.items()]
    return df.withColumn(ERROR, F.coalesce(*found, F.lit(None).cast("string")))


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at path, or an empty one where no run has written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_sessions(candidates: DataFrame, sources: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, keys: list[str], overwrite: bool = False) -> DataFrame:
    """Runs step for the candidates that have no output at path yet, writes its rows, and returns the ledger.

    step takes the rows of sources of all sessions to do at once and returns rows with keys and a column error (see checked), so one
    plan does all sessions and a session may lie in many tasks. A session with an error anywhere writes nothing, and its least message goes into the
    ledger; the others are written as folders by keys, each in files of balanced size, and replace their own folders only. A run that is
    repeated does what is missing: sessions with errors again, finished ones not, unless overwrite is set. The rows of the step are kept in
    the checkpoint folder, so that errors and output come from one computation.

    Ledger: keys, n_source (rows of the source), n_output (rows now at path), status (ok, reused_existing, skipped_no_source, error)
    and message. Rows of sessions that aren't candidates are left out; keys that are NULL name a session of their own.
    """
    spark = candidates.sparkSession
    names = candidates.select(*keys).distinct()
    own = met(sources, names, keys, "leftsemi")
    empty = step(sources.filter(F.lit(False))).drop(ERROR)
    schema = T.StructType([f for f in empty.schema if f.name not in keys] + [empty.schema[k] for k in keys])
    before = cut(stored(spark, path, schema).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    done = before.filter(F.lit(not overwrite))
    todo = met(names, done.select(*keys), keys, "leftanti")
    rows = cut(step(met(own, todo, keys, "leftsemi")))
    errors = rows.filter(F.col(ERROR).isNotNull()).select(*keys, F.col(ERROR).alias("message"))
    good = met(rows, errors.select(*keys).distinct(), keys, "leftanti").select(*(f.name for f in schema))
    good.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    told = ledger(names, own, done.select(*keys), keys, errors).drop("n_output")
    now = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("written"))
    told = met(met(told, now, keys, "left"), before, keys, "left")
    return told.select(*keys, "n_source", F.coalesce("written", "n", F.lit(0)).cast("long").alias("n_output"), "status", "message")
