"""Pipeline over documents: drop toxic ones, remove repeated lines, drop near duplicates, mix sources, pack."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import length_histogram, line_dedup, mixing, packing, simhash, toxicity
from llm.common import cut, load, shared_dir
from llm.queries import training_labels


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7; the model learns from labels of the training folds.

    NULL and empty texts are scored as documents of no words and stay, unless such documents were labelled toxic. Equal
    texts, repeated rows among them, stay or go together. An empty table gives no rows.
    """
    model = toxicity.fit(docs, training_labels(load(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the multi-line chunks that occur before; n_chars follows the text.

    A NULL text stays NULL with n_chars NULL; a document that loses all its lines stays, with an empty text. Repeated rows of
    one id lose the same chunks. An empty table gives no rows.
    """
    out = line_dedup.line_dedup(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, five words and similarity 0.8, and all others.

    NULL and empty texts and rows of NULL id stay; repeated rows of one id stay or go together. An empty table gives no rows.
    """
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of a Pfair mix of sources by the square root of their sizes.

    A NULL source is a source of its own; repeated rows stay, each in its own place. An empty table gives no rows.
    """
    return mixing.mixed(docs, mixing.tempered_weights(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its bin and its slot in the mix; a block of bins is a range of slots.

    Lengths are encoded tokens, a piece's start and its offset in the bin count tokens. The slots follow from ids, sources
    and weights alone, so they are those of the stage before. NULL and empty texts are pieces of length 0; repeated
    rows are packed as often as they occur. An empty table gives no rows.
    """
    rows = cut(length_histogram.with_lengths(docs, "n"))  # several steps read the lengths
    rows = mixing.mix(rows, mixing.tempered_weights(rows))
    return packing.pack_in_order(rows, "mix_slot", F.col("n"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Scores of a fitted model and fingerprints have no SQL form; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
