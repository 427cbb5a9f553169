"""Token counts: an exact histogram of encoded lengths, and suffix sums that answer totals for every context limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from llm.common import cut

#: Fixed value: how byte-level BPE vocabularies of this kind split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_loaded: dict = {}


def _encoding(path: str):
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row (id, n_tokens) for each document; NULL or empty text has 0 tokens. Texts of any length are encoded whole.

    Repeated rows stay, columns besides id and text are not read, an empty table gives no rows. The vocabulary file is read once by each Python worker from a path that every machine has.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary).encode_ordinary
        for b in batches:
            n = [len(encode(t.as_py())) if t.is_valid else 0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], [id_col, "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text).mapInArrow(count, f"`{id_col}` {kind}, n_tokens long")


def with_lengths(docs: DataFrame, out: str, vocabulary: str = VOCABULARY, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """Columns `keep` of docs and the encoded length `out` of the text."""
    row = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")
    rows = encoded_lengths(docs.select(row, F.col(text).alias("text")), vocabulary, "text", "row")
    return rows.select(*(F.col("row")[c].alias(c) for c in keep), F.col("n_tokens").alias(out))


def length_histogram(lengths: DataFrame, length: str = "n_tokens", band: int = 512) -> DataFrame:
    """Histogram with suffix sums, one row for each length L that occurs.

    n_docs: documents of exactly L tokens. docs_at_least, tokens_at_least: count and tokens of documents with L
    or more. truncated_total: tokens kept when every document is cut at L, the sum of min(n, L). share_at_most:
    share of documents that fit into L, so quantile q is the smallest L with share_at_most >= q. An empty table
    gives no rows. NULL lengths are left out. Counts combine map-side; the histogram, one row a length, is written once; the sums
    run within bands of lengths and over the bands' totals.
    """
    hist = cut(lengths.filter(F.col(length).isNotNull()).groupBy(F.col(length).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs")))
    hist = hist.withColumn("band", F.expr(f"n_tokens div {band}"))
    within = W.partitionBy("band").orderBy(F.desc("n_tokens"))
    sums = hist.withColumns({
        "d": F.sum("n_docs").over(within),
        "t": F.sum(F.col("n_docs") * F.col("n_tokens")).over(within),
    })
    totals = hist.groupBy("band").agg(F.sum("n_docs").alias("bd"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("bt"))
    above = W.orderBy(F.desc("band")).rowsBetween(W.unboundedPreceding, -1)
    everywhere = W.orderBy(F.desc("band")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    later = totals.select(
        "band",
        F.coalesce(F.sum("bd").over(above), F.lit(0)).alias("ad"),
        F.coalesce(F.sum("bt").over(above), F.lit(0)).alias("at"),
        F.sum("bd").over(everywhere).alias("all_docs"),
        F.sum("bt").over(everywhere).alias("all_tokens"),
    )
    out = sums.join(later, "band").withColumns({
        "docs_at_least": F.col("d") + F.col("ad"),
        "tokens_at_least": F.col("t") + F.col("at"),
    })
    below = F.col("all_tokens") - F.col("tokens_at_least")
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (below + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("share_at_most"),
    )


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that holds at least a share q of the documents."""
    return histogram.filter(F.col("share_at_most") >= F.lit(q)).agg(F.min("n_tokens").alias("n_tokens"))


def total_at(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: documents, and tokens kept with a context limit, whether or not a document has that length."""
    n = F.col("n_tokens")
    return histogram.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"),
        F.coalesce(F.sum(F.col("n_docs") * F.least(n, F.lit(limit))), F.lit(0)).alias("n_kept"),
    )
