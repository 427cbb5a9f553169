"""Line dedup with content-defined chunks of lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import cut, versions

#: A line is marked if the hash of it and the line before is a multiple of this.
MARKED = 2
#: Hashes that are dealt over several tasks at most; each holds more than this share of the repeated chunks.
HOT = 4096


def _with_chunks(docs: DataFrame, text: str) -> DataFrame:
    """Adds `parts`, an array of chunks. Joining the chunks by line feeds gives the text.

    The rolling hash of a line and the one before marks lines. A chunk begins at a marked line after an unmarked
    one, so that it depends on three lines, and an inserted line moves only the boundaries beside it. A boundary leaves two
    lines at least on both sides; only a text of one line is a chunk of one.
    """
    lines = docs.withColumn("lines", F.split(F.col(text), "\n"))
    pair = F.zip_with(F.slice("lines", F.lit(1), F.greatest(F.size("lines") - 1, F.lit(0))), F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(0))), lambda a, b: F.conv(F.substring(F.md5(F.concat(a, F.lit("\n"), b)), 1, 8), 16, 10).cast("long") % MARKED == 0)
    lines = lines.withColumn("marks", pair)
    starts = F.filter(
        F.sequence(F.lit(1), F.size("lines")),
        lambda i: (i == 1) | ((i > 2) & (i < F.size("lines")) & F.get("marks", i - 2) & ~F.get("marks", i - 3)),
    )
    lines = lines.withColumn("starts", starts)
    ends = F.transform("starts", lambda s, k: F.coalesce(F.get("starts", k + 1), F.size("lines") + 1))
    lines = lines.withColumn("ends", ends)
    parts = F.zip_with("starts", "ends", lambda s, e: F.struct(F.array_join(F.slice("lines", s, e - s), "\n").alias("chunk"), (e - s).alias("n_lines")))
    return lines.withColumn("parts", parts).drop("lines", "marks", "starts", "ends")


def repeated_chunks(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """(id, t, chunk_no) of each chunk of min_lines lines or more whose bytes occur at a smaller (id, chunk_no).

    docs has (id, t, text). Hashes only find candidates: counts of 16-byte hashes combine map-side, then the chunks with a repeated
    hash meet by hash and bytes. A hash that holds more than a share of 1 / HOT of the repeated chunks is dealt over several
    tasks; at most HOT of them can be, and they are broadcast. A NULL id comes first.
    """
    chunks = _with_chunks(docs, "text")
    # The outer form: the plain one would push a filter on size(parts), and so all of parts, into the scan.
    chunks = chunks.select("id", "t", F.posexplode_outer("parts").alias("chunk_no", "part"))
    chunks = chunks.select("id", "t", "chunk_no", F.col("part.chunk").alias("chunk"), F.col("part.n_lines").alias("n_lines"))
    chunks = chunks.filter(F.col("n_lines") >= min_lines).withColumn("hash", F.md5("chunk"))
    twice = cut(chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    total = twice.agg(F.sum("n")).first()[0] or 0
    twice = twice.withColumn("salts", F.ceil(F.col("n") * HOT / max(1, total)).cast("int"))
    hot = F.broadcast(twice.filter("salts > 1").select("hash", "salts"))
    salted = chunks.join(hot, "hash", "left").withColumn("salt", F.pmod(F.xxhash64("id", "t", "chunk_no"), F.coalesce("salts", F.lit(1))).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    again = salted.drop("salts").join(twice.select("hash", every), ["hash", "salt"], "left_semi")
    first = again.groupBy("hash", "chunk").agg(F.min(F.struct("id", "chunk_no")).alias("first"))
    first = first.join(twice.select("hash", "salts"), "hash").select("hash", "chunk", "first", every)
    met = again.join(first, ["hash", "salt", "chunk"])
    return met.filter(~F.struct("id", "chunk_no").eqNullSafe(F.col("first"))).select("id", "t", "chunk_no")


def line_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_lines: int = 2) -> DataFrame:
    """docs with repeated multi-line chunks removed from `text`, and n_chunks, n_removed.

    The first place of a chunk, the smallest (id, number in the document), keeps it. NULL text stays NULL with 0 chunks; an
    empty text is one empty line. A document that loses all its chunks keeps its row, with an empty text. Each row is
    judged by its own text: equal rows keep the same chunks, and rows of one id with different texts don't touch each
    other's. A NULL id comes first. Own columns called n_chunks or n_removed are replaced. An empty table gives no rows.
    """
    gone = repeated_chunks(versions(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))), min_lines)
    gone = gone.groupBy("id", "t").agg(F.collect_set("chunk_no").alias("gone"))
    # t is 0 or, where an id has several texts, a hash of the text: either names the row's chunks.
    gone = gone.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("t", "gone"))).alias("by_text"))
    own = [c for c in docs.columns if c not in ("n_chunks", "n_removed")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col(id_col).alias("key"), F.col(text).alias("body"))
    rows = rows.join(gone, rows["key"].eqNullSafe(gone["id"]), "left")
    mine = F.coalesce(F.try_element_at("by_text", F.lit(0).cast("long")), F.try_element_at("by_text", F.xxhash64(F.coalesce("body", F.lit("")))))
    touched = _with_chunks(rows.select("row", mine.alias("gone"), "body"), "body")
    kept = F.filter("parts", lambda p, k: ~F.coalesce(F.array_contains("gone", k), F.lit(False)))
    kept_text = F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(F.transform(kept, lambda p: p["chunk"]), "\n"))
    return touched.select(
        *((kept_text if c == text else F.col("row")[c]).alias(c) for c in own),
        F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias("n_chunks"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
