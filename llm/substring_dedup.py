"""Substring dedup on words: de Bruijn compaction of repeated windows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from llm import superkmers as sk
from llm.common import shared_dir, versions

SIZE = 20
ANCHOR = 6


def paths(found: DataFrame) -> DataFrame:
    """(e, e2, src, src_t, src_pos, edges): repeated nonbranching paths, by their first edge and their first place.

    Edge f continues edge e if every occurrence of e is followed by f and every occurrence of f is led to by e;
    so whoever takes the first edge of a path takes all of it, and its first place runs along one document. The links
    are one join of repeated edges; along a document, an edge without a link to it begins a path.
    """
    named = {"f": F.min(F.struct("id", "pos", "t")), "n": F.count(F.lit(1))}
    for c in ("before", "after"):
        named |= {f"{c}_n": F.count(c), f"{c}_lo": F.min(c), f"{c}_hi": F.max(c)}
    edges = found.groupBy("e", "e2").agg(*(x.alias(c) for c, x in named.items())).filter("n > 1")

    def only(c: str) -> Column:
        return F.when((F.col(f"{c}_n") == F.col("n")) & (F.col(f"{c}_lo") == F.col(f"{c}_hi")), F.col(f"{c}_lo"))

    edges = edges.select("e", "e2", F.col("f.id").alias("src"), F.col("f.t").alias("src_t"), F.col("f.pos").alias("src_pos"), "n", only("before").alias("before"), only("after").alias("after"))
    place = {"src": "p_src", "src_t": "p_t", "src_pos": "p_pos"}
    leads = edges.filter("after IS NOT NULL").select(F.col("e").alias("lead"), F.col("after").alias("next"), F.col("n").alias("p_n"), *(F.col(c).alias(a) for c, a in place.items()))
    joined = edges.join(leads, (F.col("before") == F.col("lead")) & (F.col("e") == F.col("next")) & (F.col("n") == F.col("p_n")) & F.col("src").eqNullSafe(F.col("p_src")) & (F.col("src_t") == F.col("p_t")) & (F.col("src_pos") == F.col("p_pos") + 1), "left")
    order = W.partitionBy("src", "src_t").orderBy("src_pos")
    begin = F.when(F.col("lead").isNull(), F.col("src_pos"))
    marked = joined.withColumn("path", F.last(begin, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    heads = marked.groupBy("src", "src_t", "path").agg(F.min_by(F.struct("e", "e2"), "src_pos").alias("head"), F.count(F.lit(1)).alias("edges"))
    return heads.select("head.e", "head.e2", "src", "src_t", F.col("path").alias("src_pos"), F.col("edges").cast("int").alias("edges"))


def repeated_spans(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR) -> DataFrame:
    """(id, t, start, n, source): words covered by windows of `size` words that also start earlier; spans may overlap.

    docs has (id, t, text). Super-k-mers carry the windows. One that occurs whole at an earlier place is a path that its
    minimiser compacts; those that share part of their windows become edges of a de Bruijn graph, whose repeated
    nonbranching paths are compacted, and each occurrence of a path's first edge but the first is an occurrence of the path.
    Paths of one document, source and shift are joined to spans, and the words at the source coordinates are
    digested, to be compared with the span's own. Each step is a table in the shared folder, so a lost executor costs
    one step.
    """
    folder = f"{shared_dir(docs.sparkSession)}/substring-{uuid.uuid4().hex}"
    rows = sk.write(sk.repeats(docs, size, anchor, True), folder, "repeats")
    found = sk.write(sk.windows(docs, rows.filter("NOT copy"), size, True), folder, "edges")
    known = sk.write(paths(found), folder, "paths").withColumnRenamed("e", "k").withColumnRenamed("e2", "k2")
    met = found.select("e", "e2", "id", "t", "pos").join(known, (F.col("e") == F.col("k")) & (F.col("e2") == F.col("k2")))
    met = met.filter(~F.struct("id", "pos").eqNullSafe(F.struct(F.col("src").alias("id"), F.col("src_pos").alias("pos"))))
    met = met.select("id", "t", F.col("pos").alias("start"), (F.col("edges") + size - 1).alias("n"), "src", "src_t", F.col("src_pos").alias("src_start"))
    whole = rows.filter("copy").select(*met.columns)
    return sk.with_sources(docs, sk.write(sk.spans(whole.union(met)), folder, "spans"), True)


def substring_dedup(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR, id_col: str = "doc_id", text: str = "text", kept: bool = False) -> DataFrame:
    """One row for each document: id, n_words, n_removed, n_spans, kept_sha256 and, if asked for, the kept words.

    Each word covered by a window of `size` words whose sequence also starts earlier (smaller id, or same id
    and earlier start) goes. Kept words are joined by one space. NULL, empty and short texts lose nothing. Each row is
    judged by its own text: equal rows keep the same words, and in rows of one id with different texts a window goes if
    it starts earlier in any of them. A NULL id is before all others, and all NULL ids are one id. Texts of any
    length are taken whole. An empty table gives no rows; other columns are not read.
    """
    rows = versions(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")))
    spans = repeated_spans(rows, size, anchor)
    out = sk.covered(rows, spans, True, ["kept"] if kept else [])
    named = [F.col("id").alias(id_col), F.col("total").alias("n_words"), F.col("removed").alias("n_removed"), F.col("runs").alias("n_spans"), "kept_sha256"]
    return out.select(*named, *([F.decode("kept", "UTF-8").alias("kept")] if kept else []))
