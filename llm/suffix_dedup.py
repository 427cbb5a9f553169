"""Suffix-array dedup on bytes: common prefixes by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import superkmers as sk
from llm.common import key_runs, partitions, shared_dir, versions

SIZE = 100
ANCHOR = 36
#: Contents of one minimiser that go to one block whole; more are cut to windows, which are dealt to blocks by a hash.
PEERS = 2000


def suffix_order(x: np.ndarray, depth: int) -> np.ndarray:
    """Positions of x (symbols below 512), sorted by the `depth` symbols or more from there on."""
    n, span = len(x), 7
    key = np.zeros(n, np.uint64)
    padded = np.r_[x, np.zeros(span, x.dtype)].astype(np.uint64)
    for i in range(span):
        key = (key << np.uint64(9)) | padded[i : i + n]
    while True:
        order = np.argsort(key)
        if span >= depth:
            return order
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.r_[np.uint64(1), (ranked[1:] != ranked[:-1]).astype(np.uint64)])
        if rank[order[-1]] == n:
            return order
        key = (rank << np.uint64(32)) | np.r_[rank[span:], np.zeros(min(span, n), np.uint64)][:n]
        span *= 2


def short_prefixes(x: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """True at row r if suffixes r - 1 and r have a common prefix shorter than `size` (0 in x: a separator).

    Breadth-first over strings by length: the interval of a string is extended backward by each symbol
    before it, through the last-to-first map. The right end of an interval that no shorter string has reached gets
    its common prefix, the string's length less 1, and only such intervals go on. So prefixes come out by
    increasing value, and the search stops when the length reaches `size`.
    """
    n = len(x)
    before = x[order - 1]
    by = np.argsort(before, kind="stable")
    last_to_first = np.empty(n, np.int64)
    last_to_first[by] = np.arange(n)
    short = np.zeros(n + 1, bool)
    short[0] = short[n] = True
    lo, hi = np.array([0]), np.array([n])
    for length in range(size):
        many = hi - lo
        rows = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        key = np.repeat(np.arange(len(lo)) << 9, many) | before[rows]
        group = np.argsort(key, kind="stable")
        key = key[group]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        new_lo = last_to_first[rows[group[head]]]
        new_hi = new_lo + np.diff(np.r_[head, len(key)])
        good = ~short[new_hi] if length else np.ones(len(new_hi), bool)
        short[new_hi] = True
        good &= ((key[head] & 511) != 0) | (length == 0)
        lo, hi = new_lo[good], new_hi[good]
        if not len(lo):
            break
    return short[:n]


def later_windows(contents: list[bytes], place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content, offset, length) of bytes covered by windows that also stand at an earlier place.

    place: a number for the place of each content's first byte; the next bytes have the next numbers.
    """
    n = np.array([len(c) for c in contents])
    stop = np.cumsum(n + 1)
    start = stop - n - 1
    x = np.zeros(int(stop[-1]), np.int64)
    inside = np.ones(len(x), bool)
    inside[stop - 1] = False
    x[inside] = np.frombuffer(b"".join(contents), np.uint8).astype(np.int64) + 1
    order = suffix_order(x, size)
    group = np.cumsum(short_prefixes(x, order, size))
    owner = np.repeat(np.arange(len(n)), n + 1)
    whole = np.arange(len(x)) + size <= stop[owner] - 1
    rows = np.flatnonzero(whole[order])
    at, group = order[rows], group[rows]
    if not len(rows):
        return np.empty(0, int), np.empty(0, int), np.empty(0, int)
    new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    where = place[owner[at]] + at - start[owner[at]]
    first = np.minimum.reduceat(where, new)
    later = np.sort(at[where != np.repeat(first, np.diff(np.r_[new, len(at)]))])
    if not len(later):
        return np.empty(0, int), np.empty(0, int), np.empty(0, int)
    head = np.r_[True, (later[1:] != later[:-1] + 1) | (owner[later[1:]] != owner[later[:-1]])]
    begin = later[head]
    end = later[np.r_[head[1:], True]] + size
    return owner[begin], begin - start[owner[begin]], end - begin


def contents(docs: DataFrame, rest: DataFrame, size: int, peers: int) -> DataFrame:
    """(h, part, id, t, start, c): the bytes of each super-k-mer in `rest`, and the block they go to.

    A minimiser of up to `peers` contents is one block, of whole super-k-mers. Those of a more frequent one are cut to
    windows, and the window's own hash picks one of as many blocks as bounds each to about `peers` contents' windows.
    """
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = sk.text_bytes(b.column(2))
            h, at = sk.column_of(b.column(3), "h")
            start, _ = sk.column_of(b.column(3), "start")
            n, _ = sk.column_of(b.column(3), "n")
            many, _ = sk.column_of(b.column(3), "peers")
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            times = np.where(many > peers, n - size + 1, 1)
            of = np.repeat(np.arange(len(n)), times)
            begin = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            length = np.where(many > peers, size, n)[of]
            first = off[row[of]] + begin
            cut = [data[i:j].tobytes() for i, j in zip(first.tolist(), (first + length).tolist(), strict=True)]
            part = np.zeros(len(of), np.int64)
            for i in np.flatnonzero(many[of] > peers).tolist():
                part[i] = zlib.crc32(cut[i]) % (-(-int(many[of[i]]) // peers) * size)
            where = pa.array(row[of])
            cols = [pa.array(h[of]), pa.array(part), b.column(0).take(where), b.column(1).take(where), pa.array(begin.astype(np.int32)), pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["h", "part", "id", "t", "start", "c"])

    joined = sk.with_rows(docs, rest, ["h", "start", "n", "peers"])
    return joined.select("id", "t", "text", "rows").mapInArrow(run, f"h long, part long, id {kind}, t long, start int, c binary")


def repeated_spans(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR, peers: int = PEERS) -> DataFrame:
    """(id, t, start, n, source): bytes covered by windows of `size` bytes that also start earlier; spans may overlap.

    docs has (id, t, text). Super-k-mers carry the windows. One that occurs whole at an earlier place is one suffix interval
    of equal contents: it goes if its bytes have the digest of those at the source coordinate. The bytes of those that
    share part of their windows meet, by minimiser, in blocks of bounded size, each of which gets a Burrows-Wheeler
    transform. Equal windows have equal minimisers, and equal hashes where a minimiser has more than one block, so no
    repeat crosses blocks. Blocks compare bytes; their spans have no digest.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/suffix-{uuid.uuid4().hex}"
    rows = sk.write(sk.repeats(docs, size, anchor, False), folder, "repeats")
    kind = dict(docs.dtypes)["id"]
    blocks = contents(docs, rows.filter("NOT copy"), size, peers)
    blocks = blocks.withColumn("block", F.xxhash64("h", "part")).drop("h", "part")
    blocks = blocks.repartition(partitions(spark), "block").sortWithinPartitions("block", "id", "start")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches, "block"):
            t = t.combine_chunks()
            ids = t["id"].combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            rank = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
            start = t["start"].to_numpy().astype(np.int64)
            owner, offset, n = later_windows(t["c"].to_pylist(), (rank << 32) | start, size)
            where = pa.array(owner)
            version = t["t"].combine_chunks()
            version = version.chunk(0) if isinstance(version, pa.ChunkedArray) else version
            yield pa.RecordBatch.from_arrays([ids.take(where), version.take(where), pa.array((start[owner] + offset).astype(np.int32)), pa.array(n.astype(np.int32))], ["id", "t", "start", "n"])

    parts = sk.write(blocks.mapInArrow(find, f"id {kind}, t long, start int, n int"), folder, "parts")
    whole = rows.filter("copy").select("id", "t", "start", "n", "src", "src_t", "src_start")
    whole = sk.with_sources(docs, sk.write(sk.spans(whole), folder, "spans"), False)
    return whole.union(parts.withColumn("source", F.lit(None).cast("binary")))


def suffix_dedup(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR, id_col: str = "doc_id", text: str = "text", kept: bool = False) -> DataFrame:
    """One row for each document: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes.

    Each byte covered by a window of `size` bytes of UTF-8 that also starts earlier (smaller id, or same id and
    earlier start) goes. NULL, empty and short texts lose nothing. Each row is judged by its own text: equal rows keep the
    same bytes, and in rows of one id with different texts a window goes if it starts earlier in any of them. A
    NULL id is before all others, and all NULL ids are one id. Texts of any length are taken whole. An empty table gives no
    rows; other columns are not read.
    """
    rows = versions(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")))
    out = sk.covered(rows, repeated_spans(rows, size, anchor), False, ["kept"] if kept else [])
    named = [F.col("id").alias(id_col), F.col("total").alias("n_bytes"), F.col("removed").alias("n_removed"), F.col("runs").alias("n_spans"), "kept_sha256"]
    return out.select(*named, *(["kept"] if kept else []))
