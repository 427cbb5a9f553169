"""Windows of L units (bytes or words) packed into super-k-mers: runs of windows that share their minimiser.

A window's minimiser is its k-mer of least hash, the leftmost on a tie, so equal windows have equal minimisers
wherever they stand, and windows under different minimisers differ. A corpus of n units gives about
2 n / (L - k + 2) super-k-mers instead of n windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from llm.common import partitions

#: Units that are worked on at once; a longer document is cut into overlapping pieces.
CHUNK = 1 << 20
_POSITION = np.uint64((1 << 22) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BYTE = np.random.default_rng(20240101).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n + 1, CHUNK + 1)
        _powers[base] = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (base, pow(base, -1, 2**64)))
    return _powers[base]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_sums(x: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * powers(base, len(x))[0][: len(x)], out=out[1:])
    return out


def digest(sums: np.ndarray, base: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of units start..stop-1, wherever they stand."""
    return mixed((sums[stop] - sums[start]) * powers(base, len(sums))[1][start])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """out[i] = min(x[i : i + w]), for i up to len(x) - w."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def super_kmers(x: np.ndarray, ends: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser hash, content digest, first unit, number of units) of each super-k-mer.

    x: hashes of units; ends[i]: where the document of unit i ends in x.
    """
    n = len(x)
    if n < size:
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    base, other = _BASES
    sums = prefix_sums(x, base)
    inverse = powers(base, n)[1]
    h = mixed((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
    keyed = (h & ~_POSITION) | np.arange(n - k + 1, dtype=np.uint64)
    at = np.arange(n)
    keyed[ends[: n - k + 1] < at[: n - k + 1] + k] = np.uint64(2**64 - 1)
    least = (sliding_min(keyed, size - k + 1) & _POSITION).astype(np.int64)
    good = ends[: n - size + 1] >= at[: n - size + 1] + size
    new = np.ones(len(good), bool)
    new[1:] = (least[1:] != least[:-1]) | ~good[:-1]
    first = np.flatnonzero(new & good)
    stop = np.flatnonzero(np.r_[new[1:] | ~good[1:], True] & good) + size
    return h[least[first]], digest(prefix_sums(x, other), other, first, stop), first, stop - first


@dataclass
class Piece:
    """Units of some documents: hashes, ends of documents, the batch row and unit number of each unit's document start."""

    x: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    origin: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and offsets of its rows (NULL: no bytes)."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    if column.null_count:
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(off), 0)
        if (np.diff(off) != sizes).any():
            return text_bytes(column.fill_null(b""))
    return data, off


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the offset of each row's first word (as off is of bytes)."""
    lo, hi = int(off[0]), int(off[-1])
    space = np.ones(hi - lo + 2, bool)
    space[1:-1] = _SPACE[data[lo:hi]]
    cut = np.zeros(hi - lo + 1, bool)
    cut[off - lo] = True
    letter = ~space[1:-1]
    start = np.flatnonzero(letter & (space[:-2] | cut[:-1])) + lo
    stop = np.flatnonzero(letter & (space[2:] | cut[1:])) + 1 + lo
    return start, stop, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.empty(0, np.uint64)
    lo, hi = int(start[0]), int(stop[-1])
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # so many words at a time that the sums stay short
        j = max(i + 1, int(np.searchsorted(stop, start[i] + CHUNK, side="right")))
        sums = prefix_sums(_BYTE[data[start[i] : stop[j - 1]]], _BASES[0])
        out[i:j] = digest(sums, _BASES[0], start[i:j] - start[i], stop[i:j] - start[i])
        i = j
    return out | np.uint64(1)


def pieces(units: np.ndarray, off: np.ndarray, size: int) -> Iterator[Piece]:
    """Documents' units in chunks; off: offsets of rows in units. Documents of fewer than `size` units are left out."""
    rows = np.flatnonzero(np.diff(off) >= size)
    i = 0
    while i < len(rows):
        if off[rows[i] + 1] - off[rows[i]] > CHUNK:
            r = rows[i]
            for s in range(int(off[r]), int(off[r + 1]) - size + 1, CHUNK - size + 1):
                e = min(s + CHUNK, int(off[r + 1]))
                yield Piece(units[s:e], np.full(e - s, e - s), np.full(e - s, r), np.full(e - s, s - off[r]) + np.arange(e - s))
            i += 1
            continue
        j = i
        total = 0
        while j < len(rows) and (n := off[rows[j] + 1] - off[rows[j]]) <= CHUNK and total + n <= CHUNK:
            total += n
            j += 1
        part = rows[i:j]
        n = off[part + 1] - off[part]
        last = np.cumsum(n)
        origin = np.arange(total) - np.repeat(last - n, n)
        x = units[np.repeat(off[part], n) + origin] if (np.diff(part) != 1).any() else units[off[part[0]] : off[part[-1] + 1]]
        yield Piece(x, np.repeat(last, n), np.repeat(part, n), origin)
        i = j


def units_of(column: pa.Array, of_words: bool) -> tuple[np.ndarray, np.ndarray]:
    data, off = text_bytes(column)
    if of_words:
        start, stop, rows = word_spans(data, off)
        return word_hashes(data, start, stop), rows
    return data, off


def _copies(h: np.ndarray, g: np.ndarray, n: np.ndarray, place: np.ndarray, version: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Within a batch: rows to keep, how many rows each stands for, and for rows of an earlier place's content that place's row, else -1.

    Rows of one place and one text are one row. Rows of one place and different texts are kept: none is earlier.
    """
    m = np.ones(len(h), np.int32)
    keep = np.ones(len(h), bool)
    source = np.full(len(h), -1)
    by = np.argsort(h, kind="stable")
    same = h[by][1:] == h[by][:-1]
    some = by[np.r_[same, False] | np.r_[False, same]]
    some = some[np.lexsort((version[some], place[some], n[some], g[some], h[some]))]
    if not len(some):
        return keep, m, source
    new = np.r_[True, (h[some][1:] != h[some][:-1]) | (g[some][1:] != g[some][:-1]) | (n[some][1:] != n[some][:-1])]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(some)])
    again = np.r_[False, ~new[1:] & (place[some][1:] == place[some][:-1]) & (version[some][1:] == version[some][:-1])]
    head = np.repeat(some[first], size)
    late = place[some] > place[head]
    keep[some[again | late]] = False
    source[some[late & ~again]] = head[late & ~again]
    m[some[first]] = np.add.reduceat((late | again).astype(np.int32), first) + 1
    return keep, m, source


def _diagonals(row: np.ndarray, start: np.ndarray, n: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, n, source row, source start) of copied runs: those that overlap with one shift to one source are joined."""
    i = np.flatnonzero(source >= 0)
    j = source[i]
    shift = start[i] - start[j]
    by = np.lexsort((start[i], shift, row[j], row[i]))
    i, j, shift = i[by], j[by], shift[by]
    if not len(i):
        return i, i, i, i, i
    stop = start[i] + n[i]
    new = np.r_[True, (row[i][1:] != row[i][:-1]) | (row[j][1:] != row[j][:-1]) | (shift[1:] != shift[:-1]) | (start[i][1:] > stop[:-1])]
    head = np.flatnonzero(new)
    return row[i[head]], start[i[head]], np.maximum.reduceat(stop, head) - start[i[head]], row[j[head]], start[j[head]]


def find_super_kmers(docs: DataFrame, size: int, k: int, of_words: bool) -> DataFrame:
    """(h, g, id, t, start, n, m, src, src_t, src_start) over docs (id, t, text): minimiser hash, content digest, and the place.

    Equal contents of one batch are combined before any shuffle: the one of the smallest place stands for m rows. The
    others have m = 0 and the place they were copied from, joined to the longest runs of one shift; their h scatters them.
    """
    kind = dict(docs.dtypes)["id"]
    names = ["h", "g", "id", "t", "start", "n", "m", "src", "src_t", "src_start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units, off = units_of(b.column(2), of_words)
            found = []
            for p in pieces(units, off, size):
                h, g, first, n = super_kmers(p.x if of_words else _BYTE[p.x], p.ends, size, k)
                found.append((h, g, p.row[first], p.origin[first].astype(np.int64), n.astype(np.int64)))
            if not found:
                continue
            h, g, row, start, n = map(np.concatenate, zip(*found, strict=True))
            rank = pc.rank(b.column(0), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
            keep, m, source = _copies(h, g, n, (rank[row] << 40) | start, b.column(1).to_numpy()[row])
            c_row, c_start, c_n, c_src, c_src_start = _diagonals(row, start, n, source)
            scatter = mixed(c_start.astype(np.uint64) * np.uint64(_BASES[0]) ^ rank[c_row].astype(np.uint64) * np.uint64(_BASES[1]))
            none = np.full(int(keep.sum()), -1)
            at, src = pa.array(np.r_[row[keep], c_row]), pa.array(np.r_[none, c_src], mask=np.r_[none, c_src] < 0)
            cols = [pa.array(np.r_[h[keep], scatter].view(np.int64)), pa.array(np.r_[g[keep], np.zeros_like(scatter)].view(np.int64)), b.column(0).take(at), b.column(1).take(at)]
            cols += [pa.array(np.r_[x[keep], y].astype(np.int32)) for x, y in ((start, c_start), (n, c_n), (m, np.zeros_like(c_n)))]
            cols += [b.column(0).take(src), b.column(1).take(src), pa.array(np.r_[none, c_src_start].astype(np.int32), mask=np.r_[none, c_src_start] < 0)]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("id", "t", "text").mapInArrow(run, f"h long, g long, id {kind}, t long, start int, n int, m int, src {kind}, src_t long, src_start int")


def repeats(docs: DataFrame, size: int, k: int, of_words: bool) -> DataFrame:
    """(id, t, start, n, h, peers, copy, src, src_t, src_start): super-k-mers that matter, of docs (id, t, text).

    copy: its whole content occurs at the earlier place (src, src_t, src_start). Not copy: the first place of a content
    whose minimiser stands in other contents too, `peers` in all; some of its windows may occur there. What
    has a minimiser of its own, or is the only content of its minimiser, holds no repeated window and is left out.
    A place is an id and a start; equal places in different rows are not earlier than each other.
    """
    content = W.partitionBy("h", "g", "n")
    anchor = W.partitionBy("h")
    rows = find_super_kmers(docs, size, k, of_words)
    # One shuffle and one sort serve both windows.
    rows = rows.repartition(partitions(docs.sparkSession), "h").sortWithinPartitions("h", "g", "n")
    rows = rows.withColumn("first", F.min(F.struct("id", "start", "t")).over(content))
    here = F.struct("id", "start").eqNullSafe(F.struct(F.col("first.id").alias("id"), F.col("first.start").alias("start")))
    rows = rows.withColumn("copy", (F.col("m") == 0) | ~here)
    what = F.struct("g", "n")
    one = F.when(F.col("m") > 0, F.col("m"))
    rows = rows.withColumns({"rows": F.sum(one).over(anchor), "peers": F.count_if(~F.col("copy")).over(anchor), "one": F.min(what).over(anchor), "other": F.max(what).over(anchor)})
    rows = rows.filter(F.col("copy") | ((F.col("rows") > 1) & (F.col("one") != F.col("other"))))
    far = F.col("copy") & (F.col("m") > 0)
    return rows.select("id", "t", "start", "n", "h", "peers", "copy", *(F.when(far, F.col(f"first.{c}")).otherwise(F.col(s)).alias(s) for c, s in (("id", "src"), ("t", "src_t"), ("start", "src_start"))))


def spans(copies: DataFrame) -> DataFrame:
    """(id, t, start, n, src, src_t, src_start): rows of one document, one source and one shift, joined where they overlap."""
    line = ["id", "t", "src", "src_t", "shift"]
    rows = copies.select("id", "t", "start", "n", "src", "src_t", "src_start", (F.col("start") - F.col("src_start")).alias("shift"))
    order = W.partitionBy(*line).orderBy("start")
    reach = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("begin", F.when(F.coalesce(F.col("start") > reach, F.lit(True)), F.col("start")))
    rows = rows.withColumn("island", F.last("begin", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.groupBy(*line, "island").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) - F.min("start")).alias("n"))
    return rows.select("id", "t", "start", "n", "src", "src_t", (F.col("start") - F.col("shift")).alias("src_start"))


def with_rows(docs: DataFrame, rows: DataFrame, fields: list[str], how: str = "inner") -> DataFrame:
    """docs (id, t, text) that have rows, with `rows`: an array of their distinct fields. Bounded by the document's length."""
    per = rows.groupBy(F.col("id").alias("key"), F.col("t").alias("key_t")).agg(F.collect_set(F.struct(*fields)).alias("rows"))
    return docs.join(per, docs["id"].eqNullSafe(per["key"]) & (docs["t"] == per["key_t"]), how).drop("key", "key_t")


def column_of(rows: pa.Array, field: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a field of an array<struct> column, and the offsets of its rows."""
    flat = rows.flatten()
    lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    return pc.struct_field(flat, field).to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lengths)]


def windows(docs: DataFrame, rest: DataFrame, size: int, of_words: bool) -> DataFrame:
    """(e, e2, before, after, id, t, pos): each window of the super-k-mers in `rest`, as a de Bruijn edge.

    e and e2 are two independent hashes of its units; before and after are e of the edges that lead to it and follow
    it in the document, NULL where the neighbouring window is not in `rest`.
    """
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _BASES
        for b in batches:
            units, off = units_of(b.column(2), of_words)
            start, at = column_of(b.column(3), "start")
            n, _ = column_of(b.column(3), "n")
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            many = n - size + 1
            begin = np.repeat(off[row] + start, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            row = np.repeat(row, many)
            by = np.argsort(begin, kind="stable")
            begin, row = begin[by], row[by]
            if not len(begin):
                continue
            e, e2 = np.empty(len(begin), np.uint64), np.empty(len(begin), np.uint64)
            i = 0
            while i < len(begin):  # so many windows at a time that the sums stay short
                j = max(i + 1, min(i + CHUNK // 4, int(np.searchsorted(begin, begin[i] + CHUNK - size))))
                lo, hi = int(begin[i]), int(begin[j - 1]) + size
                x, q = units[lo:hi] if of_words else _BYTE[units[lo:hi]], begin[i:j] - lo
                e[i:j] = digest(prefix_sums(x, one), one, q, q + size)
                e2[i:j] = digest(prefix_sums(x, two), two, q, q + size)
                i = j
            cut_ = np.r_[True, (begin[1:] != begin[:-1] + 1) | (row[1:] != row[:-1]), True]
            hashes = e.view(np.int64)
            before = pa.array(np.r_[0, hashes[:-1]], mask=cut_[:-1])
            after = pa.array(np.r_[hashes[1:], 0], mask=cut_[1:])
            where = pa.array(row)
            cols = [pa.array(hashes), pa.array(e2.view(np.int64)), before, after, b.column(0).take(where), b.column(1).take(where), pa.array((begin - off[row]).astype(np.int32))]
            made = pa.RecordBatch.from_arrays(cols, ["e", "e2", "before", "after", "id", "t", "pos"])
            for k in range(0, made.num_rows, CHUNK // 4):
                yield made.slice(k, CHUNK // 4)

    joined = with_rows(docs, rest, ["start", "n"])
    return joined.select("id", "t", "text", "rows").mapInArrow(run, f"e long, e2 long, before long, after long, id {kind}, t long, pos int")


def write(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a table in the shared folder, so that a lost executor costs one step."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


@dataclass
class Contents:
    """Units of a batch's texts as bytes: unit i of a row is joined[first[i]:stop[i]], words are parted by one space."""

    joined: np.ndarray
    first: np.ndarray
    stop: np.ndarray
    off: np.ndarray

    def of(self, i: int, j: int) -> bytes:
        """Units i..j-1, by number in the batch."""
        return self.joined[self.first[i] : self.stop[j - 1]].tobytes() if j > i else b""


def contents_of(column: pa.Array, of_words: bool) -> Contents:
    data, off = text_bytes(column)
    if not of_words:
        at = np.arange(len(data) + 1)
        return Contents(data, at, at[1:], off)
    start, stop, rows = word_spans(data, off)
    n = stop - start
    last = np.cumsum(n + 1)
    joined = np.full(int(last[-1]) if len(n) else 0, 0x20, np.uint8)
    letter = np.ones(len(joined), bool)
    letter[last - 1] = False
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    np.subtract.at(inside, stop, 1)
    joined[letter] = data[np.cumsum(inside[:-1], dtype=np.int8) > 0] if len(n) else data[:0]
    return Contents(joined, last - 1 - n, last - 1, rows)


def _strong(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


def source_digests(docs: DataFrame, found: DataFrame, of_words: bool) -> DataFrame:
    """(src, src_t, src_start, n, source): a 128-bit cryptographic digest of the units at each source coordinate of spans."""
    kind = dict(docs.dtypes)["id"]
    asked = found.select(F.col("src").alias("id"), F.col("src_t").alias("t"), F.col("src_start").alias("start"), "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = contents_of(b.column(2), of_words)
            start, at = column_of(b.column(3), "start")
            n, _ = column_of(b.column(3), "n")
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            begin = text.off[row] + start
            made = [_strong(text.of(i, j)) for i, j in zip(begin.tolist(), (begin + n).tolist(), strict=True)]
            where = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(where), b.column(1).take(where), pa.array(start), pa.array(n), pa.array(made, pa.binary())], ["src", "src_t", "src_start", "n", "source"])

    joined = with_rows(docs, asked, ["start", "n"]).select("id", "t", "text", "rows")
    return joined.mapInArrow(run, f"src {kind}, src_t long, src_start int, n int, source binary").distinct()


def with_sources(docs: DataFrame, found: DataFrame, of_words: bool) -> DataFrame:
    """(id, t, start, n, source) of spans (id, t, start, n, src, src_t, src_start), with the digest of their source."""
    digests = source_digests(docs, found, of_words)
    named = digests.select(F.col("src").alias("s"), F.col("src_t").alias("st"), F.col("src_start").alias("ss"), F.col("n").alias("sn"), "source")
    met = F.col("src").eqNullSafe(F.col("s")) & (F.col("src_t") == F.col("st")) & (F.col("src_start") == F.col("ss")) & (F.col("n") == F.col("sn"))
    return found.join(named, met).select("id", "t", "start", "n", "source")


def covered(docs: DataFrame, found: DataFrame, of_words: bool, extra: list[str]) -> DataFrame:
    """(id, total, removed, runs, kept, kept_sha256) of docs (id, t, text) less the units in spans (id, t, start, n, source).

    A span with a digest of its source goes only if its own units have that digest; one without has been compared.
    """
    rows = with_rows(docs, found, ["start", "n", "source"], "left").select("id", "text", "rows")
    kind = dict(docs.dtypes)["id"]
    keep = "kept" in extra

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = contents_of(b.column(1), of_words)
            start, at = column_of(b.column(2), "start")
            n, _ = column_of(b.column(2), "n")
            source, _ = column_of(b.column(2), "source")
            out: dict[str, list] = {c: [] for c in ("total", "removed", "runs", "kept_sha256", "kept")}
            for i in range(b.num_rows):
                lo, hi = int(text.off[i]), int(text.off[i + 1])
                edge = np.zeros(hi - lo + 1, np.int32)
                for s, m, same in zip(start[at[i] : at[i + 1]].tolist(), n[at[i] : at[i + 1]].tolist(), source[at[i] : at[i + 1]], strict=True):
                    if same is None or _strong(text.of(lo + s, lo + s + m)) == same:
                        edge[s] += 1
                        edge[s + m] -= 1
                gone = np.r_[True, np.cumsum(edge[:-1]) > 0, True]
                first, stop = np.flatnonzero(gone[:-1] & ~gone[1:]), np.flatnonzero(~gone[:-1] & gone[1:])
                left = (b" " if of_words else b"").join([text.of(lo + x, lo + y) for x, y in zip(first.tolist(), stop.tolist(), strict=True)])
                out["total"].append(hi - lo)
                out["removed"].append(int(gone[1:-1].sum()))
                out["runs"].append(int((gone[1:-1] & ~np.r_[False, gone[1:-1][:-1]]).sum()))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["kept"].append(left if keep else None)
            cols = [b.column(0), *(pa.array(out[c], pa.int64()) for c in ("total", "removed", "runs")), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "total", "removed", "runs", "kept_sha256", "kept"])

    return rows.mapInArrow(run, f"id {kind}, total long, removed long, runs long, kept_sha256 string, kept binary")
