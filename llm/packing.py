"""Best-fit packing into bins of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from llm.common import cut, key_runs, partitions, words

CAPACITIES = (512, 1024, 2048, 4096)


def pack_block(lengths: Sequence[int], capacities: Sequence[int], overhead: int) -> tuple[list[int], list[int], list[int]]:
    """Bin, offset in the bin, and capacity of each item, in the order given.

    An item goes to the open bin in which it leaves the least room, the earliest such bin on a tie. If none has
    room, a bin opens whose size costs least for the item: (size + overhead) for each copy of the item that fits
    whole, on a tie the larger size. At the end each bin shrinks to the least capacity that holds its contents.
    """
    sizes = sorted(capacities)
    room: list[tuple[int, int]] = []
    used: list[int] = []
    bins, offsets = [], []
    for n in lengths:
        i = bisect_left(room, (n, -1))
        if i < len(room):
            left, b = room.pop(i)
        else:
            left = min((s for s in sizes if s >= n), key=lambda s: ((s + overhead) / (s // max(n, 1)), -s))
            b = len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if left > n:
            insort(room, (left - n, b))
    final = [sizes[bisect_left(sizes, u)] for u in used]
    return bins, offsets, [final[b] for b in bins]


PACKED = "piece int, start long, n_tokens long, block long, bin long, bin_offset long, capacity long"


def _items(docs: DataFrame, length: Column | None, capacities: Sequence[int], id_col: str, text: str, order: str | None) -> DataFrame:
    """(id, piece, start, n_tokens, at, dealt): pieces of documents, none longer than the largest capacity."""
    largest = max(capacities)
    n = F.size(words(F.col(text))) if length is None else F.greatest(F.coalesce(length, F.lit(0)), F.lit(0))
    at = F.lit(None).cast("long") if order is None else F.col(order).cast("long")
    items = docs.select(F.col(id_col).alias("id"), n.cast("long").alias("n"), at.alias("at"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / largest).cast("int") - 1)
    items = items.select("id", "n", "at", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * largest
    return items.select("id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(largest).cast("long")).alias("n_tokens"), "at", F.xxhash64("id", "piece", "n").alias("dealt"))


def _packed(items: DataFrame, capacities: Sequence[int], overhead: int, id_col: str, order: str | None) -> DataFrame:
    """items with a column block, each block packed by itself, in order of falling length."""
    rows = items.repartition(partitions(items.sparkSession), "block")
    rows = rows.sortWithinPartitions("block", F.desc("n_tokens"), "dealt", "id", "piece", "at")
    kind = dict(items.dtypes)["id"]
    own = ["id", "piece", "start", "n_tokens", "block"]
    extra = [] if order is None else ["at"]
    names = [id_col, *own[1:], "bin", "bin_offset", "capacity", *([] if order is None else [order])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches, "block"):
            block = t["block"].to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                one = t.slice(lo, hi - lo).combine_chunks()
                packed = pack_block(one["n_tokens"].to_pylist(), capacities, overhead)
                cols = [*(one[c].combine_chunks() for c in own), *(pa.array(x, pa.int64()) for x in packed), *(one[c].combine_chunks() for c in extra)]
                yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], names)

    schema = f"`{id_col}` {kind}, {PACKED}" + ("" if order is None else f", `{order}` long")
    return rows.select(*own, *extra).mapInArrow(run, schema)


def pack(docs: DataFrame, length: Column | None = None, capacities: Sequence[int] = CAPACITIES, overhead: int = 8, id_col: str = "doc_id", text: str = "text", block_rows: int = 20_000) -> DataFrame:
    """One row for each piece of a document: id, piece, start, n_tokens, block, bin, bin_offset, capacity.

    Length is the number of words unless a column is given. A document longer than the largest capacity is cut
    into pieces of that capacity and a rest, so nothing is lost. A document of no tokens, NULL or empty, gets one piece of
    length 0. Pieces are dealt to blocks by a hash of id, piece and length; how many blocks there are follows from the number of
    pieces alone. A block is sorted by falling length and packed by itself, so (block, bin) names a bin and the loss against
    packing all at once is a few open bins for each block. block_rows is the mean of what a task holds. Repeated rows
    are packed as often as they occur; other columns are not read; an empty table gives no rows.
    """
    items = cut(_items(docs, length, capacities, id_col, text, None))
    blocks = max(1, -(-items.count() // block_rows))
    return _packed(items.withColumn("block", F.pmod("dealt", F.lit(blocks)).cast("long")), capacities, overhead, id_col, None)


def pack_in_order(docs: DataFrame, order: str, length: Column | None = None, capacities: Sequence[int] = CAPACITIES, overhead: int = 8, id_col: str = "doc_id", text: str = "text", block_rows: int = 20_000) -> DataFrame:
    """The pieces and bins of pack, with blocks that are consecutive ranges of the long column `order`, which is carried.

    All of a block's rows come before those of the next, so reading blocks by number keeps the order up to one block.
    Blocks are cut by counts of pieces for each 64 numbers of the order; no range of 64 is divided, so a block holds
    block_rows pieces and those of one range at most. Rows of one range meet in one task whatever their number: the order is a
    dense one, such as slots of a mix.
    """
    items = cut(_items(docs, length, capacities, id_col, text, order).withColumn("range", F.shiftright("at", 6)))
    counts = items.groupBy("range").agg(F.count(F.lit(1)).alias("pieces"))
    before = F.coalesce(F.sum("pieces").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.select(F.col("range").alias("of"), F.floor(before / block_rows).alias("block"))
    return _packed(items.join(blocks, F.col("range").eqNullSafe(F.col("of"))).drop("of"), capacities, overhead, id_col, order)
