"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import salted_rank

#: Slots of a schedule at most, besides one for each source; larger corpora get larger blocks.
SLOTS = 1 << 18
ADDED = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_rank")


def schedule(weights: Mapping[str, float], blocks: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of all blocks of the sources of weight above 0.

    Block j of a source of weight w, of all weights' sum 1, has the window [floor(j / w), ceil((j + 1) / w)). In each slot
    the released block with the earliest deadline runs. Utilisation is 1, so every block meets its window, and what a
    source has got after t slots deviates from t w by less than one block, for weights as exact as they are given. When a
    source is used up, the others go on from there as a new schedule, their weights in proportion.
    """
    exact = {s: Fraction(w) for s, w in weights.items() if w and w > 0}
    left = {s: blocks.get(s, 0) for s in exact if blocks.get(s, 0) > 0}
    done = dict.fromkeys(left, 0)
    out: list[tuple[str, int, int, int, int]] = []
    while left:
        begin = len(out)
        unit = math.lcm(*(exact[s].denominator for s in left))
        share = {s: int(exact[s] * unit) for s in left}
        total = sum(share.values())
        first = dict(done)
        waiting = [(0, str(s), s, 0) for s in left]
        ready: list = []
        ended = None
        while ended is None:
            t = len(out) - begin
            while waiting and waiting[0][0] <= t:
                release, name, s, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(j + 1) * total // share[s]), name, s, j, release))
            deadline, name, s, j, release = heapq.heappop(ready)
            out.append((s, first[s] + j, begin + release, begin + deadline, begin + t))
            done[s] += 1
            left[s] -= 1
            if left[s]:
                heapq.heappush(waiting, ((j + 1) * total // share[s], name, s, j + 1))
            else:
                ended = s
        del left[ended]
    return out


def tempered_weights(docs: DataFrame, source: str = "source", alpha: float = 0.5) -> dict[str, float]:
    """A weight for each source: its number of documents to the power alpha. NULL counts as a source of its own, ''.

    One number a source goes to the driver, as weights that are given do.
    """
    rows = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["s"]: r["n"] ** alpha for r in rows}


def mix(docs: DataFrame, weights: Mapping[str, float], block_rows: int = 16, seed: int = 7, id_col: str = "doc_id", source: str = "source", slots: int = SLOTS, salt_rows: int = 1 << 16) -> DataFrame:
    """docs with mix_block, mix_release, mix_deadline, mix_slot and mix_rank (place in the block).

    A source's documents are shuffled by a seeded hash of the id and cut into blocks of block_rows, or of as many more
    as leave at most `slots` blocks and one a source. The schedule of all blocks is made from the sources' counts; it is
    the one table that the driver makes, of bounded size however large the corpus. Ordering by (mix_slot, mix_rank) gives the
    mix; no slot is empty, nothing is dropped or repeated. A NULL source is the source ''. A source of weight 0, or
    without a weight, comes after all others, in slots from 2**62. Columns of docs pass through, but for those
    named like the added ones; rows with equal ids are ordered by all columns. An empty table gives no rows.
    """
    spark = docs.sparkSession
    src = F.coalesce(F.col(source).cast("string"), F.lit(""))
    rows_of = {r["s"]: r["n"] for r in docs.groupBy(src.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    block_rows = max(block_rows, -(-sum(rows_of.values()) // slots))
    table = schedule(weights, {s: -(-n // block_rows) for s, n in rows_of.items()})
    names = ["src", "block", "r", "d", "t"]
    kinds = [pa.string(), *[pa.int64()] * 4]
    planned = spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(zip(*table) if table else [[]] * 5, kinds, strict=True)], names))
    told = [c for c, kind in docs.dtypes if "map<" not in kind]
    at = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        src.alias("src"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"),
        F.xxhash64(*(F.col(f"`{c}`") for c in told)).alias("tie"),
    )
    salts = max(64, -(-max(rows_of.values(), default=0) // salt_rows))
    salt = F.floor((F.shiftrightunsigned("h", 32)) * salts / 2**32).cast("int")
    ranked = salted_rank(at, ["src"], [F.col("h"), F.col("tie")], salt, "rank")
    ranked = ranked.withColumns({"block": F.expr(f"rank div {block_rows}"), "place": (F.col("rank") % block_rows).cast("int")})
    joined = ranked.join(planned, ["src", "block"], "left")
    late = F.lit(2**62) + F.col("block")
    return joined.select(
        *(F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED),
        F.col("block").alias("mix_block"),
        *(F.coalesce(F.col(c), late).alias(f"mix_{name}") for c, name in (("r", "release"), ("d", "deadline"), ("t", "slot"))),
        F.col("place").alias("mix_rank"),
    )


def mixed(docs: DataFrame, weights: Mapping[str, float], **options) -> DataFrame:
    """docs in the order of the mix, its own columns only: range-partitioned and sorted by slot.

    Rows of a source of weight 0 stay, at the end.
    """
    own = docs.columns
    id_col, source = options.get("id_col", "doc_id"), options.get("source", "source")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("own"), F.col(id_col), F.col(source))
    out = mix(packed, weights, **options)
    out = out.repartitionByRange("mix_slot", "mix_rank").sortWithinPartitions("mix_slot", "mix_rank", "mix_block")
    return out.select(*(F.col("own")[c].alias(c) for c in own))
