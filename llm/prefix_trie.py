"""Prefix trie of conversations that are rebuilt from shared heads, by composable fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from llm.common import WORD, cut, salted_rank

#: Primes below 2**31, so that products of residues fit a long; together they make fingerprints of 124 bits.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
FP = tuple(f"f{k}" for k in range(len(PRIMES)))
#: Turns that a head can have.
HEAD = 3
#: Depths that meet in one window; longer conversations are summed over bands.
BAND = 4096
#: Bytes of joined ids that one row holds at most (one id more).
CHUNK = 1 << 16


def _bases(seed: int) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(f"{seed}/{k}".encode(), digest_size=8).digest(), "big") % (p - 2) + 2 for k, p in enumerate(PRIMES)]


def _powers(exponent: Column, bases: list[int]) -> Column:
    """Array of each base to the exponent, modulo its prime."""

    @F.pandas_udf("array<long>")
    def run(e: pd.Series) -> pd.Series:
        bits = e.to_numpy(np.int64)
        out = np.ones((len(bits), len(PRIMES)), np.int64)
        for k, p in enumerate(PRIMES):
            square, left = bases[k], bits.copy()
            while left.any():
                out[:, k] = np.where(left & 1, out[:, k] * square % p, out[:, k])
                square, left = square * square % p, left >> 1
        return pd.Series(list(out))

    return run(exponent)


def ordered_turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, pos, role, text): turns numbered from 1 in each conversation, by turn (NULL first), then text, then role.

    Rows are sorted over the whole table by ranges of conversation, turn and the text's first 64 characters, so a conversation with a third
    of all rows lies in many tasks; a row's number is that in its range and what the ranges before hold.
    """
    rows = conversations.select(F.col(conv).cast("long").alias("c"), F.col(turn).cast("long").alias("turn"), *(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(n) for x, n in ((role, "role"), (text, "text")))).filter("c IS NOT NULL")
    dealt = cut(rows.repartitionByRange("c", F.asc_nulls_first("turn"), F.substring("text", 1, 64)).withColumn("part", F.spark_partition_id()))
    ranked = salted_rank(dealt, ["c"], [F.asc_nulls_first("turn"), F.col("text"), F.col("role")], F.col("part"), "pos")
    return cut(ranked.select("c", (F.col("pos") + 1).alias("pos"), "part", "role", "text"))


def fingerprinted(turns: DataFrame, seed: int) -> tuple[DataFrame, list[int]]:
    """Turns without texts: (c, pos, n_words, t0…, r0…), and the bases.

    t is the turn's factor of its own conversation's product, hash * base**pos, and r the sum of the factors up to it.
    A product of k turns is the pair (k, r); (k, r) * (l, s) is (k + l, r + base**k * s), which is associative, and a suffix's
    pair follows from those of a conversation and of its head.
    """
    bases = _bases(seed)
    rows = turns.select("c", "pos", "part", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), *(F.pmod(F.xxhash64(F.lit(seed * len(PRIMES) + k), "role", "text"), F.lit(p)).alias(f"h{k}") for k, p in enumerate(PRIMES)))
    rows = rows.withColumn("power", _powers(F.col("pos"), bases))
    rows = rows.select("c", "pos", "part", "n_words", *((F.col(f"h{k}") * F.get("power", F.lit(k)) % p).alias(f"t{k}") for k, p in enumerate(PRIMES)))
    rows = cut(rows)
    sums = rows.groupBy("c", "part").agg(*(F.sum(f"t{k}").alias(f"s{k}") for k in range(len(PRIMES))))
    earlier = W.partitionBy("c").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("c", "part", *(F.coalesce(F.sum(f"s{k}").over(earlier), F.lit(0)).alias(f"s{k}") for k in range(len(PRIMES))))
    so_far = W.partitionBy("c", "part").orderBy("pos")
    rows = rows.join(sums, ["c", "part"])
    return cut(rows.select("c", "pos", "n_words", *(f"t{k}" for k in range(len(PRIMES))), *((F.sum(f"t{k}").over(so_far) + F.col(f"s{k}")).alias(f"r{k}") for k in range(len(PRIMES)))).select("c", "pos", "n_words", *(f"t{k}" for k in range(len(PRIMES))), *((F.col(f"r{k}") % p).alias(f"r{k}") for k, p in enumerate(PRIMES)))), bases


def visits(prints: DataFrame, bases: list[int], base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """(c, n): the rebuilt conversations' lengths; and (c, d, f…, p…, n_words, own): their prefixes of 1 turn or more.

    f is a prefix's fingerprint and p that of the prefix before. Heads come from the base's own row, suffixes from
    the conversation's own turns with the head's product put before; `own` says that the last turn is stored under c.
    """
    K = range(len(PRIMES))
    first = F.when(F.col("pos") <= HEAD, F.struct("pos", "n_words", *(f"r{k}" for k in K)))
    convs = prints.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(first)).alias("first"))
    convs = cut(convs.withColumns({"b": base, "h": head.cast("int")}))
    bases_of = convs.select(F.col("c").alias("b"), F.col("first").alias("theirs"))
    convs = convs.join(bases_of, "b", "left").withColumn("theirs", F.slice(F.coalesce("theirs", F.slice("first", 1, 0)), F.lit(1), F.col("h")))
    at = lambda column, i, k: F.coalesce(F.get(column, i - 1)[f"r{k}"], F.lit(0))
    convs = convs.select(
        "c",
        "b",
        "h",
        "theirs",
        F.size("theirs").alias("shared"),
        (F.size("theirs") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).cast("long").alias("n"),
        *(at("theirs", F.size("theirs"), k).alias(f"b{k}") for k in K),
        *(at("first", F.least(F.col("h").cast("long"), F.col("n")).cast("int"), k).alias(f"o{k}") for k in K),
    )
    convs = cut(convs)
    heads = convs.select("c", "b", F.posexplode("theirs").alias("i", "t"), "theirs")
    heads = heads.select("c", (F.col("i") + 1).cast("long").alias("d"), *(F.col("t")[f"r{k}"].alias(f"f{k}") for k in K), *(at("theirs", F.col("i"), k).alias(f"p{k}") for k in K), F.col("t")["n_words"].alias("n_words"), (F.col("c") == F.col("b")).alias("own"))
    own = prints.join(convs.drop("theirs", "b", "n"), "c").filter("pos > h")
    inverse = [pow(b, -1, p) for b, p in zip(bases, PRIMES, strict=True)]

    def shift(k: int) -> Column:
        """base**(shared - h), by which the own suffix moves."""
        return F.coalesce(*(F.when(F.col("h") - F.col("shared") == j, F.lit(pow(inverse[k], j, PRIMES[k]))) for j in range(HEAD + 1)))

    moved = lambda k, r: F.pmod(r, F.lit(PRIMES[k])) * shift(k)
    f = {f"f{k}": (F.col(f"b{k}") + moved(k, F.col(f"r{k}") - F.col(f"o{k}"))) % PRIMES[k] for k in K}
    p = {f"p{k}": (F.col(f"b{k}") + moved(k, F.col(f"r{k}") - F.col(f"t{k}") - F.col(f"o{k}"))) % PRIMES[k] for k in K}
    own = own.select("c", (F.col("pos") - F.col("h") + F.col("shared")).alias("d"), *(x.alias(n) for n, x in (f | p).items()), "n_words", F.lit(True).alias("own"))
    return convs.select("c", "n"), heads.unionByName(own)


def _equal(prefixes: DataFrame, nodes: DataFrame, turns: DataFrame, convs_h: DataFrame) -> bool:
    """Whether all prefixes of a node end in the same turn, by the stored turns that the prefixes refer to.

    A stored turn is the last one of prefixes of one node only. Equal last turns and fingerprints give equal fingerprints one turn before,
    so if it holds at each node, all prefixes of a node are equal.
    """
    several = nodes.filter("n_refs > 1").select("d", *FP)
    refs = prefixes.filter("own").join(several, ["d", *FP], "left_semi").join(convs_h, "c")
    refs = refs.select("c", F.when(F.col("d") <= F.col("shared"), F.col("d")).otherwise(F.col("d") - F.col("shared") + F.col("h")).alias("pos"), F.struct("d", *FP).alias("node"))
    ends = refs.join(turns, ["c", "pos"]).groupBy("node").agg(*(g(F.struct("role", "text")).alias(n) for g, n in ((F.min, "lo"), (F.max, "hi"))))
    return ends.filter("lo <> hi").isEmpty()


def _ends(ends: DataFrame) -> DataFrame:
    """(d, f…, ends_sha256) of (d, f…, c): SHA-256 of each node's ids in ascending order.

    Ids are sorted over the whole table by node and id; each task joins runs of a node's ids to texts of CHUNK bytes, and the last
    step reads a node's texts one after another.
    """
    key = ["d", *FP]
    rows = ends.repartitionByRange(*key, "c").sortWithinPartitions(*key, "c")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        now, first, size = None, 0, 0

        def text() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in now), pa.array([first], pa.int64()), pa.array([",".join(held)])], [*key, "first", "ids"])

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(len(key) + 1)]
            for *node, c in zip(*cols, strict=True):
                if node != now or size >= CHUNK:
                    if held:
                        yield text()
                    now, first, size, held = node, c, 0, []
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            yield text()

    kinds = "d long, " + ", ".join(f"{f} long" for f in FP)
    chunks = rows.mapInArrow(join, f"{kinds}, first long, ids string")
    chunks = chunks.repartition(*(F.col(k) for k in key)).sortWithinPartitions(*key, "first")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        out: list = []

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in out], pa.int64()) for i in range(len(key))), pa.array([r[-1] for r in out], pa.string())], [*key, "ends_sha256"])

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(len(key))]
            for *node, ids in zip(*cols, b.column("ids").to_pylist(), strict=True):
                if node != now:
                    if sha:
                        out.append([*now, sha.hexdigest()])
                    now, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if len(out) >= 4096:
                yield table()
                out = []
        if sha:
            out.append([*now, sha.hexdigest()])
        yield table()

    return chunks.mapInArrow(digest, f"{kinds}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, base: Column | None = None, head: Column | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tries: int = 8, seed: int = 5) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, the empty one included.

    Conversation c becomes the first `head` turns (0 to 3) of conversation `base` and its own turns after its first `head`; both are conditions
    on the column c, by default c - c % 20 and crc32(c) % 4. Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves and saved_tokens (of the subtree), ends_sha256 (ids of the members that end there).

    No rebuilt text is made: a prefix's fingerprint is the product of the head's and the suffix's, and nodes are groups of equal
    (depth, fingerprint). The turns that they refer to are then compared; if two differ, all is done again with other bases. Turns go by turn
    (NULL first), ties by text, then role. NULL roles and texts are empty; rows of a NULL conversation are no turns; repeated
    rows are turns each. A base that doesn't exist has no turns. Other columns are not read. An empty table gives no rows. Turns
    of one conversation with the same number and the same first 64 characters meet in one task.
    """
    base = F.col("c") - F.col("c") % 20 if base is None else base
    head = F.crc32(F.col("c").cast("string").cast("binary")) % 4 if head is None else head
    turns = ordered_turns(conversations, conv, turn, role, text)
    for k in range(tries):
        prints, bases = fingerprinted(turns, seed + k)
        convs, prefixes = visits(prints, bases, base, head)
        prefixes = cut(prefixes)
        lengths = convs.select("c", "n")
        longest = prefixes.join(lengths, "c")
        nodes = longest.groupBy("d", *FP).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n_convs"), F.max("n").alias("deepest"), F.min("n_words").alias("n_words"), F.count_if("own").alias("n_refs"), *(F.min(f"p{i}").alias(f"p{i}") for i in range(len(PRIMES))))
        nodes = cut(nodes)
        stored = lengths.select("c").withColumns({"h": head.cast("int")})
        own_head = prints.groupBy("c").agg(F.count(F.lit(1)).alias("m"))
        base_len = own_head.select(F.col("c").alias("b"), F.col("m").alias("of_base"))
        stored = stored.withColumn("b", base).join(base_len, "b", "left").select("c", "h", F.least(F.col("h").cast("long"), F.coalesce("of_base", F.lit(0).cast("long"))).alias("shared"))
        if _equal(prefixes, nodes, turns, stored):
            break
    else:
        raise RuntimeError("fingerprints of different prefixes stay equal")

    zero = [F.lit(0).cast("long").alias(f) for f in FP]
    root = lengths.agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n_convs"), F.max("n").alias("deepest")).filter("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("d"), *zero, "c", "n_convs", "deepest", F.lit(0).cast("long").alias("n_words"), *(F.lit(None).cast("long").alias(f"p{i}") for i in range(len(PRIMES))))
    nodes = cut(nodes.drop("n_refs").unionByName(root))

    # A conversation's own share: the nodes that it is the smallest member of, which are all from some depth on.
    leaf, saved = F.when(F.col("deepest") == F.col("d"), 1).otherwise(0).cast("long"), (F.col("n_convs") - 1) * F.col("n_words")
    mine = nodes.select("d", *FP, "c", leaf.alias("leaf"), saved.alias("saved"), F.expr(f"d div {BAND}").alias("band"))
    bands = mine.groupBy("c", "band").agg(F.sum("leaf").alias("leaf_band"), F.sum("saved").alias("saved_band"))
    below = W.partitionBy("c").orderBy(F.desc("band")).rowsBetween(W.unboundedPreceding, -1)
    bands = bands.select("c", "band", *(F.coalesce(F.sum(f"{x}_band").over(below), F.lit(0)).alias(f"{x}_below") for x in ("leaf", "saved")))
    down = W.partitionBy("c", "band").orderBy(F.desc("d"))
    mine = mine.join(bands, ["c", "band"]).select("d", *FP, *((F.sum(x).over(down) + F.col(f"{x}_below")).alias(f"{x}_mine") for x in ("leaf", "saved")))
    totals = nodes.groupBy("c").agg(F.sum(leaf).alias("leaf_all"), F.sum(saved).alias("saved_all"))
    every = prefixes.select("c", "d", *FP).unionByName(lengths.select("c", F.lit(0).cast("long").alias("d"), *zero))
    others = every.join(totals, "c").groupBy("d", *FP).agg(F.sum("leaf_all").alias("leaf_others"), F.sum("saved_all").alias("saved_others"))
    children = nodes.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), *(F.col(f"p{i}").alias(f) for i, f in enumerate(FP))).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("d") + 1).alias("d"), *(F.col(f).alias(f"p{i}") for i, f in enumerate(FP)), F.col("c").alias("parent_conv_id"))
    ends = _ends(every.join(lengths, "c").filter("d = n").select("d", *FP, "c"))
    key = ["d", *FP]
    out = nodes.join(totals, "c").join(mine, key).join(others, key).join(children, key, "left").join(ends, key, "left")
    out = out.join(parents, ["d", *(f"p{i}" for i in range(len(PRIMES)))], "left")
    return out.select(
        F.col("c").alias("conv_id"),
        F.col("d").alias("depth"),
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        # of the other members, whole shares; of the smallest, what lies here and below
        (F.col("leaf_others") - F.col("leaf_all") + F.col("leaf_mine")).alias("n_leaves"),
        (F.col("saved_others") - F.col("saved_all") + F.col("saved_mine")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
