"""SimHash fingerprints, pigeonring candidate search, and groups of near duplicates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import components, cut, key_runs, partitions

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of `size` words, joined by spaces; repeats count; A-Z in lower case."""
    import xxhash

    words = _WORD.findall(text.translate(_LOWER)) if text else []
    if not words:
        return np.empty(0, "<u8")
    coded = [w.encode() for w in words]
    joined = b" ".join(coded)
    ends = np.cumsum([len(w) + 1 for w in coded]) - 1
    first = max(0, len(words) - size)
    starts = [0, *(ends[:first] + 1).tolist()]
    stops = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts, stops, strict=True)), "<u8", len(starts))


_SPREAD = np.array([[(b >> i) & 1 for i in range(8)] for b in range(256)], np.uint8)


def fingerprint(hashes: np.ndarray, n_words: int = 1) -> list[int]:
    """n_words numbers of 64 bits: a bit is 1 if set in over half the hashes; zero for no hashes.

    The first number is of the hashes themselves, each further one of the hashes mixed by another odd constant.
    """
    out = []
    for k in range(n_words):
        h = hashes
        if k:
            h = (h ^ (h >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64)
            h = h ^ (h >> np.uint64(29))
            h = h * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(32))
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), 1 << 16):
            part = np.ascontiguousarray(h[i : i + (1 << 16)]).view(np.uint8).reshape(-1, 8)
            for byte in range(8):
                ones[byte * 8 : byte * 8 + 8] += np.bincount(part[:, byte], minlength=256) @ _SPREAD
        out.append(sum(1 << i for i in np.flatnonzero(ones * 2 > len(h)).tolist()))
    return out


def fingerprints(docs: DataFrame, shingle: int, n_words: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, f array<long>): the fingerprint of each whole text; NULL or wordless text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [fingerprint(shingle_hashes(t.as_py(), shingle), n_words) for t in b.column(1)]
            signed = np.array(rows, "<u8").astype("<i8").tolist() if rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signed, pa.list_(pa.int64()))], ["id", "f"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text)).mapInArrow(run, f"id {kind}, f array<long>")


#: How often `links` divides a large bucket; one word of 64 bits and chains of 7 of 16 segments leave 3 segments free.
LEVELS = 3


def xxh(content: bytes) -> int:
    """XXH64 as a signed number."""
    import xxhash

    return (xxhash.xxh64_intdigest(content, 3) + 2**63) % 2**64 - 2**63


def ring_keys(f: np.ndarray, seg: int, chain: int) -> np.ndarray:
    """For each fingerprint (row of 64-bit words) and each segment i of the ring: the bits of segments i..i+chain-1."""
    bits = np.unpackbits(f.astype("<u8").view(np.uint8).reshape(len(f), -1), axis=1, bitorder="little")
    m = bits.shape[1] // seg
    parts = bits.reshape(len(f), m, seg) @ (1 << np.arange(seg, dtype=np.int64))
    key = np.zeros((len(f), m), np.int64)
    for k in range(chain):
        key = (key << seg) | np.roll(parts, -k, axis=1)
    return key * m + np.arange(m)


def chain_masks(start: int, seg: int, n_words: int, max_bits: int) -> list[tuple[np.ndarray, int]]:
    """(mask, budget) for ever longer chains of segments from `start` on: a chain's share of the ring times max_bits."""
    m = n_words * 64 // seg
    out = []
    for c in sorted({max(1, m // 4), m // 2, 3 * m // 4}):
        on = np.zeros(m * seg, np.uint8)
        for k in range(c):
            s = ((start + k) % m) * seg
            on[s : s + seg] = 1
        out.append((np.packbits(on, bitorder="little").view("<u8"), c * max_bits // m))
    return out


def within(x: np.ndarray, masks: list[tuple[np.ndarray, int]], max_bits: int) -> np.ndarray:
    """For differences x (rows of words): every chain is within its budget, and all bits within max_bits."""
    some = np.arange(len(x))
    for mask, budget in masks:
        some = some[np.bitwise_count(x[some] & mask).sum(1) <= budget]
    some = some[np.bitwise_count(x[some]).sum(1) <= max_bits]
    ok = np.zeros(len(x), bool)
    ok[some] = True
    return ok


def linked(f: np.ndarray, start: int, seg: int, max_bits: int) -> list[tuple[int, int]]:
    """Links that join each component of "differ in max_bits or fewer" among distinct fingerprints, as row pairs.

    A member of the frontier is compared with those not yet reached. From `start` on, running sums over ever longer
    chains of segments must stay within budget, max_bits times the chain's share of the ring; if they do for some
    chain start that shares this bucket's segments, the full difference is checked. A chain that starts elsewhere is
    found in its own bucket. Only the links by which members are reached are kept, at most len(f) - 1.
    """
    left = np.arange(len(f))
    out = []
    masks = chain_masks(start, seg, f.shape[1], max_bits)
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            ok = within(f[left] ^ f[at], masks, max_bits)
            got = left[ok]
            out += [(int(at), int(g)) for g in got]
            frontier += got.tolist()
            left = left[~ok]
    return out


def rest_segments(m: int, chain: int, max_bits: int, level: int) -> list[list[int]]:
    """Offsets on the ring, from a chain's start, of the blocks that divide what the levels before leave free.

    Level 0 leaves the segments behind the chain; each level divides them into max_bits + 1 blocks, and two linked
    fingerprints agree on one of them, which the next level takes off. One list of blocks for each choice before.
    """
    free = [list(range(chain, m))]
    blocks: list[list[int]] = []
    for _ in range(level + 1):
        cuts = [[part.tolist() for part in np.array_split(f, max_bits + 1)] for f in free]
        blocks = [b for c in cuts for b in c]
        free = [[x for x in f if x not in b] for f, c in zip(free, cuts, strict=True) for b in c]
    return blocks


def links(prints: DataFrame, max_bits: int, seg: int, chain: int, limit: int = 4096) -> DataFrame:
    """(a, b): links between ids of distinct fingerprints prints (id, f) that differ in max_bits or fewer.

    Pigeonring: with m segments on a ring, some start has every chain of l consecutive segments within
    l * max_bits / m differences. Chains of `chain` segments are the buckets: their budget is below one
    difference, so two linked fingerprints share a bucket at such a start and no link is lost.
    A bucket of more than `limit` is divided by what its members have behind the chain: the free segments are cut into
    max_bits + 1 blocks, and two that differ in max_bits agree on one of them, so each member goes to max_bits + 1
    smaller buckets, and again, while a block has a segment to give. Rows grow in proportion to the members. The
    last buckets leave so few bits free that their distinct fingerprints are bounded: with one word and the segments of
    `groups`, to 4096.
    """
    n_words = len(prints.select("f").first()[0]) if not prints.isEmpty() else 1
    m = 64 * n_words // seg
    if chain * max_bits >= m:
        raise ValueError("a chain of this length can hold a difference")
    kind = dict(prints.dtypes)["id"]

    def segments(column: pa.Array) -> np.ndarray:
        flat = column.flatten().to_numpy(zero_copy_only=False).view("<u8")
        bits = np.unpackbits(flat.view(np.uint8).reshape(len(column), -1), axis=1, bitorder="little")
        return bits.reshape(len(column), m, seg) @ (1 << np.arange(seg, dtype=np.int64))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = ring_keys(b.column(1).flatten().to_numpy(zero_copy_only=False).view("<u8").reshape(b.num_rows, -1), seg, chain)
                rows = pa.array(np.repeat(np.arange(b.num_rows), m))
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array(keys.ravel()), pa.array(np.tile(np.arange(m, dtype=np.int32), b.num_rows))], ["id", "key", "start"])

    def divided(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        blocks = rest_segments(m, chain, max_bits, level)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                seg_of, start, key, which = segments(b.column(3)), b.column(2).to_numpy(), b.column(1).to_numpy(), b.column(4).to_numpy()
                n = max_bits + 1
                made = np.empty((b.num_rows, n), np.int64)
                for i, (first, k, w) in enumerate(zip(start.tolist(), key.tolist(), which.tolist(), strict=True)):
                    for j in range(n):
                        at = [(first + o) % m for o in blocks[w * n + j]]
                        made[i, j] = xxh(np.r_[k, j, seg_of[i, at]].astype("<i8").tobytes())
                rows = pa.array(np.repeat(np.arange(b.num_rows), n))
                choice = (np.repeat(which, n) * n + np.tile(np.arange(n, dtype=np.int32), b.num_rows)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array(made.ravel()), b.column(2).take(rows), b.column(3).take(rows), pa.array(choice)], ["id", "key", "start", "f", "which"])

        return run

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches, "key"):
            ids = t["id"].combine_chunks()
            key, start = t["key"].to_numpy(), t["start"].to_numpy()
            flat = t["f"].combine_chunks()
            f = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy().view("<u8").reshape(len(start), -1)
            cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]) | (start[1:] != start[:-1])) + 1, len(key)]
            ones, others = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            two = cuts[:-1][np.diff(cuts) == 2]  # the most frequent size, at once for each start
            for s in np.unique(start[two]).tolist():
                i = two[start[two] == s]
                near = i[within(f[i] ^ f[i + 1], chain_masks(s, seg, f.shape[1], max_bits), max_bits)]
                ones.append(near)
                others.append(near + 1)
            for k in np.flatnonzero(np.diff(cuts) > 2):
                lo, hi = cuts[k], cuts[k + 1]
                pair = np.array(linked(f[lo:hi], int(start[lo]), seg, max_bits), np.int64).reshape(-1, 2)
                ones.append(pair[:, 0] + lo)
                others.append(pair[:, 1] + lo)
            a, b = np.concatenate(ones), np.concatenate(others)
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], ["a", "b"])

    def found(met: DataFrame) -> DataFrame:
        met = met.select("id", "f", "key", "start").repartition(partitions(prints.sparkSession), "key")
        return met.sortWithinPartitions("key", "start", "id").mapInArrow(find, f"a {kind}, b {kind}")

    keys = prints.select("id", "f").mapInArrow(keyed, f"id {kind}, key long, start int")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = cut(keys.join(sizes, "key").join(prints.select("id", "f"), "id").withColumn("which", F.lit(0)))
    out = found(met.filter(F.col("n") <= limit))
    level, large = 0, met.filter(F.col("n") > limit)
    while level < LEVELS and all(rest_segments(m, chain, max_bits, level)) and not large.isEmpty():
        met = large.select("id", "key", "start", "f", "which").mapInArrow(divided(level), f"id {kind}, key long, start int, f array<long>, which int")
        sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        met = cut(met.join(sizes, "key"))
        level += 1
        out = out.union(found(met.filter(F.col("n") <= limit)))
        large = met.filter(F.col("n") > limit)
    return out.union(found(large)).distinct()


def groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2, n_words: int = 1, seg: int = 4, chain: int = 7, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: id, f (fingerprint words), component_id.

    Documents link if their fingerprints differ in max_bits bits or fewer; the component is named by the smallest
    id that can be reached. Equal fingerprints are one node, so thousands of copies cost no more than one.
    NULL, empty and wordless texts have fingerprint zero and link like any other. A NULL id is the smallest, but names
    a component only if all ids in it are NULL. Repeated rows are repeated in the result, rows of one id with different
    texts are nodes of their own fingerprints. Texts of any length are taken whole. An empty table gives no rows; other
    columns are not read.
    """
    prints = cut(fingerprints(docs, shingle, n_words, id_col, text))
    nodes = prints.groupBy("f").agg(F.min("id").alias("id"))
    nodes = cut(nodes.select("f", "id", (F.col("f")[0] if n_words == 1 else F.xxhash64("f")).alias("node")))
    named = nodes.select(F.col("node").alias("id"), "f")
    found = components(links(named, max_bits, seg, chain))
    nodes = nodes.join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("f", "id", F.coalesce("root", "node").alias("root"))
    least = nodes.groupBy("root").agg(F.min("id").alias("component_id"))
    nodes = nodes.join(least, "root").select(F.col("f").alias("g"), "component_id")
    out = prints.join(nodes, prints["f"] == nodes["g"])
    return out.select(F.col("id").alias(id_col), "f", "component_id")


class _Codes(dict):
    """XXH64 of words, kept while they are not too many."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word.encode(), 7)
        return code


def shingle_set(text: str | None, size: int, codes: dict[str, int]) -> np.ndarray:
    """64-bit hashes of the distinct shingles of `size` words, ascending; a shorter text is one shingle; A-Z in lower case."""
    words = _WORD.findall(text.translate(_LOWER)) if text else []
    if not words:
        return np.empty(0, "<u8")
    c = np.fromiter(map(codes.__getitem__, words), "<u8", len(words))
    size = min(size, len(words))
    h = np.full(len(words) - size + 1, size, "<u8")
    for k in range(size):
        h = (h ^ c[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


#: Keys of a shingle set: BANDS of them, each of the least values of ROWS hash functions. Sets of similarity J share a
#: key with probability 1 - (1 - J**ROWS)**BANDS: 0.99997 at 0.8, 0.0002 at 0.05.
BANDS, ROWS = 20, 4
_XOR, _ODD = np.random.default_rng(5).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
_ODD |= np.uint64(1)


def band_keys(h: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of hashes that is not empty."""
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(h), 4096):
        x = (h[i : i + 4096] ^ _XOR) * _ODD
        low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(1))
    key = np.arange(BANDS, dtype=np.uint64)
    for part in low.reshape(BANDS, ROWS).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


#: Fingerprints of PRINT_WORDS words prune pairs before their sets are compared. At similarity 0.8 each of 256 bits differs
#: with probability 0.15 (0.19 in sets of 4 and 5), so 72 are exceeded by fewer than one pair in 10,000.
PRINT_WORDS, PRINT_BITS = 4, 72
#: Rounds of pivots before the members of keys that are still open are compared with each other.
ROUNDS = 2
#: Texts that are made into sets at a time, and values that `linked_sets` looks up at a time, so that a worker's memory stays small.
TEXTS, VALUES = 1000, 1 << 17


def majority(h: np.ndarray, n_words: int) -> np.ndarray:
    """As fingerprint, of an array of distinct hashes that is not empty, for few words."""
    out = np.zeros(n_words, np.uint64)
    for k in range(n_words):
        x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        ones = np.zeros(64, np.int64)
        for i in range(0, len(x), 1 << 14):
            ones += np.unpackbits(x[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0]
    return out


def chains_hold(a: Column, b: Column) -> Column:
    """Pigeonring on the words of two fingerprints: from some word on, each chain of words is within its share of PRINT_BITS."""
    d = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(PRINT_WORDS)]
    out = F.lit(False)
    for s in range(PRINT_WORDS):
        held, total = F.lit(True), F.lit(0)
        for k in range(PRINT_WORDS):
            total = total + d[(s + k) % PRINT_WORDS]
            held = held & (total <= (k + 1) * PRINT_BITS // PRINT_WORDS)
        out = out | held
    return out


def shared(x: np.ndarray, sets: list[np.ndarray], which: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many values each of the sets `which` shares with x, all ascending and not empty; about VALUES values are held at a time."""
    out = np.zeros(len(which), np.int64)
    total = np.r_[0, np.cumsum(size[which])]
    lo = 0
    while lo < len(which):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + VALUES, "right")) - 1)
        values = np.concatenate([sets[i] for i in which[lo:hi]])
        hit = x[np.minimum(np.searchsorted(x, values), len(x) - 1)] == values
        out[lo:hi] = np.add.reduceat(hit.astype(np.int64), total[lo:hi] - total[lo])
        lo = hi
    return out


def linked_sets(sets: list[np.ndarray], comp: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join each component of "Jaccard similarity of at least `similarity`", as index pairs.

    Sets are ascending and not empty. Those of one comp are joined already and aren't compared.
    """
    size = np.array([len(x) for x in sets])
    left = np.arange(len(sets))
    out = []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            same = comp[left] == comp[at]
            frontier += left[same].tolist()
            left = left[~same]
            x = sets[at]
            some = left[np.minimum(size[left], len(x)) >= similarity * np.maximum(size[left], len(x)) - 1e-9]
            if not len(some):
                continue
            got = some[shared(x, sets, some, size) * (1 + similarity) >= similarity * (size[some] + len(x)) - 1e-9]
            out += [(int(at), int(g)) for g in got]
            frontier += got.tolist()
            left = np.setdiff1d(left, got, assume_unique=True)
    return out


def _open_members(met: DataFrame, similarity: float, limit: int) -> DataFrame:
    """(key, node) of rows (key, many, node, n, comp, f) that are near, by fingerprint and size, to a member of another component.

    Only members outside a key's largest component look for others. A key of more than `limit` rows is passed whole.
    """
    kind = dict(met.dtypes)["node"]
    large = met.filter(F.col("many") > limit).select("key", "node")
    rows = met.filter(F.col("many") <= limit).select("key", "node", "n", "comp", "f")
    rows = rows.repartition(partitions(met.sparkSession), "key").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches, "key"):
            t = t.combine_chunks()
            key, n, comp = t["key"].to_numpy(), t["n"].to_numpy(), np.unique(t["comp"].to_numpy(), return_inverse=True)[1]
            flat = t["f"].combine_chunks()
            f = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy().view("<u8").reshape(len(key), -1)
            cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
            keep = np.zeros(len(key), bool)
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                c, m, g = comp[lo:hi], n[lo:hi], f[lo:hi]
                names, sizes = np.unique(c, return_counts=True)
                for i in np.flatnonzero(c != names[np.argmax(sizes)]):
                    other = (c != c[i]) & (np.minimum(m, m[i]) >= similarity * np.maximum(m, m[i]) - 1e-9)
                    other[other] = np.bitwise_count(g[other] ^ g[i]).sum(1) <= PRINT_BITS
                    if other.any():
                        keep[lo:hi] |= other
                        keep[lo + i] = True
            some = t.filter(pa.array(keep)).select(["key", "node"])
            yield from some.to_batches()

    return rows.mapInArrow(run, f"key long, node {kind}").union(large)


def _bucket_links(met: DataFrame, similarity: float, limit: int) -> DataFrame:
    """(a, b): links between nodes of one key, from rows (key, weight, node, comp, shingles); weight is the key's shingles.

    A key of more than `limit` shingles is cut into parts by a hash, and each pair of parts is a group, so every pair of
    nodes is compared and no task holds more than two parts. Only keys of many members that are near to each other and
    still of several components come here, so this exact way for the rest meets few keys.
    """
    kind = dict(met.dtypes)["node"]
    met = met.withColumn("parts", F.ceil(F.col("weight") / limit).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    groups = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.concat_ws("-", F.col("key"), F.least(o, F.col("own")), F.greatest(o, F.col("own"))))
    met = met.select("node", "comp", "shingles", F.explode(groups).alias("bucket"))
    met = met.repartition(partitions(met.sparkSession), "bucket").sortWithinPartitions("bucket", "node")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches, "bucket"):
            t = t.combine_chunks()
            bucket, comp = t["bucket"].to_numpy(), t["comp"].to_numpy()
            sets = [x.values.to_numpy().view("<u8") for x in t["shingles"]]
            cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
            pairs = [(i + lo, j + lo) for lo, hi in zip(cuts[:-1], cuts[1:]) for i, j in linked_sets(sets[lo:hi], comp[lo:hi], similarity)]
            a, b = np.array(pairs, np.int64).reshape(-1, 2).T
            nodes = t["node"].combine_chunks()
            nodes = nodes.chunk(0) if isinstance(nodes, pa.ChunkedArray) else nodes
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b))], ["a", "b"])

    return met.mapInArrow(find, f"a {kind}, b {kind}").distinct()


def chain_pairs(nodes: DataFrame) -> DataFrame:
    """(node, least): pairs of nodes (node, f) to check, found by pigeonring on the first word of f.

    Nodes of one word are paired with the smallest of them, and those link by chains of 7 of 16 segments as in `groups`, so
    pairs join all nodes whose words differ in 2 bits or fewer.
    """
    words = nodes.select("node", F.slice("f", 1, 1).alias("f"))
    least = cut(words.groupBy("f").agg(F.min("node").alias("least")))
    same = words.join(least, "f").filter("node <> least").select("node", "least")
    close = links(least.select(F.col("least").alias("id"), "f"), 2, 4, 7)
    return same.union(close.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("least")))


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, limit: int = 1 << 22, members: int = 1 << 16, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, root) of each document that has words: near duplicates share the root, the smallest id that links reach.

    Two documents link if the Jaccard similarity of their sets of shingles is at least `similarity`; each link is checked
    on the whole sets. Pairs to check are found by pigeonring on SimHash fingerprints of the sets (`chain_pairs`). Chains lose no pair within
    2 of 64 bits, but at similarity 0.8 about ten differ; so for the rest pairs are those that share a key of `band_keys`, which at 0.8
    three pairs in 100,000 don't. All are pruned by fingerprints: chains of words within their budgets, then the full Hamming distance. Equal
    sets are one node. First the chains' pairs and each node of a key with its smallest are compared, then, while keys hold several components,
    each node with one other pivot of its keys for ROUNDS rounds; so a large group of near copies joins by a few pairs for each of
    its members. Then, in keys that still hold more than one component, the members that are
    near to one of another component are compared, in tasks of bounded size. Repeated rows of one id are one
    document, of which one text, that of the smallest digest, is compared.
    """
    said = docs.filter(F.col(text).rlike(r"[^\x20\x09-\x0D]") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = dict(said.dtypes)["id"]

    def sets(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            codes = _Codes()
            for b in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
                found = [shingle_set(t.as_py(), shingle, codes) for t in b.column(1)]
                names = np.array([divmod(xxhash.xxh3_128_intdigest(h.tobytes()), 2**64) for h in found], "<u8").reshape(-1, 2).view("<i8")
                size = pa.array([len(h) for h in found], pa.int32())
                lists = [(h if whole else band_keys(h)).view("<i8") for h in found]
                cols = [b.column(0), pa.array(names[:, 0]), pa.array(names[:, 1]), size, pa.array(lists, pa.list_(pa.int64()))]
                if not whole:
                    cols.append(pa.array([majority(h, PRINT_WORDS).view("<i8") for h in found], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, ["id", "s0", "s1", "n", *(["shingles"] if whole else ["keys", "f"])])

        return run

    prints = said.mapInArrow(sets(False), f"id {kind}, s0 long, s1 long, n int, keys array<long>, f array<long>")
    prints = cut(prints.groupBy("id").agg(F.min(F.struct("s0", "s1", "n", "keys", "f")).alias("p")).select("id", "p.*"))
    nodes = prints.groupBy("s0", "s1").agg(F.min(F.struct("id", "n", "keys", "f")).alias("p"))
    nodes = cut(nodes.select("s0", "s1", F.col("p.id").alias("node"), "p.n", "p.keys", "p.f"))
    near = nodes.select("node", "n", "f")

    keys = nodes.select("node", F.explode("keys").alias("key"))
    least = keys.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    met = cut(keys.join(least, "key").select("key", "many", "node", "least"))
    chained = cut(chain_pairs(near))

    some = met.select("node").union(chained.select("node")).union(chained.select("least")).distinct()
    asked = nodes.join(some, "node").select(F.col("node").alias("id"), "s0", "s1")
    texts = said.join(asked.select("id"), "id", "left_semi").mapInArrow(sets(True), f"id {kind}, s0 long, s1 long, n int, shingles array<long>")
    texts = texts.join(asked, ["id", "s0", "s1"], "left_semi").dropDuplicates(["id"])
    texts = cut(texts.select(F.col("id").alias("node"), "shingles"))

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b): those of the pairs (node, least) that link."""
        pairs = pairs.join(near, "node").join(near.toDF("least", "least_n", "least_f"), "least")
        close = F.least("n", "least_n") >= similarity * F.greatest("n", "least_n") - 1e-9
        pairs = pairs.filter(close & chains_hold(F.col("f"), F.col("least_f"))).select("node", "least", "n", "least_n")
        both = F.size(F.array_intersect("shingles", "least_shingles"))
        same = both * (1 + similarity) >= similarity * (F.col("n") + F.col("least_n")) - 1e-9
        pairs = pairs.join(texts, "node").join(texts.toDF("least", "least_shingles"), "least").filter(same)
        return pairs.select(F.col("node").alias("a"), F.col("least").alias("b"))

    def opened(found: DataFrame) -> DataFrame:
        """(key, many, node, comp) of keys of several components; of two nodes the pair has been compared."""
        more = met.filter("many > 2").join(found, "node", "left").select("key", "many", "node", F.coalesce("root", "node").alias("comp"))
        keys_ = more.groupBy("key").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).filter("c <> d").select("key")
        return cut(more.join(keys_, "key"))

    found = components(verified(met.filter("node <> least").select("node", "least").union(chained).distinct()))
    more = opened(found)
    for turn in range(ROUNDS):
        pivots = more.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), "node", "comp")).alias("pivot"))
        pairs = more.join(pivots, "key").filter(F.col("comp") != F.col("pivot.comp")).groupBy("node").agg(F.min(F.struct("pivot.h", "pivot.node")).alias("pivot"))
        new = cut(verified(pairs.select("node", F.col("pivot.node").alias("least"))))
        if new.isEmpty():
            break
        found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(new))
        more = opened(found)
    more = cut(more.join(near, "node"))
    late = more.join(_open_members(more, similarity, members), ["key", "node"])
    late = late.join(late.groupBy("key").agg(F.sum("n").alias("weight")), "key").join(texts, "node")
    late = _bucket_links(late.select("key", "weight", "node", "comp", "shingles"), similarity, limit)
    found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(late))
    out = prints.select("id", "s0", "s1").join(nodes.select("s0", "s1", "node"), ["s0", "s1"])
    return out.join(found, "node", "left").select("id", F.coalesce("root", "node").alias("root"))


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, limit: int = 1 << 22, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document, that of the smallest id, of each of the `near_groups`.

    Texts of no words are no near duplicates of each other and stay; so do rows of NULL id. Repeated rows of one id
    stay or go together. Columns pass through, whatever their names. An empty table gives no rows.
    """
    found = near_groups(docs, shingle, similarity, limit, id_col=id_col, text=text)
    gone = found.filter("id <> root").select(F.col("id").alias("__gone"))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def hex_digits(f: Column) -> Column:
    """16 lower-case hex digits of a long."""
    return F.lpad(F.lower(F.hex(f)), 16, "0")
