"""Search of a stated query set against all rows: exact top-k, and approximate nearest neighbours.

Rows are dealt to ranges of one kd-order over the table, whose splits come from a bounded sample, and each range keeps a
box around its rows. A query first goes to the ranges of best bound; its k-th score there decides which other ranges it
still has to visit. Each pair of a range and a block of queries is one cogrouped task of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from llm.common import cut

#: Rows of a range, queries of a block in a range, boxes and queries that meet for bounds.
ROW_BLOCK, QUERY_BLOCK, BOXES, BOUND_QUERIES = 4096, 4096, 1024, 65536
#: Rows that the kd-order's splits are fitted on, those of the smallest hashes; every row is indexed.
SAMPLE = 8192
#: Ranges that a query visits before its k-th score is known.
FIRST = 2


def usable(vectors: DataFrame, id_col: str, vector: str, zero: bool = True) -> DataFrame:
    """(id, v) of vectors without NULL or non-finite components; not empty; zero vectors only if wanted."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~bad)
    return rows if zero else rows.filter(F.exists("v", lambda x: x != 0))


def matrix(t: pa.Table, column: str, kind: str) -> np.ndarray:
    flat = t[column].combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(flat), -1)


def leaves(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of kd-tree leaves: a node splits at the median of its widest dimension."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        part = x[rows]
        d = int(np.argmax(part.max(0) - part.min(0)))
        half = len(rows) // 2
        order = np.argpartition(part[:, d], half)
        todo += [rows[order[half:]], rows[order[:half]]]
    return out


def visit(order: np.ndarray, stop: Callable[[np.ndarray, np.ndarray], np.ndarray], score: Callable[[int, np.ndarray], None]) -> None:
    """Each query visits blocks in its own order until stop(queries, next blocks) holds for it.

    Queries that are at the same block in the same round are scored together.
    """
    active = np.arange(len(order))
    for step in range(order.shape[1]):
        active = active[~stop(active, order[active, step])]
        if not len(active):
            return
        at = order[active, step]
        by = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[by])) + 1
        for group in np.split(by, cuts):
            score(int(at[group[0]]), active[group])


def chi_square(x: float, m: int) -> float:
    """Distribution function for an even number m of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - math.exp(-min(half, 700)) * total


@lru_cache
def chi_square_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, m) < p else (lo, mid)
    return hi


class Best:
    """The k best (score, id) of each query row, which keys name: larger scores first, ties to smaller ids. `least` is a score that must be reached."""

    def __init__(self, queries: np.ndarray, keys: np.ndarray, k: int, kind: type, worst: float, least: np.ndarray):
        self.own, self.keys, self.k = queries, keys, k
        self.worst, self.least = worst, least
        self.score = np.full((len(queries), k), worst, kind)
        self.id = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)

    def kth(self, at: np.ndarray) -> np.ndarray:
        """The score that the next candidate has to reach."""
        return np.maximum(self.score[at, -1], self.least[at])

    def offer(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.where((ids[None, :] == self.own[at][:, None]) | (scores < self.kth(at)[:, None]), self.worst, scores)
        s = np.concatenate([self.score[at], scores], axis=1)
        i = np.concatenate([self.id[at], np.broadcast_to(ids, scores.shape)], axis=1)
        i = np.where(s == self.worst, np.iinfo(np.int64).max, i)
        order = np.lexsort((i, -s), axis=-1)[:, : self.k]
        self.score[at], self.id[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def table(self) -> pa.Table:
        q, r = np.nonzero(self.score != self.worst)
        return pa.table({"key": self.keys[q], "query_id": self.own[q], "vec_id": self.id[q, r], "score": self.score[q, r]})


@dataclass(frozen=True)
class Exact:
    """Integer inner products: ranges by the vectors themselves, bounds by term maxima and minima, scores without rounding."""

    k: int
    kind = np.int64

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        return x

    def bounds(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The largest score a row in each box can have."""
        return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T

    def open(self, q: np.ndarray, bounds: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Whether a box can hold a row that reaches the k-th score."""
        return ~(bounds < kth)

    def block(self, x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, keys: np.ndarray, kth: np.ndarray, leaf: int = 32) -> pa.Table:
        """Top k of integer vectors by block-at-a-time pruning.

        Rows are put in order of a kd-tree and cut into ranges, with a maximum and a minimum of each term. A query
        takes ranges by falling bound, the sum over terms of its best possible product, and scores a range's forward index
        until the next bound is below its k-th score.
        """
        if np.abs(x).max() * np.abs(q).max() * x.shape[1] >= 2.0**53:
            x, q, kth = x.astype("int64"), q.astype("int64"), np.where(np.isfinite(kth), kth, np.iinfo(np.int64).min).astype("int64")
        blocks = leaves(x, leaf)
        bound = self.bounds(q, np.array([x[b].min(0) for b in blocks]), np.array([x[b].max(0) for b in blocks]))
        best = Best(own, keys, self.k, x.dtype.type, -np.inf if x.dtype == np.float64 else np.iinfo(np.int64).min, kth)
        forward = [(x[b], ids[b]) for b in blocks]
        visit(
            np.argsort(-bound, axis=1, kind="stable"),
            lambda a, b: bound[a, b] < best.kth(a),
            lambda b, a: best.offer(a, q[a] @ forward[b][0].T, forward[b][1]),
        )
        return best.table()


def in_order(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of q and x, term by term from the first: equal vectors get equal scores anywhere."""
    out = q[:, 0] * x[:, 0]
    for d in range(1, q.shape[1]):
        out = out + q[:, d] * x[:, d]
    return out


@dataclass(frozen=True)
class Near:
    """Nearest by inner product, found through m stable projections.

    A row gets one more component so that all rows are of one length; then the largest inner product is the
    least Euclidean distance. Gaussian projections are indexed by a kd-tree. A query takes leaves by projected distance, nearest
    first, and verifies a row only while the test is open for it: the squared ratio of its projected distance to the k-th true distance
    so far follows a chi-square law of m degrees for rows at that distance, so beyond its quantile `sure` a row as near as the k-th is
    missed with probability 1 - sure at most. A query stops at the first leaf that lies beyond the quantile whole.
    """

    k: int
    m: int
    sure: float
    seed: int
    scale: float
    longest: float
    kind = np.float64

    def project(self, n: int) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((n + 1, self.m))

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        unit = x / self.scale
        lift = np.sqrt(np.maximum(self.longest - (unit**2).sum(1), 0))
        p = self.project(x.shape[1])
        return unit @ p[:-1] + lift[:, None] * p[-1]

    def lengths(self, q: np.ndarray) -> np.ndarray:
        most = np.abs(q).max(1)
        return np.sqrt(((q / most[:, None]) ** 2).sum(1)) * most

    def bounds(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Less the squared distance of the projections; a query's length doesn't change its order."""
        pq = (q / self.lengths(q)[:, None]) @ self.project(q.shape[1])[:-1]
        away = np.zeros((len(q), len(low)))
        for d in range(self.m):
            x = pq[:, d, None]
            out = x - np.minimum(np.maximum(x, low[None, :, d]), high[None, :, d])
            out *= out
            away += out
        return -away

    def reach(self, q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """The squared projected distance up to which a row has to be verified."""
        with np.errstate(invalid="ignore"):
            true = np.maximum(1 + self.longest - 2 * kth / self.scale / self.lengths(q)[:, None], 1e-12)
            return np.where(np.isfinite(kth), true * chi_square_quantile(self.sure, self.m), np.inf)

    def open(self, q: np.ndarray, bounds: np.ndarray, kth: np.ndarray) -> np.ndarray:
        return -bounds <= self.reach(q, kth)

    def block(self, x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, keys: np.ndarray, kth: np.ndarray, leaf: int = 32) -> pa.Table:
        p = self.coordinates(x)
        tree = leaves(p, leaf)
        bound = self.bounds(q, np.array([p[b].min(0) for b in tree]), np.array([p[b].max(0) for b in tree]))
        best = Best(own, keys, self.k, np.float64, -np.inf, kth)
        forward = [(x[b], ids[b]) for b in tree]
        slack = self.lengths(q) * np.sqrt((x**2).sum(1).max()) * 1e-12
        pq = (q / self.lengths(q)[:, None]) @ self.project(q.shape[1])[:-1]
        pq_square = (pq**2).sum(1)
        near = [(p[b].T, (p[b] ** 2).sum(1)) for b in tree]

        def score(b: int, a: np.ndarray) -> None:
            rows, names = forward[b]
            away = pq_square[a][:, None] + near[b][1][None, :] - 2 * pq[a] @ near[b][0]
            verified = away <= self.reach(q[a], best.kth(a)[:, None])
            fast = q[a] @ rows.T
            i, j = np.nonzero(verified & (fast >= (best.kth(a) - slack[a])[:, None]))
            exact = np.full(fast.shape, -np.inf)
            exact[i, j] = in_order(q[a][i], rows[j])
            best.offer(a, exact, names)

        visit(np.argsort(-bound, axis=1, kind="stable"), lambda a, b: ~self.open(q[a], bound[a, b][:, None], best.kth(a)[:, None])[:, 0], score)
        return best.table()


def splits(sample: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(dimensions, medians) of each level of a kd-tree over the sample: a node splits its widest dimension."""
    out, parts = [], [sample]
    for _ in range(depth):
        dims, cuts, below = np.zeros(len(parts), int), np.zeros(len(parts)), []
        for i, x in enumerate(parts):
            if len(x):
                dims[i] = int(np.argmax(x.max(0) - x.min(0)))
                cuts[i] = np.median(x[:, dims[i]])
            left = x[:, dims[i]] <= cuts[i]
            below += [x[left], x[~left]]
        out.append((dims, cuts))
        parts = below
    return out


def ranges(x: np.ndarray, tree: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The leaf of each row."""
    at = np.zeros(len(x), np.int64)
    for dims, cuts in tree:
        at = 2 * at + (x[np.arange(len(x)), dims[at]] > cuts[at])
    return at


def renewed(df: DataFrame) -> DataFrame:
    """df with columns of their own, so that it can meet a table it comes from."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def search(rows: DataFrame, is_query: Column, k: int, method: Exact | Near, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK, first: int = FIRST) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best in rows (id, v); vectors meet those of their dimension."""
    spark = rows.sparkSession
    score = "long" if method.kind is np.int64 else "double"
    sides = rows.withColumn("dim", F.size("v"))
    sizes = {r["dim"]: (r["n"], r["q"]) for r in sides.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).collect()}
    taken: dict[int, list] = {}
    for r in sides.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("dim", "v").collect():
        taken.setdefault(r["dim"], []).append(r["v"])
    trees, parts = {}, {}
    for dim, (n, _) in sizes.items():
        sample = method.coordinates(np.array(taken[dim], float)) if dim in taken else np.empty((0, 1))
        depth = int(max(0, min(np.ceil(np.log2(max(1, n / row_block))), np.floor(np.log2(max(1, len(sample) / 8))))))
        trees[dim] = splits(sample, depth)
        parts[dim] = int(-(-n // (row_block << depth)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = np.zeros(b.num_rows, np.int64)
            dims, salt = b.column(2).to_numpy(), b.column(3).to_numpy()
            for dim in np.unique(dims).tolist():
                some = np.flatnonzero(dims == dim)
                x = matrix(pa.Table.from_batches([b.take(pa.array(some))]), "v", "float64")
                block[some] = ranges(method.coordinates(x), trees[dim]) * parts[dim] + salt[some] % parts[dim]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), b.column(5), pa.array(block)], ["id", "v", "dim", "asked", "key", "block"])

    kind = dict(rows.dtypes)["v"]
    dealt = sides.select("id", "v", "dim", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("salt"), is_query.alias("asked"), F.monotonically_increasing_id().alias("key"))
    # Written once, so a row keeps its key: two rows of one id are two queries.
    dealt = cut(dealt.mapInArrow(deal, f"id long, v {kind}, dim int, asked boolean, key long, block long"))

    def box(key: tuple, t: pa.Table) -> pa.Table:
        p = method.coordinates(matrix(t, "v", "float64"))
        return pa.table({"dim": [key[0].as_py()], "block": [key[1].as_py()], "low": [p.min(0).tolist()], "high": [p.max(0).tolist()]}, pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))

    boxes = cut(dealt.groupBy("dim", "block").applyInArrow(box, "dim int, block long, low array<double>, high array<double>"))
    queries = dealt.filter("asked").select("key", F.col("id").alias("query_id"), F.col("v").alias("q"), "dim")
    groups = spark.createDataFrame([(d, g, a) for d, (_, q) in sizes.items() for g in range(-(-(parts[d] << len(trees[d])) // BOXES)) for a in range(-(-q // BOUND_QUERIES))], "dim int, g int, a int")
    blocks_of = {d: max(1, -(-q // BOUND_QUERIES)) for d, (_, q) in sizes.items()}
    many = F.coalesce(*(F.when(F.col("dim") == d, F.lit(n)) for d, n in blocks_of.items()), F.lit(1)) if blocks_of else F.lit(1)
    grouped = boxes.withColumn("g", F.expr(f"block div {BOXES}").cast("int")).join(F.broadcast(groups), ["dim", "g"])

    def asked(found: DataFrame | None) -> DataFrame:
        """(key, block): the pairs of the first round, or with (key, kth) of what it found, those that are still open."""
        opening = found is None
        known = queries.withColumn("kth", F.lit(None).cast("double")) if found is None else queries.join(found, "key", "left")
        known = known.withColumn("a", F.pmod(F.xxhash64("key"), many).cast("int")).join(F.broadcast(groups), ["dim", "a"])

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            made = [[np.empty(0, np.int64)] * 2]
            bounds_ = [np.empty(0)]
            if left.num_rows and right.num_rows:
                low, high, block = matrix(right, "low", "float64"), matrix(right, "high", "float64"), right["block"].to_numpy()
                for i in range(0, left.num_rows, 4096):
                    some = left.slice(i, 4096)
                    q = matrix(some, "q", "float64")
                    kth = some["kth"].to_numpy().astype(float)[:, None]
                    bounds = method.bounds(q, low, high)
                    order = np.argsort(-bounds, axis=1, kind="stable")
                    if opening:
                        r, c = np.repeat(np.arange(len(q)), min(first, len(low))), order[:, :first].ravel()
                    else:
                        r, c = np.nonzero(method.open(q, bounds, np.where(np.isnan(kth), -np.inf, kth)))
                    made.append([some["key"].to_numpy()[r], block[c]])
                    bounds_.append(bounds[r, c].astype(float))
            ids, blocks = (np.concatenate(x) for x in zip(*made, strict=True))
            return pa.table({"key": ids, "block": blocks, "bound": np.concatenate(bounds_)})

        pairs = renewed(known).groupBy("dim", "g", "a").cogroup(grouped.groupBy("dim", "g", "a")).applyInArrow(run, "key long, block long, bound double")
        if opening:
            order = W.partitionBy("key").orderBy(F.desc("bound"), "block")
            pairs = pairs.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= first)
        return pairs.select("key", "block")

    def met(pairs: DataFrame, kth: DataFrame | None) -> DataFrame:
        """(key, query_id, vec_id, score): each query row's best in each of its blocks."""
        with_q = pairs.join(queries, "key")
        with_q = with_q.withColumn("kth", F.lit(None).cast("double")) if kth is None else with_q.join(kth, "key", "left")
        with_q = with_q.withColumn("s", F.xxhash64("key"))
        load = with_q.groupBy("dim", "block").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("k"))
        with_q = with_q.join(load, ["dim", "block"]).withColumn("a", F.pmod("s", "k").cast("int"))
        held = dealt.join(load, ["dim", "block"]).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        schema = pa.schema([("key", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64() if score == "long" else pa.float64())])

        def run(x: pa.Table, q: pa.Table) -> pa.Table:
            if not x.num_rows or not q.num_rows:
                return schema.empty_table()
            least = q["kth"].to_numpy().astype(float)
            out = method.block(matrix(x, "v", "float64"), x["id"].to_numpy(), matrix(q, "q", "float64"), q["query_id"].to_numpy(), q["key"].to_numpy(), np.where(np.isnan(least), -np.inf, least))
            return out.cast(schema)

        by = ["dim", "block", "a"]
        return held.select("id", "v", *by).groupBy(*by).cogroup(renewed(with_q.select("key", "query_id", "q", "kth", *by)).groupBy(*by)).applyInArrow(run, f"key long, query_id long, vec_id long, score {score}")

    order = W.partitionBy("key").orderBy(F.desc("score"), F.asc("vec_id"))
    pairs = cut(asked(None))
    early = cut(met(pairs, None).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    kth = early.filter(F.col("rank") == k).select("key", F.col("score").cast("double").alias("kth"))
    later = met(asked(kth).join(pairs, ["key", "block"], "left_anti"), kth)
    out = early.select("key", "query_id", "vec_id", "score").union(later).withColumn("rank", F.row_number().over(order).cast("int"))
    return out.select("query_id", "rank", "vec_id", "score").filter(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256, row_block: int = ROW_BLOCK) -> DataFrame:
    """Exact k best by integer inner product of floor(scale * x): query_id, rank, vec_id, score long.

    is_query is a condition on the column `id`. A query's own row, and rows of its id, are no candidates; two rows of one
    id are two queries, with ranks of their own under that id. NULL vectors,
    vectors holding NULL or non-finite components, empty vectors and NULL ids take no part. Ties go to
    the smaller id. A query with fewer candidates gets them all; repeated rows of one id are candidates each; an empty table
    gives no rows. Other columns are not read. Scores below 2**53 are compared as they are; above, bounds are doubles.
    """
    rows = usable(vectors, id_col, vector)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long")))
    return search(rows, is_query, k, Exact(k), row_block)


def nearest(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector: str = "embedding", m: int = 32, sure: float = 0.88, seed: int = 11, row_block: int = ROW_BLOCK) -> DataFrame:
    """k nearest found by largest inner product: query_id, rank, vec_id, score double.

    As exact_top_k, but zero vectors take no part either, and a neighbour may be missed: `sure` is the
    probability asked of the stopping test, m (even) the number of projections. A score is the sum of products from the
    first component to the last in double precision, so equal vectors have equal scores and go by id.
    """
    rows = usable(vectors, id_col, vector, zero=False)
    scale = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / scale) * (x / scale))
    longest = rows.agg(F.max(square)).first()[0] or 1.0
    return search(rows, is_query, k, Near(k, m, sure, seed, scale, longest), row_block)
