"""Whitening of embeddings by shifted Cholesky QR over distributed Gram passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import cut
from llm.vectors import matrix, usable

#: Rows that meet in one product.
ROWS = 4096
#: Entries of a Gram matrix sum over this many partial sums a round.
FAN = 64
#: Passes at most.
PASSES = 16


def _solved(y: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """y times the inverses of the upper triangular factors in order, column by column."""
    for r in factors:
        q = np.empty_like(y)
        for j in range(y.shape[1]):
            q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        y = q
    return y


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - total / n: the difference in whole numbers, then one rounding."""
    if float(np.abs(x).max(initial=0)) * n < 2.0**62:
        return (n * x - total) / n
    exact = n * x.astype(object) - total.astype(object)
    return np.array([[float(v) for v in row] for row in exact / n]).reshape(x.shape)


def _gram(fit: DataFrame, n: int, total: np.ndarray, factors: list[np.ndarray], projection: np.ndarray | None = None) -> np.ndarray:
    """Sum of outer products of the centred, solved and projected rows of fit (x).

    Each task yields one matrix; matrices are summed in groups of FAN, entry by entry, until the last sums go to the driver: one number
    an entry, whatever the number of rows or tasks.
    """
    d = len(total) if projection is None else projection.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((d, d))
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                y = _solved(_centred(matrix(pa.Table.from_batches([b.slice(i, ROWS)]), "x", "int64"), n, total), factors)
                y = y if projection is None else y @ projection
                g += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([g.ravel().tolist()], pa.list_(pa.float64()))], ["g"])

    parts = fit.select("x").mapInArrow(part, "g array<double>").withColumn("part", F.spark_partition_id())
    entries = parts.select(F.expr(f"part div {FAN}").alias("part"), F.posexplode("g").alias("at", "v"))
    sums = entries.groupBy("part", "at").agg(F.sum("v").alias("v")).groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(d * d)
    for r in sums.collect():  # d * d numbers
        out[r["at"]] = r["v"]
    out = out.reshape(d, d)
    return (out + out.T) / 2


def orthogonal_factor(fit: DataFrame, n: int, total: np.ndarray) -> tuple[np.ndarray, float]:
    """(R, squared length): R upper triangular with RᵀR the Gram matrix of the centred rows, by shifted Cholesky QR.

    Each pass takes the Gram matrix of the rows solved by the factors so far, adds a shift while it isn't safely positive
    definite, and factors it; R is the product of the factors. Passes end when the solved rows are orthonormal in all
    directions in which the data vary.
    """
    d, eps = len(total), np.finfo(float).eps
    r, factors, length = np.eye(d), [], 0.0
    for k in range(PASSES):
        g = _gram(fit, n, total, factors)
        length = float(np.trace(g)) if not k else length
        if not length:
            return np.zeros((d, d)), 0.0
        values = np.linalg.eigvalsh(g)
        if k:
            sigma = np.linalg.svd(r, compute_uv=False)
            vary = int((sigma > sigma[0] * d * eps).sum())
            if int((np.abs(values - 1) <= 1e-12 * d).sum()) >= vary:
                break
        shift = 11 * (d * n + d * (d + 1)) * eps * values[-1]
        # Beyond 1 / eps rows the proven shift exceeds the matrix: a small share of it is enough, and more passes follow.
        shift = min(shift, 1e-3 * values[-1]) if values[0] <= max(shift, 1e-10 * values[-1]) else 0.0
        factor = np.linalg.cholesky(g + shift * np.eye(d)).T
        factors.append(factor)
        r = factor @ r
    return r, length


def whitening(vectors: DataFrame, scale: int = 64, offset: int = 1_000_000, components: int = 16, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: each vector's whitened components.

    Entries become whole numbers x = floor(scale * entry) + offset. The fit list is each distinct vector x once, n of them with sums S.
    Components are unit eigenvectors of the fit list's covariance (divisor n), by falling eigenvalue e, `components` at
    most, each with its largest entry positive. deviation is the sum of (n x - S)**2, NULL if it is no long; whitened is x - S / n on the
    component, over sqrt(e); explained is e over the covariance's trace; identity_error the largest entry of the whitened fit list's
    covariance minus the identity.

    NULL vectors, empty ones, those holding NULL or non-finite entries and NULL ids take no part; nor do vectors with an entry
    beyond 2**52 / scale, whose x would not be exact. Vectors of the most frequent length (of those, the largest) are one space; other lengths
    take no part. Components in which the list does not vary (singular value under d * 2.2e-16 of the first) are left
    out: a list of one vector has none. Repeated rows have rows each. Other columns are not read. An empty table gives
    no rows. The driver holds matrices of length**2 numbers and nothing that grows with the rows.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(vectors, id_col, vector)
    rows = rows.filter(~F.exists("v", lambda x: F.abs(x) > 2.0**52 / scale))
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long") + offset).alias("x"))
    dim = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if dim is None:
        return spark.createDataFrame([], schema)
    d = dim["d"]
    rows = cut(rows.filter(F.size("x") == d))
    fit = cut(rows.select("x").distinct())
    sums = fit.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("s"))
    by = {q["j"]: q for q in sums.collect()}  # one row a dimension
    n, total = int(by[0]["n"]), [int(by[j]["s"]) for j in range(d)]
    s = np.array(total, np.int64 if max(map(abs, total)) < 2**62 else object)
    r, length = orthogonal_factor(fit, n, s)
    _, sigma, vt = np.linalg.svd(r)
    m = int((sigma[:components] > max(sigma[0], np.finfo(float).tiny) * d * np.finfo(float).eps).sum())
    if not m:
        return spark.createDataFrame([], schema)
    v = vt[:m].T
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(m)])
    project = v / (sigma[:m] / np.sqrt(n))
    explained = (sigma[:m] ** 2 / length).tolist()
    error = float(np.abs(_gram(fit, n, s, [], project) / n - np.eye(m)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                some = b.slice(i, ROWS)
                x = matrix(pa.Table.from_batches([some]), "x", "int64")
                w = _centred(x, n, s) @ project
                if float(np.abs(x).max(initial=0)) * 2 * n < 2.0**62 and (most := np.abs(away := n * x - s).max(initial=0)) and float(most) ** 2 * d < 2.0**62:
                    deviation = (away**2).sum(1).tolist()
                else:
                    deviation = [t if t < 2**63 else None for t in ((n * x.astype(object) - np.array(total, object)) ** 2).sum(1).tolist()]
                each = len(x) * m
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(some.column("id").to_numpy(), m)),
                        pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(each, n)),
                        pa.array([t for t in deviation for _ in range(m)], pa.int64()),
                        pa.array(w.ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(each, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
