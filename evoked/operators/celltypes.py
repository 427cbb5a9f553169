"""Unit quality, two-component mixtures of waveform features, waveform graph clustering, class means."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def quality_metrics(spikes: DataFrame, extent: DataFrame, keys: list[str], bin_ticks: int, refractory: int, t: str = "t_tick") -> DataFrame:
    """num_spikes, firing_rate, presence_ratio (share of bins with a spike), isi_violations_ratio."""
    w = W.partitionBy(*keys).orderBy(t)
    rows = spikes.withColumn("isi", F.col(t) - F.lag(t).over(w))
    s = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_spikes"), F.countDistinct(F.expr(f"{t} div {bin_ticks}")).alias("present"), F.avg((F.col("isi") < refractory).cast("double")).alias("isi_violations_ratio"))
    s = s.join(extent, [k for k in keys if k in extent.columns])
    return s.select(*keys, "num_spikes", (F.col("num_spikes") * 1e6 / F.col("duration")).alias("firing_rate"), (F.col("present") / F.expr(f"(duration + {bin_ticks} - 1) div {bin_ticks}")).alias("presence_ratio"), "isi_violations_ratio")


def template_quality(samples: DataFrame, keys: list[str], at: str = "i", value: str = "x") -> DataFrame:
    """(keys, num_waveforms, amplitude, noise, snr): largest absolute mean sample, and noise as 1.4826 times the median absolute deviation."""
    means = samples.groupBy(*keys, at).agg(F.avg(value).alias("m"), F.count(F.lit(1)).alias("n"))
    peaks = means.groupBy(*keys).agg(F.max(F.abs("m")).alias("amplitude"), F.max("n").alias("num_waveforms"))
    centre = samples.groupBy(*keys).agg(F.median(value).alias("__c"))
    noise = samples.join(centre, keys).groupBy(*keys).agg((F.median(F.abs(F.col(value) - F.col("__c"))) * 1.4826).alias("noise"))
    return peaks.join(noise, keys).select(*keys, "num_waveforms", "amplitude", "noise", F.when(F.col("noise") > 0, F.col("amplitude") / F.col("noise")).alias("snr"))


def good_units(metrics: DataFrame, min_spikes: int = 100, min_presence: float = 0.5, max_violations: float = 0.5) -> DataFrame:
    """Units that pass the masks; a missing presence fails, missing violations pass."""
    return metrics.filter((F.col("num_spikes") >= min_spikes) & (F.coalesce("presence_ratio", F.lit(0.0)) >= min_presence) & (F.coalesce("isi_violations_ratio", F.lit(0.0)) <= max_violations))


def mixture_labels(df: DataFrame, features: list[str], narrow: str, keys: list[str], min_confidence: float = 0.7, seed: int = 13) -> DataFrame:
    """(keys, cluster, confidence, cell_type): full-covariance mixture of two on standardised features.

    The cluster of the smaller median of `narrow` is FS, the other RS; below min_confidence boundary; rows
    with a NULL feature low_quality.
    """
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    df = df.select(*dict.fromkeys([*keys, *features, narrow])).persist()  # each iteration of the fit reads it
    ok = df.dropna(subset=features)
    vectors = VectorAssembler(inputCols=features, outputCol="__raw").transform(ok)
    scaled = StandardScaler(inputCol="__raw", outputCol="features", withMean=True).fit(vectors).transform(vectors)
    out = GaussianMixture(k=2, seed=seed, maxIter=60, tol=1e-3).fit(scaled).transform(scaled)
    out = out.withColumn("confidence", F.array_max(vector_to_array("probability"))).select(*keys, narrow, F.col("prediction").alias("cluster"), "confidence")
    fs = out.groupBy("cluster").agg(F.median(narrow).alias("m")).agg(F.min_by("cluster", "m").alias("fs"))
    kind = F.when(F.col("confidence") < min_confidence, "boundary").when(F.col("cluster") == F.col("fs"), "FS").otherwise("RS")
    labelled = out.join(F.broadcast(fs)).select(*keys, "cluster", "confidence", kind.alias("cell_type"))
    return df.select(*keys).join(labelled, keys, "left").fillna("low_quality", ["cell_type"])


#: Blocks that waveforms are dealt to, and the rows from which on more blocks are made, which bound a task's memory.
BLOCKS, BLOCK_ROWS = 16, 1 << 16


def nearest_of(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int, same: bool, cells: int = 1 << 22) -> pd.DataFrame:
    """(src, dst, d2): for each row of x its k nearest rows of y of another id, and no others; products of at most `cells` distances at once."""
    x_size, y_size = (x * x).sum(1), (y * y).sum(1)
    take, step = min(k + same, len(y)) - 1, max(1, cells // len(y))
    found = [pd.DataFrame({"src": ids[:0], "dst": others[:0], "d2": np.empty(0)})]
    for at in range(0, len(x), step):
        here = slice(at, at + step)
        near = x[here] @ (-2 * y.T)
        near += y_size
        near += x_size[here, None]
        if same:
            near[ids[here, None] == others[None, :]] = np.inf
        limit = np.partition(near, take, axis=1)[:, take] + 1e-12 * (1 + x_size[here] + y_size.max())
        i, j = np.nonzero((near <= limit[:, None]) & np.isfinite(near))
        out = pd.DataFrame({"src": ids[here][i], "dst": others[j], "d2": ((x[here][i] - y[j]) ** 2).sum(1)})
        found.append(out.sort_values(["src", "d2", "dst"]).groupby("src", sort=False).head(k))
    return pd.concat(found, ignore_index=True)


def neighbour_graph(df: DataFrame, key: str, vector: str, k: int, block: int = BLOCK_ROWS, blocks: int = BLOCKS) -> DataFrame:
    """(src, dst, d2, weight): k nearest waveforms by squared distance, ties to the smaller dst, compared block by block.

    Rows are dealt to `blocks` blocks, to more only if a block would pass `block` rows, and every pair of blocks is one task's work, both ways: matrix
    products of bounded size give the distances, and of each row only the k nearest of the other block, and what rounding can't tell from them, are
    summed up again from differences. A row is sent once for each block, so what is shuffled grows as the rows do, up to
    blocks * block rows; products of all pairs stay quadratic. Rows without a vector take no part.
    """
    df = df.filter(F.col(vector).isNotNull())
    blocks = max(blocks, -(-df.count() // block))
    kept = F.col(vector) if dict(df.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).alias("id"), kept.alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = rows.select("id", "v", "b", other.alias("o")).select("id", "v", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))
    kind = dict(rows.dtypes)["id"]

    def nearest(pair: tuple, t: pd.DataFrame) -> pd.DataFrame:
        p, q = pair
        sides = []
        for b in {p, q}:
            own = t[t.b == b]
            sides.append((own.id.to_numpy(), np.stack(own.v.to_numpy()).astype(np.float64) if len(own) else None))
        out = pd.DataFrame({"src": t.id[:0], "dst": t.id[:0], "d2": np.empty(0)})
        if any(x is None for _, x in sides):
            return out
        if p == q:
            return nearest_of(*sides[0], *sides[0], k, True)
        return pd.concat([nearest_of(*sides[0], *sides[1], k, False), nearest_of(*sides[1], *sides[0], k, False)], ignore_index=True)

    part = rows.repartition(blocks * (blocks + 1) // 2, "p", "q").groupBy("p", "q").applyInPandas(nearest, f"src {kind}, dst {kind}, d2 double")
    w = W.partitionBy("src").orderBy("d2", "dst")
    near = part.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return near.select("src", "dst", "d2", F.exp(-F.col("d2")).alias("weight"))


def plane_view(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pc_1, pc_2): centred waveforms on their first two principal components; the largest loading of each is positive.

    The covariance is summed in parts; only it and the two components are on the driver, of the size of a waveform. Rows without a vector take no part.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.filter(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("__v"))
    centred = StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False).fit(rows).transform(rows)
    model = PCA(k=2, inputCol="__c", outputCol="__o").fit(centred)
    loads = model.pc.toArray()
    signs = np.sign(loads[np.abs(loads).argmax(axis=0), [0, 1]])
    at = vector_to_array("__o")
    return model.transform(centred).select(key, *((at[i] * float(signs[i])).alias(f"pc_{i + 1}") for i in range(2)))


def graph_communities(graph: DataFrame, k: int, iterations: int = 20) -> DataFrame:
    """(id, cluster) by power iteration clustering on the symmetric neighbour graph."""
    from pyspark.ml.clustering import PowerIterationClustering

    both = graph.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    return PowerIterationClustering(k=k, maxIter=iterations, initMode="degree", weightCol="weight").assignClusters(both)


def class_waveforms(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, i, mean, sd, n): mean waveform of a class, population sd."""
    return df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.count(F.lit(1)).alias("n"))
