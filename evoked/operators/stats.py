"""Rank tests, correlations, false-discovery control, permutation clusters, regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from evoked.functions.tails import chi2_p, t_p, t_quantile, two_sided
from evoked.operators.order import cut, met, ranked, ranked_by_range, running

EXACT_MAX = 50
#: Rows that a task ranks in windows, about; counts of partitions follow from it.
RANKED_ROWS = 1 << 19


def avg_rank(value: Column, keys: list[str]) -> Column:
    """Rank within keys, ties averaged."""
    return F.rank().over(W.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, value)) - 1) / 2.0


def _exact_signed_rank(n: int, w: float) -> float:
    """P(min(W+, W-) <= w) for n untied, non-zero differences."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r]
    return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))


def _exact_u(n1: int, n2: int, u: float) -> float:
    """Two-sided P of the Mann-Whitney U for samples without ties."""
    ways = np.zeros((n1 + 1, n1 * n2 + 1))
    ways[0, 0] = 1
    for j in range(1, n1 + n2 + 1):
        for i in range(min(j, n1), 0, -1):
            shift = j - i
            if shift <= n2:
                ways[i, shift:] += ways[i - 1, : n1 * n2 + 1 - shift] if shift else ways[i - 1]
    total = ways[n1].sum()
    return float(min(1.0, 2 * ways[n1][: int(u) + 1].sum() / total))


@F.pandas_udf(T.DoubleType())
def exact_signed_rank_p(n: pd.Series, w: pd.Series) -> pd.Series:
    return pd.Series([_exact_signed_rank(int(a), b) if pd.notna(a) and pd.notna(b) and 0 < a <= EXACT_MAX else None for a, b in zip(n, w, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def exact_u_p(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    return pd.Series([_exact_u(int(a), int(b), c) if pd.notna(c) and 0 < a * b <= 400 else None for a, b, c in zip(n1, n2, u, strict=True)], dtype="float64")


def signed_rank(df: DataFrame, keys: list[str], d: str = "d", zeros: str = "wilcox", exact: bool = False, min_n: int = 1) -> DataFrame:
    """Wilcoxon signed-rank of differences d against 0: n (non-zero), stat = min(R+, R-), p.

    zeros: "wilcox" drops zero differences before ranking, "pratt" ranks them and then drops their ranks. p is
    normal with tie correction; with exact, groups of up to 50 untied differences without zeros get the exact p.
    All zero: stat 0, p 1. Fewer than min_n differences, zeros included: NULL.
    """
    rows = df.filter(F.col(d).isNotNull())
    x = F.col(d)
    every = cut(rows.groupBy(*keys, F.abs(x).alias("__a")).agg(F.count_if(x > 0).alias("__up"), F.count_if(x < 0).alias("__down"), F.count(F.lit(1)).alias("__t")))
    used = every if zeros == "pratt" else every.filter(F.col("__a") != 0)
    r, t = F.col("rank"), F.col("__t").cast("double")
    stats = ranked(used, keys, "__a", "__t").groupBy(*keys).agg(
        F.sum(F.col("__up") * r).alias("rp"),
        F.sum(F.col("__down") * r).alias("rm"),
        F.sum("__t").alias("na"),
        F.sum(F.when(F.col("__a") == 0, F.col("__t")).otherwise(0)).alias("nz"),
        F.sum(F.when(F.col("__a") != 0, t * (t * t - 1.0)).otherwise(0)).alias("ties"),
    )
    counts = every.groupBy(*keys).agg(F.sum("__t").alias("n_all"), F.sum(F.col("__up") + F.col("__down")).alias("n"))
    out = met(counts, stats, keys, "left")
    na, nz = F.col("na").cast("double"), F.col("nz").cast("double")  # their cubes pass 64 bits at 1.7 million
    mean = (na * (na + 1) - nz * (nz + 1)) / 4.0
    var = (na * (na + 1) * (2 * na + 1) - nz * (nz + 1) * (2 * nz + 1)) / 24.0 - F.col("ties") / 48.0
    stat = F.least("rp", "rm")
    p = F.when(var > 0, two_sided((stat - mean) / F.sqrt(var)))
    if exact:
        p = F.when((F.col("ties") == 0) & (F.col("n_all") == F.col("n")) & (F.col("n") <= EXACT_MAX), exact_signed_rank_p("n", stat)).otherwise(p)
    out = out.select(*keys, "n_all", "n", F.coalesce(stat, F.lit(0.0)).alias("stat"), F.when(F.col("n") == 0, 1.0).otherwise(p).alias("p"))
    enough = F.col("n_all") >= min_n
    return out.select(*keys, "n", F.when(enough, F.col("stat")).alias("stat"), F.when(enough, F.col("p")).alias("p"))


def mann_whitney(df: DataFrame, keys: list[str], value: str, group: str, reference: str, min_n: int = 3, exact: bool = False) -> DataFrame:
    """Two-sided Mann-Whitney U of every other group against the reference within keys: n1, n2, u, p.

    The reference's counted values are joined to the groups by key, so a pair of samples is ranked on its own, at any size. p is normal with tie
    and continuity correction; with exact, small samples without ties get the exact p.
    """
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).select(*keys, F.col(group).alias("grp"), F.col(value).alias("x"))
    counted = cut(rows.groupBy(*keys, "grp", "x").agg(F.count(F.lit(1)).alias("c")))
    others = counted.filter(F.col("grp") != reference)
    ref = counted.filter(F.col("grp") == reference).select(*keys, "x", "c")
    ref = met(others.select(*keys, "grp").distinct(), ref, keys).select(*keys, "grp", "x", F.lit(0).cast("long").alias("a"), F.col("c").alias("b"))
    both = others.select(*keys, "grp", "x", F.col("c").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(ref)
    by = [*keys, "grp"]
    both = both.groupBy(*by, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("t", F.col("a") + F.col("b"))
    t = F.col("t").cast("double")
    s = ranked_by_range(both, by, "x", "t").groupBy(*by).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("rank") * F.col("a")).alias("r1"), F.sum(t * (t * t - 1.0)).alias("ties"))
    s = s.filter((F.col("n1") >= min_n) & (F.col("n2") >= min_n))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2.0
    s = s.withColumn("u", u)
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (F.abs(F.col("u") - n1 * n2 / 2.0) - 0.5) / sd
    p = F.when(sd > 0, two_sided(F.greatest(z, F.lit(0.0)))).otherwise(1.0)
    if exact:
        p = F.when((F.col("ties") == 0) & (n1 * n2 <= 400), exact_u_p("n1", "n2", F.least(F.col("u"), n1 * n2 - F.col("u")))).otherwise(p)
    return s.select(*keys, F.col("grp").alias(group), "n1", "n2", "u", p.alias("p"))


def kruskal(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction, degrees of freedom and chi-square p; NULL values go."""
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    counted = cut(rows.groupBy(*keys, F.col(value).alias("__x"), F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__c")))
    values = ranked(counted.groupBy(*keys, "__x").agg(F.sum("__c").alias("__t")), keys, "__x", "__t")
    t = F.col("__t").cast("double")
    ties = values.groupBy(*keys).agg(F.sum(t * (t * t - 1.0)).alias("t"))
    g = met(counted, values, [*keys, "__x"]).groupBy(*keys, "__g").agg(F.sum(F.col("__c") * F.col("rank")).alias("s"), F.sum("__c").alias("n"))
    s = g.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ss"), F.sum("n").alias("n"), (F.count(F.lit(1)) - 1).alias("df"))
    s = met(s, ties, keys)
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("ss") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))
    return s.select(*keys, "n", "df", F.when((F.col("df") > 0) & (F.col("t") < n * n * n - n), h).alias("h")).withColumn("p", chi2_p("h", "df"))


def exact_moments(x: str, digits: int) -> tuple[Column, Column]:
    """Mean and sample sd of x in whole units of 10**-digits, from exact sums: they don't depend on the order of rows."""
    i = F.floor(F.col(x).cast("double") * float(10**digits) + 0.5).cast("decimal(19,0)")
    n, total = F.count(i), F.sum(i)
    spread = n.cast("decimal(19,0)") * F.sum(i * i) - total * total
    unit = F.lit(10**18).cast("decimal(19,0)")  # two parts of 64 bits, as in moments_sql
    low = spread % unit
    spread = ((spread - low) / unit).cast("long").cast("double") * 1e18 + low.cast("long").cast("double")
    n = n.cast("double")
    return total.cast("double") / (n * float(10**digits)), F.when(n > 1, F.sqrt(spread / (n * (n - 1.0))) / float(10**digits))


def correlation(df: DataFrame, keys: list[str], x: str, y: str, method: str = "pearson", min_n: int = 2, digits: int | None = None) -> DataFrame:
    """n finite pairs, r, two-sided p by t with n - 2 degrees, and means and sds of x and y.

    r and p are NULL for fewer than min_n pairs or zero variance; means and sds are of the values, also where ranks are correlated. With digits
    they are those of `exact_moments`: a mean that ends in a five then rounds alike in every run. Groups are dealt for their ranks to as many
    partitions as RANKED_ROWS rows each ask for, so that a task's sorts don't grow with the table; a group is one task's.
    """
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    if method == "spearman":
        rows = rows.select(*keys, x, y)
        dealt = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANKED_ROWS))
        rows = rows.repartition(dealt, *(F.col(k) for k in keys)) if keys else rows
        rows = rows.withColumns({"__x": avg_rank(a, keys), "__y": avg_rank(b, keys)})
        a, b = F.col("__x"), F.col("__y")
    of = lambda c: (F.avg(F.col(c).cast("double")), F.stddev_samp(F.col(c).cast("double"))) if digits is None else exact_moments(c, digits)
    moments = [f.alias(f"{c}_{m}") for c in (x, y) for m, f in zip(("mean", "sd"), of(c), strict=True)]
    s = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(a, b).alias("c"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), *moments)
    r = F.when((F.col("n") >= min_n) & (F.col("va") > 0) & (F.col("vb") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c") / F.sqrt(F.col("va") * F.col("vb")))))
    s = s.select(*keys, "n", r.alias("r"), *(f"{c}_{m}" for c in (x, y) for m in ("mean", "sd")))
    t = F.when(F.abs("r") < 1, F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))).when(F.col("r").isNotNull(), 1e150)
    return s.withColumn("p", t_p(t, F.when(F.col("n") > 2, F.col("n") - 2)))


def bh_fdr(df: DataFrame, family: list[str], p: str = "p", out: str = "q", alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg q within each family, and reject; NULL p stays NULL and doesn't count. No family: the whole table is one.

    Values of p are counted, so ties share the rank of their last; ranks come from the counts of smaller values, and the minimum
    from the right from those of greater ones, both for families of any size. The rows are computed once: q is joined by p, and a p from sums of
    doubles worked out again may differ in its last bit, which would leave q NULL.
    """
    own = [*(f"__f{i}" for i in range(len(family))), "__f"]
    rows = cut(df.withColumns({o: F.col(f) for o, f in zip(own, family, strict=False)} | {"__f": F.lit(0), "__p": F.col(p)}))
    counted = cut(rows.filter(F.col("__p").isNotNull()).groupBy(*own, "__p").agg(F.count(F.lit(1)).alias("__c")))
    sizes = counted.groupBy(*own).agg(F.sum("__c").alias("__m"))
    at = met(ranked(counted, own, "__p", "__c"), sizes, own)
    at = at.select(*own, "__p", (F.col("__p") * F.col("__m") / (F.col("before") + F.col("__c"))).alias("__raw"))
    at = running(at, own, "__p", "__raw", "__after", F.min, F.least, down=True)
    at = at.select(*own, "__p", F.least(F.lit(1.0), "__raw", "__after").alias("__q"))
    both = met(rows, at, [*own, "__p"], "left")
    return both.withColumn(out, F.col("__q")).withColumn("reject", F.coalesce(F.col(out) <= alpha, F.lit(False))).drop(*own, "__p", "__q")


def bh_fdr_large(df: DataFrame, p: str = "p", out: str = "q") -> DataFrame:
    """q over the whole table as one family."""
    return bh_fdr(df, [], p, out).drop("reject")


def _signs(obs: np.ndarray, perms: np.ndarray) -> np.ndarray:
    """1 or -1 for each observation's hash and each permutation; permutation 0 is the identity."""
    x = obs[:, None] + perms[None, :].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.where((x >> np.uint64(63)).astype(bool) & (perms > 0), -1.0, 1.0)


def signed_sums(rows: DataFrame, keys: list[str], n_perm: int, block: int = 256) -> DataFrame:
    """(keys, perm, s, ss, n): sums of x over rows (keys, o, x) with the signs of each permutation, of squares, and counts.

    Batches sum their rows by keys for all permutations at once, as products with the sign matrix of the
    observations' hashes o; what is shuffled is one row for each batch, keys and permutation.
    """
    kinds = dict(rows.dtypes)
    names = [*keys, "sums", "ss", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            group = b.select(keys).to_pandas().groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
            x, o = b.column("x").to_numpy()[order], b.column("o").to_numpy()[order].view(np.uint64)
            sums = np.empty((len(first), n_perm + 1))
            for p in range(0, n_perm + 1, block):
                perms = np.arange(p, min(p + block, n_perm + 1))
                sums[:, perms] = np.add.reduceat(_signs(o, perms) * x[:, None], first, axis=0)
            cols = [b.column(k).take(pa.array(order[first])) for k in keys]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, n_perm + 1, dtype=np.int32)), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*cols, flat, pa.array(np.add.reduceat(x * x, first)), pa.array(np.diff(np.r_[first, len(x)]))], names)

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "sums array<double>, ss double, n long"])
    parts = rows.select(*keys, "o", "x").mapInArrow(run, schema)
    parts = parts.select(*keys, "ss", "n", F.posexplode("sums").alias("perm", "y"))
    return parts.groupBy(*keys, "perm").agg(F.sum("y").alias("s"), F.sum("ss").alias("ss"), F.sum("n").alias("n"))


def _tested(df: DataFrame, keys: list[str], value: str, n_perm: int, seed: int, alpha: float, grid: bool, tail: int) -> tuple[DataFrame, DataFrame]:
    """(keys, perm, cell, n, mean, t) of all cells, and those beyond the threshold with their sign."""
    cell = ["freq_idx", "time_idx"] if grid else ["time_idx"]
    rows = df.select(*keys, *cell, F.xxhash64(F.lit(seed), "obs").alias("o"), F.col(value).cast("double").alias("x")).filter("x IS NOT NULL")
    sums = signed_sums(rows, [*keys, *cell], n_perm)
    var = (F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    t = F.when((F.col("n") > 1) & (var > 0), F.col("s") / F.col("n") / F.sqrt(var / F.col("n"))).otherwise(0.0)
    sides = 1 if tail else 2
    limits = F.pandas_udf(lambda n: n.map({k: t_quantile(1 - alpha / sides, k - 1) if k > 1 else float("inf") for k in n.unique()}), T.DoubleType())
    sums = sums.withColumn("t", t)
    sizes = sums.select("n").distinct().withColumn("limit", limits("n"))
    marked = sums.join(sizes, "n").filter(F.abs("t") > F.col("limit")).withColumn("sign", F.signum("t").cast("int"))
    marked = marked.filter(F.col("sign") == tail) if tail else marked
    return sums.withColumn("mean", F.col("s") / F.col("n")), marked


def _labelled(marked: DataFrame, keys: list[str], grid: bool) -> DataFrame:
    """marked with c: cells of one (keys, perm, sign) that touch share it."""
    if grid:
        return _grid_labels(marked, keys)
    w = W.partitionBy(*keys, "perm", "sign").orderBy("time_idx")
    return marked.withColumn("c", F.col("time_idx") - F.row_number().over(w)).select(*keys, "perm", "sign", "time_idx", "t", "c")


def _grid_labels(marked: DataFrame, keys: list[str], maps: int = 64) -> DataFrame:
    """4-neighbour labels of small maps; a group is `maps` permutations of one map, not the data.

    Labels of all maps of a group spread at once: each cell takes the least label of itself and its neighbours of the same sign.
    """
    kinds = dict(marked.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"perm {kinds['perm']}, sign int, freq_idx {kinds['freq_idx']}, time_idx {kinds['time_idx']}, t double, c int"])

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        at = [np.unique(pdf[c], return_inverse=True)[1] if c == "perm" else (pdf[c] - pdf[c].min()).to_numpy(int) for c in ("perm", "freq_idx", "time_idx")]
        shape = [i.max() + 3 for i in at]
        sign = np.zeros(shape, np.int8)
        inner = tuple(i + 1 for i in at)
        sign[inner] = pdf.sign
        of = np.arange(sign.size, dtype=np.int64).reshape(shape)
        while True:
            least = of
            for axis in (1, 2):
                for step in (1, -1):
                    least = np.where(np.roll(sign, step, axis) == sign, np.minimum(least, np.roll(of, step, axis)), least)
            if (least[inner] == of[inner]).all():
                break
            of = least
        names = (of - np.arange(shape[0])[:, None, None] * (shape[1] * shape[2]))[inner]
        return pdf[[*keys, "perm", "sign", "freq_idx", "time_idx", "t"]].assign(c=names.astype(np.int32))

    return marked.groupBy(*keys, F.expr(f"perm div {maps}")).applyInPandas(label, schema)


def _p_values(labelled: DataFrame, keys: list[str], n_perm: int) -> DataFrame:
    """(keys, sign, c, first_idx, last_idx, size, mass, p) of the observed clusters: p is the share of permutations whose largest absolute mass reaches theirs."""
    by = [*keys, "perm", "sign", "c"]
    clusters = labelled.groupBy(*by).agg(F.min("time_idx").alias("first_idx"), F.max("time_idx").alias("last_idx"), F.count(F.lit(1)).alias("size"), F.sum("t").alias("mass"))
    null = clusters.groupBy(*keys, "perm").agg(F.max(F.abs("mass")).alias("top"))
    seen = clusters.filter("perm = 0").drop("perm")
    cond = F.lit(True)
    null = null.select(*(F.col(k).alias(f"__{k}") for k in keys), "top")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    hits = seen.join(null, cond & (F.col("top") >= F.abs("mass") - 1e-9))
    return hits.groupBy(*seen.columns).agg((F.count(F.lit(1)) / (n_perm + 1)).alias("p"))


def cluster_permutation(df: DataFrame, keys: list[str], value: str, n_perm: int = 200, seed: int = 5, alpha: float = 0.05, grid: bool = False, tail: int = 0) -> DataFrame:
    """One-sample cluster permutation over time_idx (or, with grid, freq_idx x time_idx): cluster, sign, size, mass, p, significant.

    df: keys, obs, time_idx (freq_idx), value. A permutation flips the signs of whole observations; sums of squares don't
    change, so only signed sums are aggregated again, by (keys, permutation, cell). Cells beyond
    t(1 - alpha / 2, n - 1) that touch and share a sign are a cluster, its mass the sum of t; with a tail of 1 or -1, those of that sign
    beyond t(1 - alpha, n - 1). p is the share of permutations, the identity included, whose largest absolute mass reaches it.
    """
    _, marked = _tested(df, keys, value, n_perm, seed, alpha, grid, tail)
    out = _p_values(_labelled(marked, keys, grid), keys, n_perm).drop("c")
    return out.withColumn("significant", F.col("p") <= alpha)


def cluster_mask(df: DataFrame, keys: list[str], value: str, n_perm: int = 200, seed: int = 5, alpha: float = 0.05, grid: bool = False, tail: int = 0, level: float = 0.05) -> DataFrame:
    """The test of cluster_permutation as a map: one row a cell, (keys, cell, n, mean, t, cluster, p, mask).

    cluster names the observed cluster of the cell within keys and p is its p; mask is p <= level. Cells in no cluster have NULL and
    a mask of FALSE. Labels of the observed cells and maxima of the permutations are kept apart and meet by cluster only.
    """
    cell = ["freq_idx", "time_idx"] if grid else ["time_idx"]
    tested, marked = _tested(df, keys, value, n_perm, seed, alpha, grid, tail)
    labelled = _labelled(marked, keys, grid)
    p = _p_values(labelled, keys, n_perm)
    cells = labelled.filter("perm = 0").select(*keys, *cell, "sign", "c")
    name = F.min(F.struct(*cell)).alias("first")
    names = cells.groupBy(*keys, "sign", "c").agg(name)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("first", "sign"))  # a few clusters a map
    names = names.select(*keys, "sign", "c", rank.alias("cluster"))
    both = met(met(cells, names, [*keys, "sign", "c"]), p.select(*keys, "sign", "c", "p"), [*keys, "sign", "c"])
    every = tested.filter("perm = 0").select(*keys, *cell, "n", "mean", "t")
    out = met(every, both.select(*keys, *cell, "cluster", "p"), [*keys, *cell], "left")
    return out.withColumn("mask", F.coalesce(F.col("p") <= level, F.lit(False)))


def band_mask(cells: DataFrame, bands: DataFrame, keys: list[str], mode: str = "any", effect: str = "mean") -> DataFrame:
    """A mask over freq_idx x time_idx by band: (keys, band, time_idx, effect, sig, sig_pos, sig_neg).

    cells: keys, freq_idx, time_idx, mean, mask; bands: band, freq_idx, in which a frequency may have several bands. sig holds where any, or
    all, of the band's frequencies are in the mask; the effect is the mean or median of their means, and its sign splits sig.
    """
    if mode not in ("any", "all") or effect not in ("mean", "median"):
        raise ValueError(f"no mode {mode} or effect {effect}")
    rows = cells.join(bands, "freq_idx")
    out = rows.groupBy(*keys, "band", "time_idx").agg((F.avg if effect == "mean" else F.median)("mean").alias("effect"), (F.bool_or if mode == "any" else F.bool_and)("mask").alias("sig"))
    return out.select("*", (F.col("sig") & (F.col("effect") > 0)).alias("sig_pos"), (F.col("sig") & (F.col("effect") < 0)).alias("sig_neg"))


def ols(df: DataFrame, formula: str) -> list[dict]:
    """Least squares by formula: one dict a coefficient (term, coef, se, t, p). Rows with NULL go first."""
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import LinearRegression

    model = RFormula(formula=formula).fit(df.dropna())
    data = model.transform(df.dropna())
    fit = LinearRegression(solver="normal").fit(data)
    s = fit.summary
    names = [a["name"] for kind in data.schema["features"].metadata["ml_attr"]["attrs"].values() for a in sorted(kind, key=lambda a: a["idx"])]
    coefs = [*fit.coefficients.toArray().tolist(), fit.intercept]
    return [{"term": n, "coef": c, "se": e, "t": t, "p": p} for n, c, e, t, p in zip([*names, "intercept"], coefs, s.coefficientStandardErrors, s.tValues, s.pValues, strict=True)]
