"""Order statistics by digits against numpy: hot groups, ties, signs, NULL keys, infinities, integers, empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoked.operators import describe, order, stats

ROWS = "g string, x double"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    hot = np.round(rng.normal(0, 1e3, 9000), 1)
    small = [0.0, -0.0, 1e-300, -1e-300, 1e300, -5.0, -5.0, math.inf, -math.inf, 7.25]
    rows = [("hot", float(x)) for x in hot] + [(None, float(x)) for x in small] + [("one", 3.5), ("none", None)]
    return spark.createDataFrame(rows, ROWS), {"hot": hot, None: np.array(small), "one": np.array([3.5])}


def test_code_keeps_the_order(spark):
    xs = [-math.inf, -1e300, -2.5, -1e-320, 0.0, 1e-320, 1.0, math.nextafter(1.0, 2), 2.0**53, math.inf, math.nan]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)] + [(4, -0.0)], "i int, x double")
    got = df.select("i", order.code(df, "x").alias("c")).distinct().collect()
    assert len(got) == len(xs)
    assert [r.i for r in sorted(got, key=lambda r: r.c)] == list(range(len(xs)))
    with pytest.raises(TypeError):
        order.code(spark.createDataFrame([("a",)], "x string"), "x")


def test_ranks(data):
    df, plain = data
    counted = df.filter("x IS NOT NULL").groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    got = {(r.g, r.x): (r.before, r.rank) for r in order.ranked(counted, ["g"], "x", "n").collect()}
    want = {}
    for g, xs in plain.items():
        for x in np.unique(xs):
            low, n = int((xs < x).sum()), int((xs == x).sum())
            want[g, float(x)] = (low, low + (n + 1) / 2)
    assert got == want


def test_long_integers_are_not_rounded(spark):
    df = spark.createDataFrame([(2**53 + i, 1) for i in range(-3, 4)] + [(-(2**60), 2)], "x long, n int")
    got = order.ranked(df, [], "x", "n").orderBy("x").collect()
    assert [r.before for r in got] == [0, *range(2, 9)]


def test_running_minimum_from_above(spark):
    rows = [("a", float(x), float(v)) for x, v in [(-3, 5), (1, 2), (2, 9), (1e9, 4)]]
    df = spark.createDataFrame(rows, "g string, x double, v double")
    got = order.running(df, ["g"], "x", "v", "m", F.min, F.least, down=True).orderBy("x").collect()
    assert [r.m for r in got] == [2.0, 4.0, 4.0, None]


def test_windows_hold_one_digit(data):
    """Every window is over keys and the digits before, never over a whole group of values."""
    df, _ = data
    counted = df.filter("x IS NOT NULL").groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    plan = order.ranked(counted, ["g"], "x", "n")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert len(windows) == 4
    assert sum("__p" in line.split("windowspecdefinition(")[1].split(" ASC")[0].rsplit(",", 1)[0] for line in windows) == 3


def test_quantiles(data):
    df, plain = data
    got = {r.g: r for r in order.quantiles(df, ["g"], "x", {"a": 0.0, "b": 0.333, "c": 0.5, "d": 1.0}).collect()}
    assert set(got) == {"hot", None, "one", "none"}
    assert (got["none"].n, got["none"].c, got["none"].lo) == (0, None, None)
    for g, xs in plain.items():
        r = got[g]
        assert (r.n, r.lo, r.hi, r.a, r.d) == (len(xs), xs.min(), xs.max(), xs.min(), xs.max())
        finite = np.isfinite(xs).all()
        if finite:
            assert np.allclose([r.b, r.c], np.quantile(xs, [0.333, 0.5]))
    assert got[None].c == np.median(plain[None])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], ROWS)
    assert order.quantiles(empty, ["g"], "x", {"m": 0.5}).collect() == []
    assert describe.five_numbers(empty, ["g"], "x").collect() == []
    assert stats.bh_fdr(empty, ["g"], "x").collect() == []
    assert stats.kruskal(empty.withColumn("h", F.lit(1)), ["g"], "x", "h").collect() == []


def plain_q(p):
    p = np.asarray(p)
    at = np.argsort(p, kind="stable")
    raw = p[at] * len(p) / np.arange(1, len(p) + 1)
    q = np.empty(len(p))
    q[at] = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
    return q


def test_false_discovery_by_family(spark):
    rng = np.random.default_rng(1)
    hot = np.round(rng.random(5000) ** 3, 3)  # many ties, also at 0
    rows = [("hot", i, float(p)) for i, p in enumerate(hot)] + [(None, 0, 0.2), (None, 1, 0.01), ("hot", -1, None)]
    df = spark.createDataFrame(rows, "f string, i long, p double")
    got = {(r.f, r.i): (r.q, r.reject) for r in stats.bh_fdr(df, ["f"]).collect()}
    assert len(got) == len(rows) and got["hot", -1] == (None, False)
    assert np.allclose([got["hot", i][0] for i in range(len(hot))], plain_q(hot), rtol=1e-12)
    assert np.allclose([got[None, 0][0], got[None, 1][0]], [0.2, 0.02])
    pooled = {(r.f, r.i): r.q for r in stats.bh_fdr_large(df).collect()}
    want = plain_q([*hot, 0.2, 0.01])
    assert np.allclose([*(pooled["hot", i] for i in range(len(hot))), pooled[None, 0], pooled[None, 1]], want, rtol=1e-12)


def test_kruskal_and_mann_whitney_with_ties(spark):
    rng = np.random.default_rng(2)
    samples = {g: np.round(rng.normal(m, 1, 400), 1) for g, m in (("a", 0), ("b", 0.1), ("c", 0.3))}
    df = spark.createDataFrame([("k", g, float(x)) for g, xs in samples.items() for x in xs], "k string, g string, x double")
    every = np.concatenate(list(samples.values()))
    n = len(every)

    def ranks(xs):
        return np.array([(xs < x).sum() + ((xs == x).sum() + 1) / 2 for x in xs])

    r = ranks(every)
    ties = sum(t**3 - t for t in np.unique(every, return_counts=True)[1])
    h = (12 / (n * (n + 1)) * sum(r[i : i + 400].sum() ** 2 / 400 for i in (0, 400, 800)) - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    got = stats.kruskal(df, ["k"], "x", "g").first()
    assert (got.n, got.df) == (n, 2) and math.isclose(got.h, h, rel_tol=1e-9)
    for row in stats.mann_whitney(df, ["k"], "x", "g", "a").collect():
        both = np.concatenate([samples[row.g], samples["a"]])
        assert (row.n1, row.n2) == (400, 400)
        assert math.isclose(row.u, ranks(both)[:400].sum() - 400 * 401 / 2)


@pytest.mark.parametrize("zeros", ["wilcox", "pratt"])
def test_signed_rank_with_zeros(spark, zeros):
    d = np.array([0, 0, 1, -1, 2, 2, -3, 5, 5, 5, -8], float)
    df = spark.createDataFrame([("k", float(x)) for x in d] + [("z", 0.0)], "k string, d double")
    got = {r.k: r for r in stats.signed_rank(df, ["k"], zeros=zeros).collect()}
    used = d if zeros == "pratt" else d[d != 0]
    a = np.abs(used)
    r = np.array([(a < x).sum() + ((a == x).sum() + 1) / 2 for x in a])
    assert got["k"].n == 9 and got["k"].stat == min(r[used > 0].sum(), r[used < 0].sum())
    assert (got["z"].n, got["z"].stat, got["z"].p) == (0, 0.0, 1.0)


def test_limits(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3, 500))
    df = spark.createDataFrame([("s", c, i, float(x[c, i])) for c in range(3) for i in range(500)], "s string, c int, i int, x double")
    joint = describe.joint_limits(df, ["s"], ["c"], "x").first()
    assert np.allclose([joint.lo, joint.hi], [np.quantile(x, 0.05, axis=1).min(), np.quantile(x, 0.95, axis=1).max()])
    scale = describe.robust_scale(df, ["s"], "i", "x", 7).first()
    assert scale.n == 3 * 72 and math.isclose(scale.scale, np.quantile(np.abs(x[:, ::7]), 0.99))
