"""Chunked recordings and cluster masks against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoked.operators import chunks as ck
from evoked.operators import intervals as iv
from evoked.operators import stats
from evoked.plans import all_queries

KEYS = ["k"]


def cut(x, sizes):
    ends = np.cumsum(sizes)
    return [(i, int(e - n), x[e - n : e].tolist()) for i, (n, e) in enumerate(zip(sizes, ends))]


def chunked(spark, of):
    rows = [(k, i, s, v, f"own {i}") for k, (x, sizes) in of.items() for i, s, v in cut(x, sizes)]
    return spark.createDataFrame(rows, "k string, chunk_id int, start_sample long, samples array<double>, note string").repartition(4)


@pytest.mark.parametrize("halo", [1, 6, 40])
def test_halo_equals_slices(spark, halo):
    rng = np.random.default_rng(1)
    of = {"a": (rng.normal(size=100), [10, 30, 7, 50, 3]), "b": (rng.normal(size=9), [9]), None: (rng.normal(size=40), [4] * 10)}
    df = ck.with_halo(chunked(spark, of), KEYS, halo)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Cartesian" not in plan
    rows = df.collect()
    assert len(rows) == 16
    for r in rows:
        x, sizes = of[r["k"]]
        lo, n = r["start_sample"], len(r["samples"])
        assert r["left"] == min(halo, lo) and r["note"] == f"own {r['chunk_id']}"
        assert np.allclose(r["padded"], x[max(0, lo - halo) : lo + n + halo])


def test_halo_ends_at_missing_and_empty_chunks(spark):
    rows = [("a", 0, [1.0, 2.0]), ("a", 1, [3.0, 4.0]), ("a", 3, [5.0]), ("a", 4, []), ("a", 5, [6.0, 7.0])]
    df = spark.createDataFrame(rows, "k string, chunk_id int, samples array<double>")
    got = {r["chunk_id"]: (r["padded"], r["left"]) for r in ck.with_halo(df, KEYS, 3).collect()}
    assert got == {0: ([1, 2, 3, 4], 0), 1: ([1, 2, 3, 4], 2), 3: ([5], 0), 4: ([5, 6, 7], 1), 5: ([6, 7], 0)}
    assert ck.with_halo(df.limit(0), KEYS, 3).count() == 0


@pytest.mark.parametrize("size", [1, 13, 1000])
def test_compaction_equals_deletion(spark, size):
    rng = np.random.default_rng(2)
    of = {"a": (rng.normal(size=240), [40, 5, 95, 60, 40]), "b": (rng.normal(size=30), [30]), "c": (rng.normal(size=10), [5, 5])}
    dead = [("a", 0.0, 0.3), ("a", 3.9, 4.6), ("a", 4.2, 9.95), ("a", 23.0, 99.0), ("a", 12.0, 12.0), ("c", -1.0, 5.0)]
    merged = ck.dead_samples(spark.createDataFrame(dead, "k string, s double, e double"), KEYS, 10.0)
    extent = spark.createDataFrame([(k, len(x)) for k, (x, _) in of.items()], "k string, duration long")
    out = ck.compact_signal(chunked(spark, of), iv.good_chunks(merged, extent, KEYS), KEYS, size, 17).collect()
    for k, (x, _) in of.items():
        gone = np.zeros(len(x), bool)
        for name, s, e in dead:
            if name == k:
                gone[max(0, round(s * 10)) : max(0, round(e * 10))] = True
        own = sorted((r["chunk_id"], r["start_sample"], r["samples"]) for r in out if r["k"] == k)
        assert [s for _, s, _ in own] == [size * i for i in range(len(own))] and [i for i, *_ in own] == list(range(len(own)))
        assert np.array_equal(np.concatenate([v for *_, v in own]) if own else np.empty(0), x[~gone])


def test_compaction_of_a_recording_with_holes(spark):
    rows = [("a", 0, [1.0, 2.0]), ("a", 4, [5.0, 6.0, 7.0])]
    df = spark.createDataFrame(rows, "k string, start_sample long, samples array<double>")
    good = spark.createDataFrame([("a", 1, 3, 0), ("a", 3, 7, 2)], "k string, lo long, hi long, origin long")
    got = [(r["start_sample"], r["samples"]) for r in ck.compact_signal(df, good, KEYS, 10).collect()]
    assert got == [(0, [2.0, None, None, 5.0, 6.0, 7.0])]


def test_reference_moments(spark):
    rng = np.random.default_rng(3)
    of = {"a": (rng.normal(size=200) + 1e6, [50, 7, 143]), "b": (np.array([2.0, math.nan, 4.0]), [2, 1]), "c": (np.array([math.nan]), [1])}
    df = chunked(spark, of)
    trials = spark.createDataFrame([("a", 6.05), ("a", 20.0), ("b", -3.0), ("c", 1.0)], "k string, t0 double")
    stops = ck.first_stimulation(trials, KEYS, 10.0)
    got = {r["k"]: tuple(r)[1:] for r in ck.reference_moments(df.join(stops, "k"), KEYS, F.col("stop_sample")).collect()}
    assert set(got) == {"a", "b"} and got["a"][0] == 60 and got["b"] == (1, 2.0, 0.0)
    assert np.allclose(got["a"][1:], (of["a"][0][:60].mean(), of["a"][0][:60].std()), rtol=1e-12)
    rows = ck.normalise_chunks(df, KEYS, ["mean", "zscore"]).orderBy("k", "chunk_id").collect()
    z = np.concatenate([r["zscore"] for r in rows if r["k"] == "a"])
    assert np.allclose(z, (of["a"][0] - of["a"][0].mean()) / of["a"][0].std(), atol=1e-6)
    assert [r["zscore"] for r in rows if r["k"] == "c"] == [None]


def labels(t, limit):
    """4-neighbour components of cells beyond the limit with one sign."""
    left = {(f, s): np.sign(v) for (f, s), v in np.ndenumerate(t) if abs(v) > limit}
    out = []
    while left:
        start = min(left)
        sign, todo, own = left.pop(start), [start], []
        while todo:
            f, s = todo.pop()
            own.append((f, s))
            for near in ((f - 1, s), (f + 1, s), (f, s - 1), (f, s + 1)):
                if left.get(near) == sign:
                    left.pop(near)
                    todo.append(near)
        out.append(own)
    return out


@pytest.mark.parametrize("tail", [0, 1, -1])
def test_cluster_mask_on_a_lattice(spark, tail):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(24, 4, 9))
    x[:, 1:3, 2:5] += 1.5
    x[:, 0, 7:] -= 1.5
    x[:, 2, 5] -= 1.6
    rows = [("g", o, f, s, float(v)) for (o, f, s), v in np.ndenumerate(x)]
    df = spark.createDataFrame(rows, "k string, obs int, freq_idx int, time_idx int, x double").repartition(3)
    got = stats.cluster_mask(df, KEYS, "x", n_perm=199, grid=True, tail=tail).collect()
    t = x.mean(0) / (x.std(0, ddof=1) / math.sqrt(24))
    limit = stats.t_quantile(1 - 0.05 / (1 if tail else 2), 23)
    want = labels(np.where(np.sign(t) == tail, t, 0) if tail else t, limit)
    assert len(got) == 36 and np.allclose([r["t"] for r in got], [t[r["freq_idx"], r["time_idx"]] for r in got]) and np.allclose([r["mean"] for r in got], [x.mean(0)[r["freq_idx"], r["time_idx"]] for r in got])
    found = {}
    for r in got:
        if r["cluster"] is None:
            assert r["p"] is None and not r["mask"]
        else:
            found.setdefault(r["cluster"], set()).add((r["freq_idx"], r["time_idx"]))
            assert r["mask"] == (r["p"] <= 0.05)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want))
    # p from the same signs, permutation by permutation
    hashes = df.select("obs", F.xxhash64(F.lit(5), "obs").alias("h")).distinct().toPandas().sort_values("obs").h.to_numpy().view(np.uint64)
    signs = stats._signs(hashes, np.arange(200))
    tops = []
    for p in range(200):
        y = signs[:, p, None, None] * x
        v = y.mean(0) / (y.std(0, ddof=1) / math.sqrt(24))
        v = np.where(np.sign(v) == tail, v, 0) if tail else v
        tops.append(max((abs(sum(v[c] for c in own)) for own in labels(v, limit)), default=0))
    for own in want:
        mass = abs(sum(t[c] for c in own))
        p = {r["p"] for r in got if (r["freq_idx"], r["time_idx"]) in own}
        assert len(p) == 1 and math.isclose(p.pop(), np.mean(np.array(tops) >= mass - 1e-9))
    assert any(r["mask"] for r in got)


def test_cluster_mask_over_time(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(20, 30))
    x[:, 4:9] += 1.4
    x[:, 9:12] -= 1.4
    df = spark.createDataFrame([(None, o, s, float(v)) for (o, s), v in np.ndenumerate(x)], "k string, obs int, time_idx int, x double")
    got = {r["time_idx"]: r for r in stats.cluster_mask(df, KEYS, "x", n_perm=99).collect()}
    assert len(got) == 30 and all(got[i]["mask"] for i in range(4, 12)) and got[8]["cluster"] != got[9]["cluster"]
    assert stats.cluster_mask(df.limit(0), KEYS, "x", n_perm=9).count() == 0


def test_registered_map_mask_agrees_with_its_clusters(spark, sf_dir):
    cells = all_queries()["map_mask"](spark, sf_dir).collect()
    clusters = all_queries()["map_clusters"](spark, sf_dir).collect()
    sums = {}
    for r in cells:
        if r["cluster"] is not None:
            s = sums.setdefault((r["label"], r["cluster"]), [0, 0.0, r["p"]])
            s[0] += 1
            s[1] += r["t"]
    assert sorted((k[0], n, round(m, 6), round(p, 9)) for k, (n, m, p) in sums.items()) == sorted((r["label"], r["size"], round(r["mass"], 6), round(r["p"], 9)) for r in clusters)


def test_band_mask_refuses_unknown_modes(spark):
    with pytest.raises(ValueError):
        stats.band_mask(spark.range(1), spark.range(1), [], "frac")
