"""Queries and readers without SQL against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoked.operators import celltypes as ct
from evoked.functions import frequency as fq
from evoked.operators import reconcile as rc
from evoked.operators import signal as sg
from evoked.operators import stats
from evoked.plans import all_queries
from evoked.sources import readers as rd


@pytest.fixture(scope="module")
def epochs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)


def test_signed_sums(spark):
    rng = np.random.default_rng(1)
    rows = [(k, c, int(o), float(x)) for k in "ab" for c in range(3) for o, x in enumerate(rng.normal(size=40))]
    df = spark.createDataFrame(rows, "k string, c int, o long, x double").repartition(3)
    got = {(r["k"], r["c"], r["perm"]): (r["s"], r["ss"], r["n"]) for r in stats.signed_sums(df, ["k", "c"], 5).collect()}
    for (k, c, perm), (s, ss, n) in got.items():
        own = [(o, x) for a, b, o, x in rows if (a, b) == (k, c)]
        sign = stats._signs(np.array([o for o, _ in own], np.uint64), np.array([perm]))[:, 0]
        x = np.array([x for _, x in own])
        assert np.isclose(s, (sign * x).sum()) and np.isclose(ss, (x * x).sum()) and n == 40
        assert perm or (sign == 1).all()
    assert len(got) == 36


def test_time_clusters(spark, sf_dir, epochs):
    """Observed clusters and their mass; p is a share of 2001 permutations."""
    _, label, x = epochs
    want = set()
    for g in np.unique(label):
        y = x[label == g]
        n = len(y)
        t = y.mean(0) / (y.std(0, ddof=1) / math.sqrt(n))
        limit = stats.t_quantile(0.975, n - 1)
        for sign in (1, -1):
            over = np.flatnonzero(sign * t > limit)
            for run in np.split(over, np.flatnonzero(np.diff(over) != 1) + 1):
                if len(run):
                    want.add((int(g), sign, int(run[0]), int(run[-1]), round(float(t[run].sum()), 6)))
    rows = all_queries()["time_clusters"](spark, sf_dir).collect()
    assert {(r["label"], r["sign"], r["first_idx"], r["last_idx"], round(r["mass"], 6)) for r in rows} == want
    assert all(1 / 2001 <= r["p"] <= 1 and abs(r["p"] * 2001 - round(r["p"] * 2001)) < 1e-6 for r in rows)


def test_morlet_map(spark, sf_dir, epochs):
    _, label, x = epochs
    rows = {(r["label"], r["freq_hz"], r["time_idx"]): r["power"] for r in all_queries()["morlet_map"](spark, sf_dir).collect()}
    assert len(rows) == len(np.unique(label)) * 4 * 16 and all(p >= 0 for p in rows.values())


def test_least_squares(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_extendedprice", "l_quantity", "l_discount").toPandas().astype(float)
    q, d, y = li.l_quantity.to_numpy(), li.l_discount.to_numpy(), li.l_extendedprice.to_numpy()
    a = np.column_stack([q, d, q * d, np.ones(len(y))])
    coef = np.linalg.lstsq(a, y, rcond=None)[0]
    s2 = ((y - a @ coef) ** 2).sum() / (len(y) - 4)
    se = np.sqrt(s2 * np.diag(np.linalg.inv(a.T @ a)))
    got = all_queries()["least_squares"](spark, sf_dir).collect()
    assert np.allclose([r["coef"] for r in got], coef, rtol=1e-6) and np.allclose([r["se"] for r in got], se, rtol=1e-6)


def test_cell_types(spark, sf_dir):
    rows = all_queries()["cell_type_pipeline"](spark, sf_dir).collect()
    assert {r["cell_type"] for r in rows} <= {"FS", "RS", "boundary", "low_quality"} and len(rows) == len({r["vec_id"] for r in rows})
    means = {k: np.median([r["trough_to_peak_ms"] for r in rows if r["cell_type"] == k]) for k in ("FS", "RS") if any(r["cell_type"] == k for r in rows)}
    assert len(means) < 2 or means["FS"] <= means["RS"]
    communities = all_queries()["waveform_communities"](spark, sf_dir).collect()
    assert len({r[1] for r in communities}) <= 4


def test_waveform_graph(spark):
    """Several blocks, equal rows and ties: the graph is that of all pairs; communities part what is far apart; the plane is numpy's."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.2, (60, 6)) for c in (0, 6)] + [np.zeros((9, 6))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "id long, v array<double>")
    got = sorted((r.src, r.dst, round(r.d2, 9)) for r in ct.neighbour_graph(df, "id", "v", 4, block=20).collect())
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    want = []
    for i in range(len(x)):
        near = sorted((d2[i, j], j) for j in range(len(x)) if j != i)[:4]
        want += [(i, j, round(v, 9)) for v, j in near]
    assert got == sorted(want)
    plane = {r.id: (r.pc_1, r.pc_2) for r in ct.plane_view(df, "id", "v").collect()}
    assert sorted(plane) == list(range(len(x)))
    c = x - x.mean(0)
    _, _, axes = np.linalg.svd(c, full_matrices=False)
    axes = axes[:2] * np.sign(axes[[0, 1], np.abs(axes[:2]).argmax(1)])[:, None]
    assert np.allclose([plane[i] for i in range(len(x))], c @ axes.T, atol=1e-9)


def test_frequency():
    assert fq.sub_bands(4, 8, 2) == [(4, 6), (6, 8)] and fq.sub_bands(4, 9, 2)[-1] == (8, 9)
    assert fq.grid(1, 3, 3) == [1, 2, 3] and np.allclose(fq.grid(1, 100, 3, "log"), [1, 10, 100])
    semi = fq.grid(1, 100, 6, "semilog")
    assert len(semi) == 6 and semi[0] == 1 and np.isclose(semi[-1], 100) and sorted(semi) == semi
    assert fq.band_name("theta", 4.0, 5.5) == "theta_4_5.5"


def test_event_readers(spark, tmp_path):
    with_header, bare = tmp_path / "a.txt", tmp_path / "b.txt"
    with_header.write_text("label_stim\tt_start\tduration\nA1-A2\t1,5\t2\n")
    bare.write_text("A1-A2\t1.5\t2\nA2-A3\t4\t1\n")
    assert [tuple(r)[:3] for r in rd.stim_events(spark, str(with_header)).collect()] == [("A1-A2", 1.5, 2.0)]
    assert rd.stim_events(spark, str(bare)).count() == 2
    bad = tmp_path / "c.txt"
    bad.write_text("A1-A2\t1.5\t2\nstim7\tbad\t2\n")
    with pytest.raises(Exception, match="no event"):
        rd.stim_events(spark, str(bad)).collect()
    corrected = tmp_path / "d.tsv"
    corrected.write_text("A1-A2\t1\t2\nA2-A3\t4\t1\t9\t0.5\tp2\t1\t0\n")
    rows = rd.corrected_events(spark, str(corrected)).orderBy("t_start").collect()
    assert [(r["t_start"], r["t_end"], r["macro_part"], r["macro_part_index"]) for r in rows] == [(1.0, 3.0, "session", 0), (4.0, 9.0, "p2", 1)]
    corrected.write_text("label_stim\tt_start\tduration\nA1-A2\t1\t2\n")
    assert rd.corrected_events(spark, str(corrected)).count() == 1
    corrected.write_text("label_stim\tduration\tt_start\tnote\nA1-A2\t2\t1,5\tx\n\nA3-A4\t1\t7\ty\n")
    rows = rd.corrected_events(spark, str(corrected)).orderBy("t_start").collect()
    assert [(r["label_stim"], r["t_start"], r["duration"], r["t_end"], r["macro_event_index"]) for r in rows] == [("A1-A2", 1.5, 2.0, 3.5, 0), ("A3-A4", 7.0, 1.0, 8.0, 1)]
    for text, error in (("label_stim\tt_start\nA1-A2\t1\n", "no columns"), ("label_stim\tt_start\tduration\nA1-A2\t1\t\n", "no time"), ("A1-A2\t\t3\n", "no time")):
        corrected.write_text(text)
        with pytest.raises(Exception, match=error):
            rd.corrected_events(spark, str(corrected)).collect()
    assert rd.dead_intervals(spark, str(tmp_path / "none_*.dead"), 100.0).collect() == []
    (tmp_path / "x_E1.dead").write_text("100\t300\n")
    assert [tuple(r) for r in rd.dead_intervals(spark, str(tmp_path / "*.dead"), 100.0).collect()] == [("E1", 1.0, 3.0)]


def test_tensor_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s1", "low", 1, 0.5), ("s1", "high", 1, 0.7), ("s2", "low", 2, 0.1)], "session string, band string, trial int, value double")
    rd.write_tensor(df, str(tmp_path / "t"), ["session", "band"])
    back = rd.read_tensor(spark, str(tmp_path / "t"), {"band": ["low"]})
    assert sorted(tuple(r) for r in back.select(*df.columns).collect()) == [("s1", "low", 1, 0.5), ("s2", "low", 2, 0.1)]


def plain_waveform(w):
    """(values, flipped, trough ms, outside share) at 20 kHz, 1 ms before the event, or None."""
    x = np.array([np.nan if v is None else v for v in w or []], float)
    good = np.isfinite(x)
    if good.sum() < 5:
        return None
    y = np.interp(np.arange(len(x)), np.flatnonzero(good), x[good])
    y = y - np.median(y[:4])
    if np.abs(y).max() <= 1e-12:
        return None
    flipped = y.max() > -y.min()
    y = -y if flipped else y
    low = int(y.argmin())
    place = low + np.linspace(-20, 40, 121)
    return np.interp(place, np.arange(len(y)), y), flipped, low / 20 - 1, np.mean((place < 0) | (place > len(y) - 1))


def test_standard_waveforms(spark):
    rng = np.random.default_rng(5)
    waves = [list(map(float, rng.normal(size=90))) for _ in range(12)]
    for w in waves[:6]:
        w[25] = 9.0 if w[0] > 0 else -9.0
    waves[0][0], waves[1][-1], waves[2][30], waves[3][10:14] = math.nan, math.inf, None, [math.nan] * 4
    waves += [None, [], [1.0] * 4, [2.0] * 40, [math.nan] * 40, [math.nan] * 36 + [1.0, 2.0, 0.5, 3.0], [1.0, 2.0, 0.5, 3.0, -1.0]]
    df = spark.createDataFrame(list(enumerate(waves)), "k int, w array<double>")
    rows = {r["k"]: r for r in sg.standardise(df, "w", 20000.0, 1.0).collect()}
    assert len(rows) == len(waves)
    for k, w in enumerate(waves):
        r, want = rows[k], plain_waveform(w)
        if want is None:
            assert (set(r["w_std"]), set(r["w_norm"]), r["flipped"], r["trough_ms"], r["outside"], r["ok"]) == ({0.0}, {0.0}, False, None, 1.0, False)
            continue
        assert np.allclose(r["w_std"], want[0]) and np.allclose(r["w_norm"], want[0] / np.abs(want[0]).max())
        assert r["flipped"] == want[1] and math.isclose(r["trough_ms"], want[2], abs_tol=1e-9) and math.isclose(r["outside"], want[3]) and r["ok"] == (want[3] <= 0.1)
    assert any(r["ok"] for r in rows.values())


def test_macro_electrodes(spark):
    schema = "patient string, spelling string, model string, tetrodes int, channel string, x double, y double, z double, place long"
    rows = [("P", "TPp", "hybride", 2, "1-2"), ("P", "TP_p", "hybride", 2, "1-2"), ("P", "TPB", "hybride latérale", 3, "5-6"), ("P", "TPA_", "hybride latérale", 2, "8-9"), ("P", "HI'", "hybride", 2, "1-2"), ("P", "HI'", "hybride", 2, "1-2"), ("P", "OF", "plain", 2, "1-2"), ("P", "AM", "hybride", 2, "3-4")]
    contacts = spark.createDataFrame([(*r, i + 0.5, i + 1.0, i + 2.0, i) for i, r in enumerate(rows)], schema)
    wanted = spark.createDataFrame([("P", n) for n in ("TP_L", "TP_R", "HI_L", "HI_R", "OF_R", "AM_R")] + [("Q", "TP_L")], "patient string, name string")
    got = {(r["patient"], r["name"]): (r["macro"], r["contacts"], r["x"]) for r in rc.macro_electrodes(wanted, contacts).collect()}
    none = (None, None, None)
    assert got == {("P", "TP_L"): ("TPp", "1-2", 0.5), ("P", "TP_R"): ("TPB", "5-6", 2.5), ("P", "HI_L"): ("HI'", "1-2", None), ("P", "HI_R"): none, ("P", "OF_R"): none, ("P", "AM_R"): ("AM", "1-2", None), ("Q", "TP_L"): none}
