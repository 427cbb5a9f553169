"""Autocorrelogram, half widths and firing rates worked by hand or by plain loops."""

import math

import numpy as np
import pytest

from evoked.operators import signal as sg
from evoked.operators import spiketrain as st

MS = 1000


def spikes(spark, times, unit=1):
    return spark.createDataFrame([("S", 1, unit, i, int(t)) for i, t in enumerate(times)], "session string, electrode int, unit_id int, spike_id int, t_tick long")


def test_autocorrelogram_by_hand(spark):
    """Spikes at 0, 1.5, 5, 17 ms: lags 1.5, 5, 17, 3.5, 15.5, 12; all in [0, 100]."""
    df = spikes(spark, [0, 1.5 * MS, 5 * MS, 17 * MS]).unionByName(spikes(spark, [0, 200 * MS], 2))
    units = df.select("session", "electrode", "unit_id").distinct()
    dead = spark.createDataFrame([], "session string, electrode int, s long, e long")
    got = {r["unit_id"]: r.asDict() for r in st.acg_features(df, units, dead, ["session", "unit_id"], ["session", "electrode"]).collect()}
    r = got[1]
    per = 1 / 4 / 0.001  # one count, by spike and second
    assert (r["n_lags"], r["peak_lag_ms"], r["peak_count"], r["refractory_count"]) == (6, 3.5, 1, 1)
    assert math.isclose(r["peak_rate_hz"], per) and math.isclose(r["refractory_ratio"], 1 / 6)
    assert math.isclose(r["mean_3_10ms_rate_hz"], 2 * per / 7)  # 3.5 and 5 in seven bins
    assert math.isclose(r["mean_10_50ms_rate_hz"], 3 * per / 40)  # 12, 15.5 and 17 in forty
    assert math.isclose(r["burst_ratio"], 2 / 5)
    assert got[2]["n_lags"] == 0 and got[2]["peak_lag_ms"] is None and got[2]["refractory_count"] is None and got[2]["burst_ratio"] is None
    dead = spark.createDataFrame([("S", 1, 6 * MS, 7 * MS)], "session string, electrode int, s long, e long")
    assert {r["unit_id"]: r["n_lags"] for r in st.acg_features(df, units, dead, ["session", "unit_id"], ["session", "electrode"]).collect()} == {1: 3, 2: 0}


@pytest.mark.parametrize("n,stated", [(9, False), (10, True)])
def test_gated_cv2_needs_ten_spikes(spark, n, stated):
    df = spikes(spark, np.cumsum(np.arange(1, n + 1)) * MS)
    dead = spark.createDataFrame([], "session string, electrode int, s long, e long")
    r = st.isi_features(df, df.select("session", "electrode", "unit_id").distinct(), dead, ["session", "unit_id"], ["session", "electrode"]).first()
    assert r["n_isi_valid"] == n - 1 and (r["cv2_gated"] is not None) == stated and r["cv2"] is not None and (r["lv"] is not None) == stated
    if stated:
        i = np.arange(2, n + 1, dtype=float)
        assert math.isclose(r["cv2_gated"], np.mean(2 * np.diff(i) / (i[1:] + i[:-1])))


def walk(w, at, level, below):
    inside = (lambda x: x <= level) if below else (lambda x: x >= level)
    if not inside(w[at]):
        return None
    left = right = at
    while left > 0 and inside(w[left]):
        left -= 1
    while right < len(w) - 1 and inside(w[right]):
        right += 1
    return (right - left) / 10.0


def test_half_widths(spark):
    rng = np.random.default_rng(3)
    waves = [[0, 0, 0, 0, -1, -4, -10, -6, -4, 1, 6, 4, 2, 0], [0, 0, 0, 0, 1, 2, -8], [0, 0, 0, 0, 1, 2, -8, -1], [0, 0, 0, 0, -8, -8, -8, -8], *np.round(rng.normal(size=(40, 30)), 2).tolist()]
    df = spark.createDataFrame([(i, [float(x) for x in w]) for i, w in enumerate(waves)], "k int, w array<double>")
    rows = {r["k"]: r for r in sg.waveform_features(df, "w", 10_000.0).collect()}
    r = rows[0]
    assert (r["trough_half_width_ms"], r["peak_half_width_ms"], r["trough_to_peak_ms"], r["slope"], r["peak_trough_ratio"]) == (0.3, 0.3, 0.4, 40.0, 0.6)
    assert rows[1]["peak"] is None and rows[1]["peak_half_width_ms"] is None and rows[1]["slope"] is None and rows[1]["ptp"] == 10 and rows[2]["peak_idx"] is None
    for i, w in enumerate(waves):
        y = np.array(w, float) - np.median(w[:4])
        y = -y if abs(y.max()) > abs(y.min()) else y
        at = int(y.argmin())
        assert rows[i]["trough_idx"] == at and rows[i]["trough_half_width_ms"] == walk(y, at, y[at] / 2, True)
        if at < len(y) - 2:
            peak = at + int(y[at:].argmax())
            assert rows[i]["peak_idx"] == peak and rows[i]["peak_half_width_ms"] == (walk(y, peak, y[peak] / 2, False) if y[peak] > 0 else None)


def test_rate_table_against_loops(spark):
    rng = np.random.default_rng(9)
    sp = [(f"S{u % 2}", u % 4, u, i, int(t)) for u in range(6) for i, t in enumerate(np.sort(rng.integers(0, 60 * st.SECOND, 40)))]
    sp += [("S0", 0, 6, 0, 59_999_999)]
    tr = [(f"S{k % 2}", k, int(t), int(t) + 700_000) for k, t in enumerate(rng.integers(10 * st.SECOND, 50 * st.SECOND, 8))]
    dead = [("S0", 0, 12_000_000, 13_700_000), ("S0", 0, 20_000_000, 33_000_000), ("S1", 1, 30_100_000, 30_350_000), ("S1", 3, 0, 60_000_000)]
    s = spark.createDataFrame(sp, "session string, electrode int, unit_id int, spike_id int, t_tick long").repartition(3)
    t = spark.createDataFrame(tr, "session string, stim_index int, t0 long, t1 long")
    d = spark.createDataFrame(dead, "session string, electrode int, s long, e long")
    units = s.select("session", "electrode", "unit_id").distinct()
    half, multiples = 6, [1, 2, 4]
    table, quiet = st.rate_table(s, t, units, d, st.SECOND, half, multiples, 10 * st.SECOND, sigma=1.0)
    rows = {(r["multiple"], r["unit_id"], r["stim_index"]): r for r in table.collect()}
    silent = {(r["multiple"], r["session"], r["electrode"], r["stim_index"]): r for r in quiet.collect()}
    sums = {}
    for session, electrode, unit in {x[:3] for x in sp}:
        own = [x[4] for x in sp if x[2] == unit and not any(a == session and b == electrode and lo <= x[4] < hi for a, b, lo, hi in dead)]
        for where, k, t0, t1 in tr:
            if where != session:
                continue
            for m in multiples:
                size = half // m
                starts = [t0 - half * st.SECOND + i * m * st.SECOND for i in range(size)] + [t1 + i * m * st.SECOND for i in range(size)]
                fr, n = [], []
                for lo in starts:
                    hi = lo + m * st.SECOND
                    lost = sum(max(0, min(hi, e) - max(lo, b)) for a, c, b, e in dead if (a, c) == (session, electrode))
                    n.append(sum(lo <= x < hi for x in own))
                    fr.append(n[-1] / m if 1 - lost / (hi - lo) >= 0.8 else math.nan)
                smooth = []
                for i in range(2 * size):
                    side = range(size) if i < size else range(size, 2 * size)
                    w = [(math.exp(-0.5 * (i - j) ** 2), fr[j]) for j in side if not math.isnan(fr[j]) and abs(i - j) <= 4]
                    smooth.append(sum(a * b for a, b in w) / sum(a for a, _ in w) if w else math.nan)
                base = [x for x in smooth[:size] if not math.isnan(x)]
                mean = np.mean(base) if base else math.nan
                sd = np.std(base, ddof=1) if len(base) > 1 else math.nan
                want = {"fr": fr, "smooth": smooth, "subtract": [x - mean for x in smooth], "percent": [100 * (x - mean) / (mean + 0.1) for x in smooth], "logratio": [math.log((x + 0.1) / (mean + 0.1)) for x in smooth], "zscore": [(x - mean) / sd if sd > 1e-9 else math.nan for x in smooth]}
                for c, values in want.items():
                    for i, x in enumerate(values):
                        if not math.isnan(x):
                            a = sums.setdefault((m, i - size, c), [0, 0.0])
                            a[0] += 1
                            a[1] += x
                got = rows.get((m, unit, k))
                assert (got is not None) == any(t0 - half * st.SECOND <= x < t0 or t1 <= x < t1 + half * st.SECOND for x in own)
                got = got or silent.get((m, session, electrode, k))
                if got is None:
                    assert all(x == 0 for x in fr)
                    continue
                assert got["n"] == n
                for c in want:
                    assert np.allclose([math.nan if x is None else x for x in got[c]], want[c], equal_nan=True), c
    means = st.mean_rates(table, quiet, t, units, half, multiples).collect()
    assert len(means) == 2 * (6 + 3 + 1)
    for r in means:
        for c in st.RATES:
            n, total = sums.get((r["multiple"], r["bin"], c), (0, 0.0))
            assert r[f"n_{c}"] == n and (n == 0 or math.isclose(r[f"mean_{c}"], total / n, abs_tol=1e-9))
    none, _ = st.rate_table(s.limit(0), t, units, None, st.SECOND, half, [1], 10 * st.SECOND)
    assert none.count() == 0
