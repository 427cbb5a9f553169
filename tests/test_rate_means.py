"""Means of rates over all pairs of unit and trial are summed in groups of trials, by classes of equal counts."""

import math

import numpy as np
import pytest

from evoked.operators import rates
from evoked.operators import spiketrain as st

S = 1_000_000


@pytest.mark.parametrize("spikes,trials,span,late", [(300, 40, 60, 5), (40, 3000, 40, 3), (2000, 500, 30, 60), (5, 1, 10, 1), (4000, 200, 2, 1)])
def test_equal_counts_against_loops(spikes, trials, span, late):
    rng = np.random.default_rng(spikes)
    unit, ticks = np.sort(rng.integers(0, 9, spikes)), rng.integers(-span, span, spikes) * 100
    t0 = rng.integers(-span, span, trials) * 50
    t1 = t0 + rng.integers(0, late, trials) * 70
    t0[:1], t1[-1:] = -rates.NEVER, rates.NEVER
    want = {}
    for u in range(9):
        own = ticks[unit == u]
        n = np.stack([((own >= x) & (own < x + 200)).sum(1) for at, shift in ((t0, -600), (t1, 0)) for x in (at[:, None] + shift + np.arange(3)[:, None, None] * 200)], 1) if trials else []
        for row in n[n.any(1)].tolist():
            want[tuple(row)] = want.get(tuple(row), 0) + 1
    for at_once in (1 << 15, 10):
        got = {}
        for weights, counts in rates.equal_counts(t0, t1, unit, ticks, 200, 3, at_once):
            for w, row in zip(weights.tolist(), counts.tolist()):
                got[tuple(row)] = got.get(tuple(row), 0) + w
        assert got == want


def test_means_agree_with_the_table_of_pairs(spark):
    rng = np.random.default_rng(5)
    spikes = [(f"S{u % 2}", None if u == 9 else u % 4, u if u < 10 else None, i, int(t)) for u in range(11) for i, t in enumerate(rng.integers(-20 * S, 60 * S, 4 * u))]
    trials = [(f"S{k % 3}", k, int(t), int(t) + k * 80_000) for k, t in enumerate(rng.integers(-30 * S, 50 * S, 40))] + [("S0", 90, 20 * S, None), ("S1", 91, None, 20 * S), ("S1", 92, None, None)]
    dead = [("S0", 0, 12 * S, 14 * S), ("S0", 2, 20 * S, 33 * S), ("S1", 1, 30 * S + 5, 30 * S + 350_000), ("S1", 7, 0, 60 * S)]
    p = spark.createDataFrame(spikes, "session string, electrode int, unit_id int, spike_id int, t_tick long")
    t = spark.createDataFrame(trials, "session string, stim_index int, t0 long, t1 long")
    d = spark.createDataFrame(dead, "session string, electrode int, s long, e long")
    u = p.select("session", "electrode", "unit_id").distinct().unionByName(spark.createDataFrame([("S0", 2, 50), ("S1", 1, 51)], "session string, electrode int, unit_id int"))
    for merged, sigma, strict in ((None, None, False), (d, 1.0, False), (d, 0.7, True)):
        how = (S, 6, [1, 2, 4], 10 * S, sigma, 0.8, strict)
        want = {(r.multiple, r.bin): r for r in st.mean_rates(*st.rate_table(p, t, u, merged, *how), t, u, 6, [1, 2, 4]).collect()}
        got = rates.mean_rates_of(p, t, u, merged, *how).collect()
        assert len(got) == len(want) == 20
        for r in got:
            for c, x in want[r.multiple, r.bin].asDict().items():
                assert (r[c] is None) == (x is None) and (x is None or math.isclose(r[c], x, rel_tol=1e-9, abs_tol=1e-12)), (r.multiple, r.bin, c)


def test_means_build_no_pairs(spark):
    from pyspark.sql import functions as F

    many = 60_000
    p = spark.range(many).select(F.lit("A").alias("session"), F.lit(0).alias("electrode"), (F.col("id") % 100).alias("unit_id"), (3 * S + F.col("id")).alias("t_tick"))
    t = spark.range(many).select(F.lit("A").alias("session"), F.col("id").alias("stim_index"), (F.lit(2 * S) - F.col("id")).alias("t0"), (3 * S - F.col("id")).alias("t1"))
    u = p.select("session", "electrode", "unit_id").distinct()
    rows = {r.bin: r for r in rates.mean_rates_of(p, t, u, None, S, 2, [1], 10 * S, sigma=None).collect()}  # 3.6 billion pairs of spike and trial
    assert rows[0].n_fr == 100 * many and rows[0].mean_fr == 600 and rows[1].mean_fr == 0 and rows[0].mean_percent == 600_000 and rows[0].mean_zscore is None


def test_queries_of_means_shuffle_no_pairs(spark, sf_dir):
    from evoked.plans import all_queries

    for name in ("firing_rate_bins", "firing_rate_widths"):
        plan = all_queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "MapInArrow" not in plan.replace("FlatMapGroupsInArrow", "")
