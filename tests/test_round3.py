"""Findings of review r03."""

import math
from collections import Counter

from pyspark.sql import functions as F

from evoked.operators import celltypes as ct
from evoked.operators import order
from evoked.operators import signal as sg
from evoked.operators import spiketrain as st
from evoked.operators import stats
from evoked.plans import all_queries


def test_unit_summary_can_be_written(spark, sf_dir, tmp_path):
    df = all_queries()["unit_summary"](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    df.write.parquet(str(tmp_path / "units"))
    assert {"refractory_ratio", "acg_refractory_ratio"} <= set(spark.read.parquet(str(tmp_path / "units")).columns)


def test_rank_tests_of_millions_do_not_overflow(spark):
    rows = spark.range(3_000_000).select(F.lit("a").alias("g"), (F.col("id") % 7 - 3).cast("double").alias("d"))
    r = stats.signed_rank(rows, ["g"]).first()
    n = sum(i % 7 != 3 for i in range(3_000_000))
    assert r["n"] == n and math.isfinite(r["p"]) and math.isclose(r["stat"], n * (n + 1) / 4, rel_tol=1e-5)


def test_histograms_by_running_sums(spark):
    s = 1_000_000
    spikes = [("A", u, t) for u, times in {1: [0, 5 * s, 5 * s, 5 * s + 1, 9 * s], 2: [5 * s, 7 * s - 1, 31 * s], 3: [-3 * s]}.items() for t in times] + [("B", 9, 4)]
    trials = [("A", 10, 5 * s, 5 * s), ("A", 11, 5 * s, 7 * s), ("A", 12, 8 * s + 1, 30 * s), ("C", 13, 0, 1)]
    units = sorted({x[:2] for x in spikes})
    want = Counter()
    for a, u, t in spikes:
        for b, i, t0, t1 in trials:
            if a == b and t0 - 3 * s <= t < t0:
                want[i, u, (t - t0) // s] += 1
            elif a == b and t1 <= t < t1 + 3 * s:
                want[i, u, (t - t1) // s] += 1
    p = spark.createDataFrame(spikes, "session string, unit_id long, t_tick long")
    t = spark.createDataFrame(trials, "session string, stim_index long, t0 long, t1 long")
    n = spark.createDataFrame(units, "session string, unit_id long")
    got = {(r.stim_index, r.bin): (r.n, r.units, r.silent) for r in st.trial_histogram(p, t, n, s, 3, 10 * s).collect()}
    assert got == {(i, b): (sum(want[i, u, b] for u in (1, 2, 3)), 3, sum(not want[i, u, b] for u in (1, 2, 3))) for i in (10, 11, 12) for b in range(-3, 3)}
    got = {(r.unit_id, r.bin): r.n for r in st.unit_histogram(p, t, n, s, 3, 10 * s).collect()}
    assert got == {(u, b): sum(want[i, u, b] for i in (10, 11, 12)) for u in (1, 2, 3) for b in range(-3, 3)}


def test_histograms_build_no_pairs(spark):
    s, many = 1_000_000, 60_000
    p = spark.range(many).select(F.lit("A").alias("session"), (F.col("id") % 100).alias("unit_id"), (3 * s + F.col("id")).alias("t_tick"))
    t = spark.range(many).select(F.lit("A").alias("session"), F.col("id").alias("stim_index"), (F.lit(2 * s) - F.col("id")).alias("t0"), (3 * s - F.col("id")).alias("t1"))
    n = p.select("session", "unit_id").distinct()
    assert st.unit_histogram(p, t, n, s, 2, 10 * s).filter("bin = 0").agg(F.sum("n")).first()[0] == many * many  # 3.6 billion pairs
    assert st.trial_histogram(p, t, n, s, 2, 10 * s).filter("bin = 0 AND silent = 0").agg(F.sum("n")).first()[0] == many * many


def test_epochs_meet_cells_and_shuffle_no_samples(spark):
    samples = [("a", i, float(i)) for i in range(-10, 300) if i not in (70, 200)] + [("a", 200, None), ("b", 0, 1.0)]
    firsts = [-11, -10, -3, 0, 48, 50, 54, 55, 60, 63, 64, 71, 127, 128, 184, 185, 201, 284, 285, 1000]
    s = spark.createDataFrame(samples, "channel string, sample_idx long, value double")
    t = spark.createDataFrame([("a", k, f) for k, f in enumerate(firsts)] + [("b", 99, 0)], "channel string, trial_idx long, first long")
    held = {(c, i) for c, i, x in samples if x is not None}
    got = sorted(tuple(r) for r in sg.epochs(s, t, ["channel"], 16).collect())
    assert got == sorted(("a", k, i, float(f + i)) for k, f in enumerate(firsts) if all(("a", f + i) in held for i in range(16)) for i in range(16))
    plan = sg.epochs(s, t, ["channel"], 16)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.index("Generate explode(__own") < plan.index("Join")


def test_ranks_by_range_agree_with_digits(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 1009 / 7.0 - 70).alias("x")).groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    want = {(r.g, r.x): (r.before, r["rank"]) for r in order.ranked(rows, ["g"], "x", "n").collect()}
    assert want == {(r.g, r.x): (r.before, r["rank"]) for r in order.ranked_by_range(rows, ["g"], "x", "n").collect()}
    plan = order.ranked_by_range(rows, ["g"], "x", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("windowspecdefinition") == 2 and plan.count("Join") == 1


def test_means_and_sds_do_not_depend_on_order(spark):
    x = [(i * 7919 % 10007) / 100 + 90000 for i in range(4000)]
    got = set()
    for rows in (x, x[::-1], sorted(x), [*x[1::2], *x[::2]]):
        df = spark.createDataFrame([(1, v, -v) for v in rows], "k int, x double, y double").coalesce(1)
        r = stats.correlation(df, ["k"], "x", "y", digits=2).first()
        got.add((r.x_mean, r.x_sd, r.y_mean, r.y_sd))
    cents = [round(v * 100) for v in x]
    mean, sd = sum(cents) / 400000, math.sqrt((4000 * sum(c * c for c in cents) - sum(cents) ** 2) / (4000 * 3999)) / 100
    assert len(got) == 1 and next(iter(got))[::2] == (mean, -mean) and all(math.isclose(s, sd, rel_tol=1e-14) for s in next(iter(got))[1::2])


def test_false_discovery_computes_p_once(spark):
    p = F.udf(lambda i: __import__("random").random(), "double").asNondeterministic()
    rows = stats.bh_fdr(spark.range(50).select("id", p("id").alias("p")), []).collect()
    assert all(r.q is not None and r.q >= r.p for r in rows)


def test_neighbours_send_a_row_once_a_block(spark):
    rows = [(i, [math.sin(i * j) for j in range(1, 9)]) for i in range(300)] + [(300, [math.sin(7 * j) for j in range(1, 9)])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    d2 = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    v = {r.id: r.v for r in df.collect()}
    want = sorted((i, j) for i in v for _, j in sorted((d2(v[i], v[j]), j) for j in v if j != i)[:3])
    for block in (1 << 16, 10):
        graph = ct.neighbour_graph(df, "id", "v", 3, block=block)
        assert sorted((r.src, r.dst) for r in graph.collect()) == want
    plan = ct.neighbour_graph(df, "id", "v", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "CoGroup" not in plan and "array<double>" not in plan


def test_ranks_of_large_tables_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(stats, "RANKED_ROWS", 100)
    rows = spark.range(2000).select((F.col("id") % 50).alias("g"), (F.col("id") * 37 % 1009).alias("x"), (F.col("id") * 91 % 997).alias("y"))
    out = stats.correlation(rows, ["g"], "x", "y", "spearman")
    assert "RepartitionByExpression [g" in out._jdf.queryExecution().optimizedPlan().toString() and ", 20" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.filter("n = 40 AND abs(r) <= 1 AND p IS NOT NULL").count() == 50


def test_paired_bins_shuffle_no_pairs(spark):
    s = 1_000_000
    spikes = [("A", u, 8 * s + (u * 7919 + i * 104729) % (25 * s)) for u in range(6) for i in range(40 * u)]
    trials = [("A", 50 + i, 12 * s + 611_003 * i, 12 * s + 611_003 * i + i % 3 * s) for i in range(9)] + [("B", 99, 0, 1)]
    dead = [("A", 0, 14 * s, 15 * s + 500), ("A", 1, 17 * s + 100_000, 17 * s + 250_000)]
    p = spark.createDataFrame(spikes, "session string, unit_id long, t_tick long")
    t = spark.createDataFrame(trials, "session string, stim_index long, t0 long, t1 long")
    u = spark.createDataFrame([("A", i % 2, i) for i in range(7)], "session string, electrode long, unit_id long")
    d = spark.createDataFrame(dead, "session string, electrode long, s long, e long")
    want = []
    for _, i, t0, t1 in trials[:-1]:
        for unit in range(7):
            for k in range(8):
                lows = (t0 - (8 - k) * s, t1 + k * s)
                live = [s - sum(max(0, min(e, lo + s) - max(b, lo)) for _, x, b, e in dead if x == unit % 2) for lo in lows]
                if min(live) >= 0.8 * s:
                    rates = [sum(a == unit and lo <= at < lo + s for _, a, at in spikes) * 1e6 / v for lo, v in zip(lows, live)]
                    want.append((unit * 1000 + i, rates[1] - rates[0]))
    plain = {r.k: r for r in stats.signed_rank(spark.createDataFrame(want, "k long, d double"), ["k"], zeros="pratt", min_n=5).collect()}
    for cells in (1 << 21, 100):
        out = st.paired_bins_test(p, t, u, d, s, 8, cells=cells)
        got = out.collect()
        assert len(got) == 63
        for r in got:
            x = plain[r.unit_id * 1000 + r.stim_index]
            assert (r.n, r.stat) == (x.n, x.stat) and (r.p == x.p or math.isclose(r.p, x.p, rel_tol=1e-9))
            assert r.n_bins == sum(k == r.unit_id * 1000 + r.stim_index for k, _ in want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("FlatMapGroupsInArrow")] and "RepartitionByExpression" not in plan[: plan.index("FlatMapGroupsInArrow")]
