"""Hand-computed rows, and laws that hold whatever the data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoked.functions import labels as lb
from evoked.functions import tails
from evoked.operators import binning as bn
from evoked.operators import intervals as iv
from evoked.operators import reconcile as rc
from evoked.operators import signal as sg
from evoked.operators import spiketrain as st
from evoked.operators import stats
from evoked.plans import views as v
from evoked.sources import raw, readers


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_merge_intervals(spark):
    df = spark.createDataFrame([("a", 0, 2), ("a", 1, 3), ("a", 3, 4), ("a", 6, 7), ("a", 5, 5), ("a", None, 9)], "k string, s long, e long")
    assert sorted((r.s, r.e) for r in iv.merge_intervals(df, ["k"]).collect()) == [(0, 4), (6, 7)]


def test_crossing(spark):
    pairs = spark.createDataFrame([(1, 10, 20)], "k long, lo long, hi long")
    for s, e, want in [(20, 30, False), (0, 10, False), (15, 16, True)]:
        dead = spark.createDataFrame([(1, s, e)], "k long, s long, e long")
        assert iv.crossing(pairs, dead, ["k"], "lo", "hi").first()["crosses"] is want


def test_compaction(spark):
    dead = spark.createDataFrame([(1, 10, 20)], "k long, s long, e long")
    chunks = iv.good_chunks(dead, spark.createDataFrame([(1, 100)], "k long, duration long"), ["k"])
    points = spark.createDataFrame([(1, t) for t in (5, 15, 20, 30)], "k long, t long")
    assert sorted((r.t, r.t_compact) for r in iv.compact(points, chunks, ["k"], "t", 7).collect()) == [(5, 5), (20, 10), (30, 20)]


@pytest.mark.parametrize("width", [1_000_000, 7_654_321, 500_000_000])
def test_grid_width_changes_nothing(spark, sf_dir, width):
    t = v.trials(spark, sf_dir).withColumn("lo", F.col("t0") - 10_000_000)
    joined = iv.interval_join(v.spikes(spark, sf_dir), t, ["session"], "t_tick", "lo", "t1", width)
    plain = v.spikes(spark, sf_dir).join(t, "session").filter("t_tick >= lo AND t_tick < t1")
    assert joined.count() == plain.count() > 0


def test_isi_features(spark):
    rows = [("s", 1, 1, i, t * 1000) for i, t in enumerate([0, 5, 13, 113])] + [("s", 1, 2, 9, 50)]
    spikes = spark.createDataFrame(rows, "session string, electrode long, unit_id long, spike_id long, t_tick long")
    dead = spark.createDataFrame([], "session string, electrode long, s long, e long")
    units = spikes.select("session", "electrode", "unit_id").distinct()
    out = {r.unit_id: r for r in st.isi_features(spikes, units, dead, ["session", "unit_id"], ["session", "electrode"]).collect()}
    r = out[1]
    assert r.n_isi_valid == 3 and r.isi_median_ms == 8 and r.n_refractory == 0
    assert math.isclose(r.isi_mean_ms, 37.6667, abs_tol=1e-4) and math.isclose(r.isi_sd_ms, 54.0031, abs_tol=1e-4)
    assert math.isclose(r.cv2, 1.082621, abs_tol=1e-6) and math.isclose(r.burst6, 1 / 3) and math.isclose(r.burst10, 2 / 3)
    assert out[2].n_isi_total == 0 and out[2].n_isi_valid == 0 and out[2].isi_mean_ms is None


def test_bh(spark):
    df = spark.createDataFrame([(1, p) for p in (0.01, 0.04, 0.03, 0.5, None)], "f long, p double")
    q = {r.p: r.q for r in stats.bh_fdr(df, ["f"]).collect()}
    large = {r.p: r.q for r in stats.bh_fdr_large(df).collect()}
    for p, want in {0.01: 0.04, 0.04: 0.053333, 0.03: 0.053333, 0.5: 0.5}.items():
        assert math.isclose(q[p], want, abs_tol=1e-6) and math.isclose(large[p], want, abs_tol=1e-6)
    assert q[None] is None and large[None] is None


def test_signed_rank(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4, 5)] + [(2, 0.0)] * 6 + [(3, 1.0)] * 4, "k long, d double")
    out = {r.k: r for r in stats.signed_rank(df, ["k"], exact=True, min_n=5).collect()}
    assert out[1].stat == 0 and out[1].p == 0.0625
    assert out[2].stat == 0 and out[2].p == 1
    assert out[3].p is None
    flipped = {r.k: r.p for r in stats.signed_rank(df.withColumn("d", -F.col("d")), ["k"], exact=True, min_n=5).collect()}
    assert flipped == {k: r.p for k, r in out.items()}


def test_mann_whitney(spark):
    df = spark.createDataFrame([("r", g, float(x)) for g, xs in (("a", (1, 2, 3)), ("n", (4, 5, 6))) for x in xs], "k string, g string, x double")
    r = stats.mann_whitney(df, ["k"], "x", "g", "n", exact=True).first()
    assert r.u == 0 and math.isclose(r.p, 0.1)


def test_correlation_of_constant(spark):
    df = spark.createDataFrame([(1, 2.0, float(i)) for i in range(5)], "k long, x double, y double")
    r = stats.correlation(df, ["k"], "x", "y").first()
    assert r.n == 5 and r.r is None and r.p is None


def test_tails():
    assert math.isclose(tails.t_two_sided(2.0, 10), 0.0733880, abs_tol=1e-6)
    assert math.isclose(tails.chi2_upper(3.841459, 1), 0.05, abs_tol=1e-6)
    assert math.isclose(tails.t_quantile(0.975, 10), 2.228139, abs_tol=1e-5)


def test_condition_classes(spark):
    cases = {"['negatif']": ("negatif", []), "['controle']": ("controle", []), "['aphasie', 'negatif']": ("cog+", ["aphasie"]), "['negatif', 'controle']": ("unknown", []), "": ("unknown", []), None: ("unknown", []), "nan": ("unknown", [])}
    for cell, want in cases.items():
        kind, effects = lb.condition_class(lb.list_cell(F.lit(cell).cast("string")))
        assert tuple(one(spark, kind, effects)) == want, cell


def test_names(spark):
    for raw_name, want in {"va1": "A_L", "dtp2": "TP_R", "A": "A_R", "B'": "B_L", "TPp": "TP_L", "TP_": "TP_R", "ABCp": "AB_L", "vtp1": "TP_L", "da1": "A_R", "vhip2": "HI_L", "B_p": "B_L", "x9": None}.items():
        assert one(spark, lb.electrode_name(F.lit(raw_name))) == [want], raw_name
    for label in ("3", "stim3", "stimic3"):
        assert one(spark, lb.session_label(F.lit(label))) == ["stimic3"]
    parts = lb.stim_label(F.lit("Tp3-Tp42.0mA7.0Hz1025µsec"))
    assert one(spark, parts["shaft"], parts["pair"], parts["intensity_ma"], parts["frequency_hz"]) == ["Tp", "3-4", 2.0, 7.0]
    assert one(spark, lb.stim_label(F.lit("no label"))["shaft"]) == [None]
    assert one(spark, lb.number(F.lit("1,5")), lb.number(F.lit("nan"))) == [1.5, None]
    assert one(spark, *lb.condition_key(F.lit("cog::tag::local"))) == ["cog::tag", "local"]
    assert one(spark, lb.unwarp(lb.warp(F.lit(7.0), F.lit(5.0), F.lit(9.0), F.lit(1.0)), F.lit(5.0), F.lit(9.0), F.lit(1.0))) == [7.0]
    assert one(spark, lb.stars(F.lit(0.004)), lb.stars(F.lit(None).cast("double"))) == ["**", "NA"]


def test_pairs_do_not_bridge(spark):
    rows = [("s", f"A{i}", "A", i) for i in (1, 2, 4, 5)] + [("s", "B1", "B", 1)]
    channels = spark.createDataFrame(rows, "session string, channel string, shaft string, contact int")
    out = sg.adjacent_pairs(channels, ["session"], spark.createDataFrame([("s", "A5")], "session string, channel string"))
    assert [(r.a, r.b) for r in out.collect()] == [("A1", "A2")]


def test_bins_and_normalisation(spark):
    bins = bn.relative_bins(spark, 1.0, 1.0, 0.4).collect()
    assert [(round(r.start, 6), round(r.end, 6)) for r in bins] == [(-1.0, -0.6), (-0.6, -0.2), (0.0, 0.4), (0.4, 0.8)]
    df = spark.createDataFrame([(1, -1, 0.0), (1, -2, 0.0), (1, 0, 0.0)], "k long, b int, x double")
    r = bn.baseline_normalise(df, ["k"], "x", F.col("b") < 0, ["logratio", "zscore"]).filter("b = 0").first()
    assert r.logratio == 0.0 and r.zscore is None
    flat = spark.createDataFrame([(1, i, None if i == 3 else 2.0) for i in range(9)], "k long, i int, x double")
    assert all(math.isclose(r.smooth, 2.0) for r in bn.smooth(flat, ["k"], "i", "x", 1.5).collect())


def test_filters_on_sines(spark):
    fs, n = 256.0, 1024
    t = np.arange(n) / fs
    x = np.sin(2 * math.pi * 10 * t) + np.sin(2 * math.pi * 60 * t)
    whole = spark.createDataFrame([(1, 0, x.tolist())], "k long, chunk_id long, samples array<double>")
    cut = spark.createDataFrame([(1, i, x[i * 256 : (i + 1) * 256].tolist()) for i in range(4)], "k long, chunk_id long, samples array<double>")
    a = np.concatenate([r.samples for r in sg.filter_chunks(whole, ["k"], fs, 5.0, 20.0).orderBy("chunk_id").collect()])
    b = np.concatenate([r.samples for r in sg.filter_chunks(cut, ["k"], fs, 5.0, 20.0, halo=256).orderBy("chunk_id").collect()])
    mid = slice(300, 724)
    assert np.abs(a[mid] - np.sin(2 * math.pi * 10 * t)[mid]).max() < 0.05
    assert np.abs(a[mid] - b[mid]).max() < 0.02
    e = np.array(sg.filter_chunks(whole, ["k"], fs, 5.0, 20.0, with_envelope=True).first().samples)
    assert np.abs(e[mid] - 1).max() < 0.06
    quiet = np.array(sg.filter_chunks(whole, ["k"], fs, None, None, notches=(60.0, 500.0)).first().samples)
    assert np.abs(quiet[mid] - np.sin(2 * math.pi * 10 * t)[mid]).max() < 0.1


def test_welch_peak_and_both_paths(spark):
    fs, n = 64.0, 128
    x = np.sin(2 * math.pi * 8 * np.arange(n) / fs)
    df = spark.createDataFrame([(1, x.tolist())], "k long, w array<double>")
    fast = {r.freq_hz: r.psd for r in sg.welch(df, ["k"], "w", fs, 32).collect()}
    slow = {r.freq_hz: r.psd for r in sg.welch_relational(df.select("k", F.posexplode("w").alias("i", "x")), ["k"], fs, 32).collect()}
    assert max(fast, key=fast.get) == 8 and fast.keys() == slow.keys()
    assert all(math.isclose(fast[f], slow[f], rel_tol=1e-9, abs_tol=1e-12) for f in fast)
    assert abs(sum(fast.values()) * 2 - 0.5) < 0.05
    m = {}
    for r in sg.morlet_power(df, ["k"], "w", fs, [4.0, 8.0, 16.0]).filter("time_idx BETWEEN 50 AND 80").collect():
        m[r.freq_hz] = m.get(r.freq_hz, 0) + r.power
    assert max(m, key=m.get) == 8.0


def test_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [(1, o, t, float(rng.normal() + (2 if 5 <= t < 12 else 0))) for o in range(20) for t in range(30)]
    df = spark.createDataFrame(rows, "k long, obs long, time_idx int, x double")
    best = stats.cluster_permutation(df, ["k"], "x", n_perm=99).orderBy("p", F.desc("size")).first()
    assert best.significant and abs(best.first_idx - 5) <= 1 and abs(best.last_idx - 11) <= 1
    grid = df.withColumn("freq_idx", F.lit(0))
    other = stats.cluster_permutation(grid, ["k"], "x", n_perm=99, grid=True).orderBy("p", F.desc("size")).first()
    assert (other.first_idx, other.last_idx, other.p) == (best.first_idx, best.last_idx, best.p)


def test_joins(spark):
    a = spark.createDataFrame([("s", "x", 1.0), ("s", "y", 2.0)], "session string, label string, t0 double")
    b = spark.createDataFrame([("s", "y", 12.0), ("s", "x", 13.0)], "session string, label string, t0 double")
    out = rc.strategy_join(a, b, ["session"], ["t0"], ["t0"], "label").collect()
    assert {(r.label, r.t0_b, r.strategy) for r in out} == {("x", 13.0, "label"), ("y", 12.0, "label")}
    with pytest.raises(ValueError):
        rc.assert_unique(a.union(a), ["label"])
    assert rc.assert_unique(a, ["label"]).count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "session1.txt").write_text("label\tstart\tdur\nA1-A2\t1,5\t2\n")
    (tmp_path / "session2.txt").write_text("B1-B2\t3\t1\tlobe\n")
    rows = readers.event_parts(spark, [str(tmp_path / "session1.txt"), str(tmp_path / "session2.txt")]).orderBy("part_index").collect()
    assert [(r.label_stim, r.t_start, r.t_end, r.lobe, r.part_index) for r in rows] == [("A1-A2", 1.5, 3.5, None, 0), ("B1-B2", 3.0, 4.0, "lobe", 1)]
    (tmp_path / "bad.txt").write_text("A\tx\t1\n")
    with pytest.raises(Exception, match="no event"):
        readers.stim_events(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "cog.txt").write_text("stim;t_start;duration;lobe;cog\nA1;1,5;2;T;['aphasie']\nB1,3.5,1,F;['negatif', 'x']\n")
    cog = readers.annotated_events(spark, str(tmp_path / "cog.txt")).orderBy("t_start").collect()
    assert [(r.stim, r.t_start, r.cog_labels) for r in cog] == [("A1", 1.5, ["aphasie"]), ("B1", 3.5, ["negatif", "x"])]
    (tmp_path / "dead_TP.txt").write_text("30000\t60000\n")
    r = readers.dead_intervals(spark, str(tmp_path / "dead_*.txt"), 30000.0).first()
    assert (r.electrode, r.s, r.e) == ("TP", 1.0, 2.0)
    readers.write_metadata(spark, {"a": 1}, str(tmp_path / "meta"))
    assert readers.read_metadata(spark, str(tmp_path / "meta"), "a int").first().a == 1


def test_raw_source(spark, tmp_path):
    data = np.arange(40, dtype="<i2").reshape(10, 4)
    (tmp_path / "x.dat").write_bytes(data.tobytes())
    spark.dataSource.register(raw.RawSource)
    n = raw.records((tmp_path / "x.dat").stat().st_size, 4)
    df = spark.read.format("raw_int16").option("channels", 4).option("records", n).option("chunk", 4).load(str(tmp_path / "x.dat"))
    got = {}
    for r in df.orderBy("chunk_id").collect():
        got.setdefault(r.channel, []).extend(r.samples)
    assert got == {c: data[:, c].tolist() for c in range(4)}
    with pytest.raises(ValueError):
        raw.records(81, 4)
    assert raw.tetrode_channels(2) == [4, 5, 6, 7]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
