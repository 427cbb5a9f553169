"""User-level pipelines over tables of any number of sessions; each is one plan, not a loop over sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoked.operators import binning as bn
from evoked.operators import celltypes as ct
from evoked.operators import describe as ds
from evoked.operators import intervals as iv
from evoked.operators import reconcile as rc
from evoked.operators import signal as sg
from evoked.operators import spiketrain as st
from evoked.operators import stats


def unit_summary(spikes: DataFrame, trials: DataFrame, units: DataFrame, dead: DataFrame, extent: DataFrame, acg_bin: int = 1000, acg_bins: int = 100, acg_ms: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Unit table (rates, interval and autocorrelogram features) and unit x trial table.

    refractory_ratio is the share of intervals, acg_refractory_ratio that of the autocorrelogram's lags.
    """
    keys, dead_keys = ["session", "unit_id"], ["session", "electrode"]
    merged = iv.merge_intervals(dead, dead_keys)
    rates = st.unit_rates(spikes, extent, trials, units, merged)
    isi = st.isi_features(spikes, units, merged, keys, dead_keys)
    acg = st.acg_features(spikes, units, merged, keys, dead_keys, acg_bin, acg_bins, acg_ms).withColumnRenamed("refractory_ratio", "acg_refractory_ratio")
    return rates.join(isi, keys, "left").join(acg, keys, "left"), st.trial_responses(spikes, trials, units, dead)


def psd(epochs: DataFrame, keys: list[str], column: str, fs: float, nperseg: int, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """Long power spectra within [low, high], and their grand average by the keys after session."""
    rows = sg.welch(epochs, keys, column, fs, nperseg).filter(F.col("freq_hz").between(low, high))
    rest = [k for k in keys if k not in ("session", "trial_idx")]
    return rows, ds.grand_average(rows, [*[k for k in keys if k != "trial_idx"], "freq_hz"], [*rest, "freq_hz"], "psd")


def morlet(epochs: DataFrame, keys: list[str], column: str, fs: float, freqs: list[float], condition: str, n: int, n_perm: int = 200) -> tuple[DataFrame, DataFrame]:
    """Baseline-normalised time-frequency power (the first half of the epoch's n samples is the baseline) and clusters by condition."""
    power = sg.morlet_power(epochs, keys, column, fs, freqs)
    power = power.withColumn("pre", F.col("time_idx") < n / 2)
    norm = bn.baseline_normalise(power, [*keys, "freq_hz"], "power", F.col("pre"), ["logratio", "zscore"], eps=1e-12, ddof=0)
    index = F.array_position(F.array(*map(F.lit, map(float, freqs))), F.col("freq_hz")).cast("int")
    rows = norm.select(condition, F.xxhash64(*keys).alias("obs"), index.alias("freq_idx"), "time_idx", F.col("logratio").alias("x"))
    return norm, stats.cluster_permutation(rows, [condition], "x", n_perm, grid=True)


def hilbert(chunks: DataFrame, keys: list[str], fs: float, bands: list[tuple[str, float, float]], trials: DataFrame, n: int, step: int) -> DataFrame:
    """Band envelopes cut to epochs and decimated: (keys, band, trial_idx, time_idx, value)."""
    env = sg.band_envelopes(chunks, keys, fs, bands)
    starts = chunks.select(*keys, "chunk_id", "start_sample")
    samples = env.join(starts, [*keys, "chunk_id"]).select(*keys, "band", "start_sample", F.posexplode("samples").alias("i", "value"))
    samples = samples.select(*keys, "band", (F.col("start_sample") + F.col("i")).alias("sample_idx"), "value")
    bands_of = chunks.sparkSession.createDataFrame([(b[0],) for b in bands], "band string")
    return bn.decimate(sg.epochs(samples, trials.join(F.broadcast(bands_of)), [*keys, "band"], n), "time_idx", step)


def hilbert_tests(epochs: DataFrame, by: list[str], obs: list[str], mu0: float = 0.0) -> DataFrame:
    """Signed-rank test of each time against mu0 with q within `by`; 100 is the meaningful mu0 for envelopes in percent."""
    rows = epochs.withColumn("d", F.col("value") - mu0)
    return stats.bh_fdr(stats.signed_rank(rows, [*by, "time_idx"]), by)


def common_trials(micro: DataFrame, macro: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Reconciled trials of two clocks and the offset of each session."""
    joined = rc.strategy_join(macro, micro, ["session"], ["t0"], ["t0"], label)
    return joined, rc.clock_offset(joined, ["session"], "t0", "t0_b")


def rate_power(fr_bins: DataFrame, lfp_bins: DataFrame, bin_keys: list[str], by: list[str], variants: list[tuple[str, str]], method: str = "spearman", min_pairs: int = 5, digits: int | None = None) -> DataFrame:
    """Correlations of firing rate with band power for each (fr column, power column) pair, q within variant.

    Both tables are built once with all normalised columns; variants are rows of one stack, not new runs.
    """
    pairs = F.array(*(F.struct(F.lit(f"fr_{a}__lfp_{b}").alias("variant"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in variants))
    rows = fr_bins.join(lfp_bins, bin_keys).withColumn("v", F.explode(pairs)).select(*by, "v.*")
    out = stats.correlation(rows, ["variant", *by], "x", "y", method, digits=digits).filter(F.col("n") >= min_pairs)
    return stats.bh_fdr(out, ["variant"])


def cell_types(waveforms: DataFrame, key: str, vector: str, fs: float) -> DataFrame:
    """Waveform features with mixture labels."""
    rows = sg.waveform_features(waveforms, vector, fs)
    labels = ct.mixture_labels(rows.select(key, F.col("trough_to_peak_ms").cast("double"), F.col("trough_half_width_ms").cast("double")), ["trough_to_peak_ms", "trough_half_width_ms"], "trough_to_peak_ms", [key])
    return rows.join(labels, key)


def group_study(responses: DataFrame, region: str, tag: str, value: str, reference: str) -> tuple[DataFrame, DataFrame]:
    """Each tag against the reference within regions with q over all tests, and Kruskal-Wallis over the tags."""
    tests = stats.mann_whitney(responses, [region], value, tag, reference).withColumn("family", F.lit("all"))
    return stats.bh_fdr(tests, ["family"]).drop("family"), stats.kruskal(responses, [region], value, tag)
