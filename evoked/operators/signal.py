"""Operators on sampled signals: epochs, bipolar pairs, filters, envelopes, spectra, wavelets, waveforms.

Relational steps are DataFrame code. Fourier steps run over one chunk, epoch or waveform at a time in numpy, in
batches that Spark deals out, so what a task holds is bounded by a chunk, never by a recording.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evoked.operators.chunks import with_halo


def map_arrays(df: DataFrame, column: str, f: Callable[[np.ndarray], np.ndarray], keep: list[str], out: str = "samples") -> DataFrame:
    """(keep, out array<double>): f of each array, NULL and empty arrays unchanged."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(len(keep))
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            made = [f(x) if len(x) else x for x in np.split(flat, ends[:-1])] if len(ends) else []
            lengths = np.array([len(x) for x in made], np.int32)
            offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32), mask=np.r_[~valid, False])
            values = pa.array(np.concatenate(made) if made else np.empty(0))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.ListArray.from_arrays(offsets, values)], [*keep, out])

    return df.select(*keep, column).mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), f"{out} array<double>"]))


def butter_gain(freq: np.ndarray, low: float | None, high: float | None, order: int = 4) -> np.ndarray:
    """Gain of a Butterworth filter run forward and backward: the squared magnitude, no phase."""
    gain = np.ones_like(freq)
    if low:
        ratio = np.divide(low, freq, out=np.full_like(freq, np.inf), where=freq > 0)
        gain = gain / (1 + ratio ** (2 * order))
    if high:
        gain = gain / (1 + (freq / high) ** (2 * order))
    return gain


def notch_gain(freq: np.ndarray, notches: tuple[float, ...], q: float) -> np.ndarray:
    gain = np.ones_like(freq)
    for f0 in notches:
        num = (freq**2 - f0**2) ** 2
        gain = gain * num / (num + (f0 * freq / q) ** 2 + 1e-300)
    return gain


def apply_gain(x: np.ndarray, fs: float, gain: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Zero-phase filter by a gain over frequencies; the ends are extended by odd reflection."""
    n = len(x)
    pad = min(n - 1, int(fs))
    ext = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]] if pad > 0 else x
    spectrum = np.fft.rfft(ext) * gain(np.fft.rfftfreq(len(ext), 1 / fs))
    return np.fft.irfft(spectrum, len(ext))[pad : pad + n]


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal."""
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * h))


def filter_chunks(chunks: DataFrame, keys: list[str], fs: float, low: float | None, high: float | None, notches: tuple[float, ...] = (), q: float = 30.0, halo: int | None = None, with_envelope: bool = False) -> DataFrame:
    """Chunks filtered (band, high-pass or notch) with a halo that is trimmed after; notches at or above Nyquist are left out."""
    good = tuple(n for n in notches if n < fs / 2)
    rows = with_halo(chunks, keys, int(2 * fs) if halo is None else halo)
    rows = rows.withColumn("n", F.size("samples"))

    def one(x: np.ndarray) -> np.ndarray:
        y = apply_gain(x, fs, lambda f: butter_gain(f, low, high) * notch_gain(f, good, q))
        return envelope(y) if with_envelope else y

    done = map_arrays(rows, "padded", one, [*keys, "chunk_id", "left", "n"], "out")
    return done.select(*keys, "chunk_id", F.slice("out", F.col("left") + 1, F.col("n")).alias("samples"))


def band_envelopes(chunks: DataFrame, keys: list[str], fs: float, bands: list[tuple[str, float, float]]) -> DataFrame:
    """(keys, band, chunk_id, samples): envelope of each sub-band."""
    out = None
    for name, low, high in bands:
        part = filter_chunks(chunks, keys, fs, low, high, with_envelope=True).withColumn("band", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def adjacent_pairs(channels: DataFrame, keys: list[str], bad: DataFrame | None = None) -> DataFrame:
    """(keys, shaft, a, b): contacts n and n + 1 of a shaft, bad channels removed first, so no gap is bridged.

    channels: keys, channel, shaft, contact.
    """
    good = channels if bad is None else channels.join(bad.select(*keys, "channel"), [*keys, "channel"], "left_anti")
    left = good.select(*keys, "shaft", "contact", F.col("channel").alias("a"))
    right = good.select(*keys, "shaft", (F.col("contact") - 1).alias("contact"), F.col("channel").alias("b"))
    return left.join(right, [*keys, "shaft", "contact"])


def bipolar(chunks: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Samples of a minus samples of b, chunk by chunk."""
    a = chunks.select(*keys, F.col("channel").alias("a"), "chunk_id", F.col("samples").alias("x"))
    b = chunks.select(*keys, F.col("channel").alias("b"), "chunk_id", F.col("samples").alias("y"))
    joined = pairs.join(a, [*keys, "a"]).join(b, [*keys, "b", "chunk_id"])
    return joined.select(*keys, "shaft", F.concat_ws("-", "a", "b").alias("channel"), "chunk_id", F.zip_with("x", "y", lambda p, q: p - q).alias("samples"))


def epochs(samples: DataFrame, trials: DataFrame, keys: list[str], n: int, pad: bool = False) -> DataFrame:
    """(keys, trial_idx, time_idx, value): n samples from each trial's first sample.

    samples: keys, sample_idx, value; trials: keys, trial_idx, first. A trial with a missing sample goes, or with pad keeps
    its whole grid with NULLs.
    """
    if pad:
        grid = trials.withColumn("time_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("sample_idx", F.col("first") + F.col("time_idx"))
        return grid.join(samples, [*keys, "sample_idx"], "left").select(*keys, "trial_idx", "time_idx", "value")
    # samples in cells that reach n - 1 samples into the next: a trial meets one cell, and becomes rows after that
    size = max(64, n)
    cell = F.floor(F.col("sample_idx") / size).cast("long")
    held = samples.filter(F.col("value").isNotNull()).withColumn("__cell", F.explode(F.when(F.pmod("sample_idx", F.lit(size)) < n - 1, F.array(cell, cell - 1)).otherwise(F.array(cell))))
    held = held.groupBy(*keys, "__cell").agg(F.collect_list(F.struct("sample_idx", "value")).alias("__held"))
    met = trials.withColumn("__cell", F.floor(F.col("first") / size).cast("long")).join(held, [*keys, "__cell"])
    own = F.filter("__held", lambda s: (s["sample_idx"] >= F.col("first")) & (s["sample_idx"] < F.col("first") + n))
    met = met.select(*keys, "trial_idx", "first", own.alias("__own")).filter(F.size("__own") == n)
    got = met.select(*keys, "trial_idx", "first", F.explode("__own").alias("__s"))
    return got.select(*keys, "trial_idx", (F.col("__s.sample_idx") - F.col("first")).cast("int").alias("time_idx"), F.col("__s.value").alias("value"))


def welch_relational(rows: DataFrame, keys: list[str], fs: float, nperseg: int) -> DataFrame:
    """(keys, freq_hz, psd) of (keys, i, x): Hann window, half overlap, mean removed, one-sided density.

    Segments by explode, the transform as sums over samples x a broadcast frequency grid. For short
    segments; welch is the Fourier path with the same result.
    """
    step = nperseg // 2
    spark = rows.sparkSession
    last = F.max("i").over(W.partitionBy(*keys))
    seg = F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("i") - nperseg + 1) / step)).cast("int"), F.expr(f"CAST(i div {step} AS INT)")))
    parts = rows.withColumn("__last", last).withColumn("seg", seg).filter(F.col("seg") * step + nperseg - 1 <= F.col("__last"))
    parts = parts.withColumn("__at", F.col("i") - F.col("seg") * step)
    parts = parts.withColumn("x", F.col("x") - F.avg("x").over(W.partitionBy(*keys, "seg")))
    k = np.arange(nperseg)
    hann = 0.5 - 0.5 * np.cos(2 * math.pi * k / nperseg)
    scale = 1 / (fs * (hann**2).sum())
    freqs = range(nperseg // 2 + 1)
    basis = [(int(i), int(f), float(hann[i] * math.cos(2 * math.pi * f * i / nperseg)), float(hann[i] * math.sin(2 * math.pi * f * i / nperseg))) for i in k for f in freqs]
    table = spark.createDataFrame(basis, "__at int, f int, c double, s double")
    sums = parts.join(F.broadcast(table), "__at").groupBy(*keys, "seg", "f").agg(F.sum(F.col("x") * F.col("c")).alias("re"), F.sum(F.col("x") * F.col("s")).alias("im"))
    twice = F.when((F.col("f") > 0) & (F.col("f") < (nperseg + 1) // 2) | ((F.col("f") == nperseg // 2) & F.lit(nperseg % 2 == 1)), 2.0).otherwise(1.0)
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) * scale * twice
    return sums.withColumn("p", power).groupBy(*keys, "f").agg(F.avg("p").alias("psd")).select(*keys, (F.col("f") * fs / nperseg).alias("freq_hz"), "psd")


def welch(df: DataFrame, keys: list[str], column: str, fs: float, nperseg: int) -> DataFrame:
    """(keys, freq_hz, psd) of arrays, by Fourier transforms."""
    hann = 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(nperseg) / nperseg)

    def one(x: np.ndarray) -> np.ndarray:
        if len(x) < nperseg:
            return np.empty(0)
        starts = range(0, len(x) - nperseg + 1, nperseg // 2)
        segs = np.array([x[s : s + nperseg] for s in starts])
        spectrum = np.abs(np.fft.rfft((segs - segs.mean(1, keepdims=True)) * hann)) ** 2 / (fs * (hann**2).sum())
        spectrum[:, 1 : (nperseg + 1) // 2] *= 2
        return spectrum.mean(0)

    out = map_arrays(df, column, one, keys, "psds")
    return out.select(*keys, F.posexplode("psds").alias("f", "psd")).select(*keys, (F.col("f") * fs / nperseg).alias("freq_hz"), "psd")


def morlet_power(df: DataFrame, keys: list[str], column: str, fs: float, freqs: list[float], cycles: float = 7.0, step: int = 1) -> DataFrame:
    """(keys, freq_hz, time_idx, power): zero-mean Morlet wavelets, every step-th sample."""

    def wavelet(f: float) -> np.ndarray:
        sd = cycles / (2 * math.pi * f)
        t = np.arange(-math.ceil(5 * sd * fs), math.ceil(5 * sd * fs) + 1) / fs
        g = np.exp(-0.5 * (t / sd) ** 2)
        w = g * (np.exp(2j * math.pi * f * t) - math.exp(-0.5 * cycles**2))
        w = w - g * (w.sum() / g.sum())
        return w / (math.sqrt(0.5) * np.linalg.norm(w))

    def one(x: np.ndarray) -> np.ndarray:
        out = []
        for f in freqs:
            w = wavelet(f)
            size = 1 << (len(x) + len(w) - 2).bit_length()
            y = np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(w, size))[: len(x) + len(w) - 1]
            h = (len(w) - 1) // 2
            out.append((np.abs(y[h : h + len(x)]) ** 2)[::step])
        return np.concatenate(out)

    table = map_arrays(df.withColumn("__n", F.ceil(F.size(column) / step).cast("int")), column, one, [*keys, "__n"], "p")
    flat = table.select(*keys, "__n", F.posexplode("p").alias("i", "power"))
    grid = F.array(*map(F.lit, map(float, freqs)))
    return flat.select(*keys, F.get(grid, F.expr("CAST(i div __n AS INT)")).alias("freq_hz"), (F.expr("i % __n") * step).alias("time_idx"), "power")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row: a column named in a lambda could be evaluated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def standard_waveform(w: Column) -> Column:
    """Median of the first four samples off, sign so that the largest deflection is negative."""
    median = let(F.array_sort(F.slice(w, 1, 4)), lambda base: (base[1] + base[2]) / 2)
    flat = let(median, lambda m: F.transform(w, lambda x: x - m))
    sign = lambda c: F.when(F.abs(F.array_max(c)) > F.abs(F.array_min(c)), -1.0).otherwise(1.0)
    return let(flat, lambda c: let(sign(c), lambda f: F.transform(c, lambda x: x * f)))


def half_width(s: Column, at: Column, level: Column, below: bool, fs: float) -> Column:
    """Milliseconds between the first samples to both sides of `at` that leave the level (or the array's ends); NULL if `at` isn't beyond it.

    With below, samples at or under the level belong to the width, else those at or over it.
    """
    inside = (lambda x: x <= level) if below else (lambda x: x >= level)
    out = F.filter(F.transform(s, lambda x, i: F.when(~inside(x), i)), lambda i: i.isNotNull())
    ends = lambda o: F.coalesce(F.array_min(F.filter(o, lambda i: i > at)), F.size(s) - 1) - F.coalesce(F.array_max(F.filter(o, lambda i: i < at)), F.lit(0))
    return F.when(inside(F.get(s, at)), let(out, ends) * 1000.0 / fs)


def waveform_features(df: DataFrame, column: str, fs: float) -> DataFrame:
    """Adds trough, trough_idx, peak and peak_idx (from the trough on), trough_to_peak_ms, ptp, peak_trough_ratio, both half widths in ms, slope.

    A half width is the walk out from the trough or peak while values stay beyond half of it. A trough in the last two samples has no
    peak; a peak at or below 0 has no width, a trough at or above 0 no ratio. slope is the rise per ms from trough to peak. NULL
    arrays give NULLs.
    """

    def features(s: Column, trough: Column, at: Column, after: Column) -> Column:
        has = at < F.size(s) - 2
        peak = F.when(has, F.array_max(after))
        peak_at = F.when(has, (F.array_position(after, F.array_max(after)) - 1 + at).cast("int"))
        ms = (peak_at - at) * 1000.0 / fs
        return let(
            F.struct(peak.alias("peak"), peak_at.alias("at"), ms.alias("ms")),
            lambda p: F.struct(
                trough.alias("trough"),
                at.alias("trough_idx"),
                p["peak"].alias("peak"),
                p["at"].alias("peak_idx"),
                p["ms"].alias("trough_to_peak_ms"),
                (F.array_max(s) - trough).alias("ptp"),
                F.when(trough < 0, p["peak"] / F.abs(trough)).alias("peak_trough_ratio"),
                half_width(s, at, trough / 2, True, fs).alias("trough_half_width_ms"),
                F.when(p["peak"] > 0, half_width(s, p["at"], p["peak"] / 2, False, fs)).alias("peak_half_width_ms"),
                F.when(p["ms"] > 0, (p["peak"] - trough) / p["ms"]).alias("slope"),
            ),
        )

    def of_signed(s: Column) -> Column:
        after = lambda at: F.slice(s, at + 1, F.size(s))
        place = lambda t: (F.array_position(s, t) - 1).cast("int")
        return let(F.array_min(s), lambda t: let(place(t), lambda at: let(after(at), lambda rest: features(s, t, at, rest))))

    rows = df.withColumn("__f", let(standard_waveform(F.col(column)), of_signed))
    return rows.select("*", "__f.*").drop("__f")


def standardise(df: DataFrame, column: str, fs: float, before_ms: float, from_ms: float = -1.0, to_ms: float = 2.0, n: int = 121, max_outside: float = 0.1) -> DataFrame:
    """Adds w_std, w_norm (largest magnitude 1), flipped, trough_ms, outside (share of held points) and ok.

    Samples that aren't finite are interpolated between finite ones, edges held; the median of the first 0.2 ms goes; the
    largest deflection becomes negative and its trough 0 ms of n points. NULL, flat and short arrays, and those of fewer than five
    finite samples, give zeros, outside 1 and not ok. More than max_outside held points aren't ok either.
    """
    first, step, base = from_ms * fs / 1000, (to_ms - from_ms) * fs / 1000 / (n - 1), max(3, int(0.2 * fs / 1000))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    def line(w: Column, i: Column, lo: Column, hi: Column) -> Column:
        a, b = F.get(w, lo), F.get(w, hi)
        return F.coalesce(a + (i - lo) * (b - a) / (hi - lo), a, b)

    def filled(w: Column) -> Column:
        place = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: finite(F.get(w, i)))
        before = lambda g, i: F.array_max(F.filter(g, lambda k: k < i))
        after = lambda g, i: F.array_min(F.filter(g, lambda k: k > i))
        missing = lambda g, i: let(before(g, i), lambda lo: let(after(g, i), lambda hi: line(w, i, lo, hi)))
        return let(place, lambda g: F.when(F.size(g) >= 5, F.transform(w, lambda x, i: F.when(finite(x), x).otherwise(missing(g, i)))))

    def median(y: Column) -> Column:
        size = F.least(F.lit(base), F.size(y))
        return let(F.array_sort(F.slice(y, F.lit(1), size)), lambda b: (F.get(b, F.floor((F.size(b) - 1) / 2).cast("int")) + F.get(b, F.floor(F.size(b) / 2).cast("int"))) / 2)

    def value(s: Column, place: Column) -> Column:
        held = F.greatest(F.lit(0.0), F.least(place, F.size(s) - 1.0))
        left = lambda h: F.floor(h).cast("int")
        return let(held, lambda h: F.get(s, left(h)) + (h - left(h)) * (F.get(s, F.least(left(h) + 1, F.size(s) - 1)) - F.get(s, left(h))))

    def result(s: Column, flipped: Column, at: Column, places: Column, w: Column, top: Column) -> Column:
        outside = F.size(F.filter(places, lambda p: (p < 0) | (p > F.size(s) - 1))) / n
        norm = F.transform(w, lambda x: F.when(top > 1e-12, x / top).otherwise(0.0))
        return F.struct(w.alias("w_std"), norm.alias("w_norm"), flipped.alias("flipped"), (at * 1000.0 / fs - before_ms).alias("trough_ms"), outside.alias("outside"), ((top > 1e-12) & (outside <= max_outside)).alias("ok"))

    def of_signed(s: Column, flipped: Column) -> Column:
        at = (F.array_position(s, F.array_min(s)) - 1).cast("int")
        places = lambda a: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: a + F.lit(first) + j * step)
        top = lambda w: F.array_max(F.transform(w, F.abs))
        return let(at, lambda a: let(places(a), lambda q: let(F.transform(q, lambda p: value(s, p)), lambda w: let(top(w), lambda t: result(s, flipped, a, q, w, t)))))

    def of_flat(c: Column) -> Column:
        up = F.abs(F.array_max(c)) > F.abs(F.array_min(c))
        signed = lambda f: F.transform(c, lambda x: F.when(f, -x).otherwise(x))
        some = F.greatest(F.abs(F.array_max(c)), F.abs(F.array_min(c))) > 1e-12
        return F.when(some, let(up, lambda f: let(signed(f), lambda s: of_signed(s, f))))

    flat = lambda y: let(median(y), lambda m: F.transform(y, lambda x: x - m))
    zeros = F.array_repeat(F.lit(0.0), n)
    none = F.struct(zeros.alias("w_std"), zeros.alias("w_norm"), F.lit(False).alias("flipped"), F.lit(None).cast("double").alias("trough_ms"), F.lit(1.0).alias("outside"), F.lit(False).alias("ok"))
    rows = df.withColumn("__w", F.coalesce(let(filled(F.col(column)), lambda y: let(flat(y), of_flat)), none))
    return rows.select("*", "__w.*").drop("__w")


def resample(df: DataFrame, keys: list[str], column: str, origin: Column, step: float, n: int) -> DataFrame:
    """(keys, i, value, outside): linear interpolation at positions origin + i * step of the array, edges held."""
    grid = df.select(*keys, F.col(column).alias("a"), origin.alias("o"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    at = F.col("o") + F.col("i") * step
    held = F.greatest(F.lit(0.0), F.least(at, F.size("a") - 1.0))
    grid = grid.withColumns({"at": at, "held": held}).withColumn("lo", F.floor("held").cast("int"))
    hi = F.least(F.col("lo") + 1, F.size("a") - 1)
    value = F.get("a", F.col("lo")) + (F.col("held") - F.col("lo")) * (F.get("a", hi) - F.get("a", F.col("lo")))
    return grid.select(*keys, "i", value.alias("value"), (F.col("at") != F.col("held")).alias("outside"))


def templates(spikes: DataFrame, samples: DataFrame, before: int, after: int, at_most: int, seed: int = 3) -> DataFrame:
    """(session, unit_id, channel, offset, mean, n): mean waveform of at most N spikes a unit, drawn by a seeded hash.

    spikes: session, unit_id, spike_id, sample_idx; samples: session, channel, sample_idx, value.
    """
    pick = F.row_number().over(W.partitionBy("session", "unit_id").orderBy(F.xxhash64(F.lit(seed), "spike_id"), "spike_id"))
    some = spikes.withColumn("__r", pick).filter(F.col("__r") <= at_most)
    cut = some.select("session", "unit_id", "sample_idx", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset"))
    cut = cut.withColumn("sample_idx", F.col("sample_idx") + F.col("offset"))
    return cut.join(samples, ["session", "sample_idx"]).groupBy("session", "unit_id", "channel", "offset").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def best_channel(means: DataFrame) -> DataFrame:
    """Channel of the largest peak-to-peak mean waveform of each unit; the first on a tie."""
    ptp = means.groupBy("session", "unit_id", "channel").agg((F.max("mean") - F.min("mean")).alias("ptp"))
    w = W.partitionBy("session", "unit_id").orderBy(F.desc("ptp"), "channel")
    return ptp.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
