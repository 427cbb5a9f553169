"""Recordings as chunks (keys, chunk_id, start_sample, samples): halos, compaction of gaps, reference segments.

A recording is never one row, one group or one window: chunks meet by equality on a chunk number or start, and what a group holds
is bounded by a chunk and its neighbours.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoked.operators import intervals as iv


def shortest_inner(chunks: DataFrame, keys: list[str]) -> int | None:
    """Samples of the shortest chunk that holds any and isn't the last of its recording; NULL keys are a recording of their own."""
    sizes = chunks.select(F.struct(*keys).alias("k"), "chunk_id", F.size("samples").alias("n")).filter("n > 0")
    last = sizes.groupBy("k").agg(F.max("chunk_id").alias("last"))
    return sizes.join(last, "k").filter("chunk_id < last").agg(F.min("n")).first()[0]


def with_halo(chunks: DataFrame, keys: list[str], halo: int, shortest: int | None = None) -> DataFrame:
    """chunks with up to `halo` samples of each side's neighbours: padded, left (samples added in front).

    Each chunk sends its first and last samples to the chunk numbers around it, and a chunk meets what was sent to it by equality: one
    aggregation, no window. It sends as far as chunks of `shortest` samples need (found in the data unless given), so neighbours shorter than
    the halo are joined by theirs. A missing or empty chunk ends the halo on its side. Other columns pass through.
    """
    if shortest is None:
        shortest = shortest_inner(chunks, keys)
    reach = max(1, math.ceil(halo / max(1, shortest))) if shortest else 1
    h, n = F.col("__h"), F.size("samples")
    part = F.least(F.lit(halo), n)
    sent = F.when(h > 0, F.slice("samples", n - part + 1, part)).when(h < 0, F.slice("samples", F.lit(1), part))
    own = F.struct(*(F.col(c) for c in chunks.columns))
    steps = F.when(n > 0, F.sequence(F.lit(-reach), F.lit(reach))).otherwise(F.array(F.lit(0)))
    rows = chunks.withColumn("__h", F.explode(steps)).select(*keys, (F.col("chunk_id") + h).alias("__to"), h, F.when(h == 0, own).alias("__own"), sent.alias("__part"))
    near = F.struct(F.abs(h).alias("h"), F.col("__part").cast("array<double>").alias("x"))
    met = rows.groupBy(*keys, "__to").agg(
        F.first("__own", ignorenulls=True).alias("__own"),
        F.sort_array(F.collect_list(F.when(h > 0, near))).alias("__front"),
        F.sort_array(F.collect_list(F.when(h < 0, near))).alias("__back"),
    )
    joined = lambda c: F.transform(F.filter(c, lambda p, i: p["h"] == i + 1), lambda p: p["x"])
    front, back = F.flatten(F.reverse(joined("__front"))), F.flatten(joined("__back"))
    met = met.filter("__own IS NOT NULL").select("__own.*", front.alias("__front"), back.alias("__back"))
    size = F.least(F.lit(halo), F.size("__front"))
    padded = F.concat(F.slice("__front", F.size("__front") - size + 1, size), "samples", F.slice("__back", F.lit(1), F.least(F.lit(halo), F.size("__back"))))
    return met.select(*chunks.columns, padded.alias("padded"), size.alias("left"))


def dead_samples(dead: DataFrame, keys: list[str], fs: float, lo: str = "s", hi: str = "e") -> DataFrame:
    """Disjoint dead intervals (keys, s, e) in whole samples, from intervals in seconds; ends are rounded half to even."""
    rows = dead.select(*keys, F.rint(F.col(lo) * fs).cast("long").alias("s"), F.rint(F.col(hi) * fs).cast("long").alias("e"))
    return iv.merge_intervals(rows, keys)


def compact_signal(chunks: DataFrame, good: DataFrame, keys: list[str], size: int, width: int | None = None) -> DataFrame:
    """The recording without its gaps, in new chunks of `size` samples: (keys, chunk_id, start_sample, samples).

    good has (keys, lo, hi, origin), as good_chunks gives them, in samples. Source chunks may have any lengths and need not touch. Their extents
    meet the good intervals by grid cells, without samples; each source chunk is then cut once into what goes to each new chunk, and
    a new chunk joins its parts in order. Samples that no source chunk has are NULL inside a new chunk and absent at its
    ends. A source chunk occurs once.
    """
    extent = chunks.select(*keys, "start_sample", (F.col("start_sample") + F.size("samples")).alias("__end"))
    met = iv.overlap(extent, good.select(*keys, "lo", "hi", "origin"), keys, "start_sample", "__end", "lo", "hi", width or 16 * size)
    a, b = F.greatest("start_sample", "lo"), F.least("__end", "hi")
    pieces = met.select(*keys, "start_sample", a.alias("a"), (b - a).alias("n"), (F.col("origin") + a - F.col("lo")).alias("at"))
    pieces = pieces.withColumn("to", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size))))
    first = F.greatest(F.col("at"), F.col("to") * size)
    last = F.least(F.col("at") + F.col("n"), (F.col("to") + 1) * size)
    cut = F.struct(F.col("to"), first.alias("first"), (F.col("a") + first - F.col("at") - F.col("start_sample") + 1).cast("int").alias("pos"), (last - first).cast("int").alias("n"))
    cuts = pieces.groupBy(*keys, "start_sample").agg(F.collect_list(cut).alias("cuts"))  # no more than the chunk has samples
    parts = chunks.select(*keys, "start_sample", "samples").join(cuts, [*keys, "start_sample"]).withColumn("c", F.explode("cuts"))
    parts = parts.select(*keys, F.col("c.to").alias("chunk_id"), F.col("c.first").alias("first"), F.slice("samples", F.col("c.pos"), F.col("c.n")).alias("x"))
    out = parts.groupBy(*keys, "chunk_id").agg(F.sort_array(F.collect_list(F.struct("first", "x"))).alias("parts"))
    gap = lambda p, i: F.when(i > 0, p["first"] - F.get("parts", i - 1)["first"] - F.size(F.get("parts", i - 1)["x"])).otherwise(0)
    filled = F.transform("parts", lambda p, i: F.concat(F.array_repeat(F.lit(None).cast("double"), gap(p, i).cast("int")), p["x"].cast("array<double>")))
    return out.select(*keys, "chunk_id", F.col("parts")[0]["first"].alias("start_sample"), F.flatten(filled).alias("samples"))


def first_stimulation(trials: DataFrame, keys: list[str], fs: float, t0: str = "t0") -> DataFrame:
    """(keys, stop_sample): samples before the first stimulation of each recording, one at least."""
    return trials.groupBy(*keys).agg(F.greatest(F.rint(F.min(t0) * fs).cast("long"), F.lit(1)).alias("stop_sample"))


def reference_moments(chunks: DataFrame, keys: list[str], stop: Column | None = None) -> DataFrame:
    """(keys, ref_n, ref_mean, ref_sd): of the samples before sample number `stop` of each key, or of all; sd with divisor n.

    Each chunk is cut at stop and gives (n, mean, M2); these few numbers are merged, so no sample becomes a row. NULL and NaN don't count.
    """
    kept = F.col("samples") if stop is None else F.slice("samples", F.lit(1), F.greatest(F.lit(0), F.least(F.size("samples").cast("long"), stop - F.col("start_sample"))).cast("int"))
    kept = F.filter(kept, lambda x: x.isNotNull() & ~F.isnan(x))
    rows = chunks.select(*keys, kept.alias("x")).withColumn("n", F.size("x")).filter("n > 0")
    rows = rows.withColumn("mean", F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.col("n"))
    rows = rows.select(*keys, "n", "mean", F.aggregate("x", F.lit(0.0), lambda s, v: s + (v - F.col("mean")) * (v - F.col("mean"))).alias("m2"))
    whole = rows.groupBy(*keys).agg(F.sum("n").alias("ref_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("ref_mean"))
    away = rows.join(whole, keys).groupBy(*keys, "ref_n", "ref_mean").agg(F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("ref_mean")) * (F.col("mean") - F.col("ref_mean"))).alias("m2"))
    return away.select(*keys, "ref_n", "ref_mean", F.sqrt(F.col("m2") / F.col("ref_n")).alias("ref_sd"))


def normalise_chunks(chunks: DataFrame, keys: list[str], forms: list[str], stop: Column | None = None, eps: float = 1e-12) -> DataFrame:
    """chunks with one array a form, relative to the reference of the keys: all samples, or those before sample number `stop`.

    mean: 100 x / (m + eps); zscore: (x - m) / (sd + eps), sd with divisor n. The reference of a whole session takes keys of a recording and no
    stop; before the first stimulation, stop is that of first_stimulation; within epochs, the keys name an epoch and stop is
    the length of its baseline. Keys without a reference sample get NULL arrays.
    """
    rows = chunks.join(reference_moments(chunks, keys, stop), keys, "left")
    m, sd = F.col("ref_mean"), F.col("ref_sd")
    made = {"mean": lambda x: 100 * x / (m + eps), "zscore": lambda x: (x - m) / (sd + eps)}
    known = lambda f: F.when(m.isNotNull(), F.transform("samples", made[f]))
    return rows.select(*chunks.columns, *(known(f).alias(f) for f in forms))
