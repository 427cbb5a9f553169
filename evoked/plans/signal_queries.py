"""Queries on signals: one embedding is one epoch or waveform of 64 samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoked.functions import labels as lb
from evoked.operators import celltypes as ct
from evoked.operators import chunks as ck
from evoked.operators import intervals as iv
from evoked.operators import signal as sg
from evoked.operators import stats
from evoked.operators.binning import decimate
from evoked.functions.tails import two_sided_sql
from evoked.plans import pipelines as pl
from evoked.plans import views as v
from evoked.plans.registry import query

FS = 64.0


def waves(spark: SparkSession, d: str) -> DataFrame:
    return v.read(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("w"))


def long(spark: SparkSession, d: str) -> DataFrame:
    return waves(spark, d).select("vec_id", "label", F.posexplode("w").alias("i", "x"))


N = 32
WELCH = f"""s AS (SELECT vec_id, seg, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS x FROM (SELECT vec_id, seg, list_transform(embedding[seg * 16 + 1 : seg * 16 + {N}], lambda z: z::DOUBLE) AS w FROM embeddings, (SELECT unnest([0, 1, 2]) AS seg))),
  m AS (SELECT vec_id, seg, i, (x - avg(x) OVER (PARTITION BY vec_id, seg)) * (0.5 - 0.5 * cos(2 * pi() * i / {N})) AS y FROM s),
  f AS (SELECT vec_id, seg, f, sum(y * cos(2 * pi() * f * i / {N})) AS re, sum(y * sin(2 * pi() * f * i / {N})) AS im FROM m, (SELECT unnest(range({N // 2 + 1})) AS f) GROUP BY ALL),
  p AS (SELECT vec_id, f * 2.0 AS freq_hz, avg((re * re + im * im) * CASE WHEN f BETWEEN 1 AND {N // 2 - 1} THEN 2 ELSE 1 END) / ({FS} * {N} * 0.375) AS psd FROM f GROUP BY ALL)"""


@query(f"WITH {WELCH} SELECT vec_id, freq_hz, round(psd, 8) AS psd FROM p")
def welch_psd(spark: SparkSession, d: str) -> DataFrame:
    """D3 by Fourier transforms; the relational form is held against it in the tests."""
    return sg.welch(waves(spark, d), ["vec_id"], "w", FS, N).withColumn("psd", F.round("psd", 8))


@query(f"WITH {WELCH} SELECT vec_id % 5 AS channel, freq_hz, avg(psd) AS psd, count(*) AS n FROM p WHERE freq_hz BETWEEN 4 AND 20 GROUP BY ALL")
def welch_by_channel(spark: SparkSession, d: str) -> DataFrame:
    """D3 relational, F6, A10."""
    rows = long(spark, d).select("vec_id", "i", "x")
    psd = sg.welch_relational(rows, ["vec_id"], FS, N).filter(F.col("freq_hz").between(4, 20))
    return psd.groupBy((F.col("vec_id") % 5).alias("channel"), "freq_hz").agg(F.avg("psd").alias("psd"), F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
  b AS (SELECT *, avg(x) FILTER (i < 16) OVER (PARTITION BY vec_id) AS m, stddev_pop(x) FILTER (i < 16) OVER (PARTITION BY vec_id) AS sd FROM l)
SELECT label, (i // 8)::BIGINT AS bin, avg((x - m) / sd) AS z, avg(x - m) AS sub, count(*) AS n FROM b WHERE i % 2 = 0 GROUP BY ALL""")
def power_bins(spark: SparkSession, d: str) -> DataFrame:
    """A9, P23 (ddof 0), O-W9, O-W10."""
    from evoked.operators.binning import baseline_normalise

    rows = baseline_normalise(long(spark, d), ["vec_id"], "x", F.col("i") < 16, ["zscore", "subtract"], ddof=0)
    return decimate(rows, "i", 2).groupBy("label", F.expr("i div 8").alias("bin")).agg(F.avg("zscore").alias("z"), F.avg("subtract").alias("sub"), F.count(F.lit(1)).alias("n"))


@query("""SELECT label, i, avg(x) AS mean, stddev_pop(x) AS sd, count(*) AS n FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL""")
def class_waveforms(spark: SparkSession, d: str) -> DataFrame:
    """A20."""
    return ct.class_waveforms(waves(spark, d), "label", "w")


FEATURES = """w AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings),
  a AS (SELECT vec_id, label, list_transform(w, lambda x: x - m) AS c FROM (SELECT *, median_of[1] AS m FROM (SELECT *, [(list_sort(w[1:4])[2] + list_sort(w[1:4])[3]) / 2] AS median_of FROM w))),
  s AS (SELECT vec_id, label, CASE WHEN abs(list_max(c)) > abs(list_min(c)) THEN list_transform(c, lambda x: -x) ELSE c END AS s FROM a),
  t AS (SELECT *, list_min(s) AS trough, list_position(s, list_min(s)) - 1 AS trough_idx FROM s),
  p AS (SELECT *, CASE WHEN trough_idx < len(s) - 2 THEN list_max(s[trough_idx + 1 :]) END AS peak, CASE WHEN trough_idx < len(s) - 2 THEN list_position(s[trough_idx + 1 :], list_max(s[trough_idx + 1 :])) - 1 + trough_idx END AS peak_idx FROM t),
  h AS (SELECT *, list_filter(range(len(s)), lambda i: s[i + 1] > trough / 2) AS out_t, list_filter(range(len(s)), lambda i: s[i + 1] < peak / 2) AS out_p, (peak_idx - trough_idx) * 1000.0 / 20000 AS trough_to_peak_ms FROM p),
  feat AS (SELECT vec_id, label, trough, trough_idx, peak, peak_idx, trough_to_peak_ms, list_max(s) - trough AS ptp, CASE WHEN trough < 0 THEN peak / abs(trough) END AS peak_trough_ratio,
    CASE WHEN trough <= 0 THEN (coalesce(list_min(list_filter(out_t, lambda i: i > trough_idx)), len(s) - 1) - coalesce(list_max(list_filter(out_t, lambda i: i < trough_idx)), 0)) * 1000.0 / 20000 END AS trough_half_width_ms,
    CASE WHEN peak > 0 THEN (coalesce(list_min(list_filter(out_p, lambda i: i > peak_idx)), len(s) - 1) - coalesce(list_max(list_filter(out_p, lambda i: i < peak_idx)), 0)) * 1000.0 / 20000 END AS peak_half_width_ms,
    CASE WHEN trough_to_peak_ms > 0 THEN (peak - trough) / trough_to_peak_ms END AS slope FROM h)"""


@query(f"WITH {FEATURES} SELECT vec_id, trough, trough_idx, peak, peak_idx, trough_to_peak_ms, ptp, peak_trough_ratio, trough_half_width_ms, peak_half_width_ms, slope FROM feat")
def waveform_features(spark: SparkSession, d: str) -> DataFrame:
    """D5 baseline and sign, D6."""
    return sg.waveform_features(waves(spark, d), "w", 20000.0).drop("w", "label")


@query(f"""WITH {FEATURES}, g AS (SELECT a.vec_id, t.trough_idx, list_transform(a.embedding, lambda x: x::DOUBLE) AS w, i, t.trough_idx - 8 + i * 0.5 AS place FROM embeddings a JOIN feat t USING (vec_id), (SELECT unnest(range(33)) AS i)),
  k AS (SELECT *, greatest(0.0, least(place, len(w) - 1.0)) AS held FROM g)
SELECT vec_id, i, w[floor(held)::INT + 1] + (held - floor(held)) * (w[least(floor(held)::INT + 2, len(w))] - w[floor(held)::INT + 1]) AS value, place <> held AS outside FROM k""")
def aligned_waveforms(spark: SparkSession, d: str) -> DataFrame:
    """Trough at a fixed place, linear interpolation, edges held."""
    rows = sg.waveform_features(waves(spark, d), "w", 20000.0)
    return sg.resample(rows, ["vec_id"], "w", F.col("trough_idx") - 8.0, 0.5, 33)


@query("""WITH l AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
  n AS (SELECT vec_id, i, CASE WHEN (vec_id + i) % 17 <> 0 THEN x END AS x FROM l),
  o AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY vec_id ORDER BY i) AS lo, min(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY vec_id ORDER BY i DESC) AS hi FROM n),
  u AS (SELECT o.vec_id, o.i, CASE WHEN o.x IS NOT NULL THEN o.x ELSE coalesce(a.x + (o.i - o.lo) * (b.x - a.x) / (o.hi - o.lo), a.x, b.x) END AS y FROM o LEFT JOIN n a ON a.vec_id = o.vec_id AND a.i = o.lo LEFT JOIN n b ON b.vec_id = o.vec_id AND b.i = o.hi),
  y AS (SELECT vec_id, list(y ORDER BY i) AS y FROM u GROUP BY 1), c AS (SELECT vec_id, list_transform(y, lambda x: x - m) AS c FROM (SELECT *, (list_sort(y[1:4])[2] + list_sort(y[1:4])[3]) / 2 AS m FROM y)),
  f AS (SELECT vec_id, list_max(c) > -list_min(c) AS flipped, CASE WHEN list_max(c) > -list_min(c) THEN list_transform(c, lambda x: -x) ELSE c END AS s FROM c),
  g AS (SELECT *, list_position(s, list_min(s)) - 1 - 20 + j * 0.5 AS place FROM f, (SELECT unnest(range(121)) AS j)),
  h AS (SELECT *, greatest(0.0, least(place, len(s) - 1.0)) AS held FROM g),
  v AS (SELECT vec_id, flipped, list_position(s, list_min(s)) - 1 AS low, j, place <> held AS off, s[floor(held)::INT + 1] + (held - floor(held)) * (s[least(floor(held)::INT + 2, len(s))] - s[floor(held)::INT + 1]) AS value FROM h)
SELECT vec_id, flipped, low * 1000.0 / 20000 - 1 AS trough_ms, j AS i, value, value / max(abs(value)) OVER w AS norm, avg(off::INT) OVER w AS outside, avg(off::INT) OVER w <= 0.1 AS ok FROM v WINDOW w AS (PARTITION BY vec_id)""")
def standard_waveforms(spark: SparkSession, d: str) -> DataFrame:
    """D5 in full, with samples that aren't finite: interpolation, baseline, sign, alignment, amplitude, ok flag."""
    gaps = F.transform("w", lambda x, i: F.when((F.col("vec_id") + i) % 17 == 0, float("nan")).otherwise(x))
    rows = sg.standardise(waves(spark, d).select("vec_id", gaps.alias("w")), "w", 20000.0, 1.0)
    points = F.posexplode(F.zip_with("w_std", "w_norm", lambda a, b: F.struct(a.alias("value"), b.alias("norm")))).alias("i", "p")
    return rows.select("vec_id", "flipped", "trough_ms", "outside", "ok", points).select("vec_id", "flipped", "trough_ms", "outside", "ok", "i", "p.*")


@query("""WITH p AS (SELECT vec_id, label, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS z FROM embeddings),
  c AS (SELECT label, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM p) WHERE r = 1),
  d AS (SELECT p.vec_id, c.label AS other, sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) + (p.z - c.z) * (p.z - c.z)) AS dist, p.label = c.label AS same, p.label % 3 = c.label % 3 AS lobe, p.vec_id % 2 AS a, c.label % 2 AS b FROM p CROSS JOIN c)
SELECT vec_id, other, dist, CASE WHEN dist <= 40 THEN 'local_inf4cm' WHEN same THEN 'same_electrode' WHEN lobe THEN 'same_lobe' WHEN a <> b THEN 'contralateral' END AS proximity FROM d""")
def proximity(spark: SparkSession, d: str) -> DataFrame:
    """Distances to one reference point a label."""
    p = waves(spark, d).select("vec_id", "label", *((F.col("w")[i] * 100).alias(c) for i, c in enumerate("xyz")))
    c = p.groupBy("label").agg(F.min_by(F.struct("x", "y", "z"), "vec_id").alias("c")).select(F.col("label").alias("other"), F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("c.z").alias("cz"))
    both = p.join(F.broadcast(c))
    dist = lb.distance([F.col("x"), F.col("y"), F.col("z")], [F.col("cx"), F.col("cy"), F.col("cz")])
    near = lb.proximity(dist, F.col("label") == F.col("other"), F.col("label") % 3 == F.col("other") % 3, F.col("vec_id") % 2, F.col("other") % 2)
    return both.select("vec_id", "other", dist.alias("dist"), near.alias("proximity"))


@query("""WITH l AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
  s AS (SELECT vec_id % 5 AS channel, (vec_id // 5) * 64 + i AS sample_idx, x FROM l), t AS (SELECT o_orderkey AS trial_idx, o_custkey * 3 AS first FROM orders),
  g AS (SELECT channel, trial_idx, first, k FROM (SELECT DISTINCT channel FROM s), t, (SELECT unnest(range(16)) AS k)),
  j AS (SELECT g.channel, g.trial_idx, g.k AS time_idx, s.x AS value FROM g JOIN s ON s.channel = g.channel AND s.sample_idx = g.first + g.k)
SELECT channel, trial_idx, count(*) AS n, avg(value) AS mean, min(value) AS lo, arg_max(value, time_idx) AS last FROM j GROUP BY ALL HAVING count(*) = 16""")
def trial_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Epochs by an equi-join on sample numbers; incomplete trials go. Summed up by channel and trial."""
    s = long(spark, d).select((F.col("vec_id") % 5).alias("channel"), (F.expr("vec_id div 5") * 64 + F.col("i")).alias("sample_idx"), F.col("x").alias("value"))
    t = v.read(spark, d, "orders").select(F.col("o_orderkey").alias("trial_idx"), (F.col("o_custkey") * 3).alias("first"))
    t = t.join(F.broadcast(spark.range(5).withColumnRenamed("id", "channel")))
    rows = sg.epochs(s, t, ["channel"], 16)
    return rows.groupBy("channel", "trial_idx").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("lo"), F.max_by("value", "time_idx").alias("last"))


@query("""WITH a AS (SELECT vec_id // 5 AS trial, vec_id % 5 AS contact, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings WHERE NOT (vec_id % 5 = 3 AND (vec_id // 5) % 4 = 0))
SELECT a.trial, a.contact AS a, b.contact AS b, list_sum(a.w) - list_sum(b.w) AS total FROM a JOIN a b ON b.trial = a.trial AND b.contact = a.contact + 1""")
def bipolar_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring contacts, bad channels removed first."""
    rows = waves(spark, d).select(F.expr("vec_id div 5").alias("trial"), (F.col("vec_id") % 5).alias("channel"), F.lit(0).alias("chunk_id"), F.col("w").alias("samples"))
    channels = rows.select("trial", "channel", F.lit("A").alias("shaft"), F.col("channel").alias("contact"))
    bad = channels.filter("channel = 3 AND trial % 4 = 0")
    pairs = sg.adjacent_pairs(channels, ["trial"], bad)
    out = sg.bipolar(rows, pairs, ["trial"])
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x)
    return out.select("trial", F.split("channel", "-")[0].cast("long").alias("a"), F.split("channel", "-")[1].cast("long").alias("b"), total.alias("total"))


@query("""WITH f AS (SELECT label, (i // 4)::BIGINT AS band, vec_id, avg(x) AS m FROM (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL)
SELECT label, band // 4 AS main, avg(m) AS mean, median(m) AS med, bool_or(m > 0.2) AS any_high, bool_and(m > -0.2) AS all_above, count(DISTINCT vec_id) AS n_obs FROM f GROUP BY ALL""")
def band_reduction(spark: SparkSession, d: str) -> DataFrame:
    """A16, A13."""
    f = long(spark, d).groupBy("label", F.expr("i div 4").alias("band"), "vec_id").agg(F.avg("x").alias("m"))
    return f.groupBy("label", F.expr("band div 4").alias("main")).agg(F.avg("m").alias("mean"), F.median("m").alias("med"), F.bool_or(F.col("m") > 0.2).alias("any_high"), F.bool_and(F.col("m") > -0.2).alias("all_above"), F.countDistinct("vec_id").alias("n_obs"))


@query("""WITH s AS (SELECT user_id % 4 AS session, user_id AS unit, event_id AS spike, event_id * 7 % 5000 AS at FROM events WHERE event_type = 'view'),
  x AS (SELECT vec_id % 4 AS session, vec_id % 3 AS channel, (vec_id // 12) * 64 + generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
  y AS (SELECT session, channel, i, avg(x) AS x FROM x GROUP BY ALL)
SELECT s.session, s.unit AS unit_id, channel, o AS "offset", avg(y.x) AS mean, count(*) AS n FROM s, (SELECT unnest(range(-4, 9)) AS o) JOIN y ON true WHERE y.session = s.session AND y.i = s.at + o GROUP BY ALL""")
def unit_templates(spark: SparkSession, d: str) -> DataFrame:
    """J16, O-L3: all spikes of a unit are below the limit here, so the mean has an exact oracle."""
    e = v.read(spark, d, "events").filter("event_type = 'view'")
    s = e.select((F.col("user_id") % 4).alias("session"), F.col("user_id").alias("unit_id"), F.col("event_id").alias("spike_id"), (F.col("event_id") * 7 % 5000).alias("sample_idx"))
    x = long(spark, d).select((F.col("vec_id") % 4).alias("session"), (F.col("vec_id") % 3).alias("channel"), (F.expr("vec_id div 12") * 64 + F.col("i")).alias("sample_idx"), F.col("x").alias("value"))
    x = x.groupBy("session", "channel", "sample_idx").agg(F.avg("value").alias("value"))
    return sg.templates(s, x, 4, 8, 10_000_000)


@query()
def envelope_means(spark: SparkSession, d: str) -> DataFrame:
    """Filtered band envelopes; golden sines in the tests."""
    rows = waves(spark, d).select("vec_id", F.lit(0).alias("chunk_id"), F.col("w").alias("samples"))
    out = sg.band_envelopes(rows, ["vec_id"], FS, [("low", 4.0, 8.0), ("high", 12.0, 24.0)])
    return out.select("band", F.posexplode("samples").alias("i", "x")).groupBy("band", "i").agg(F.avg("x").alias("mean"))


@query()
def morlet_map(spark: SparkSession, d: str) -> DataFrame:
    """Mean power by label, frequency and time."""
    power = sg.morlet_power(waves(spark, d), ["vec_id", "label"], "w", FS, [6.0, 10.0, 16.0, 24.0], step=4)
    return power.groupBy("label", "freq_hz", "time_idx").agg(F.avg("power").alias("power"))


@query()
def time_clusters(spark: SparkSession, d: str) -> DataFrame:
    """T3, O-W11: cluster permutation over time for each label."""
    rows = long(spark, d).select("label", F.col("vec_id").alias("obs"), F.col("i").alias("time_idx"), "x")
    return stats.cluster_permutation(rows, ["label"], "x", n_perm=2000)


@query()
def map_clusters(spark: SparkSession, d: str) -> DataFrame:
    """T3 on a frequency x time lattice."""
    power = sg.morlet_power(waves(spark, d), ["vec_id", "label"], "w", FS, [6.0, 10.0, 16.0], step=8)
    return stats.cluster_permutation(deviations(spark, d), ["label"], "x", n_perm=2000, grid=True)


def deviations(spark: SparkSession, d: str) -> DataFrame:
    """(label, obs, freq_idx, time_idx, x): power of each epoch less the mean over all epochs."""
    power = sg.morlet_power(waves(spark, d), ["vec_id", "label"], "w", FS, [6.0, 10.0, 16.0], step=8)
    rows = power.join(power.groupBy("freq_hz", "time_idx").agg(F.avg("power").alias("m")), ["freq_hz", "time_idx"])
    idx = F.when(F.col("freq_hz") == 6, 0).when(F.col("freq_hz") == 10, 1).otherwise(2)
    return rows.select("label", F.col("vec_id").alias("obs"), idx.alias("freq_idx"), (F.col("time_idx") / 8).cast("int").alias("time_idx"), (F.col("power") - F.col("m")).alias("x"))


@query()
def map_mask(spark: SparkSession, d: str) -> DataFrame:
    """T3 as a mask: t, cluster, p and membership of each frequency and time."""
    return stats.cluster_mask(deviations(spark, d), ["label"], "x", n_perm=2000, grid=True)


@query("""WITH l AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
  c AS (SELECT label, i % 8 AS freq_idx, i // 8 AS time_idx, avg(x) AS mean, avg(x) ** 2 > 0.0004 AS mask FROM l GROUP BY ALL),
  b AS (SELECT * FROM (VALUES ('low', 0), ('low', 1), ('low', 2), ('mid', 2), ('mid', 3), ('high', 4), ('high', 5), ('high', 6), ('high', 7)) AS t(band, freq_idx)),
  g AS (SELECT label, band, time_idx, avg(mean) AS m, median(mean) AS md, bool_or(mask) AS one, bool_and(mask) AS every FROM c JOIN b USING (freq_idx) GROUP BY ALL)
SELECT label, band, time_idx, 'any' AS mode, m AS effect, one AS sig, one AND m > 0 AS sig_pos, one AND m < 0 AS sig_neg FROM g
UNION ALL SELECT label, band, time_idx, 'all', md, every, every AND md > 0, every AND md < 0 FROM g""")
def band_masks(spark: SparkSession, d: str) -> DataFrame:
    """A16 on masks: any and all of a band's frequencies, split by the sign of the band's mean or median."""
    cells = long(spark, d).groupBy("label", (F.col("i") % 8).alias("freq_idx"), F.expr("i div 8").alias("time_idx")).agg(F.avg("x").alias("mean"))
    cells = cells.withColumn("mask", F.col("mean") * F.col("mean") > 0.0004)
    bands = spark.createDataFrame([("low", 0), ("low", 1), ("low", 2), ("mid", 2), ("mid", 3), ("high", 4), ("high", 5), ("high", 6), ("high", 7)], "band string, freq_idx int")
    made = [stats.band_mask(cells, bands, ["label"], mode, effect).withColumn("mode", F.lit(mode)) for mode, effect in (("any", "mean"), ("all", "median"))]
    return made[0].unionByName(made[1])


def recordings(spark: SparkSession, d: str) -> DataFrame:
    """Five channels in chunks of 64 samples, every third one stored in two parts of 20 and 44."""
    rows = waves(spark, d).select((F.col("vec_id") % 5).alias("channel"), F.expr("vec_id div 5").alias("k"), "w")
    whole = F.array(F.struct(F.lit(0).alias("at"), F.lit(64).alias("n")))
    halves = F.array(F.struct(F.lit(0).alias("at"), F.lit(20).alias("n")), F.struct(F.lit(20).alias("at"), F.lit(44).alias("n")))
    rows = rows.withColumn("p", F.explode(F.when(F.col("k") % 3 == 0, halves).otherwise(whole)))
    return rows.select("channel", (2 * F.col("k") + (F.col("p.at") > 0).cast("int")).alias("chunk_id"), (64 * F.col("k") + F.col("p.at")).alias("start_sample"), F.slice("w", F.col("p.at") + 1, F.col("p.n")).alias("samples"))


SAMPLES = "x AS (SELECT vec_id % 5 AS channel, (vec_id // 5) * 64 + generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query(f"""WITH {SAMPLES},
  d AS (SELECT user_id % 5 AS channel, round_even(event_id * 37 % 20000 / 64.0 * 64.0, 0)::BIGINT AS s, round_even((event_id * 37 % 20000 / 64.0 + value / 640.0) * 64.0, 0)::BIGINT AS e FROM events WHERE event_type = 'error'),
  g AS (SELECT channel, i FROM x WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.channel = x.channel AND d.s <= x.i AND x.i < d.e))
SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY i) - 1 AS sample_idx, x AS value FROM x JOIN g USING (channel, i)""")
def compacted_signal(spark: SparkSession, d: str) -> DataFrame:
    """J15 on signals: recordings without their dead intervals, in new chunks of 50 samples."""
    rows = recordings(spark, d)
    e = v.read(spark, d, "events").filter("event_type = 'error'")
    s = F.col("event_id") * 37 % 20000 / 64.0
    dead = ck.dead_samples(e.select((F.col("user_id") % 5).alias("channel"), s.alias("s"), (s + F.col("value") / 640.0).alias("e")), ["channel"], FS)
    extent = rows.groupBy("channel").agg(F.max(F.col("start_sample") + F.size("samples")).alias("duration"))
    out = ck.compact_signal(rows, iv.good_chunks(dead, extent, ["channel"]), ["channel"], 50)
    return out.select("channel", "start_sample", F.posexplode("samples").alias("i", "value")).select("channel", (F.col("start_sample") + F.col("i")).alias("sample_idx"), "value")


@query(f"""WITH {SAMPLES}, f AS (SELECT o_orderkey % 5 AS channel, greatest(round_even(min(o_custkey * 3 + 200) / 64.0 * 64.0, 0)::BIGINT, 1) AS stop FROM orders GROUP BY ALL),
  r AS (SELECT channel, 'session' AS ref, avg(x) AS m, stddev_pop(x) AS sd FROM x GROUP BY channel
    UNION ALL SELECT channel, 'before first', avg(x), stddev_pop(x) FROM x JOIN f USING (channel) WHERE i < stop GROUP BY channel),
  e AS (SELECT channel, i // 64 AS k, avg(x) AS m, stddev_pop(x) AS sd FROM x WHERE i % 64 < 16 GROUP BY ALL),
  z AS (SELECT channel, i // 64 AS k, ref, 100 * x / (m + 1e-12) AS a, (x - m) / (sd + 1e-12) AS b FROM x JOIN r USING (channel)
    UNION ALL SELECT x.channel, k, 'epoch', 100 * x / (m + 1e-12), (x - m) / (sd + 1e-12) FROM x JOIN e ON e.channel = x.channel AND e.k = x.i // 64)
SELECT channel, k, ref, count(*) AS n, avg(a) AS mean_form, max(b) AS z_max, min(b) AS z_min FROM z GROUP BY ALL""")
def reference_forms(spark: SparkSession, d: str) -> DataFrame:
    """J12 and P23 over chunks: percent of the mean and z against the whole session, the time before the first stimulation, and an epoch's baseline."""
    rows = recordings(spark, d)
    trials = v.read(spark, d, "orders").select((F.col("o_orderkey") % 5).alias("channel"), ((F.col("o_custkey") * 3 + 200) / 64.0).alias("t0"))
    stops = rows.join(ck.first_stimulation(trials, ["channel"], FS), "channel")
    epochs = waves(spark, d).select((F.col("vec_id") % 5).alias("channel"), F.expr("vec_id div 5").alias("k"), F.lit(0).alias("start_sample"), F.col("w").alias("samples"))
    forms = ["mean", "zscore"]
    k = F.expr("start_sample div 64").alias("k")
    made = {
        "session": ck.normalise_chunks(rows, ["channel"], forms).select("channel", k, *forms),
        "before first": ck.normalise_chunks(stops, ["channel"], forms, F.col("stop_sample")).select("channel", k, *forms),
        "epoch": ck.normalise_chunks(epochs, ["channel", "k"], forms, F.lit(16)).select("channel", "k", *forms),
    }
    out = None
    for name, part in made.items():
        part = part.select("channel", "k", F.lit(name).alias("ref"), F.explode(F.arrays_zip(*forms)).alias("z"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("channel", "k", "ref").agg(F.count(F.lit(1)).alias("n"), F.avg("z.mean").alias("mean_form"), F.max("z.zscore").alias("z_max"), F.min("z.zscore").alias("z_min"))


@query()
def cell_types(spark: SparkSession, d: str) -> DataFrame:
    """T9, O-L2: mixture labels of waveform features."""
    rows = sg.waveform_features(waves(spark, d), "w", 20000.0).select("vec_id", F.col("trough_to_peak_ms").cast("double"), F.col("trough_half_width_ms").cast("double"))
    return ct.mixture_labels(rows, ["trough_to_peak_ms", "trough_half_width_ms"], "trough_to_peak_ms", ["vec_id"])


@query("""WITH p AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2))) AS d2 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT src, dst, d2, exp(-d2) AS weight FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY d2, dst) <= 5""")
def waveform_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Neighbour graph."""
    return ct.neighbour_graph(v.read(spark, d, "embeddings"), "vec_id", "embedding", 5)


@query()
def waveform_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the neighbour graph of normalised waveforms that are ok."""
    rows = sg.standardise(waves(spark, d), "w", 20000.0, 1.0).filter("ok")
    return ct.graph_communities(ct.neighbour_graph(rows, "vec_id", "w_norm", 15), 4)


@query()
def waveform_plane(spark: SparkSession, d: str) -> DataFrame:
    """T10's view: normalised waveforms that are ok in the plane of their first two components."""
    rows = sg.standardise(waves(spark, d), "w", 20000.0, 1.0).filter("ok")
    return ct.plane_view(rows, "vec_id", "w_norm")


@query(f"WITH {WELCH} SELECT label AS channel, freq_hz, avg(psd) AS mean, stddev_samp(psd) AS sd, count(*) AS n, stddev_samp(psd) / sqrt(count(*)) AS sem FROM (SELECT vec_id % 4 AS session, label, freq_hz, avg(psd) AS psd FROM p JOIN embeddings USING (vec_id) WHERE freq_hz BETWEEN 2 AND 24 GROUP BY ALL) GROUP BY label, freq_hz")
def psd_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """L2: power spectra of epochs and their grand average over sessions."""
    rows = waves(spark, d).select((F.col("vec_id") % 4).alias("session"), F.col("label").alias("channel"), F.col("vec_id").alias("trial_idx"), "w")
    return pl.psd(rows, ["session", "channel", "trial_idx"], "w", FS, N, 2, 24)[1]


@query()
def morlet_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """L3: baseline-normalised time-frequency power and its clusters by condition."""
    return pl.morlet(waves(spark, d), ["vec_id", "label"], "w", FS, [6.0, 10.0, 16.0], "label", 64, n_perm=200)[1]


@query()
def hilbert_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """L4: band envelopes cut to epochs and decimated, as means by band and time."""
    rows = waves(spark, d).select((F.col("vec_id") % 5).alias("channel"), F.expr("vec_id div 5").alias("chunk_id"), (F.expr("vec_id div 5") * 64).alias("start_sample"), F.col("w").alias("samples"))
    trials = v.read(spark, d, "orders").select(F.col("o_orderkey").alias("trial_idx"), (F.col("o_custkey") * 3).alias("first")).join(F.broadcast(spark.range(5).withColumnRenamed("id", "channel")))
    out = pl.hilbert(rows, ["channel"], FS, [("low", 4.0, 8.0), ("high", 12.0, 24.0)], trials, 16, 4)
    return out.groupBy("channel", "band", "time_idx").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


SR = """l AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS time_idx, unnest(embedding)::DOUBLE - 0.01 AS d FROM embeddings),
  r AS (SELECT label, time_idx, d, rank() OVER (PARTITION BY label, time_idx ORDER BY abs(d)) + (count(*) OVER (PARTITION BY label, time_idx, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY label, time_idx, abs(d)) AS t FROM l WHERE d <> 0),
  s AS (SELECT label, time_idx, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS rp, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS rm, sum(t::DOUBLE * t - 1) AS ties FROM r GROUP BY ALL),
  z AS (SELECT label, time_idx, n, least(rp, rm) AS stat, (least(rp, rm) - n * (n + 1) / 4.0) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS z FROM s)"""


@query(f"""WITH {SR}, p AS (SELECT label, time_idx, n, stat, {two_sided_sql('z')} AS p FROM z), m AS (SELECT *, p * count(*) OVER (PARTITION BY label) / row_number() OVER (PARTITION BY label ORDER BY p) AS raw FROM p)
SELECT *, q <= 0.05 AS reject FROM (SELECT label, time_idx, n, stat, p, least(1.0, min(raw) OVER (PARTITION BY label ORDER BY p DESC, raw ROWS UNBOUNDED PRECEDING)) AS q FROM m)""")
def envelope_tests(spark: SparkSession, d: str) -> DataFrame:
    """Signed-rank tests at each time against mu0, q within a condition."""
    rows = long(spark, d).select("label", F.col("i").alias("time_idx"), F.col("x").alias("value"))
    return pl.hilbert_tests(rows, ["label"], ["vec_id"], 0.01)


@query()
def cell_type_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Waveform features with mixture labels."""
    return pl.cell_types(waves(spark, d), "vec_id", "w", 20000.0).select("vec_id", "trough_to_peak_ms", "trough_half_width_ms", "cluster", "confidence", "cell_type")


@query("""WITH l AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
  m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM l GROUP BY ALL), t AS (SELECT label, max(abs(m)) AS amplitude, any_value(n) AS num_waveforms FROM m GROUP BY label),
  c AS (SELECT label, median(x) AS c FROM l GROUP BY label), n AS (SELECT l.label, median(abs(x - c)) * 1.4826 AS noise FROM l JOIN c ON c.label = l.label GROUP BY l.label)
SELECT label, num_waveforms, amplitude, noise, CASE WHEN noise > 0 THEN amplitude / noise END AS snr, amplitude / noise >= 0.05 AS good FROM t JOIN n USING (label)""")
def template_quality(spark: SparkSession, d: str) -> DataFrame:
    """Amplitude of the mean waveform, noise by the median absolute deviation, their ratio, and a mask on it."""
    rows = ct.template_quality(long(spark, d), ["label"])
    return rows.withColumn("good", F.col("snr") >= 0.05)
