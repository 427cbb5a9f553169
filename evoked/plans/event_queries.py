"""Queries on spikes, trials and dead time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoked.operators import binning as bn
from evoked.operators import intervals as iv
from evoked.operators import spiketrain as st
from evoked.plans import views as v
from evoked.plans.registry import query

ELECTRODE = ["session", "electrode"]
UNIT = ["session", "unit_id"]
EXTENT = "ext AS (SELECT session, max(t_tick) + 1 AS duration FROM fx_events GROUP BY session)"


def merged(spark: SparkSession, d: str) -> DataFrame:
    return iv.merge_intervals(v.dead(spark, d), ELECTRODE)


def extent(spark: SparkSession, d: str) -> DataFrame:
    return v.events(spark, d).groupBy("session").agg((F.max("t_tick") + 1).alias("duration"))


@query(f"""WITH {v.FX},
  live AS (SELECT * FROM fx_spikes p WHERE NOT EXISTS (SELECT 1 FROM fx_merged d WHERE d.session = p.session AND d.electrode = p.electrode AND p.t_tick >= d.s AND p.t_tick < d.e)),
  n AS (SELECT t.session, t.stim_index, p.unit_id, count_if(p.t_tick < t.t0) AS n_pre, count_if(p.t_tick >= t.t1) AS n_post
    FROM fx_trials t JOIN live p ON p.session = t.session AND ((p.t_tick >= t.t0 - 10000000 AND p.t_tick < t.t0) OR (p.t_tick >= t.t1 AND p.t_tick < t.t1 + 10000000)) GROUP BY ALL),
  l AS (SELECT t.session, t.stim_index, d.electrode, sum(greatest(0, least(d.e, t.t0) - greatest(d.s, t.t0 - 10000000))) AS pre, sum(greatest(0, least(d.e, t.t1 + 10000000) - greatest(d.s, t.t1))) AS post
    FROM fx_trials t JOIN fx_merged d USING (session) GROUP BY ALL),
  r AS (SELECT u.session, u.unit_id, u.electrode, t.stim_index, t.cond, coalesce(n_pre, 0) AS n_pre, coalesce(n_post, 0) AS n_post,
      10000000 - coalesce(pre, 0) AS live_pre, 10000000 - coalesce(post, 0) AS live_post
    FROM fx_units u JOIN fx_trials t USING (session) LEFT JOIN n USING (session, stim_index, unit_id) LEFT JOIN l USING (session, stim_index, electrode)),
  f AS (SELECT *, CASE WHEN live_pre > 0 THEN n_pre * 1e6 / live_pre END AS fr_pre, CASE WHEN live_post > 0 THEN n_post * 1e6 / live_post END AS fr_post FROM r)
SELECT *, CASE WHEN fr_pre > 0 THEN 100 * (fr_post - fr_pre) / fr_pre END AS delta_pct,
  CASE WHEN fr_pre >= 0 THEN ln((fr_post + 0.1) / (fr_pre + 0.1)) END AS log_ratio,
  CASE WHEN fr_post + fr_pre > 0 THEN (fr_post - fr_pre) / (fr_post + fr_pre) END AS modulation FROM f""")
def trial_response(spark: SparkSession, d: str) -> DataFrame:
    """O-W3, J6-J9, A2, P21, P24: unit x trial response table."""
    return st.trial_responses(v.spikes(spark, d), v.trials(spark, d), v.units(spark, d), v.dead(spark, d))


@query(f"WITH {v.FX} SELECT * FROM fx_merged")
def merged_dead_time(spark: SparkSession, d: str) -> DataFrame:
    """O-W3, O-W4, S5."""
    return merged(spark, d)


@query(f"""WITH {v.FX}, {EXTENT}, f AS (SELECT session, min(t0) AS first FROM fx_trials GROUP BY session),
  x AS (SELECT session, duration, coalesce(first, duration) AS first FROM ext LEFT JOIN f USING (session)),
  l AS (SELECT session, electrode, sum(greatest(0, least(e, duration) - greatest(s, 0))) AS da, sum(greatest(0, least(e, first) - greatest(s, 0))) AS db FROM fx_merged JOIN x USING (session) GROUP BY ALL),
  n AS (SELECT session, unit_id, count(*) AS n, count_if(t_tick <= first) AS nb FROM fx_spikes JOIN x USING (session) GROUP BY ALL)
SELECT session, unit_id, electrode, CASE WHEN duration > coalesce(da, 0) THEN coalesce(n, 0) * 1e6 / (duration - coalesce(da, 0)) END AS fr_global,
  CASE WHEN first > coalesce(db, 0) THEN coalesce(nb, 0) * 1e6 / (first - coalesce(db, 0)) END AS fr_baseline
FROM fx_units JOIN x USING (session) LEFT JOIN l USING (session, electrode) LEFT JOIN n USING (session, unit_id)""")
def unit_rates(spark: SparkSession, d: str) -> DataFrame:
    """A1, P28."""
    return st.unit_rates(v.spikes(spark, d), extent(spark, d), v.trials(spark, d), v.units(spark, d), merged(spark, d))


ISI = f"""{v.FX}, p AS (SELECT *, lag(t_tick) OVER (PARTITION BY session, unit_id ORDER BY t_tick, spike_id) AS prev FROM fx_spikes),
  i AS (SELECT *, t_tick - prev AS isi, EXISTS (SELECT 1 FROM fx_merged d WHERE d.session = p.session AND d.electrode = p.electrode AND d.s < p.t_tick AND d.e > p.prev) AS crosses FROM p WHERE prev IS NOT NULL)"""


@query(f"""WITH {ISI}, g AS (SELECT *, isi / 1000.0::DOUBLE AS ms, lag(isi / 1000.0::DOUBLE) OVER (PARTITION BY session, unit_id ORDER BY t_tick, spike_id) AS b FROM i WHERE isi > 0 AND NOT crosses),
  s AS (SELECT session, unit_id, count(*) AS n_isi_valid, avg(ms) AS isi_mean_ms, median(ms) AS isi_median_ms, stddev_samp(ms) AS isi_sd_ms, min(ms) AS isi_min_ms, max(ms) AS isi_max_ms,
    avg(2 * abs(ms - b) / (ms + b)) AS cv2, avg(3 * pow((ms - b) / (ms + b), 2)) AS lv, count_if(ms < 2) AS n_refractory, avg((ms < 2)::INT) AS refractory_ratio,
    avg((ms < 6)::INT) AS burst6, avg((ms < 10)::INT) AS burst10, CASE WHEN avg(ms) > 0 THEN stddev_samp(ms) / avg(ms) END AS cv FROM g GROUP BY ALL),
  t AS (SELECT session, unit_id, count(*) AS n_isi_total FROM i GROUP BY ALL)
SELECT session, unit_id, coalesce(n_isi_total, 0) AS n_isi_total, coalesce(n_isi_valid, 0) AS n_isi_valid, isi_mean_ms, isi_median_ms, isi_sd_ms, isi_min_ms, isi_max_ms, cv2, CASE WHEN n_isi_total + 1 >= 10 THEN cv2 END AS cv2_gated, CASE WHEN n_isi_total + 1 >= 10 THEN lv END AS lv, n_refractory, refractory_ratio, burst6, burst10, cv
FROM fx_units LEFT JOIN t USING (session, unit_id) LEFT JOIN s USING (session, unit_id)""")
def isi_features(spark: SparkSession, d: str) -> DataFrame:
    """A3, A5, O-W1, O-W2, J10."""
    return st.isi_features(v.spikes(spark, d), v.units(spark, d), merged(spark, d), UNIT, ELECTRODE)


BIN, BINS = 100_000, 100


@query(f"""WITH {v.FX}, l AS (SELECT a.session, a.unit_id, least((b.t_tick - a.t_tick) // {BIN}, {BINS - 1}) AS bin FROM fx_spikes a JOIN fx_spikes b ON a.session = b.session AND a.unit_id = b.unit_id
    AND b.t_tick > a.t_tick AND b.t_tick <= a.t_tick + {BIN * BINS}
    WHERE NOT EXISTS (SELECT 1 FROM fx_merged d WHERE d.session = a.session AND d.electrode = a.electrode AND d.s < b.t_tick AND d.e > a.t_tick)),
  c AS (SELECT session, unit_id, bin, count(*) AS n FROM l GROUP BY ALL),
  g AS (SELECT session, unit_id, bin, coalesce(n, 0) AS n FROM fx_units CROSS JOIN (SELECT unnest(range({BINS})) AS bin) LEFT JOIN c USING (session, unit_id, bin)),
  k AS (SELECT session, unit_id, count(*) AS ns FROM fx_spikes GROUP BY ALL),
  r AS (SELECT session, unit_id, bin, bin + 0.5 AS ms, n, n / ns / 0.1 AS hz FROM g JOIN k USING (session, unit_id)),
  a AS (SELECT session, unit_id, sum(n)::BIGINT AS n_lags, arg_min(ms, -n * 1000 + bin) FILTER (ms >= 2) AS pk, max(n) FILTER (ms >= 2) AS pn, max(hz) FILTER (ms >= 2) AS ph, avg(hz) FILTER (ms >= 3 AND ms < 10) AS m1, avg(hz) FILTER (ms >= 10 AND ms < 50) AS m2,
    sum(n) FILTER (ms < 2)::BIGINT AS rf, sum(n) FILTER (ms >= 3 AND ms < 10) AS b, sum(n) FILTER (ms >= 3 AND ms < 50) AS w FROM r GROUP BY ALL)
SELECT session, unit_id, n_lags, CASE WHEN n_lags > 0 THEN pk END AS peak_lag_ms, CASE WHEN n_lags > 0 THEN pn END AS peak_count, CASE WHEN n_lags > 0 THEN ph END AS peak_rate_hz, CASE WHEN n_lags > 0 THEN m1 END AS mean_3_10ms_rate_hz, CASE WHEN n_lags > 0 THEN m2 END AS mean_10_50ms_rate_hz,
  CASE WHEN n_lags > 0 THEN rf END AS refractory_count, CASE WHEN n_lags > 0 THEN rf / n_lags END AS refractory_ratio, CASE WHEN w > 0 THEN b / w END AS burst_ratio FROM a""")
def autocorrelogram(spark: SparkSession, d: str) -> DataFrame:
    """A4, J11, O-L2: windows in bins, as if a bin of 100 ms were one of 1 ms."""
    units = v.spikes(spark, d).select("session", "electrode", "unit_id").distinct()
    return st.acg_features(v.spikes(spark, d), units, merged(spark, d), UNIT, ELECTRODE, BIN, BINS, BIN)


@query(f"""WITH {v.FX}, {EXTENT}, b AS (SELECT session, unit_id, t_tick // 5000000 AS bin, count(*) AS n FROM fx_spikes GROUP BY ALL),
  g AS (SELECT session, unit_id, unnest(range((duration + 4999999) // 5000000)) AS bin FROM fx_units JOIN ext USING (session))
SELECT session, unit_id, var_pop(coalesce(n, 0)) / avg(coalesce(n, 0)) AS fano FROM g LEFT JOIN b USING (session, unit_id, bin) GROUP BY ALL""")
def fano_factor(spark: SparkSession, d: str) -> DataFrame:
    """A5: dense bins without a grid."""
    return st.fano_factor(v.spikes(spark, d), extent(spark, d), UNIT, 5_000_000)


HB, HN = 1_000_000, 10
HIST = f"""{v.FX}, c AS (SELECT t.session, p.unit_id, t.stim_index, CASE WHEN p.t_tick < t.t0 THEN (p.t_tick - t.t0 + {HB * HN}) // {HB} - {HN} ELSE (p.t_tick - t.t1) // {HB} END AS bin, count(*) AS n
    FROM fx_trials t JOIN fx_spikes p ON p.session = t.session AND ((p.t_tick >= t.t0 - {HB * HN} AND p.t_tick < t.t0) OR (p.t_tick >= t.t1 AND p.t_tick < t.t1 + {HB * HN})) GROUP BY ALL),
  h AS (SELECT session, unit_id, stim_index, bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT session, unit_id FROM fx_units) JOIN (SELECT session, stim_index FROM fx_trials) USING (session) CROSS JOIN (SELECT unnest(range({-HN}, {HN})) AS bin) LEFT JOIN c USING (session, unit_id, stim_index, bin))"""


def unit_histogram(spark: SparkSession, d: str) -> DataFrame:
    return st.unit_histogram(v.spikes(spark, d), v.trials(spark, d), v.units(spark, d), HB, HN, v.CELL)


@query(f"WITH {HIST} SELECT stim_index, bin, sum(n) AS n, count(*) AS units, count_if(n = 0) AS silent FROM h GROUP BY ALL")
def peri_event_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Counts by trial and bin, zero bins included."""
    return st.trial_histogram(v.spikes(spark, d), v.trials(spark, d), v.units(spark, d), HB, HN, v.CELL).drop("session")


@query(f"""WITH {HIST}, m AS (SELECT session, unit_id, bin, sum(n) AS n FROM h GROUP BY ALL), b AS (SELECT session, unit_id, avg(n) FILTER (bin < 0) AS mu, stddev_samp(n) FILTER (bin < 0) AS sd FROM m GROUP BY ALL),
  x AS (SELECT session, unit_id, min(bin) FILTER (bin >= 0 AND n > mu + 2 * sd) AS first_above, min(bin) FILTER (bin >= 0 AND n < mu - 2 * sd) AS first_below, count_if(bin >= 0 AND n > mu + 2 * sd) AS n_above, count_if(bin >= 0 AND n < mu - 2 * sd) AS n_below FROM m JOIN b USING (session, unit_id) GROUP BY ALL)
SELECT *, (n_above > 0 AND n_below = 0)::INT AS excit_only, (n_below > 0 AND n_above = 0)::INT AS inhib_only, coalesce(first_below < first_above, FALSE)::INT AS inhib_then_excit, coalesce(first_above < first_below, FALSE)::INT AS excit_then_inhib, (n_above > 0)::INT AS excit_general, (n_below > 0)::INT AS inhib_general FROM x""")
def response_classes(spark: SparkSession, d: str) -> DataFrame:
    """A7 on unit histograms summed over trials."""
    out = st.response_classes(unit_histogram(spark, d), UNIT)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("inhib_then_excit", "excit_then_inhib")})


@query(f"""WITH {v.FX} SELECT t.session, p.unit_id, t.stim_index, p.t_tick - t.t0 AS rel FROM fx_trials t JOIN fx_spikes p ON p.session = t.session AND p.t_tick >= t.t0 - 10000000 AND p.t_tick < t.t1 + 10000000""")
def raster_table(spark: SparkSession, d: str) -> DataFrame:
    """A25, J7."""
    return st.raster(v.spikes(spark, d), v.trials(spark, d), 10_000_000, 10_000_000, v.CELL)


@query(f"""WITH {v.FX}, {EXTENT}, c AS (SELECT session, electrode, greatest(s, 0) AS s, least(e, duration) AS e FROM fx_merged JOIN ext USING (session) WHERE least(e, duration) > greatest(s, 0))
SELECT p.session, p.unit_id, p.spike_id, p.t_tick, p.t_tick - coalesce((SELECT sum(c.e - c.s) FROM c WHERE c.session = p.session AND c.electrode = p.electrode AND c.e <= p.t_tick), 0) AS t_compact
FROM fx_spikes p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.session = p.session AND c.electrode = p.electrode AND p.t_tick >= c.s AND p.t_tick < c.e)""")
def gap_compaction(spark: SparkSession, d: str) -> DataFrame:
    """J15, O-W5, J8."""
    ext = v.units(spark, d).select(*ELECTRODE).distinct().join(extent(spark, d), "session")
    chunks = iv.good_chunks(merged(spark, d), ext, ELECTRODE)
    return iv.compact(v.spikes(spark, d), chunks, ELECTRODE, "t_tick", 60 * v.SECOND).select("session", "unit_id", "spike_id", "t_tick", "t_compact")


@query(f"""WITH {v.FX} SELECT t.session, t.stim_index, d.electrode, count(*) AS n_spans, sum(least(d.e, t.t1 + 10000000) - greatest(d.s, t.t0 - 10000000)) AS lost
FROM fx_trials t JOIN fx_merged d ON d.session = t.session AND d.s < t.t1 + 10000000 AND d.e > t.t0 - 10000000 GROUP BY ALL""")
def dead_overlap(spark: SparkSession, d: str) -> DataFrame:
    """J9, F8."""
    wins = v.trials(spark, d).select("session", "stim_index", (F.col("t0") - 10_000_000).alias("lo"), (F.col("t1") + 10_000_000).alias("hi"))
    both = iv.overlap(wins, merged(spark, d), ["session"], "lo", "hi", "s", "e", v.CELL)
    return both.groupBy("session", "stim_index", "electrode").agg(F.count(F.lit(1)).alias("n_spans"), F.sum("overlap").alias("lost"))


BINS_SQL = f"""bins AS (SELECT session, stim_index, bin, CASE WHEN bin < 0 THEN t0 + bin * {HB} ELSE t1 + bin * {HB} END AS lo FROM fx_trials, (SELECT unnest(range({-HN}, {HN})) AS bin)),
  dd AS (SELECT b.session, d.electrode, stim_index, bin, sum(least(d.e, lo + {HB}) - greatest(d.s, lo)) AS dead FROM bins b JOIN fx_merged d ON d.session = b.session AND d.s < lo + {HB} AND d.e > lo GROUP BY ALL)"""


@query(f"WITH {v.FX}, {BINS_SQL} SELECT session, electrode, stim_index, bin, dead, dead <= 0 AS strict_valid, {HB} - dead >= 0.8 * {HB} AS valid FROM dd")
def bin_validity(spark: SparkSession, d: str) -> DataFrame:
    """Bins that dead time touches, strict and by live share."""
    wins = st.windows_of(v.trials(spark, d), HB * HN).select("session", "stim_index", "win", F.col("lo").alias("from"), F.explode(F.sequence(F.lit(0), F.lit(HN - 1))).alias("k"))
    at = F.col("from") + F.col("k") * HB
    wins = wins.select("session", "stim_index", F.when(F.col("win") == "pre", F.col("k") - HN).otherwise(F.col("k")).alias("bin"), at.alias("lo"), (at + HB).alias("hi"))
    return bn.bin_validity(wins, merged(spark, d), ["session", "stim_index", "bin"], ELECTRODE, v.CELL)


@query(f"WITH {v.FX}, {EXTENT} SELECT t.session, t.stim_index, t.t0, t.t1 FROM fx_trials t JOIN ext USING (session) WHERE t0 - 10000000 >= 0 AND t1 + 10000000 <= duration AND session IN ('S0', 'S2')")
def fitting_trials(spark: SparkSession, d: str) -> DataFrame:
    """trials whose windows fit the recording, of an allow-list of sessions."""
    rows = bn.fitting(v.trials(spark, d), extent(spark, d), ["session"], F.col("t0") - 10_000_000, F.col("t1") + 10_000_000)
    return bn.allowed(rows, "session", ["S0", "S2"]).select("session", "stim_index", "t0", "t1")
