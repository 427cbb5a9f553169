"""Queries on labels, joins, sets and run ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoked.functions import labels as lb
from evoked.operators import celltypes as ct
from evoked.operators import reconcile as rc
from evoked.operators import binning as bn
from evoked.operators import order
from evoked.operators import runs
from evoked.operators import spiketrain as st
from evoked.operators import stats
from evoked.operators.binning import locality
from evoked.functions import frequency as fq
from evoked.functions.tails import two_sided_sql
from evoked.plans import event_queries as eq
from evoked.plans import views as v
from evoked.plans import pipelines as pl
from evoked.plans.registry import ORACLES, query
from evoked.plans.stat_queries import MW_Z, moments_sql, r_and_p
from evoked.sources import readers

STIM = "concat('Bp', p_size % 12 + 1, '-Bp', p_size % 12 + 2, '2.0mA', p_size, '.0Hz1025µsec')"


@query(f"""WITH s AS (SELECT p_partkey, {STIM} AS label FROM part)
SELECT p_partkey, label, regexp_extract(label, '^([A-Za-z]+)', 1) AS shaft, regexp_extract(label, '^[A-Za-z]+([0-9]+)', 1)::INT AS contact_a, regexp_extract(label, '-[A-Za-z]+([0-9]+?)...mA', 1)::INT AS contact_b,
  regexp_extract(label, '^[A-Za-z]+([0-9]+)', 1) || '-' || regexp_extract(label, '-[A-Za-z]+([0-9]+?)...mA', 1) AS pair, regexp_extract(label, '(...)mA', 1)::DOUBLE AS intensity_ma, regexp_extract(label, 'mA(.*)Hz', 1)::DOUBLE AS frequency_hz,
  lower(replace(replace(label, ' ', ''), ',', '.')) AS match_key FROM s""")
def stim_labels(spark: SparkSession, d: str) -> DataFrame:
    """P1, P2."""
    rows = v.read(spark, d, "part").select("p_partkey", F.expr(STIM).alias("label"))
    return rows.withColumns(lb.stim_label(F.col("label"))).withColumn("match_key", lb.match_key(F.col("label")))


CELL = "CASE user_id % 5 WHEN 0 THEN '[''negatif'']' WHEN 1 THEN '[''controle'']' WHEN 2 THEN '[''aphasie'', ''negatif'']' WHEN 3 THEN 'a; b' ELSE '' END"
SPARK_CELL = """CASE user_id % 5 WHEN 0 THEN "['negatif']" WHEN 1 THEN "['controle']" WHEN 2 THEN "['aphasie', 'negatif']" WHEN 3 THEN 'a; b' ELSE '' END"""


@query("""SELECT user_id % 5 AS kind, count(*) AS n, CASE user_id % 5 WHEN 0 THEN 'negatif' WHEN 1 THEN 'controle' WHEN 2 THEN 'cog+' WHEN 3 THEN 'cog+' ELSE 'unknown' END AS group_label,
  CASE user_id % 5 WHEN 2 THEN 'aphasie' WHEN 3 THEN 'a|b' ELSE '' END AS effects FROM events GROUP BY ALL""")
def condition_classes(spark: SparkSession, d: str) -> DataFrame:
    """P3, P4."""
    rows = v.read(spark, d, "events").select((F.col("user_id") % 5).alias("kind"), lb.list_cell(F.expr(SPARK_CELL)).alias("tags"))
    kind, effects = lb.condition_class(F.col("tags"))
    rows = rows.select("kind", kind.alias("group_label"), F.array_join(effects, "|").alias("effects"))
    return rows.groupBy("kind", "group_label", "effects").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s_suppkey, concat('TP', CASE WHEN s_suppkey % 2 = 0 THEN '''' ELSE '' END, s_suppkey % 12 + 1) AS channel, concat('TP', CASE WHEN s_suppkey % 2 = 0 THEN '''' ELSE '' END) AS shaft, (s_suppkey % 12 + 1)::INT AS contact,
  CASE WHEN s_suppkey % 3 = 0 THEN 'local' ELSE 'distant' END AS locality, CASE WHEN s_nationkey < 10 THEN 30000 WHEN s_nationkey <= 20 THEN 16384 ELSE 32768 END AS rate, CASE WHEN s_acctbal > 0 THEN log10(s_acctbal) END AS log_bal,
  concat('stimic', s_suppkey % 9) AS session, regexp_replace(s_name, '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM supplier""")
def channel_names(spark: SparkSession, d: str) -> DataFrame:
    """P6, P8, P9, P12, P14, F7."""
    s = v.read(spark, d, "supplier")
    quote = F.when(F.col("s_suppkey") % 2 == 0, "'").otherwise("")
    channel = lb.channel_name(F.concat(F.lit(" tp"), quote, (F.col("s_suppkey") % 12 + 1).cast("string"), F.lit(" ")))
    shaft, contact = lb.shaft_contact(channel)
    stim = F.when(F.col("s_suppkey") % 3 == 0, shaft).otherwise(F.lit("ZZ"))
    return s.select("s_suppkey", channel.alias("channel"), shaft.alias("shaft"), contact.alias("contact"), locality(shaft, stim).alias("locality"), lb.sampling_rate(F.col("s_nationkey") + 55).alias("rate"), lb.positive_log10(F.col("s_acctbal")).alias("log_bal"), lb.session_label(F.concat(F.lit("stim"), (F.col("s_suppkey") % 9).cast("string"))).alias("session"), lb.safe_name(F.col("s_name")).alias("safe"))


PAIRS = f"""{v.FX}, a AS (SELECT session, stim_index, concat('L', stim_index % 7) AS label, t0 + 5000000 + CASE WHEN (stim_index // 20) % 13 = 0 THEN 90000000 ELSE 0 END AS macro, t1 - t0 AS dur FROM fx_trials),
  b AS (SELECT session, stim_index, concat('L', stim_index % 7) AS label, t0 AS micro FROM fx_trials)"""


def clocks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = v.trials(spark, d).withColumn("label", F.concat(F.lit("L"), (F.col("stim_index") % 7).cast("string")))
    macro = F.col("t0") + 5_000_000 + F.when(F.expr("(stim_index div 20) % 13") == 0, 90_000_000).otherwise(0)
    return t.select("session", "stim_index", "label", macro.alias("macro"), (F.col("t1") - F.col("t0")).alias("dur")), t.select("session", "stim_index", "label", F.col("t0").alias("micro"))


@query(f"""WITH {PAIRS}, x AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY macro, stim_index) AS pos FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY micro, stim_index) AS pos FROM b)
SELECT session, pos, x.label AS label, y.label AS label_b, macro, micro, x.label = y.label AS matched FROM x JOIN y USING (session, pos)""")
def positional_trials(spark: SparkSession, d: str) -> DataFrame:
    """J1, O-W6: k-th with k-th; labels compared."""
    a, b = clocks(spark, d)
    out = rc.positional_join(a, b, ["session"], ["macro", "stim_index"], ["micro", "stim_index"], "label")
    return out.select("session", "pos", "label", "label_b", "macro", F.col("micro_b").alias("micro"), "matched")


@query(f"""WITH {PAIRS}, p AS (SELECT session, stim_index, macro, micro, concat(label, '_', row_number() OVER (PARTITION BY session, label ORDER BY stim_index)) AS label,
    row_number() OVER (PARTITION BY session ORDER BY macro) AS i, row_number() OVER (PARTITION BY session ORDER BY micro) AS j FROM a JOIN b USING (session, stim_index, label)),
  m AS (SELECT session, bool_and(i = j) AS same FROM p GROUP BY session)
SELECT session, label, macro, micro, CASE WHEN same THEN 'order' ELSE 'label' END AS strategy FROM p JOIN m USING (session)""")
def strategy_trials(spark: SparkSession, d: str) -> DataFrame:
    """Labels made unique, then order or label chosen by session."""
    a, b = clocks(spark, d)
    n = lambda t: rc.ordinal(t, ["session", "label"], ["stim_index"], "k").withColumn("label", F.concat_ws("_", "label", "k")).drop("k")
    out = rc.strategy_join(n(a).drop("stim_index"), n(b), ["session"], ["macro"], ["micro"], "label")
    return out.select("session", "label", "macro", F.col("micro_b").alias("micro"), "strategy")


@query(f"""WITH {PAIRS}, d AS (SELECT session, (macro - micro)::DOUBLE AS d FROM a JOIN b USING (session, stim_index)), m AS (SELECT session, median(d) AS m, count(*) AS n FROM d GROUP BY 1),
  r AS (SELECT session, d, n, abs(d - m) AS a FROM d JOIN m USING (session)), q AS (SELECT session, median(a) AS mad FROM r GROUP BY 1),
  u AS (SELECT r.* FROM r JOIN q USING (session) WHERE n < 5 OR a <= 6 * mad), f AS (SELECT session, median(d) AS "offset", count(*) AS n_used, any_value(n) AS n FROM u GROUP BY 1)
SELECT session, "offset", n_used, n, median(abs(d - "offset")) AS residual_median, max(abs(d - "offset")) AS residual_max FROM u JOIN f USING (session, n) GROUP BY ALL""")
def clock_offsets(spark: SparkSession, d: str) -> DataFrame:
    """A15."""
    a, b = clocks(spark, d)
    return rc.clock_offset(a.join(b.drop("label"), ["session", "stim_index"]), ["session"], "macro", "micro")


@query("""WITH p AS (SELECT ps, o_orderkey, o_custkey, o_totalprice FROM (SELECT o_custkey % 50 AS ps, * FROM orders)), d AS (SELECT c_custkey % 50 AS ps, c_acctbal, row_number() OVER (PARTITION BY c_custkey % 50 ORDER BY c_custkey DESC) AS r FROM customer)
SELECT o_orderkey, p.ps, c_acctbal FROM p LEFT JOIN (SELECT * FROM d WHERE r = 1) d USING (ps)""")
def keep_last_join(spark: SparkSession, d: str) -> DataFrame:
    """J4, O-L4: many to one, the last of a repeated key."""
    facts = v.read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("ps"))
    dim = v.read(spark, d, "customer").select((F.col("c_custkey") % 50).alias("ps"), "c_acctbal", "c_custkey")
    return rc.many_to_one(facts, dim, ["ps"], [F.col("c_custkey")]).select("o_orderkey", "ps", "c_acctbal")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), x AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 400000)
SELECT k, 'intersection' AS mode FROM ((SELECT k FROM a INTERSECT SELECT k FROM b) EXCEPT SELECT k FROM x) UNION ALL SELECT k, 'union' FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def session_sets(spark: SparkSession, d: str) -> DataFrame:
    """O-S1, O-S2, O-S3."""
    o = v.read(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    a, b = o.filter("o_orderstatus = 'F'").select("k"), o.filter("o_orderstatus = 'P'").select("k")
    x = o.filter("o_totalprice > 400000").select("k").distinct()
    return rc.select_sessions(a, b, exclude=x).withColumn("mode", F.lit("intersection")).unionByName(rc.select_sessions(a, b, "union").withColumn("mode", F.lit("union")))


@query("""WITH c AS (SELECT DISTINCT c_custkey AS k FROM customer), s AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), o AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT k, coalesce(s.n, 0) AS n_source, coalesce(o.n, 0) AS n_output, CASE WHEN e.message IS NOT NULL THEN 'error' WHEN o.n > 0 THEN 'reused_existing' WHEN s.n IS NULL THEN 'skipped_no_source' ELSE 'ok' END AS status, e.message AS message
FROM c LEFT JOIN s USING (k) LEFT JOIN o USING (k) LEFT JOIN (SELECT o_custkey AS k, min(concat('bad order ', o_orderkey)) AS message FROM orders WHERE o_totalprice > 490000 GROUP BY 1) e USING (k)""")
def run_ledger(spark: SparkSession, d: str) -> DataFrame:
    """S16, S17."""
    o = v.read(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    c = v.read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    bad = o.filter("o_totalprice > 490000").select("k", F.concat(F.lit("bad order "), F.col("o_orderkey").cast("string")).alias("message"))
    return rc.ledger(c, o.filter("o_orderstatus <> 'P'"), o.filter("o_orderstatus = 'P'"), ["k"], bad)


@query("""WITH p AS (SELECT p_partkey, concat('P', p_size % 4) AS patient, concat('E', p_size % 4) AS electrode, p_size % 12 AS a, p_size % 12 + 1 AS b FROM part),
  z(patient, zone, electrode, lo, hi) AS (VALUES ('P0','ZE','E0',0,1000000),('P0','ZE','E1',2,5),('P0','ZE','E1',9,10),('P1','ZI','E1',1,12),('P2','ZP','E2',3,4)), k AS (SELECT DISTINCT zone FROM z),
  i AS (SELECT p.patient AS patient, p.electrode AS electrode, a, b, k.zone AS zone, CASE WHEN bool_or(p.patient IN ('P0', 'P1', 'P2')) THEN bool_or(coalesce(a >= lo AND b <= hi, FALSE)) END AS inside FROM p CROSS JOIN k LEFT JOIN z ON z.patient = p.patient AND z.zone = k.zone AND z.electrode = p.electrode GROUP BY ALL)
SELECT * FROM i UNION ALL SELECT patient, electrode, a, b, 'NI', NOT bool_or(inside) FROM i GROUP BY ALL""")
def zones(spark: SparkSession, d: str) -> DataFrame:
    """Contact ranges as numbers, NULL for patients without zones, and NI for pairs in none."""
    p = v.read(spark, d, "part").select(F.concat(F.lit("P"), (F.col("p_size") % 4).cast("string")).alias("patient"), F.concat(F.lit("E"), (F.col("p_size") % 4).cast("string")).alias("electrode"), (F.col("p_size") % 12).alias("a"), (F.col("p_size") % 12 + 1).alias("b")).distinct()
    z = spark.createDataFrame([("P0", "ZE", "E0", "Full"), ("P0", "ZE", "E1", "2-5_9-10"), ("P1", "ZI", "E1", "1-12"), ("P2", "ZP", "E2", "3-4")], "patient string, zone string, electrode string, ranges string")
    return rc.zone_membership(p, z)


@query(f"""WITH {v.FX}, {eq.EXTENT}, i AS (SELECT *, t_tick - lag(t_tick) OVER (PARTITION BY session, unit_id ORDER BY t_tick) AS isi FROM fx_spikes),
  s AS (SELECT session, unit_id, count(*) AS num_spikes, count(DISTINCT t_tick // 60000000) AS present, avg((isi < 100000)::INT) AS isi_violations_ratio FROM i GROUP BY ALL)
SELECT session, unit_id, num_spikes, num_spikes * 1e6 / duration AS firing_rate, present / ((duration + 59999999) // 60000000) AS presence_ratio, isi_violations_ratio FROM s JOIN ext USING (session) WHERE num_spikes >= 20 AND present / ((duration + 59999999) // 60000000) >= 0.2 AND coalesce(isi_violations_ratio, 0) <= 0.5""")
def quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A26, F4."""
    return ct.good_units(ct.quality_metrics(v.spikes(spark, d), eq.extent(spark, d), ["session", "unit_id"], 60_000_000, 100_000), 20, 0.2, 0.5)


def cents(x: str) -> str:
    """SQL for the mean of x, which is in hundredths, from an exact sum."""
    return f"sum(floor({x} * 1e2 + 0.5)::BIGINT)::DOUBLE / (count(*) * 1e2)"


@query(f"""WITH f AS (SELECT l_orderkey % 200 AS trial, l_suppkey % 10 AS unit, l_linenumber AS bin, {cents('l_quantity')} AS fr_raw, {cents('l_tax')} AS fr_tax FROM lineitem WHERE l_linenumber > 2 GROUP BY ALL), l AS (SELECT l_orderkey % 200 AS trial, l_partkey % 5 AS channel, l_linenumber AS bin, {cents('l_extendedprice')} AS lfp_raw FROM lineitem WHERE l_linenumber > 2 GROUP BY ALL),
  j AS (SELECT 'fr_fr_raw__lfp_lfp_raw' AS variant, unit, channel, bin, fr_raw AS x, lfp_raw AS y FROM f JOIN l USING (trial, bin) UNION ALL SELECT 'fr_fr_tax__lfp_lfp_raw', unit, channel, bin, fr_tax, lfp_raw FROM f JOIN l USING (trial, bin)),
  s AS (SELECT variant, unit, channel, bin, count(*) AS n, CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) END AS r, {moments_sql('x', 9)}, {moments_sql('y', 9)} FROM j GROUP BY ALL HAVING count(*) >= 5),
  p AS (SELECT *, {r_and_p('r', 'n')} AS p FROM s), b AS (SELECT *, p * count(p) OVER (PARTITION BY variant) / row_number() OVER (PARTITION BY variant, p IS NULL ORDER BY p) AS raw FROM p)
SELECT variant, unit, channel, bin, n, round(r, 5) AS r, x_mean, x_sd, y_mean, y_sd, round(p, 5) AS p, CASE WHEN p IS NOT NULL THEN round(least(1.0, min(raw) OVER (PARTITION BY variant, p IS NULL ORDER BY p DESC, raw ROWS UNBOUNDED PRECEDING)), 4) END AS q FROM b""")
def rate_power(spark: SparkSession, d: str) -> DataFrame:
    """Bins of two tables by trial and bin, then correlations of each variant by unit, channel and bin, with q.

    Bins are means of hundredths by exact sums, and means and sds over them are in billionths, so no digit depends on the order of rows.
    """
    mean = lambda c: stats.exact_moments(c, 2)[0]
    li = v.read(spark, d, "lineitem").filter("l_linenumber > 2").withColumn("trial", F.col("l_orderkey") % 200).withColumnRenamed("l_linenumber", "bin")
    fr = li.groupBy("trial", (F.col("l_suppkey") % 10).alias("unit"), "bin").agg(mean("l_quantity").alias("fr_raw"), mean("l_tax").alias("fr_tax"))
    pw = li.groupBy("trial", (F.col("l_partkey") % 5).alias("channel"), "bin").agg(mean("l_extendedprice").alias("lfp_raw"))
    out = pl.rate_power(fr, pw, ["trial", "bin"], ["unit", "channel", "bin"], [("fr_raw", "lfp_raw"), ("fr_tax", "lfp_raw")], "pearson", digits=9).drop("reject")
    return out.withColumns({"r": F.round("r", 5), "p": F.round("p", 5), "q": F.round("q", 4)})


NAMES = ("va", "vtp1", "da1", "vhip2", "dtp3", "B_p", "TP_", "TPp", "TPp_", "ABC", "ABCp", "A'", "B", "xyz", "Ab", " dha12 ")
NAMES_SQL = "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in NAMES) + "]"


@query(f"""WITH n AS (SELECT p_partkey, {NAMES_SQL}[p_partkey % 16 + 1] AS name, {NAMES_SQL}[p_size % 16 + 1] AS stim, CASE WHEN p_size % 3 = 0 THEN ' F' ELSE 'T' END AS lobe, p_size FROM part),
  e AS (SELECT *, trim(name) AS t, trim(stim) AS u FROM n),
  m AS (SELECT *, list_transform([t, u], lambda z: CASE WHEN regexp_matches(z, '^[vd][a-z]+[0-9]*$') THEN upper(regexp_extract(z, '^[vd]([a-z]{{1,2}})', 1)) || CASE WHEN length(regexp_extract(z, '^[vd]([a-z]+)', 1)) > 3 THEN upper(regexp_extract(z, '^[vd][a-z]{{2}}([a-z]+)', 1)) ELSE '' END || CASE WHEN z[1] = 'v' THEN '_L' ELSE '_R' END
    WHEN regexp_matches(z, '^[A-Z]{{1,3}}(_p|p_|p|''|_)?$') THEN regexp_extract(z, '^([A-Z]{{1,2}})', 1) || CASE WHEN regexp_matches(z, '(p|p_|'')$') THEN '_L' ELSE '_R' END END) AS w FROM e)
SELECT p_partkey, name, w[1] AS electrode, w[1] = w[2] AS same_electrode, trim(lobe) = 'F' AS same_lobe, p_size % 4 IN (1, 2) AS local_after_discharge, left({STIM}, length({STIM}) - 8) AS label FROM m""")
def electrode_names(spark: SparkSession, d: str) -> DataFrame:
    """Normalised electrode names and topology flags."""
    p = v.read(spark, d, "part").withColumn("names", F.array(*map(F.lit, NAMES)))
    p = p.select("p_partkey", "p_size", F.get("names", (F.col("p_partkey") % 16).cast("int")).alias("name"), F.get("names", F.col("p_size") % 16).alias("stim"), F.when(F.col("p_size") % 3 == 0, " F").otherwise("T").alias("lobe"), F.expr(STIM).alias("full"))
    flags = lb.topology(F.col("name"), F.col("stim"), F.col("lobe"), F.lit("F "), F.col("p_size") % 4, F.array(F.lit(1), F.lit(2)))
    return p.select("p_partkey", "name", lb.electrode_name(F.col("name")).alias("electrode"), *(x.alias(c) for c, x in flags.items()), lb.short_label(F.col("full")).alias("label"))


BANDS = fq.flat_bands({"low": (0, 20), "high": (20, 50)}, 8)


@query(f"""WITH b(main, band, lo, hi) AS (VALUES {", ".join(f"('{m}', '{n}', {a}, {b})" for m, n, a, b in BANDS)}) SELECT main, band, count(*) AS n, avg(l_extendedprice) AS power, min(l_quantity) AS lowest FROM lineitem JOIN b ON l_quantity >= lo AND l_quantity < hi GROUP BY ALL""")
def frequency_bands(spark: SparkSession, d: str) -> DataFrame:
    """Sub-bands of the main bands, and the band of each frequency (here a quantity)."""
    li = v.read(spark, d, "lineitem").withColumn("band", fq.band_of(F.col("l_quantity"), [(n, a, b) for _, n, a, b in BANDS])).filter("band IS NOT NULL")
    return li.groupBy(F.split("band", "_")[0].alias("main"), "band").agg(F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("power"), F.min("l_quantity").alias("lowest"))


@query("""WITH s AS (SELECT l_suppkey % 50 AS session, l_returnflag AS band, array_agg(DISTINCT l_quantity ORDER BY l_quantity) AS axis FROM lineitem GROUP BY ALL)
SELECT band, count(*) AS n_sessions, count(DISTINCT axis) AS n_axes, count(DISTINCT axis) = 1 AS same FROM s GROUP BY band""")
def same_axes(spark: SparkSession, d: str) -> DataFrame:
    """Do all sessions have the same axis."""
    li = v.read(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("session"), F.col("l_returnflag").alias("band"), "l_quantity")
    return bn.same_axis(li, "session", ["band"], "l_quantity")


GROUPS = f"""b AS (SELECT o_orderpriority AS region, o_orderstatus AS tag, o_totalprice AS x FROM orders), o AS (SELECT * FROM b WHERE tag <> 'O'),
  a AS (SELECT *, 1 AS one FROM o UNION ALL SELECT q.region, q.tag, b.x, 0 FROM (SELECT DISTINCT region, tag FROM o) q JOIN b ON b.region = q.region AND b.tag = 'O'),
  r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY region, tag, x) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY region, tag, x) AS t FROM a WINDOW w AS (PARTITION BY region, tag ORDER BY x)),
  s AS (SELECT region, tag, sum(one) AS n1, sum(1 - one) AS n2, sum(r * one) - sum(one) * (sum(one) + 1) / 2.0 AS u, sum(t::DOUBLE * t - 1) AS ties FROM r GROUP BY ALL),
  p AS (SELECT region, tag, n1, n2, u, {two_sided_sql(MW_Z)} AS p FROM s WHERE n1 >= 3 AND n2 >= 3), m AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw FROM p)"""


@query(f"WITH {GROUPS} SELECT *, q <= 0.05 AS reject FROM (SELECT region, tag, n1, n2, u, p, least(1.0, min(raw) OVER (ORDER BY p DESC, raw ROWS UNBOUNDED PRECEDING)) AS q FROM m)")
def group_study(spark: SparkSession, d: str) -> DataFrame:
    """Each tag against the reference within regions, q over all tests."""
    o = v.read(spark, d, "orders").select(F.col("o_orderpriority").alias("region"), F.col("o_orderstatus").alias("tag"), F.col("o_totalprice").alias("x"))
    return pl.group_study(o, "region", "tag", "x", "O")[0]


@query(f"""WITH {v.FX}, live AS (SELECT * FROM fx_spikes p WHERE NOT EXISTS (SELECT 1 FROM fx_merged d WHERE d.session = p.session AND d.electrode = p.electrode AND p.t_tick >= d.s AND p.t_tick < d.e)),
  c AS (SELECT p.unit_id, t.stim_index, (p.t_tick - t.t0 + 10000000) // 50000 AS bin, count(*) AS n FROM fx_trials t JOIN live p ON p.session = t.session AND p.t_tick >= t.t0 - 10000000 AND p.t_tick < t.t0 GROUP BY ALL),
  m AS (SELECT unit_id, stim_index, sum(n) / 200.0 AS m, (sum(n * n) - sum(n) * sum(n) / 200.0) / 199 AS var FROM c GROUP BY ALL)
SELECT r.*, fr_baseline, CASE WHEN var > 0 THEN (fr_post - m / 0.05) / (sqrt(var) / 0.05) END AS z_pre, CASE WHEN fr_baseline > 0 THEN 100 * (fr_post - fr_baseline) / fr_baseline END AS delta_base_pct
FROM ({ORACLES["trial_response"]}) r LEFT JOIN m USING (unit_id, stim_index) LEFT JOIN (SELECT unit_id, fr_baseline FROM ({ORACLES["unit_rates"]})) USING (unit_id)""")
def trial_scores(spark: SparkSession, d: str) -> DataFrame:
    """P24 in full: the response table with z against the bins before and the change from the baseline rate."""
    spikes, trials, merged = v.spikes(spark, d), v.trials(spark, d), eq.merged(spark, d)
    rates = st.unit_rates(spikes, eq.extent(spark, d), trials, v.units(spark, d), merged)
    return st.trial_scores(spikes, trials, rates, merged)


@query(f"""SELECT r.*, i.* EXCLUDE (session, unit_id), a.* EXCLUDE (session, unit_id, refractory_ratio), a.refractory_ratio AS acg_refractory_ratio FROM ({ORACLES["unit_rates"]}) r LEFT JOIN ({ORACLES["isi_features"]}) i USING (session, unit_id) LEFT JOIN ({ORACLES["autocorrelogram"]}) a USING (session, unit_id)""".replace("1e6 / (", "1e6 / ("))
def unit_summary(spark: SparkSession, d: str) -> DataFrame:
    """L1: one row a unit with rates, intervals and autocorrelogram."""
    return pl.unit_summary(v.spikes(spark, d), v.trials(spark, d), v.units(spark, d), v.dead(spark, d), eq.extent(spark, d), eq.BIN, eq.BINS, eq.BIN)[0]


@query("""WITH o AS (SELECT o_orderkey AS k, (o_orderkey * 37 % 1000) / 10.0::DOUBLE AS t, (o_orderkey % 1000) / 1000.0::DOUBLE AS p, (o_orderkey % 7)::DOUBLE AS pre, (o_custkey % 9)::DOUBLE AS post, o_custkey AS c FROM orders)
SELECT k, CASE WHEN t < 30 THEN t WHEN t <= 60 THEN 30 + (t - 30) * 5 / 30 ELSE t - 25 END AS warped, t AS unwarped,
  CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars, 'cog::t' || (c % 5) AS effect, CASE WHEN c % 2 = 0 THEN 'local' ELSE 'distant' END AS place,
  CASE WHEN pre > 0 AND post > 0 THEN CASE WHEN post >= pre THEN 100 * (post - pre) / pre ELSE -100 * (pre - post) / post END END AS change,
  'P' || (c % 90) AS patient, (c % 4)::INT AS session_no, 'Gyrus ' || (c % 6) AS region,
  CASE WHEN c % 90 > 75 THEN -1 ELSE 1 END * CASE WHEN k % 10 = 0 THEN -1 ELSE 1 END AS polarity, 'fr_raw__lfp_' || (c % 3) AS variant FROM o""")
def label_functions(spark: SparkSession, d: str) -> DataFrame:
    """P7, P9, P10, P11, P12, P15, P16, P22, P25."""
    o = v.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.expr("CAST((o_orderkey * 37 % 1000) AS DOUBLE) / 10").alias("t"),
        F.expr("CAST(o_orderkey % 1000 AS DOUBLE) / 1000").alias("p"),
        F.expr("CAST(o_orderkey % 7 AS DOUBLE)").alias("pre"),
        F.expr("CAST(o_custkey % 9 AS DOUBLE)").alias("post"),
        F.col("o_custkey").alias("c"),
    )
    text = lambda c: c.cast("string")
    t0, t1, span = F.lit(30.0), F.lit(60.0), F.lit(5.0)
    warped = lb.warp(F.col("t"), t0, t1, span)
    effect, place = lb.condition_key(F.concat(F.lit("cog::t"), text(F.col("c") % 5), F.when(F.col("c") % 2 == 0, "::local").otherwise("::distant")))
    patient, number = lb.session_parts(F.concat(F.lit("P"), text(F.col("c") % 90), F.lit("_stim"), text(F.col("c") % 4), F.lit("a")))
    return o.select(
        "k",
        warped.alias("warped"),
        lb.unwarp(warped, t0, t1, span).alias("unwarped"),
        lb.stars(F.col("p")).alias("stars"),
        effect.alias("effect"),
        place.alias("place"),
        lb.signed_change(F.col("pre"), F.col("post")).alias("change"),
        patient.alias("patient"),
        number.alias("session_no"),
        lb.without_laterality(F.concat(F.when(F.col("c") % 2 == 0, "L. ").otherwise("R "), F.lit("Gyrus "), text(F.col("c") % 6))).alias("region"),
        lb.polarity(lb.sampling_rate(F.col("c") % 90), F.col("k") % 10 == 0).alias("polarity"),
        lb.variant_name(F.lit("raw"), text(F.col("c") % 3)).alias("variant"),
    )


@query("""WITH p AS (SELECT p_partkey AS name, concat('E', p_size) AS a, concat('F', p_size % 9) AS b, concat('G', p_size % 5) AS c FROM part), k AS (SELECT concat('E', n_nationkey * 2) AS s FROM nation UNION SELECT concat('F', n_nationkey % 4) FROM nation UNION SELECT 'G1')
SELECT name, CASE WHEN a IN (SELECT s FROM k) THEN a WHEN b IN (SELECT s FROM k) THEN b WHEN c IN (SELECT s FROM k) THEN c END AS resolved FROM p""")
def resolved_names(spark: SparkSession, d: str) -> DataFrame:
    """P20: the first known spelling, by priority."""
    p = v.read(spark, d, "part").select(F.col("p_partkey").alias("name"), "p_size")
    n = v.read(spark, d, "nation")
    text = lambda c: c.cast("string")
    known = n.select(F.concat(F.lit("E"), text(F.col("n_nationkey") * 2)).alias("spelling")).union(n.select(F.concat(F.lit("F"), text(F.col("n_nationkey") % 4)))).union(spark.createDataFrame([("G1",)], "spelling string"))
    s = [F.concat(F.lit("E"), text(F.col("p_size"))), F.concat(F.lit("F"), text(F.col("p_size") % 9)), F.concat(F.lit("G"), text(F.col("p_size") % 5))]
    return rc.resolve_name(p, known, s).select("name", "resolved")


LETTER = "substring('ABCDEF', CAST({} AS INT) + 1, 1)"
KNOWN = [
    "concat('P', c_custkey % 20) AS patient",
    f"concat({LETTER.format('floor(c_custkey / 20) % 5')}, {LETTER.format('floor(c_custkey / 100) % 2')}, CASE WHEN c_custkey % 3 = 0 THEN {LETTER.format('c_custkey % 4')} ELSE '' END, CASE c_custkey % 6 WHEN 0 THEN 'p' WHEN 1 THEN chr(39) WHEN 2 THEN '_p' WHEN 3 THEN '' WHEN 4 THEN '_' ELSE 'p' END) AS spelling",
    "CASE WHEN c_custkey % 20 < 9 THEN 'hybride' WHEN c_custkey % 20 < 17 THEN 'hybride latérale' ELSE 'other' END AS model",
    "CASE WHEN c_custkey % 20 < 15 THEN 2 ELSE 3 END AS tetrodes",
    "CASE WHEN c_custkey % 20 < 9 THEN '1-2' WHEN c_custkey % 7 < 4 THEN '8-9' ELSE '5-6' END AS channel",
    *(f"CAST(c_custkey * {k} AS DOUBLE) AS {c}" for c, k in {"x": 2, "y": 3, "z": -1}.items()),
    "c_custkey AS place",
]
WANTED = [
    "concat('P', p_partkey % 20) AS patient",
    f"concat({LETTER.format('floor(p_partkey / 20) % 6')}, {LETTER.format('floor(p_partkey / 120) % 2')}, CASE WHEN p_partkey % 3 = 0 THEN '_L' ELSE '_R' END) AS name",
]


@query(f"""WITH k AS (SELECT {', '.join(KNOWN)} FROM customer), w AS (SELECT DISTINCT {', '.join(WANTED)} FROM part), b AS (SELECT *, left(name, length(name) - 2) AS core, right(name, 1) = 'L' AS l FROM w),
  u AS (SELECT patient, spelling, min(place) AS place, CASE WHEN min(model) <> max(model) THEN NULL WHEN min(model) = 'hybride' THEN '1-2' WHEN min(model) = 'hybride latérale' AND min(tetrodes) = 2 AND max(tetrodes) = 2 THEN '8-9' WHEN min(model) = 'hybride latérale' AND min(tetrodes) = 3 AND max(tetrodes) = 3 THEN '5-6' END AS contacts FROM k GROUP BY ALL),
  m AS (SELECT b.patient, name, u.spelling, contacts FROM b JOIN u ON b.patient = u.patient AND regexp_full_match(u.spelling, concat(core, '[A-Z]?', CASE WHEN l THEN '(p|_p|[^A-Za-z_])' ELSE '_?' END))
    QUALIFY row_number() OVER (PARTITION BY b.patient, name ORDER BY CASE u.spelling[length(core) + 1:] WHEN 'p' THEN 0 WHEN chr(39) THEN 1 WHEN '_p' THEN 2 WHEN '' THEN 0 WHEN '_' THEN 1 ELSE 9 END, u.place) = 1),
  c AS (SELECT patient, spelling, channel, max(x) AS x, max(y) AS y, max(z) AS z FROM k GROUP BY ALL HAVING count(*) = 1)
SELECT w.patient, w.name, m.spelling AS macro, m.contacts, c.x, c.y, c.z FROM w LEFT JOIN m ON m.patient = w.patient AND m.name = w.name AND m.contacts IS NOT NULL LEFT JOIN c ON c.patient = m.patient AND c.spelling = m.spelling AND c.channel = m.contacts""")
def macro_electrodes(spark: SparkSession, d: str) -> DataFrame:
    """P20: exact spellings, one wildcard letter, contact pair, the only row of coordinates."""
    known = v.read(spark, d, "customer").selectExpr(*KNOWN)
    wanted = v.read(spark, d, "part").selectExpr(*WANTED).distinct()
    return rc.macro_electrodes(wanted, known)


#: A wide zone file's cells by nation: two lists, one range for all, an empty zone, an unknown one.
WIDE = {
    "ZE": ("CASE n_nationkey % 4 WHEN 0 THEN 'A; B_p' WHEN 1 THEN '-' WHEN 2 THEN 'TP' END", "CASE n_nationkey % 4 WHEN 0 THEN '1-3; 2-4_6-8' WHEN 2 THEN 'Full' END"),
    "ZI": ("CASE WHEN n_nationkey % 3 = 0 THEN 'TP;A' ELSE '-' END", "CASE WHEN n_nationkey % 3 = 0 THEN '2-7' END"),
    "ZP": ("CASE WHEN n_nationkey % 5 = 1 THEN '0' ELSE '-' END", "''"),
    "ZL": ("'-'", "''"),
}
WIDE_SQL = ", ".join(f"{e} AS {z}_Electrode, {r} AS {z}_contacts" for z, (e, r) in WIDE.items())
PLACES = "CASE p_size % 3 WHEN 0 THEN 'A_R' WHEN 1 THEN 'B_L' ELSE 'TP_R' END"


@query(f"""WITH w AS (SELECT n_name AS patient, {WIDE_SQL} FROM nation), l AS ({" UNION ALL ".join(f"SELECT patient, '{z}' AS zone, {z}_Electrode AS e, {z}_contacts AS r FROM w" for z in WIDE)}),
  u AS (SELECT *, generate_subscripts(string_split(e, ';'), 1) AS i FROM l WHERE e NOT IN ('-', '0')),
  n AS (SELECT patient, zone, CASE trim(string_split(e, ';')[i]) WHEN 'A' THEN 'A_R' WHEN 'B_p' THEN 'B_L' WHEN 'TP' THEN 'TP_R' END AS electrode, trim(CASE WHEN contains(r, ';') THEN string_split(r, ';')[i] ELSE r END) AS r FROM u),
  q AS (SELECT patient, zone, electrode, unnest(string_split(r, '_')) AS r FROM n),
  z AS (SELECT patient, zone, electrode, CASE WHEN r = 'Full' THEN 0 ELSE split_part(r, '-', 1)::INT END AS lo, CASE WHEN r = 'Full' THEN 1000000 ELSE split_part(r, '-', 2)::INT END AS hi FROM q),
  p AS (SELECT DISTINCT coalesce(n_name, 'nobody') AS patient, {PLACES} AS electrode, p_size % 8 AS a, p_size % 8 + 1 AS b FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 27),
  k AS (SELECT DISTINCT patient, zone, e FROM l),
  o AS (SELECT p.patient, p.electrode, p.a, p.b, s.zone, CASE WHEN any_value(k.e) IS NOT NULL AND any_value(k.e) <> '0' THEN bool_or(coalesce(p.a >= lo AND p.b <= hi, FALSE)) END AS inside
    FROM p CROSS JOIN (SELECT unnest(['ZE', 'ZI', 'ZP', 'ZL']) AS zone) s LEFT JOIN k ON k.patient = p.patient AND k.zone = s.zone LEFT JOIN z ON z.patient = p.patient AND z.zone = s.zone AND z.electrode = p.electrode GROUP BY ALL)
SELECT * FROM o UNION ALL SELECT patient, electrode, a, b, 'NI', CASE WHEN bool_or(inside) THEN FALSE WHEN count(*) = count(inside) THEN TRUE END FROM o GROUP BY ALL""")
def zone_scan(spark: SparkSession, d: str) -> DataFrame:
    """Wide zone cells to rows, and contact pairs against them: known, empty and unknown zones, and none of them."""
    n = v.read(spark, d, "nation")
    wide = n.selectExpr("n_name AS Patient", *(f"{c} AS {z}_{name}" for z, pair in WIDE.items() for c, name in zip(pair, ("Electrode", "contacts"), strict=True)))
    parts = v.read(spark, d, "part").join(n, F.col("n_nationkey") == F.col("p_partkey") % 27, "left")
    pairs = parts.selectExpr("coalesce(n_name, 'nobody') AS patient", f"{PLACES} AS electrode", "p_size % 8 AS a", "p_size % 8 + 1 AS b").distinct()
    return rc.zone_membership(pairs, readers.zone_rows(wide))


RULES = {"quantity at its limit": "s_nationkey % 5 = 0 AND l_quantity = 50", "tax at its limit": "s_nationkey % 7 = 3 AND l_tax = 0.08"}


@query(f"""WITH s AS (SELECT s_nationkey AS session, l_returnflag AS kind, {" ".join(["CASE", *(f"WHEN {c} THEN '{m}'" for m, c in RULES.items()), "END"])} AS e FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
  t AS (SELECT n_nationkey AS session, count(s.session) AS n_source, count(DISTINCT kind) AS kinds, min(e) AS message FROM nation LEFT JOIN s ON s.session = n_nationkey GROUP BY 1)
SELECT attempt, session, n_source, CASE WHEN message IS NULL THEN kinds ELSE 0 END AS n_output,
  CASE WHEN message IS NOT NULL THEN 'error' WHEN n_source = 0 THEN 'skipped_no_source' WHEN attempt = 2 THEN 'reused_existing' ELSE 'ok' END AS status, message FROM t, (SELECT unnest([1, 2]) AS attempt)""")
def session_runs(spark: SparkSession, d: str) -> DataFrame:
    """A run that writes good sessions and tells of bad ones, and the same run again, which reuses what was written."""
    rows = v.read(spark, d, "lineitem").join(v.read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("session", F.col("s_nationkey"))
    sessions = v.read(spark, d, "nation").select(F.col("n_nationkey").alias("session"))

    def totals(df: DataFrame) -> DataFrame:
        seen = runs.checked(df, {m: F.expr(c) for m, c in RULES.items()})
        return seen.groupBy("session", F.col("l_returnflag").alias("kind")).agg(F.sum("l_quantity").alias("quantity"), F.min(runs.ERROR).alias(runs.ERROR))

    path = f"{order.shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    told = [runs.run_sessions(sessions, rows, totals, path, ["session"]).withColumn("attempt", F.lit(i)) for i in (1, 2)]
    return told[0].unionByName(told[1])
