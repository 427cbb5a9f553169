"""Reconciling tables of trials: positional, label and strategy joins, clock offsets, ledgers, uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evoked.operators.order import met


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, or an error that names some repeated keys; looks at the data."""
    bad = duplicates(df, keys).limit(3).collect()
    if bad:
        raise ValueError(f"keys {keys} are repeated: {[tuple(r) for r in bad]}")
    return df


def ordinal(df: DataFrame, keys: list[str], order: list[str], out: str = "pos") -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def repeated_label_suffix(df: DataFrame, keys: list[str], label: str, order: list[str], out: str) -> DataFrame:
    """Label, with _1, _2, ... where it occurs more than once within keys."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys, label))
    k = F.row_number().over(W.partitionBy(*keys, label).orderBy(*order))
    return df.withColumn(out, F.when(n > 1, F.concat_ws("_", F.col(label), k.cast("string"))).otherwise(F.col(label)))


def positional_join(a: DataFrame, b: DataFrame, keys: list[str], order_a: list[str], order_b: list[str], label: str) -> DataFrame:
    """k-th row with k-th row within keys; columns of b get the suffix _b. `matched` says if the labels agree.

    A full outer join, so tables of different lengths show as NULL sides.
    """
    x = ordinal(a, keys, order_a)
    y = ordinal(b, keys, order_b)
    y = y.select(*keys, "pos", *(F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys))
    return x.join(y, [*keys, "pos"], "full").withColumn("matched", F.coalesce(F.col(label) == F.col(f"{label}_b"), F.lit(False)))


def label_join(a: DataFrame, b: DataFrame, keys: list[str], label: str) -> DataFrame:
    """One-to-one by label within keys; repeated labels must have been made unique."""
    y = b.select(*keys, label, *(F.col(c).alias(f"{c}_b") for c in b.columns if c not in [*keys, label]))
    return a.join(y, [*keys, label], "full")


def strategy_join(a: DataFrame, b: DataFrame, keys: list[str], order_a: list[str], order_b: list[str], label: str, max_mismatch: float = 0.1) -> DataFrame:
    """Per key: by order if all labels agree or the mismatch share is within the limit and labels don't identify rows, else by label.

    `strategy` says which. One aggregate a key picks the branch, and both branches are filtered by it.
    """
    by_order = positional_join(a, b, keys, order_a, order_b, label)
    share = by_order.groupBy(*keys).agg(F.avg((~F.col("matched")).cast("double")).alias("mismatch"))
    unique = a.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg((F.max("n") == 1).alias("by_label"))
    choice = share.join(unique, keys, "left").withColumn("strategy", F.when(F.col("mismatch") == 0, "order").when(F.coalesce("by_label", F.lit(False)), "label").when(F.col("mismatch") <= max_mismatch, "order").otherwise("none"))
    choice = choice.select(*keys, "strategy")
    first = by_order.drop("pos", "matched", f"{label}_b").join(choice.filter("strategy = 'order'"), keys)
    second = label_join(a, b, keys, label).join(choice.filter("strategy = 'label'"), keys)
    return first.unionByName(second.select(*first.columns))


def many_to_one(facts: DataFrame, dimension: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Left join of dimension columns, the last row of a repeated key kept; columns that facts have too are replaced."""
    w = W.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    last = dimension.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    replaced = [c for c in last.columns if c in facts.columns and c not in keys]
    return facts.drop(*replaced).join(last, keys, "left")


def clock_offset(pairs: DataFrame, keys: list[str], macro: str, micro: str, k: float = 6.0, min_n: int = 5) -> DataFrame:
    """Robust offset of two clocks by key: median difference, outliers beyond k MADs rejected (from min_n pairs on), refit.

    offset, n, n_used, residual_median, residual_mad, residual_max of the used pairs.
    """
    d = pairs.filter(F.col(macro).isNotNull() & F.col(micro).isNotNull()).withColumn("d", (F.col(macro) - F.col(micro)).cast("double"))
    m = d.groupBy(*keys).agg(F.median("d").alias("m"), F.count(F.lit(1)).alias("n"))
    r = d.join(m, keys).withColumn("a", F.abs(F.col("d") - F.col("m")))
    mad = r.groupBy(*keys).agg(F.median("a").alias("mad"))
    used = r.join(mad, keys).withColumn("used", (F.col("n") < min_n) | (F.col("a") <= k * F.col("mad")) | (F.col("mad") == 0) & (F.col("a") == 0))
    fit = used.filter("used").groupBy(*keys).agg(F.median("d").alias("offset"), F.count(F.lit(1)).alias("n_used"), F.first("n").alias("n"))
    res = used.filter("used").join(fit.select(*keys, "offset"), keys).withColumn("res", F.abs(F.col("d") - F.col("offset")))
    res = res.groupBy(*keys).agg(F.median("res").alias("residual_median"), F.max("res").alias("residual_max"))
    return fit.join(res, keys)


def select_sessions(a: DataFrame, b: DataFrame, mode: str = "intersection", include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Sessions of two one-column tables: intersection or union, kept by include, less exclude."""
    out = a.intersect(b) if mode == "intersection" else a.union(b).distinct()
    out = out if include is None else out.intersect(include)
    return out if exclude is None else out.exceptAll(exclude.distinct()).distinct()


def pending(candidates: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates without an output yet."""
    return candidates.join(done, keys, "left_anti")


def ledger(candidates: DataFrame, sources: DataFrame, outputs: DataFrame, keys: list[str], errors: DataFrame | None = None) -> DataFrame:
    """One row a candidate: status ok, reused_existing, skipped_no_source or error, and the rows seen.

    errors (keys, message) are those of the run; the least message of a key is kept, and message is NULL without one.
    """
    s = sources.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_source"))
    o = outputs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_output"))
    out = met(met(candidates.select(*keys).distinct(), s, keys, "left"), o, keys, "left").fillna(0, ["n_source", "n_output"])
    status = F.when(F.col("n_output") > 0, "reused_existing").when(F.col("n_source") == 0, "skipped_no_source")
    if errors is None:
        return out.withColumn("status", status.otherwise("ok"))
    out = met(out, errors.groupBy(*keys).agg(F.min("message").alias("message")), keys, "left")
    return out.withColumn("status", F.when(F.col("message").isNotNull(), "error").otherwise(status.otherwise("ok")))


def zone_membership(pairs: DataFrame, zones: DataFrame) -> DataFrame:
    """(patient, electrode, a, b, zone, inside): contact pairs against zone rows (patient, zone, electrode, ranges).

    ranges: Full, or a-b, or a-b_c-d, compared as numbers, or - where the zone is empty; a row without ranges says that the patient's zone is unknown. A pair
    is inside if both contacts lie in one range; it is unknown, NULL, in an unknown zone and for a patient without zones. Zone NI, not
    involved: inside none of the zones, unknown where no zone holds the pair and one of them is unknown.
    """
    parts = zones.withColumn("r", F.explode(F.split("ranges", "_")))
    full = F.lower(F.trim("r")) == "full"
    lo = F.when(full, 0).otherwise(F.regexp_extract("r", r"(\d+)-(\d+)", 1).try_cast("int"))
    hi = F.when(full, 10**6).otherwise(F.regexp_extract("r", r"(\d+)-(\d+)", 2).try_cast("int"))
    parts = parts.select("patient", "zone", "electrode", lo.alias("lo"), hi.alias("hi"))
    grid = pairs.join(F.broadcast(zones.select("zone").distinct()))
    hit = grid.join(parts, ["patient", "electrode", "zone"], "left")
    inside = F.coalesce((F.col("a") >= F.col("lo")) & (F.col("b") <= F.col("hi")), F.lit(False))
    known = zones.select("patient", F.lit(True).alias("known")).distinct()
    dark = zones.filter(F.col("ranges").isNull()).select("patient", "zone", F.lit(True).alias("dark")).distinct()
    out = hit.groupBy("patient", "electrode", "a", "b", "zone").agg(F.bool_or(inside).alias("inside")).join(known, "patient", "left").join(dark, ["patient", "zone"], "left")
    out = out.select("patient", "electrode", "a", "b", "zone", F.when(F.col("known") & F.col("dark").isNull(), F.col("inside")).alias("inside"))
    unsure = F.count_if(F.col("inside").isNull()) > 0
    none = out.groupBy("patient", "electrode", "a", "b").agg(F.when(F.bool_or("inside"), False).when(~unsure, True).alias("inside"))
    return out.unionByName(none.withColumn("zone", F.lit("NI")))


def resolve_name(wanted: DataFrame, known: DataFrame, spellings: list[Column]) -> DataFrame:
    """wanted (name) with the first of its spellings, in order, that known (spelling) has."""
    tries = wanted.select("*", F.posexplode(F.array(*spellings)).alias("priority", "spelling"))
    hits = tries.join(known.select("spelling").distinct(), "spelling")
    best = hits.groupBy("name").agg(F.min_by("spelling", "priority").alias("resolved"))
    return wanted.join(best, "name", "left")


#: Suffixes of macro names by side, in order of preference.
SUFFIXES = {"L": ["p", "'", "_p"], "R": ["", "_"]}


def macro_electrodes(wanted: DataFrame, contacts: DataFrame) -> DataFrame:
    """wanted (patient, name) with macro, contacts, x, y and z of the macro electrode behind a normalised name.

    contacts: patient, spelling, model, tetrodes, channel, x, y, z, place (order in the list). A spelling is the core and a suffix of
    the side; if there is none, one capital may stand between the two, and the first in the list is taken. The model and the number of
    tetrodes give the pair of contacts, without which all are NULL. Coordinates need exactly one row of the pair. Each spelling is
    keyed by the cores that it can stand for, so names meet by equality.
    """
    known = contacts.groupBy("patient", "spelling").agg(
        F.min("place").alias("place"),
        F.when((F.min("model") == F.max("model")) & (F.count("model") == F.count(F.lit(1))), F.min("model")).alias("model"),
        F.when((F.min("tetrodes") == F.max("tetrodes")) & (F.count("tetrodes") == F.count(F.lit(1))), F.min("tetrodes")).alias("tetrodes"),
    )
    pair = F.when(F.col("model") == "hybride", "1-2").when((F.col("model") == "hybride latérale") & (F.col("tetrodes") == 2), "8-9").when((F.col("model") == "hybride latérale") & (F.col("tetrodes") == 3), "5-6")
    suffix = F.regexp_extract("spelling", "(_p|p|'|_)?$", 1)
    known = known.withColumns({"pair": pair, "suffix": suffix}).withColumn("core", F.expr("substring(spelling, 1, length(spelling) - length(suffix))"))
    side = F.when(F.col("suffix").isin(SUFFIXES["L"]), "L").otherwise("R")
    rank = F.coalesce(*(F.when(F.col("suffix") == x, F.lit(i)) for of in SUFFIXES.values() for i, x in enumerate(of)))
    exact = F.struct(F.col("core").alias("core"), rank.alias("rank"))
    wild = F.struct(F.expr("substring(core, 1, length(core) - 1)").alias("core"), F.lit(9).alias("rank"))
    keys = F.when(F.col("core").rlike("[A-Z]$"), F.array(exact, wild)).otherwise(F.array(exact))
    known = known.select("patient", side.alias("side"), F.explode(keys).alias("k"), F.struct("spelling", "pair").alias("found"), "place").select("patient", "side", "k.*", "found", "place")
    names = wanted.select("patient", "name").distinct().withColumns({"core": F.expr("substring(name, 1, length(name) - 2)"), "side": F.when(F.col("name").endswith("L"), "L").otherwise("R")})
    best = names.join(known, ["patient", "side", "core"]).groupBy("patient", "name").agg(F.min_by("found", F.struct("rank", "place")).alias("found"))
    best = best.filter("found.pair IS NOT NULL").select("patient", "name", F.col("found.spelling").alias("macro"), F.col("found.pair").alias("contacts"))
    at = contacts.select("patient", F.col("spelling").alias("macro"), F.col("channel").alias("contacts"), "x", "y", "z")
    one = at.groupBy("patient", "macro", "contacts").agg(F.count(F.lit(1)).alias("n"), *(F.max(c).alias(c) for c in "xyz")).filter("n = 1").drop("n")
    return wanted.join(best.join(one, ["patient", "macro", "contacts"], "left"), ["patient", "name"], "left")
