"""Typed readers and sinks. Every reader has an explicit schema; rescue rules are expressions, not guesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evoked.functions.labels import channel_name, electrode_name, list_cell, number

EVENTS = "label_stim string, t_start double, duration double, lobe string"


def clean(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every double column."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


#: Names of the label column in a header.
LABEL_COLUMNS = ("label_stim", "label", "stim", "stimulation", "name")


def is_header(first: Column) -> Column:
    return F.lower(F.trim(first)).isin(*LABEL_COLUMNS)


def first_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(value, file, first, place): lines that aren't blank, whether a line is the first of its file, and what orders a file's lines.

    Lines are read in splits; that of offset 0 begins with the file's first line.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"))
    lines = lines.filter(F.trim("value") != "")
    first = lines.filter("__start = 0").groupBy("file").agg(F.min("__at").alias("__first"))
    return lines.join(first, "file").select("value", "file", (F.col("__at") == F.col("__first")).alias("first"), F.struct("__start", "__at").alias("place"))


def existing(spark: SparkSession, glob: str) -> list[str]:
    """Files that a glob names, by the Hadoop file system of the path; none is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [s.getPath().toString() for s in found or []]


def _fields(line: Column, sep: str) -> Column:
    return F.transform(F.split(line, sep), lambda x: F.trim(x))


def stim_events(spark: SparkSession, paths: str | list[str], sep: str = "\t") -> DataFrame:
    """label_stim, t_start, duration, lobe, t_end, part: 3 or 4 columns, with or without a header.

    A line without numbers is a header if it is the first of its file and its first field names the label column; any other
    such line is an error.
    """
    lines = first_lines(spark, paths).withColumnRenamed("file", "part")
    f = _fields(F.col("value"), sep)
    rows = lines.select(F.get(f, F.lit(0)).alias("label_stim"), number(F.get(f, F.lit(1))).alias("t_start"), number(F.get(f, F.lit(2))).alias("duration"), F.get(f, F.lit(3)).alias("lobe"), "part", "value", "first")
    header = F.col("first") & F.col("t_start").isNull() & is_header(F.col("label_stim"))
    bad = F.col("t_start").isNull() | F.col("duration").isNull()
    rows = rows.filter(~header).withColumn("t_start", F.when(bad, F.raise_error(F.concat(F.lit("no event: "), "value"))).otherwise(F.col("t_start")))
    return rows.select("label_stim", "t_start", "duration", "lobe", (F.col("t_start") + F.col("duration")).alias("t_end"), "part")


def event_parts(spark: SparkSession, paths: str | list[str], sep: str = "\t") -> DataFrame:
    """stim_events with part_index (files in name order) and event_index within the part."""
    rows = stim_events(spark, paths, sep)
    parts = rows.select("part").distinct().withColumn("part_index", F.row_number().over(W.orderBy("part")) - 1)
    event = F.row_number().over(W.partitionBy("part").orderBy("t_start", "label_stim")) - 1
    return rows.withColumn("event_index", event).join(F.broadcast(parts), "part")


def preferred(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of first, and those of second for keys that first lacks: a corrected file before the plain one."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def annotated_events(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """stim, t_start, duration, lobe, cog_labels from clean ; tab or , tables, or lines `label,t,dur,lobe;['tag']`.

    Decimal commas are accepted in ; and tab tables. A line that fits no form is an error.
    """
    lines = spark.read.text(paths).filter(F.trim("value") != "")
    value = F.col("value")
    mixed = value.rlike(r"^[^;\t]+,[^;\t]+,[^;\t]+,[^;\t]*;")
    sep = F.when(mixed, "mixed").when(value.contains(";"), ";").when(value.contains("\t"), "\t").otherwise(",")
    head, tail = F.split(value, ";", 2)[0], F.get(F.split(value, ";", 2), F.lit(1))
    f = F.when(mixed, F.concat(F.split(head, ","), F.array(tail))).when(value.contains(";"), F.split(value, ";")).when(value.contains("\t"), F.split(value, "\t")).otherwise(F.split(value, ",", 5))
    rows = lines.withColumns({"f": F.transform(f, lambda x: F.trim(x)), "sep": sep})
    rows = rows.select(F.get("f", F.lit(0)).alias("stim"), number(F.get("f", F.lit(1))).alias("t_start"), number(F.get("f", F.lit(2))).alias("duration"), F.get("f", F.lit(3)).alias("lobe"), list_cell(F.get("f", F.lit(4))).alias("cog_labels"), "value")
    rows = rows.filter(~(F.col("t_start").isNull() & F.lower("stim").isin("stim", "label", "label_stim")))
    bad = F.col("t_start").isNull() | F.col("duration").isNull()
    return rows.withColumn("t_start", F.when(bad, F.raise_error(F.concat(F.lit("no event: "), "value"))).otherwise(F.col("t_start"))).drop("value")


#: Columns of corrected events, in their order where no header names them.
CORRECTED = ("label_stim", "t_start", "duration", "t_end", "correction_start", "macro_part", "macro_part_index", "macro_event_index")


def corrected_events(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated corrected events with or without a header: t_end filled from t_start + duration, default part columns.

    A first line that has a field label_stim, or whose first field names the label column, is a header, and its names say which column is which;
    without one the columns are CORRECTED in order. Columns that a file lacks are NULL, macro_event_index is then the line's number in its file from
    0, macro_part 'session' and macro_part_index 0. A header without label, t_start or duration, and a row without either time,
    are errors.
    """
    lines = first_lines(spark, path).withColumn("f", _fields(F.col("value"), "\t"))
    names = F.transform("f", F.lower)
    head = F.col("first") & (F.array_contains(names, "label_stim") | is_header(F.get("f", F.lit(0))))
    named = F.transform(names, lambda c, i: F.when((i == 0) & ~F.array_contains(names, "label_stim"), F.lit("label_stim")).otherwise(c))
    missing = ~(F.array_contains(named, "t_start") & F.array_contains(named, "duration"))
    named = F.when(missing, F.raise_error(F.concat(F.lit("no columns t_start and duration: "), "value"))).otherwise(named)
    headers = lines.filter(head).select("file", named.alias("names"))
    rows = lines.filter(~head).join(headers, "file", "left").withColumn("names", F.coalesce("names", F.array(*map(F.lit, CORRECTED))))
    at = lambda c: F.array_position("names", c).cast("int")
    cell = lambda c: F.when(at(c) > 0, F.nullif(F.get("f", at(c) - 1), F.lit("")))
    line = F.row_number().over(W.partitionBy("file").orderBy("place")) - 1
    t0, length = number(cell("t_start")), number(cell("duration"))
    bad = t0.isNull() | length.isNull()
    return rows.select(
        cell("label_stim").alias("label_stim"),
        F.when(bad, F.raise_error(F.concat(F.lit("an event has no time: "), "value"))).otherwise(t0).alias("t_start"),
        length.alias("duration"),
        F.coalesce(number(cell("t_end")), t0 + length).alias("t_end"),
        number(cell("correction_start")).alias("correction_start"),
        F.coalesce(cell("macro_part"), F.lit("session")).alias("macro_part"),
        F.coalesce(cell("macro_part_index").try_cast("int"), F.lit(0)).alias("macro_part_index"),
        F.coalesce(cell("macro_event_index").try_cast("int"), line).alias("macro_event_index"),
    )


def dead_intervals(spark: SparkSession, glob: str, rate: float) -> DataFrame:
    """electrode (from the file name), s and e in seconds, from tab files of sample numbers; empty where no file is."""
    schema = "start_sample long, end_sample long"
    files = existing(spark, glob)
    if not files:
        return spark.createDataFrame([], "electrode string, s double, e double")
    rows = spark.read.csv(files, schema=schema, sep="\t")
    name = F.regexp_extract(F.col("_metadata.file_name"), r"([^/_]+)\.[^.]*$", 1)
    return rows.select(name.alias("electrode"), (F.col("start_sample") / rate).alias("s"), (F.col("end_sample") / rate).alias("e"))


def anatomy(spark: SparkSession, path: str) -> DataFrame:
    """tt, lobe, loca, clu and tetrode_index, the row's place in the file from 1; electrode is tt without its last character."""
    rows = spark.read.csv(path, schema="tt string, lobe string, loca string, clu int", header=True).withColumn("__at", F.monotonically_increasing_id())
    rows = rows.withColumn("tetrode_index", F.row_number().over(W.orderBy("__at"))).drop("__at")
    return rows.withColumn("electrode", F.expr("substring(tt, 1, length(tt) - 1)"))


def bad_channels(spark: SparkSession, path: str) -> DataFrame:
    """(session, channel), one row a name in the list cell."""
    rows = spark.read.csv(path, schema="session string, bad_channels string", header=True)
    return rows.select("session", F.explode(list_cell(F.col("bad_channels"))).alias("c")).select("session", channel_name(F.col("c")).alias("channel"))


def bad_for_sessions(bad: DataFrame, sessions: DataFrame) -> DataFrame:
    """Bad channels of (session, part): those listed for the part, or else for the whole session."""
    own = sessions.join(bad.withColumnRenamed("session", "part"), "part").select("session", "part", "channel")
    rest = sessions.join(own.select("part").distinct(), "part", "left_anti").join(bad, "session").select("session", "part", "channel")
    return own.unionByName(rest)


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    return clean(spark.read.csv(path, schema="Patient string, Electrode_name string, Electrode_model string, Number_of_tetrodes int, Channel_num string, X double, Y double, Z double", header=True))


#: The zones of a wide zone file, and cells that say that a zone is empty or that nothing is known.
ZONES = ("ZE", "ZI", "ZP", "ZL")
EMPTY_ZONE, UNKNOWN_ZONE = "-", "0"


def zone_rows(wide: DataFrame, zones: tuple[str, ...] = ZONES) -> DataFrame:
    """(patient, zone, electrode, ranges) from one row a patient: for a zone Z, column Z_Electrode and the column after it.

    The first is a list of electrodes separated by ;, the second a list of their contact ranges, by position, or one for all of them. Electrodes get their
    normalised names; the first of equal names counts. An empty cell, or 0, says that the zone is unknown: a row without ranges. A cell - says that the zone is empty:
    a row with ranges -. Lists of unequal length, electrodes without ranges and names that aren't electrodes are errors. Repeated patients: their first row by all columns counts.
    """
    at = {z: wide.columns.index(f"{z}_Electrode") for z in zones}
    cells = F.array(*(F.struct(F.lit(z).alias("zone"), *(F.trim(F.col(f"`{wide.columns[i + k]}`").cast("string")).alias(n) for k, n in enumerate(("names", "lists")))) for z, i in at.items()))
    first = wide.filter(F.col("Patient").isNotNull()).groupBy(F.trim("Patient").alias("patient")).agg(F.min(cells).alias("cells"))
    rows = first.select("patient", F.explode("cells").alias("c")).select("patient", "c.*")
    parts = lambda c: F.transform(F.split(c, ";"), lambda x: F.trim(x))
    unknown = F.coalesce(F.col("names").isin("", UNKNOWN_ZONE), F.lit(True))
    empty = F.col("names") == EMPTY_ZONE
    names, lists = parts("names"), parts(F.coalesce("lists", F.lit("")))
    lists = F.when(F.size(lists) == 1, F.array_repeat(lists[0], F.size(names))).otherwise(lists)
    bad = (F.size(names) != F.size(lists)) | F.exists(lists, lambda r: r == "")
    pairs = F.when(bad, F.raise_error(F.concat(F.lit("electrodes and ranges of a zone don't fit: "), "patient", F.lit(" "), "zone"))).otherwise(F.arrays_zip(names.alias("name"), lists.alias("ranges")))
    told = rows.filter(~unknown & ~empty).select("patient", "zone", F.posexplode(pairs).alias("i", "p"))
    named = F.coalesce(electrode_name(F.col("p")["name"]), F.raise_error(F.concat(F.lit("no electrode: "), F.col("p")["name"])))
    told = told.select("patient", "zone", "i", named.alias("electrode"), F.col("p")["ranges"].alias("ranges"))
    told = told.groupBy("patient", "zone", "electrode").agg(F.min_by("ranges", "i").alias("ranges"))
    rest = rows.filter(unknown | empty).select("patient", "zone", F.lit(None).cast("string").alias("electrode"), F.when(~unknown, F.lit(EMPTY_ZONE)).alias("ranges"))
    return told.unionByName(rest)


def zone_table(spark: SparkSession, path: str, sep: str = ",", zones: tuple[str, ...] = ZONES) -> DataFrame:
    """zone_rows of a file with a header; cells are text."""
    return zone_rows(spark.read.csv(path, header=True, sep=sep, inferSchema=False), zones)


def spikes(df: DataFrame) -> DataFrame:
    """Finite spike times only; sort on use."""
    return df.filter(F.col("spike_time").isNotNull() & ~F.isnan("spike_time") & (F.abs("spike_time") < float("inf")))


def write_tensor(df: DataFrame, path: str, by: list[str]) -> None:
    """Feature tensors as Parquet folders; only the partitions written are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def stored_or_computed(keys: list[str], stored: DataFrame, computed: DataFrame, value: str) -> DataFrame:
    """Stored value where there is one, else the computed one."""
    return computed.withColumnRenamed(value, "__c").join(stored.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, "__c")).drop("__c")


def read_tensor(spark: SparkSession, path: str, filters: dict[str, list] | None = None) -> DataFrame:
    """A feature tensor back from its folders; filters on partition columns prune folders."""
    rows = spark.read.parquet(path)
    for column, values in (filters or {}).items():
        rows = rows.filter(F.col(column).isin(values))
    return rows


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("overwrite").csv(path, header=True, compression="gzip" if gzip else "none")


def write_metadata(spark: SparkSession, metadata: dict, path: str) -> None:
    import json

    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("m")).select("m.*")


def read_all(spark: SparkSession, root: str, pattern: str, schema: str) -> DataFrame:
    """All CSV files under root that fit the pattern as one table, with global_clu = patient_session_clu."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(root, schema=schema, header=True)
    return rows.withColumn("global_clu", F.concat_ws("_", "patient", "session", F.col("clu").cast("string")))
