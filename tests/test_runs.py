"""Runs by session, and wide zone files."""

import os

import pytest
from pyspark.sql import functions as F

from evoked.operators import reconcile as rc
from evoked.operators import runs
from evoked.sources import readers


def step(df):
    return runs.checked(df.select("s", "x", (F.col("x") * 2).alias("y")), {"x is negative": F.col("x") < 0, "x is missing": F.col("x").isNull()})


def written(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet")}


def test_runs_resume(spark, tmp_path):
    path = str(tmp_path / "out")
    names = spark.createDataFrame([("01",), ("2",), ("bad",), ("nothing",), (None,), ("2",)], "s string")
    rows = [("01", 1), ("01", 2), ("2", 3), ("bad", 4), ("bad", -1), ("bad", None), ("stranger", 9), (None, 5)]
    sources = spark.createDataFrame(rows, "s string, x int")

    def told(src, **options):
        return {r.s: (r.n_source, r.n_output, r.status, r.message) for r in runs.run_sessions(names, src, step, path, ["s"], **options).collect()}

    first = told(sources)
    assert first == {
        "01": (2, 2, "ok", None),
        "2": (1, 1, "ok", None),
        "bad": (3, 0, "error", "x is missing"),
        "nothing": (0, 0, "skipped_no_source", None),
        None: (1, 1, "ok", None),
    }
    files = written(path)
    mended = sources.filter("s <> 'bad' OR s IS NULL OR x = 4")
    again = told(mended)
    assert again["01"] == (2, 2, "reused_existing", None) and again[None] == (1, 1, "reused_existing", None)
    assert again["bad"] == (1, 1, "ok", None)
    assert files.items() <= written(path).items()
    out = readers.read_tensor(spark, path).collect()
    assert sorted((str(r.s), r.x, r.y) for r in out) == [("01", 1, 2), ("01", 2, 4), ("2", 3, 6), ("None", 5, 10), ("bad", 4, 8)]
    assert told(mended.filter("x < 3"), overwrite=True)["01"] == (2, 2, "ok", None)


def test_runs_of_nothing(spark, tmp_path):
    names = spark.createDataFrame([], "s string")
    sources = spark.createDataFrame([], "s string, x int")
    assert runs.run_sessions(names, sources, step, str(tmp_path / "none"), ["s"]).collect() == []


HEAD = "Patient,ZE_Electrode,ZE_contacts,ZI_Electrode,c2,ZP_Electrode,c3,ZL_Electrode,c4\n"


def zones(spark, tmp_path, line):
    (tmp_path / "zones.csv").write_text(HEAD + line + "\n")
    return readers.zone_table(spark, str(tmp_path / "zones.csv"))


def test_wide_zones(spark, tmp_path):
    rows = zones(spark, tmp_path, "p1,A; B'; A,Full; 1-3_10-12;2-3,TPp;Cp,4-5,-,,,")
    got = {(r.zone, r.electrode, r.ranges) for r in rows.collect()}
    assert got == {("ZE", "A_R", "Full"), ("ZE", "B_L", "1-3_10-12"), ("ZI", "TP_L", "4-5"), ("ZI", "C_L", "4-5"), ("ZP", None, "-"), ("ZL", None, None)}
    pairs = spark.createDataFrame([("p1", "A_R", 30, 31), ("p1", "B_L", 10, 11), ("p1", "B_L", 3, 4), ("p1", "C_L", 4, 5), ("p2", "A_R", 1, 2)], "patient string, electrode string, a int, b int")
    inside = {(r.patient, r.electrode, r.a, r.zone): r.inside for r in rc.zone_membership(pairs, rows).collect()}
    assert len(inside) == 25
    assert inside["p1", "A_R", 30, "ZE"] is True and inside["p1", "A_R", 30, "NI"] is False
    assert inside["p1", "B_L", 10, "ZE"] is True and inside["p1", "B_L", 3, "ZE"] is False
    assert inside["p1", "B_L", 3, "ZP"] is False and inside["p1", "B_L", 3, "ZL"] is None
    assert inside["p1", "B_L", 3, "NI"] is None  # in no zone that is known, but ZL isn't
    assert inside["p1", "C_L", 4, "ZI"] is True
    assert all(inside["p2", "A_R", 1, z] is None for z in ("ZE", "ZI", "ZP", "ZL", "NI"))


def test_none_of_known_zones(spark, tmp_path):
    rows = zones(spark, tmp_path, "p1,A,1-2,-,,-,,-,")
    pairs = spark.createDataFrame([("p1", "A_R", 5, 6)], "patient string, electrode string, a int, b int")
    assert {r.zone: r.inside for r in rc.zone_membership(pairs, rows).collect()} == {"ZE": False, "ZI": False, "ZP": False, "ZL": False, "NI": True}


@pytest.mark.parametrize("line", ["p1,A;B;C,1-2;3-4,-,,-,,-,", "p1,A,,-,,-,,-,", "p1,what?,1-2,-,,-,,-,"])
def test_zone_errors(spark, tmp_path, line):
    with pytest.raises(Exception, match="don't fit|no electrode"):
        zones(spark, tmp_path, line).collect()
