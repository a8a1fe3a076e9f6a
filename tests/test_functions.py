"""Scalar functions, masks and name handling on hand-computed rows."""

import datetime as dt
import math

from pyspark.sql import functions as F

from rimeweave.functions import clock, masks, names as N, numeric, thermo
from rimeweave.operators import filters


def values(spark, expression, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def es(t):
    k = t + 273.15
    return math.exp(9.550426 - 5723.265 / k + 3.53068 * math.log(k) - 0.007283 * k)


def test_numbers_from_text(spark):
    texts = ["1.5", " 2 ", "-9999", "1e3", ".5", "5.", "NaN", "inf", "-inf", "12d", "12f", "bad", "", None, "1e999", "+7"]
    got = values(spark, numeric.to_number(F.col("t")), [(t,) for t in texts], "t string")
    assert got == [1.5, 2.0, -9999.0, 1000.0, 0.5, 5.0, None, None, None, None, None, None, None, None, None, 7.0]


def test_numbers_of_an_array_trim_once(spark):
    texts = ["1.5", " 2 ", "-9999", "1e3", ".5", "5.", "NaN", "inf", "-inf", "12d", "12f", "bad", "", None, "1e999", "+7"]
    df = spark.createDataFrame([(texts,)], "t array<string>").select(numeric.to_numbers(F.col("t")).alias("n"))
    assert df.first()["n"] == [1.5, 2.0, -9999.0, 1000.0, 0.5, 5.0, None, None, None, None, None, None, None, None, None, 7.0]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("trim(") == 1


def test_supersaturation(spark):
    c = F.col
    rows = [(-30.0, -28.0), (-300.0, -28.0), (None, 1.0)]
    got = values(spark, thermo.si_from_frost_point(c("f"), c("t")), rows, "f double, t double")
    assert abs(got[0] - (es(-30) / es(-28) - 1)) < 1e-12
    assert got[1:] == [None, None]          # below absolute zero, missing

    rows = [(100.0, 220.0, 150.0), (0.0, 220.0, 150.0), (100.0, 149.9, 150.0), (100.0, 350.0, 150.0), (100.0, 220.0, 0.0)]
    schema = "q double, t double, p double"
    got = values(spark, thermo.si_from_ppmv(c("q"), c("t"), c("p")), rows, schema)
    want = 100 / 1e6 * 150 / (6.112 * math.exp(22.46 * (220 - 273.15) / (220 - 0.55))) - 1
    assert abs(got[0] - want) < 1e-12
    assert got[1] is None and got[2] is None and got[3] is not None and got[4] is None
    free = values(spark, thermo.si_from_ppmv(c("q"), c("t"), c("p"), bound_temperature=False), rows, schema)
    assert free[2] is not None


def test_clock(spark):
    day = dt.date(2008, 12, 31)
    rows = [(day, 0.25), (day, 86400.0 + 61), (day, None), (day, 9.999e30), (None, 5.0), (day, -1.0)]
    got = values(spark, clock.seconds_after(F.col("d"), F.col("s")), rows, "d date, s double")
    assert got[0] == dt.datetime(2008, 12, 31, 0, 0, 0, 250000)
    assert got[1] == dt.datetime(2009, 1, 1, 0, 1, 1)
    assert got[2:5] == [None, None, None]
    assert got[5] == dt.datetime(2008, 12, 30, 23, 59, 59)
    got = values(spark, clock.yymmdd_to_date(F.col("p")), [(309.0,), (1301.0,), (991231.0,), (None,)], "p double")
    assert got == [dt.date(2000, 3, 9), None, dt.date(2099, 12, 31), None]
    rows = [(day, 1.9, None, 59.99), (day, None, None, None)]
    got = values(spark, clock.hms_after(*[F.col(x) for x in "dhms"]), rows, "d date, h double, m double, s double")
    assert got == [dt.datetime(2008, 12, 31, 1, 0, 59), dt.datetime(2008, 12, 31)]


def test_masks(spark):
    v = F.col("v")
    rows = [(1.0,), (-9999.0,), (None,), (60.0,), (60.1,), (-95.0,)]
    assert values(spark, masks.drop_flags(v, [-9999, -8888]), rows, "v double") == [1.0, None, None, 60.0, 60.1, -95.0]
    assert values(spark, masks.keep_range(v, -95, 60), rows, "v double") == [1.0, None, None, 60.0, None, -95.0]
    assert values(spark, masks.clip(v, -1, 1), rows, "v double") == [1.0, -1.0, None, 1.0, 1.0, -1.0]
    assert values(spark, masks.keep_half_open(v, 0, 60), rows, "v double") == [1.0, None, None, 60.0, None, None]
    pairs = [(25.0, 5.0), (25.1, 5.0), (25.0, None), (None, 5.0)]
    assert values(spark, masks.drop_if_above(v, F.col("o"), 20), pairs, "v double, o double") == [25.0, None, 25.0, None]


def test_names(spark):
    rows = [("  Air-Temp (C) ",), ("__x//y__",), ("%RH",)]
    assert values(spark, N.clean_name(F.col("n")), rows, "n string") == ["Air_Temp_C", "x_y", "RH"]
    rows = [("UT (s) T (K) RH (%)",), ("UT(s)  A (b c) Z",)]
    assert values(spark, N.names_with_units(F.col("n")), rows, "n string") == [["UT_s", "T_K", "RH"], ["UT_s", "A", "b", "c", "Z"]]
    got = values(spark, N.unique_names(F.split("n", ",")), [("HH, MM,HH,,HH,",)], "n string")
    assert got == [["HH", "MM", "HH_1", "unnamed", "HH_2", "unnamed_1"]]


def test_three_tiers(spark):
    def pick(names, candidates):
        return values(spark, N.three_tier(F.col("n"), candidates), [(names,)], "n array<string>")[0]

    assert pick(["temp", "Temp"], ["Temp", "T"]) == "Temp"
    assert pick(["x", "Air-Temp"], ["Temp", "Air_Temp"]) == "Air-Temp"
    assert pick(["x", "My_Temp2"], ["Temp"]) == "My_Temp2"
    assert pick(["x", "y"], ["Temp"]) is None


def test_time_column(spark):
    def pick(names):
        column = N.time_column(F.col("n"), F.lit("Time_UTC"), ["Time_Start", "Time_Mid"])
        return values(spark, column, [(names,)], "n array<string>")[0]

    assert pick(["a", "Time_Mid", "Time_UTC"]) == "Time_UTC"
    assert pick(["a", "Time_Mid", "Time_Start"]) == "Time_Start"
    assert pick(["a", "my_utc"]) == "my_utc"
    assert pick(["a", "b"]) == "a"


def test_row_filters(spark):
    df = spark.createDataFrame([(1, 200.0), (2, 200.1), (3, None)], "i int, rh double")
    assert [r.i for r in filters.keep_humidity(df, "rh").collect()] == [1]
    rows = [(1, "0", "ok"), (2, "2", "ok"), (3, "1.9", "Suspect"), (4, None, None), (5, "x", "REJECTED"), (6, "-9999", "fine")]
    df = spark.createDataFrame(rows, "i int, qc_level string, status string")
    assert [r.i for r in filters.drop_flagged_rows(df).collect()] == [1, 4, 6]
    got = values(spark, filters.flag_is_bad(F.col("f"), [999999]), [("999999",), ("3",)], "f string")
    assert got == [False, True]
