"""Guards, quantiles, alignment and quality operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rimeweave.functions import masks
from rimeweave.operators import align, guards, project, quality, summary


@pytest.mark.parametrize("seed", range(3))
def test_guards_follow_the_median(spark, seed):
    rng = np.random.default_rng(seed)
    rows, want = [], {}
    for group in range(40):
        values = rng.choice([149.0, 150.0, 151.0, 10.0, 300.0], size=rng.integers(0, 6)).tolist() + [None]
        known = [v for v in values if v is not None]
        kelvin = bool(known) and float(np.median(known)) > 150
        want[group] = sorted(str(None if v is None else v - 273.15 if kelvin else v) for v in values)
        rows += [(group, v) for v in values]
    df = spark.createDataFrame(rows, "g int, v double")
    got: dict = {}
    for r in guards.apply_guards(df, [guards.kelvin_guard("v")], ["g"]).collect():
        got.setdefault(r.g, []).append(str(r.v))
    assert {g: sorted(v) for g, v in got.items()} == want


def test_guard_bands(spark):
    pascal = [("a", 2000.0), ("b", 2001.0), ("c", 119999.0), ("d", 120000.0)]
    got = guards.apply_guards(spark.createDataFrame(pascal, "g string, v double"), [guards.pascal_guard("v")], ["g"])
    assert {r.g: r.v for r in got.collect()} == {"a": 2000.0, "b": 20.01, "c": 1199.99, "d": 120000.0}
    feet = [("a", 11999.0), ("b", 12000.0), ("c", 70000.0), ("d", 70001.0)]
    got = guards.apply_guards(spark.createDataFrame(feet, "g string, v double"), [guards.feet_guard("v")], ["g"])
    fixed = {r.g: round(r.v, 4) for r in got.collect()}
    assert fixed == {"a": 11999.0, "b": 3657.6, "c": 21336.0, "d": 70001.0}


def test_whole_frame_guard(spark):
    df = spark.createDataFrame([(-50.0,), (-60.0,), (None,)], "t double")
    got = guards.apply_guards(df, [guards.celsius_to_kelvin_guard("t")], [])
    assert [None if r.t is None else round(r.t, 2) for r in got.collect()] == [223.15, 213.15, None]
    already = guards.apply_guards(spark.createDataFrame([(210.0,), (220.0,)], "t double"), [guards.celsius_to_kelvin_guard("t")], [])
    assert [r.t for r in already.collect()] == [210.0, 220.0]


@pytest.mark.parametrize("accuracy", [40, 10_000])
def test_exact_quantiles(spark, accuracy):
    rng = np.random.default_rng(1)
    samples = {
        "smooth": rng.normal(size=4000).tolist(),
        "hot": [1.0] * 2000 + rng.integers(0, 5, 2000).astype(float).tolist(),
        "outlier": [1e12] + rng.random(999).tolist(),
        "single": [3.0],
    }
    rows = [(g, v) for g, vs in samples.items() for v in vs] + [("smooth", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    wanted = {"low": 0.0, "q1": 0.25, "median": 0.5, "p99": 0.99, "top": 1.0}
    got = {r.g: r for r in summary.exact_quantiles(df, "v", wanted, ["g"], accuracy).collect()}
    assert set(got) == {*samples, "empty"} and all(got["empty"][name] is None for name in wanted)
    for g, vs in samples.items():
        for name, p in wanted.items():
            assert got[g][name] == pytest.approx(np.percentile(vs, 100 * p), rel=1e-12, abs=1e-12), (g, name)
    whole = summary.exact_quantiles(df, "v", {"median": 0.5}, [], accuracy).first()
    assert whole.median == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_distribution_and_drift(spark):
    rng = np.random.default_rng(3)
    si = rng.normal(-0.13, 0.3, 500)
    df = spark.createDataFrame([(float(v),) for v in si] + [(None,)], "Si double")
    stats = summary.distribution_stats(df, "Si", by=())
    row = summary.distribution_drift(stats).first()
    assert row.q1 == pytest.approx(np.percentile(si, 25)) and row["std"] == pytest.approx(np.std(si))
    assert row.aligned
    shifted = summary.distribution_stats(df.select((F.col("Si") + 1).alias("Si")), "Si", by=())
    assert not summary.distribution_drift(shifted).first().aligned


def test_left_join_matches_missing_times(spark):
    left = spark.createDataFrame([("f", 1, 10), ("f", None, 20), ("g", 1, 30)], "pair string, t int, x int")
    right = spark.createDataFrame([("f", 1, 0.5), ("f", None, 0.7), ("f", 1, 0.6)], "pair string, t int, tair double")
    got = align.left_join_nullsafe(left, right, ["pair"], "t")
    assert sorted((r.x, r.tair) for r in got.collect() if r.tair) == [(10, 0.5), (10, 0.6), (20, 0.7)]
    assert got.filter("tair is null").count() == 1


def test_grid_rows(spark):
    axis = spark.createDataFrame([("a", i, i) for i in range(3)] + [("b", 0, 0), ("c", 0, 0)], "source_file string, idx int, t int")
    rows = [("a", "ATX", i, float(i)) for i in range(5)]                  # longer than the axis
    rows += [("a", "LAT", 0, 50.0), ("a", "LATC", 0, 1.0), ("a", "LATC", 1, 2.0), ("a", "LATC", 2, 3.0)]
    rows += [("b", "ATX", 0, 9.0), ("b", "LATC", 0, 4.0), ("c", "LAT", 0, 1.0)]
    values = spark.createDataFrame(rows, "source_file string, var string, idx int, val double")
    choices = {"atx": ("ATX",), "lat": ("LAT", "LATC")}
    got = {(r.source_file, r.idx): (r.atx, r.lat) for r in align.grid_rows(axis, values, choices, required=("atx",)).collect()}
    # LAT is present in file a, so its gaps are not filled from LATC; c lacks ATX
    assert got == {("a", 0): (0.0, 50.0), ("a", 1): (1.0, None), ("a", 2): (2.0, None), ("b", 0): (9.0, 4.0)}
    strict = align.grid_rows(axis, values, choices, required=("atx",), same_length=("lat",))
    assert {r.lat for r in strict.filter("source_file = 'a'").collect()} == {None}


STANDARD = "Timestamp timestamp, Tair_C double, Si double, Lat double, Lon double, Alt_m double, Campaign string, source_file string"


def test_quality_report(spark):
    import datetime as dt

    day = dt.datetime(2020, 1, 1)
    rows = [(day, -60.0, 0.1, 10.0, 20.0, 9000.0, "A", "f")] * 2 + [(None, 250.0, None, -9999.0, 190.0, -2000.0, "B", "g")]
    clean = quality.replace_fills(spark.createDataFrame(rows, STANDARD))
    b = clean.filter("Campaign = 'B'").first()
    assert b.Lat is None and b.Lon is None and b.Tair_C == 250.0
    report = {(r.check, r.campaign): (r.value, r.passed) for r in quality.quality_report(clean, ["A", "Z"]).collect()}
    assert report["duplicates", None] == (1.0, False)
    assert report["null_timestamp", "B"] == (1.0, False) and report["null_timestamp", "A"] == (0.0, True)
    assert report["tair_max", "B"] == (250.0, False) and report["alt_min", "B"] == (-2000.0, False)
    assert report["lat_min", "B"] == (None, True)
    assert report["present", "A"] == (2.0, True) and report["present", "Z"] == (0.0, False)


def test_missing_report_and_counters(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (-9999.0, 3.0)], "a double, b double")
    assert [tuple(r) for r in summary.missing_report(df).collect()] == [("b", 2, 66.67)]
    counters = summary.mask_counters(df, {"a_flag": (F.col("a"), masks.drop_flags(F.col("a"), [-9999]))})
    assert [tuple(r) for r in counters.collect()] == [("a_flag", 1)]


def test_generic_projection_and_sources(spark):
    df = spark.createDataFrame([(1.5, "x", None)], "T_C double, source_file string, source_file_b string")
    row = project.generic_projection(df, "NEW").first()
    assert (row.Tair_C, row.Campaign, row.source_file, row.Lat, row.Timestamp) == (1.5, "NEW", "x", None, None)
    joined = df.select(project.joined_sources(["source_file", "source_file_b"], "+").alias("s")).first()
    assert joined.s == "x+nan"


def test_only_complete_runs_are_read(spark, tmp_path):
    from rimeweave.sources.sinks import read_run, save_run

    rows = spark.range(100).selectExpr("if(id % 3 = 0, 'A', 'B') as Campaign", "timestamp_seconds(1000 - id) as Timestamp", "id")
    save_run(rows, str(tmp_path), rows_per_file=10)
    rows.write.parquet(f"{tmp_path}/runs/unfinished")
    assert sorted(r.id for r in read_run(spark, str(tmp_path)).collect()) == list(range(100))
    sizes = read_run(spark, str(tmp_path)).groupBy("_metadata.file_path").count().collect()
    assert max(r["count"] for r in sizes) <= 10
    save_run(rows.filter("id < 7"), str(tmp_path))
    assert read_run(spark, str(tmp_path)).count() == 7
