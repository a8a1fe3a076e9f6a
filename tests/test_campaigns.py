"""All campaigns from raw files to the combined table."""

import datetime as dt
import math
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rimeweave.operators import guards
from rimeweave.operators.project import STANDARD_COLUMNS
from rimeweave.plans import campaigns as pc, harmonise as harmonise_module
from rimeweave.plans.harmonise import campaign, harmonise, run
from rimeweave.sources.formats import ScannedHeader, TableFormat, comma_names
from rimeweave.sources.tables import open_files
from rimeweave.specs import CampaignSpec

from .raw_files import everything, put
from .test_functions import es


def tetens(t):
    return 6.112 * math.exp(22.46 * t / (272.62 + t))


def ppmv(q, t, p):
    return q / 1e6 * p / (6.112 * math.exp(22.46 * (t - 273.15) / (t - 0.55))) - 1


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    return {**everything(spark, root), "root": str(root)}


def rows(spark, folders, name, **options):
    df = campaign(spark, CampaignSpec(name, folders[name], options=options))
    assert df.columns[:8] == list(STANDARD_COLUMNS)
    out = df.collect()
    assert {r.Campaign for r in out} == {name}
    return sorted(out, key=lambda r: (str(r.source_file), str(r.Timestamp)))


def close(a, b):
    return a == pytest.approx(b, rel=1e-9, abs=1e-9)


def test_arm(spark, folders):
    a, b = rows(spark, folders, "ARM")
    assert a.Timestamp == dt.datetime(2000, 3, 9, 0, 0, 10, 500000) and a.source_file == "a.t4archive.gz"
    assert close([a.Tair_C, a.Si, a.Lat, a.Lon, a.Alt_m], [-40, es(-38) / es(-40) - 1, 36.5, -97.5, 9000])
    assert close(b.Si, es(-38) / es(-41) - 1)


def test_crystal_face_nasa(spark, folders):
    a, b = rows(spark, folders, "CRYSTAL-FACE-NASA")
    assert (a.Timestamp, a.Lat) == (dt.datetime(2002, 7, 9, 0, 1, 40), None)
    assert close([a.Tair_C, a.Si, b.Si], [-53, 0.1, -0.05])
    a, b = rows(spark, folders, "CRYSTAL-FACE-NASA", position_path=folders["root"] + "/positions")
    assert close([a.Lat, a.Lon, a.Alt_m], [25.0, -80.0, 9000.0])
    assert (b.Lat, b.Alt_m, b.source_file) == (None, None, "j1")


def test_crystal_face_und(spark, folders):
    a, b, c, d = rows(spark, folders, "CRYSTAL-FACE-UND")
    assert close([a.Tair_C, a.Si, a.Lat], [-55.5, 0.2, 25.0]) and a.source_file == "02MIS.CIT"
    assert (b.Tair_C, b.Si) == (None, None)
    assert (c.Tair_C, c.Lat) == (None, None) and close(c.Si, -0.2)
    assert (d.Tair_C, d.source_file) == (None, "03MIS.CIT") and close(d.Si, 0.0)


def test_mc3e(spark, folders):
    out = rows(spark, folders, "MC3E")
    assert len(out) == 3                                  # the over-long row is gone
    late = out[-1]
    assert late.Timestamp == dt.datetime(2011, 4, 26, 0, 0, 1, 500000)
    assert close([late.Tair_C, late.Si, late.Alt_m], [-40, es(-39) / es(-40) - 1, 9000])
    assert [r.Tair_C for r in out[:2]] == [None, None]


def test_midcix_and_olympex(spark, folders):
    a, b = rows(spark, folders, "MIDCIX")
    assert close([a.Tair_C, a.Si, a.Lat, a.Alt_m], [-50, -0.1, 30.5, 15000]) and b.Tair_C is None
    (o,) = rows(spark, folders, "OLYMPEX")
    assert close([o.Tair_C, o.Si, o.Lat, o.Alt_m], [-20, es(-21) / es(-20) - 1, 47, 5000])


def test_gridded(spark, folders):
    a, b = rows(spark, folders, "AIRS-II")                # rh 201 is dropped
    assert close([a.Tair_C, a.Si, a.Lat, a.Alt_m], [-30, 0.99, 45, 3000]) and a.Lon is None
    a, b, c = rows(spark, folders, "ICE-L")
    assert close([a.Tair_C, a.Si, a.Lat], [-30, 0.2, 41]) and a.Alt_m is None
    assert (b.Si, c.Si) == (None, None) and close(c.Tair_C, -28)


def test_attrex(spark, folders):
    a, b, c, d = rows(spark, folders, "ATTREX")
    assert close([a.Tair_C, a.Si, a.Lat, a.Alt_m], [195 - 273.15, ppmv(5, 195, 85), 10, 16000])
    assert a.source_file == "DLH-H2O_GH_1.ict+MMS-1HZ_GH_1.ict+NOAA-H2O_GH_1.ict"
    assert b.Si is None and b.Tair_C is not None          # 101 takes the sample at 100.9
    assert c.Tair_C is None and close(c.Lat, 11)          # 999.99 K is masked
    assert d.source_file.endswith("+nan+nan")
    merged = pc.attrex_merged(spark, CampaignSpec("ATTREX", folders["ATTREX"]))
    first = merged.orderBy("Timestamp").first()
    assert close(first.Si_alt, ppmv(4, 195, 85))


def test_staging(spark, folders, tmp_path):
    staged = rows(spark, folders, "ATTREX", staging_path=str(tmp_path))
    assert staged == rows(spark, folders, "ATTREX") and len(list(tmp_path.glob("*/DLH-H2O"))) == 1


def test_campaigns_share_a_staging_folder(spark, folders, tmp_path):
    """Instrument names of one campaign come up in another; none reads what another wrote."""
    names = ["ATTREX", "POSIDON", "MACPEX"]

    def table(**options):
        done = harmonise(spark, [CampaignSpec(n, folders[n], options=options) for n in names])
        return sorted(map(tuple, done.table.collect()), key=str)

    assert table(staging_path=str(tmp_path)) == table()


@pytest.mark.parametrize("name", ["IPHEX", "ISDAC", "ESCAPE"])
def test_guards_of_giant_files(spark, folders, name, monkeypatch):
    """Files read split by split give what whole files give."""
    whole = rows(spark, folders, name)
    monkeypatch.setattr(pc, "open_files", lambda *a, **k: open_files(*a, **k, whole_limit=1))
    assert rows(spark, folders, name) == whole


def test_file_guards_need_no_shuffle(spark, folders):
    df = campaign(spark, CampaignSpec("IPHEX", folders["IPHEX"]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_iphex(spark, folders):
    a, b, c = rows(spark, folders, "IPHEX")
    assert close([a.Tair_C, a.Si], [-20, tetens(-22) / tetens(-20) - 1])
    assert a.Timestamp == dt.datetime(2014, 5, 6, 0, 0, 10)
    assert (b.Si, b.Lat, b.Alt_m) == (None, None, None)
    assert c.Si is None                                   # frost point 23 K above air


def test_isdac(spark, folders):
    a, b, c = rows(spark, folders, "ISDAC")
    stamps = {r.Timestamp for r in (a, b, c)}
    assert stamps == {dt.datetime(2008, 4, 5, 20, 10, 5), dt.datetime(2008, 4, 5, 20, 0, 6), dt.datetime(2008, 4, 5, 20, 10)}
    full = next(r for r in (a, b, c) if r.Timestamp.second == 5)
    assert close([full.Tair_C, full.Si, full.Lat, full.Alt_m], [-15, 0.05, 71, 2000])
    filled = next(r for r in (a, b, c) if r.Timestamp.second == 6)
    assert (filled.Si, filled.Alt_m) == (None, None)


def test_posidon(spark, folders):
    df = campaign(spark, CampaignSpec("POSIDON", folders["POSIDON"]))
    a, b, c = df.orderBy("Timestamp").collect()
    assert close([a.Si, a.Tair_K, a.Pressure_hPa, a.Lat, a.Lon, a.Alt_m], [1.0, 195, 85, 13.4, 144.8, 16000])
    assert close(b.Si, ppmv(5, 196, 84)) and b.Alt_m is None
    assert (c.Si, c.Tair_K, c.source_file) == (None, None, None)


def test_escape(spark, folders):
    a, c = rows(spark, folders, "ESCAPE")                 # one row by number, one by word, one file by metadata
    assert close([a.Tair_C, a.Si, a.Alt_m], [-10, es(-11) / es(-10) - 1, 3048]) and a.Timestamp == dt.datetime(2022, 6, 2, 0, 1)
    assert (c.Tair_C, c.Si) == (None, None)


def test_macpex(spark, folders):
    a, b, c = rows(spark, folders, "MACPEX")
    assert close([a.Tair_C, a.Si, a.Lat], [210 - 273.15, ppmv(10, 210, 150), 35])
    assert a.source_file == "m.ict|d.ict|h.ict|j.ict"     # exactly one second away still matches
    assert c.source_file == "m.ict|nan|nan|nan"
    assert b.Si is None and c.Tair_C is None
    jlh = rows(spark, folders, "MACPEX", wv_source="JLH")
    assert close([jlh[0].Si, jlh[1].Si], [ppmv(11, 210, 150), ppmv(11, 211, 149)])
    merged = pc.macpex_merged(spark, CampaignSpec("MACPEX", folders["MACPEX"]))
    assert {"Si", "Si_HWV", "Si_JLH"} <= set(merged.columns)
    with pytest.raises(ValueError):
        campaign(spark, CampaignSpec("MACPEX", folders["MACPEX"], options={"wv_source": "XYZ"}))


def test_harmonise_and_run(spark, folders, tmp_path):
    specs = [CampaignSpec(n, p) for n, p in folders.items() if n != "root"]
    specs += [CampaignSpec("GONE", str(tmp_path / "none"), kind="MC3E"), CampaignSpec("ODD", folders["MC3E"])]
    out = str(tmp_path / "combined.parquet")
    report = run(spark, specs, out)
    assert set(report.failed) == {"GONE", "ODD"}
    counts = {r.Campaign: r.n_rows for r in report.campaigns.collect()}
    assert set(counts) == set(folders) - {"root"} and counts["MC3E"] == 3
    assert all(r.n_records > 0 for r in report.summary.collect())
    assert "Lat" in {r.column_name for r in report.missing.collect()}
    faults = {(r.Campaign, r.file_name) for r in report.errors.collect()}
    assert {("MC3E", "f2"), ("ARM", "broken.t4archive.gz"), ("CRYSTAL-FACE-NASA", "j2")} <= faults
    assert {(r.Campaign, r.file_name): r.n_rows for r in report.corrupt.collect()}[("MC3E", "f1")] == 1
    back = spark.read.parquet(out)
    assert back.columns[:2] == ["Timestamp", "Tair_C"] and set(back.columns) == {*STANDARD_COLUMNS, "Tair_K", "Pressure_hPa"}
    assert back.filter(F.isnan("Si") | F.isnan("Tair_C")).count() == 0
    csv = str(tmp_path / "combined.csv")
    run(spark, specs[:1], csv)
    assert spark.read.option("header", True).csv(csv).count() == 2
    with pytest.raises(ValueError):
        run(spark, specs[:1], str(tmp_path / "x.json"))
    with pytest.raises(RuntimeError):
        harmonise(spark, specs[-2:])


def test_a_fault_while_reading_stops_only_its_campaign(spark, folders, tmp_path):
    def broken(spark, spec):
        return pc.mc3e(spark, spec).withColumn("Si", F.raise_error(F.lit("bad block")).cast("double"))

    pipelines = dict(pc.PIPELINES)
    pc.PIPELINES["BROKEN"] = broken
    try:
        specs = [CampaignSpec("BROKEN", folders["MC3E"]), CampaignSpec("MC3E", folders["MC3E"])]
        report = run(spark, specs, str(tmp_path / "t.parquet"))
    finally:
        pc.PIPELINES.clear()
        pc.PIPELINES.update(pipelines)
    assert set(report.failed) == {"BROKEN"} and "bad block" in report.failed["BROKEN"]
    assert [(r.Campaign, r.n_rows) for r in report.campaigns.collect()] == [("MC3E", 3)]


def test_late_headers_and_equal_names(spark, folders, tmp_path):
    """A header far down is a header; files of one name in two folders are judged apart, read whole or split."""
    for path in Path(folders["IPHEX"]).glob("*"):
        put(tmp_path / "late" / path.name, ["# comment"] * 10_001 + path.read_text().split("\n"))
    late = campaign(spark, CampaignSpec("IPHEX", str(tmp_path / "late")))
    assert late.count() == len(rows(spark, folders, "IPHEX")) > 0
    for folder, shift in (("a", 0), ("b", 273.15)):
        lines = [f"{k},{20 + k + shift},{10 + k + shift}" for k in range(5)]
        put(tmp_path / "two" / folder / "2014_05_06_1.iphex", ["Time,T,D", *lines])
    fmt = TableFormat(header=ScannedHeader(lambda v: v.startswith("Time"), skip=1), names=comma_names)
    for limit in (1, 1 << 20):
        tables = open_files(spark, str(tmp_path / "two"), fmt, recursive=True, whole_limit=limit)
        got = tables.guarded_rows({"t": "T"}, [guards.kelvin_guard("t")]).collect()
        assert len(got) == 10 and all(19 < r.t < 26 for r in got)


def test_campaigns_are_written_at_the_same_time(spark, folders, tmp_path, monkeypatch):
    """Each job waits until the other one has begun."""
    both = threading.Barrier(2, timeout=120)
    save = harmonise_module.save_campaign

    def waiting(df, path, name):
        both.wait()
        save(df, path, name)

    monkeypatch.setattr(harmonise_module, "save_campaign", waiting)
    output = str(tmp_path / "both.parquet")
    report = run(spark, [CampaignSpec("MC3E", folders["MC3E"]), CampaignSpec("OLYMPEX", folders["OLYMPEX"])], output)
    assert not report.failed and {r.Campaign for r in spark.read.parquet(output).collect()} == {"MC3E", "OLYMPEX"}
