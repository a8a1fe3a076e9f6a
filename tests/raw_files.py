"""Tiny raw files in the shapes the campaigns use."""

from __future__ import annotations

import gzip
from pathlib import Path

import numpy as np

from rimeweave.specs import ARM_RECORD, OLYMPEX_TABLE


def put(path: Path, lines: list[str]) -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")
    return path


def icartt(path: Path, names: str, rows: list[str], date: str = "2014, 02, 16, 2014, 03, 01") -> Path:
    return put(path, ["4, 1001", "Institute", date, names, *rows])


def arm(path: Path, records: list[dict], tail: bytes = b"") -> Path:
    data = np.full((len(records), len(ARM_RECORD)), 100_000, ">i4")
    for i, r in enumerate(records):
        for name, value in r.items():
            at = ARM_RECORD.index(name)
            data[i, at] = value if name == "Date" else round((value + 100) * 1000)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(data.tobytes() + tail))
    return path


def everything(spark, root: Path) -> dict[str, str]:
    """One or more files per campaign; returns campaign -> folder."""
    arm(root / "ARM/a.t4archive.gz", [
        {"Date": 309, "Time_sec": 10.5, "Air_Temp_Rosemount_C": -40, "Frost_Point_Cryo_C": -38, "GPS_Lat_deg": 36.5, "GPS_Lon_deg": -97.5, "GPS_Alt_m": 9000},
        {"Date": 309, "Time_sec": 11.5, "Air_Temp_Rosemount_C": -41, "Frost_Point_Cryo_C": -38},
    ])
    arm(root / "ARM/broken.t4archive.gz", [{"Date": 309}], tail=b"xx")

    jlh = ["3 1001", "2002 07 09 2002 08 01", "UT (s) T (K) RHi (%)"]
    put(root / "CRYSTAL-FACE-NASA/j1", [*jlh, "100.0 220.15 110.0", "200.0 221.15 95.0", "50 1 2 3 4"])
    put(root / "CRYSTAL-FACE-NASA/j2", ["not a header"])
    put(root / "positions/m1", [
        "7 1001", "2002 07 09", "x", "y", "1 0.1 0.01 0.01 1 ; scales", "99999 9999 99999 99999 9999 ; missing",
        "UT P_ALT LAT LONG TAS", "95 90000 2500 -8000 200", "108 9999 2600 -8100 200",
    ])

    mis = ["5 1001", "x", "2002 07 09", "Time RH Lat_deg", "s % deg"]
    put(root / "CRYSTAL-FACE-UND/02MIS.CIT", [*mis, "10 120 25.0", "11 999999.9999 25.1", "12 80"])
    put(root / "CRYSTAL-FACE-UND/02MET.CIT", ["5 1001", "x", "2002 07 09", "Time Air_Temp_R", "s C", "10 -55.5", "12 -9999"])
    put(root / "CRYSTAL-FACE-UND/03MIS.CIT", [*mis, "10 100 26.0"])

    mc3e = ["5 1001", "x", " 2011 04 25", "Time Air_Temp FrostPoint POS_Lat POS_Lon POS_Alt", "s C C d d m"]
    put(root / "MC3E/f1", [*mc3e, "86401.5 -40.0 -39.0 36.0 -97.0 9000", "2 -9999.0 -39 36 -97 9000", "3 bad -39 36 -97 9000", "4 1 2 3 4 5 6 7"])
    put(root / "MC3E/f2", ["no header here"])

    put(root / "MIDCIX/w1", ["3 1001", "2004 04 19", "UTsec T (K) RH (%) Lat Z", "100 223.15 90 30.5 15000", "101 999999 80 30.6 15001"])

    cells = {"Time": "30", "Air_Temp": "-20", "FrostPoint": "-21", "POS_Lat": "47", "POS_Lon": "-124", "POS_Alt": "5000"}
    put(root / "OLYMPEX/o1", ["2 1001", "2015 11 12", " ".join(cells.get(n, "999999.9999") for n in OLYMPEX_TABLE)])

    spark.createDataFrame(
        [("r1.nc", i, f"2003-11-0{i + 1} 12:00:00") for i in range(3)], "source_file string, idx int, t string"
    ).selectExpr("source_file", "idx", "cast(t as timestamp) as Timestamp").write.parquet(f"{root}/AIRS-II/axis")
    rows = [("r1.nc", v, i, x + i) for v, x in (("RHUM", 199.0), ("ATX", -30.0), ("LATC", 45.0), ("GGALT", 3000.0)) for i in range(3)]
    rows += [("r1.nc", "LON", 0, -75.0)]
    spark.createDataFrame(rows, "source_file string, var string, idx int, val double").write.parquet(f"{root}/AIRS-II/values")
    spark.createDataFrame(
        [("RF01.nc", i, f"2007-11-07 00:00:0{i}") for i in range(3)], "source_file string, idx int, t string"
    ).selectExpr("source_file", "idx", "cast(t as timestamp) as Timestamp").write.parquet(f"{root}/ICE-L/axis")
    rows = [("RF01.nc", "ATX", i, 243.15 + i) for i in range(3)] + [("RF01.nc", "PSXC", i, 400.0) for i in range(5)]
    rows += [("RF01.nc", "RHUM", 0, 120.0), ("RF01.nc", "RHUM", 1, 250.0), ("RF01.nc", "GGLAT", 0, 41.0), ("RF01.nc", "PALTF", 0, 99999.0)]
    spark.createDataFrame(rows, "source_file string, var string, idx int, val double").write.parquet(f"{root}/ICE-L/values")

    base = root / "ATTREX"
    icartt(base / "DLH-H2O/DLH-H2O_GH_1.ict", "Time_UTC, H2O_ppmv", ["100, 5.0", "101, -9999", "102, 6.0", "500, 7.0"])
    icartt(base / "NOAA-H2O/NOAA-H2O_GH_1.ict", "NW_UTC_s, NW_H2O_ppmv", ["100.4, 4.0", "102, 4.5, 9, 9"])
    icartt(base / "MMS/MMS-1HZ_GH_1.ict", "TIME_UTC, T, P, G_LAT, G_LONG, G_ALT", ["100.9, 19500, 8500, 10.0, 160.0, 16000", "102.5, 99999, 8500, 11, 161, 16001"])
    icartt(base / "MMS/bad.ict", "TIME_UTC, T", ["1, 2"], date="no date")

    iphex = ["free text", "Time Air_Temp FrostPoint STATIC_PR POS_Lat POS_Lon POS_Alt", "s K C Pa d d m"]
    put(root / "IPHEX/2014_05_06_10_00_00.iphex", [*iphex, "10 253.15 -22 50000 35 -83 5000", "11 254.15 -9999 51000 95 -83 30000", "12 255.15 5 52000 35 -83 5000"])
    put(root / "IPHEX/2014_05_06_Combined.iphex", [*iphex, "10 253.15 -22 50000 35 -83 5000"])
    put(root / "IPHEX/2014_05_07_10_00_00.iphex", ["x", "Time Air_Temp FrostPoint", "s C C", "1 2 3"])

    isdac = ["Flight Date: 2008/Apr/05    Aircraft: X", "HH,MM,SS,RSTem,NPres,ReHuI,HH,MM,SS,LicFro,MastrLAT,MasterLON,PreAlt", "u", "---"]
    put(root / "ISDAC/001F01_1.txt", [*isdac, "20,10,5,-15,800,105,1,2,3,-16,71,-156,2000", "20,,6,-15.5,800,-8.88,1,2,3,-16,71,-156,-3000", "20,10"])

    base = root / "POSIDON"
    icartt(base / "DLH-H2O/DLH-H2O_WB57_1.ict", "Time_UTC, H2O_ppmv", ["100, 900.0", "200, 5.0", "300, -1"])
    icartt(base / "MMS/MMS-1HZ_WB57_1.ict", "TIME_UTC, T, P, G_LAT, G_LONG, G_ALT", ["100, 19500, 8500, 1340000, 14480000, 160000", "200.5, 19600, 8400, 1350000, 14490000, -9999"])
    icartt(base / "OTHER/X_1.ict", "Time_UTC, a", ["1, 2"])

    escape = ["Platform: Learjet", "Time_Start, a, b, c, d, e, f, g", "Altitude note: palt in feet", "Time_Start,Temp,Dew,Pressure,Palt,Lat,Long,qc_flag"]
    folder = root / "ESCAPE/deep"
    put(folder / "ESCAPE-Page0_Learjet_20220602_R0.ict", [*escape, "60,-10,-11,500,10000,29,-95,0", "61,-10,-11,500,10000,29,-95,2", "62,-999,-11,500,10000,29,-95,999999", "63,-10,n/a,10,200000,29,-95,bad value"])
    put(folder / "ESCAPE-Page0_Learjet_20220603_R0.ict", ["quality status: rejected", *escape, "60,-10,-11,500,10000,29,-95,0"])

    base = root / "MACPEX"
    icartt(base / "DLH/d.ict", "Time_Start, H2O_ppmv", ["100, 10", "101, -999.99"])
    icartt(base / "HWV/h.ict", "Time_Start, H2O", ["100.2, 12"])
    icartt(base / "JLH/j.ict", "Time_Start, H2O(v)_ppmv", ["101, 11"])
    icartt(base / "MMS-MetData/m.ict", "Time_Start, T, P, LAT, LON, ALT", ["100, 21000, 1500, 35, -97, 14000", "101, 21100, 1490, 35.1, -97.1, 14010", "150, -9999, 1490, 1, 2, 3"])
    return {
        n: str(root / n)
        for n in (
            "ARM", "CRYSTAL-FACE-NASA", "CRYSTAL-FACE-UND", "MC3E", "MIDCIX", "OLYMPEX", "AIRS-II", "ATTREX", "IPHEX", "ISDAC",
            "POSIDON", "ESCAPE", "ICE-L", "MACPEX",
        )
    }
