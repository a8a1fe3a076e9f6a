"""File discovery, layouts, errors, and the equality of the ways in."""

import gzip
import os
import struct

import numpy as np
import pytest
from pyspark.sql import DataFrameReader, functions as F

from rimeweave.plans.campaigns import ARM_RECORD, ESCAPE_FORMAT, ICARTT, IPHEX_FORMAT, NAMES_BEFORE_LAST
from rimeweave.sources import records
from rimeweave.sources.files import list_files, read_split_lines
from rimeweave.sources.records import open_records
from rimeweave.sources.sinks import save_lines
from rimeweave.sources.tables import open_files, open_lines

from .raw_files import arm, icartt, put


def test_discovery(spark, tmp_path):
    put(tmp_path / "a.ict", ["x"])
    put(tmp_path / "a_Combined.ict", ["x"])
    put(tmp_path / "sub/b.ict", ["x"])
    put(tmp_path / "c.txt", ["x"])

    def names(**kw):
        return sorted(r.file_name for r in list_files(spark, str(tmp_path), "*.ict", **kw).collect())

    assert names(recursive=True) == ["a.ict", "a_Combined.ict", "b.ict"]
    assert names(recursive=True, exclude="Combined") == ["a.ict", "b.ict"]
    with pytest.raises(FileNotFoundError):
        open_files(spark, str(tmp_path), ICARTT, "*.nothing", recursive=True)


@pytest.fixture()
def folder(tmp_path):
    body = [f"{i}, {i * 0.5}, {'bad' if i % 7 == 0 else i}" for i in range(400)]
    icartt(tmp_path / "good.ict", "time, x, y", body)
    icartt(tmp_path / "wide.ict", "time, x, y", ["1, 2, 3, 4", "5", "", "6, -9999, 8"])
    icartt(tmp_path / "nodate.ict", "time, x", ["1, 2"], date="none")
    icartt(tmp_path / "twice.ict", "time, x, x", ["1, 2, 3"])
    put(tmp_path / "nohead.ict", ["hello", "1, 2"])
    put(tmp_path / "short.ict", ["90, 1001", "2014, 1, 1"])
    return str(tmp_path)


def read(tables):
    rows = tables.rows({"time": "time", "x": "x", "y": "y"}, sentinels=[-9999]).collect()
    return sorted((r.source_file, r.time, r.x, r.y) for r in rows if r.x is not None), len(rows)


def test_errors_and_bad_rows(spark, folder):
    tables = open_files(spark, folder, ICARTT, "*.ict")
    errors = {r.file_name: r.error for r in tables.errors().collect()}
    assert errors == {
        "nodate.ict": "no flight date", "twice.ict": "repeated column name",
        "nohead.ict": "no table header found", "short.ict": "no table header found",
    }
    assert [(r.file_name, r.value) for r in tables.corrupt_rows().collect()] == [("wide.ict", "1, 2, 3, 4")]
    rows, n = read(tables)
    assert n == 402 and ("good.ict", 7.0, 3.5, None) in rows and ("good.ict", 8.0, 4.0, 8.0) in rows
    assert tables.column_names() == {"": ["time", "x", "y"]}
    cells = tables.cells([-9999]).filter("source_file = 'wide.ict'").orderBy("row_no").collect()
    assert [r.cells for r in cells] == [{"time": 5.0, "x": None, "y": None}, {"time": 6.0, "x": None, "y": 8.0}]


def test_giant_files_give_the_same(spark, folder):
    """With a tiny limit the large file is read split by split."""
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = read_split_lines(spark, folder, "*.ict", above=1000)
        assert lines.rdd.getNumPartitions() > 1
        numbered = sorted((r.line_no, r.value) for r in lines.collect())
        assert [n for n, _ in numbered] == list(range(404)) and numbered[0][1] == "4, 1001"
        tables = open_files(spark, folder, ICARTT, "*.ict", whole_limit=1000)
        assert tables.split_layout.count() == 1
        mixed = read(tables)
        assert len(tables.errors().collect()) == 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    assert mixed == read(open_files(spark, folder, ICARTT, "*.ict"))


def test_lines_give_the_same(spark, tmp_path):
    formats = {
        "e.ict": (ESCAPE_FORMAT, ["a: b", "Time_Start,1,2,3,4,5,6,7", "Time_Start,Temp,c,d,e,f,g,h", "1,2,3,4,5,6,7,8"], "Temp"),
        "2014_05_06_x.iphex": (IPHEX_FORMAT, ["hello", "Time Air_Temp FrostPoint STATIC_PR", "units", "1 2 3 4", "2 3"], "Air_Temp"),
        "m": (NAMES_BEFORE_LAST, ["4 1", "2011 01 02", "Time Air_Temp", "units", "1 2", "2 3"], "Air_Temp"),
    }
    for name, (fmt, text, column) in formats.items():
        put(tmp_path / name, text)
        rows = [(f"/x/{name}", name, i, line) for i, line in enumerate(text)]
        lines = spark.createDataFrame(rows, "path string, file_name string, line_no long, value string")
        got = {}
        for way, tables in (("files", open_files(spark, str(tmp_path), fmt, name)), ("lines", open_lines(lines, fmt))):
            assert tables.errors().count() == 0
            got[way] = sorted((r.row_no, r.v) for r in tables.rows({"v": column}).collect())
        assert got["files"] == got["lines"] and got["files"][0][1] == 2.0, name


def test_line_ends_and_tabs(spark, tmp_path):
    text = "4, 1001\r\nInstitute\r\n2014, 02, 16\r\n\ttime,\tx \r\n1,\t2.5\t\r\n 2 , 3\r\n"
    for name, content in (("dos.ict", text), ("mac.ict", text.replace("\r\n", "\r")), ("unix.ict", text.replace("\r", ""))):
        (tmp_path / name).write_bytes(content.encode())
        for limit in (1_000_000, 1):
            tables = open_files(spark, str(tmp_path), ICARTT, name, whole_limit=limit)
            got = sorted((r.t, r.x) for r in tables.rows({"t": "time", "x": "x"}).collect())
            assert got == [(1.0, 2.5), (2.0, 3.0)], (name, limit)


def test_column_order(spark, tmp_path):
    icartt(tmp_path / "a.ict", "time, x", ["1, 2"])
    icartt(tmp_path / "b.ict", "lat, time, z, x", ["1, 2, 3, 4"])
    assert open_files(spark, str(tmp_path), ICARTT).column_names()[""] == ["time", "x", "lat", "z"]


def test_records(spark, tmp_path):
    arm(tmp_path / "a.gz", [{"Date": 309, "Time_sec": float(i)} for i in range(5)])
    arm(tmp_path / "b.gz", [{"Date": 309}], tail=b"x")
    (tmp_path / "c.gz").write_bytes(b"\x1f\x8bnonsense")
    rows = open_records(spark, str(tmp_path), ARM_RECORD, "*.gz")
    good = rows.filter("error is null").orderBy("row_no").collect()
    assert [(r.source_file, r.row_no, r.Date, r.Time_sec) for r in good] == [("a.gz", i, 309, (i + 100) * 1000) for i in range(5)]
    errors = {r.source_file: r.error for r in rows.filter("error is not null").collect()}
    assert errors["b.gz"] == "length is not a whole number of records" and errors["c.gz"].startswith("cannot unpack")


def test_file_plan_has_no_shuffle(spark, folder):
    """Rows of files of normal size come from one scan, without exchange or join."""
    df = open_files(spark, folder, ICARTT, "*.ict").rows({"x": "x"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan
    assert df.filter(F.col("x") > 1).count() > 0


def test_late_column_choice_reads_raw_text_once(spark, tmp_path):
    """The first name by path and position fills a role in every file, also one from a file without rows."""
    icartt(tmp_path / "a.ict", "time, PLATE, lon1", [])
    icartt(tmp_path / "b.ict", "time, GPS_Lat, LON2, lon1", ["1, 10, 20, 30", "2, -9999, bad, 31", "3, 4, 5, 6, 7"])
    icartt(tmp_path / "c.ict", "time, PLATE, lon1, GPS_Lat", ["5, 40, 50, 60"])
    icartt(tmp_path / "d.ict", "time, x", ["6, 7"])
    icartt(tmp_path / "e.ict", "time, latitude", ["8, 9"], date="none")
    roles = {"lat": lambda n: n.contains("lat"), "lon": lambda n: n.contains("lon"), "alt": lambda n: n.contains("alt")}
    for limit in (10_000, 0):
        tables = open_files(spark, str(tmp_path), ICARTT, "*.ict", whole_limit=limit)
        df = tables.late_rows({"time": "time"}, roles, [-9999])
        got = sorted((r.source_file, r.time, r.lat, r.lon, r.alt) for r in df.collect())
        assert got == [
            ("b.ict", 1.0, None, 30.0, None), ("b.ict", 2.0, None, 31.0, None), ("c.ict", 5.0, 40.0, 50.0, None), ("d.ict", 6.0, None, None, None),
        ]
        assert {(r.file_name, r.error) for r in tables.errors().collect()} == {("e.ict", "no flight date")}
        assert [(r.file_name, r.n_rows) for r in tables.corrupt_counts().collect()] == [("b.ict", 1)]
        plans = df._jdf.queryExecution().toString() + tables.corrupt_counts()._jdf.queryExecution().toString()
        assert "FileScan text" not in plans and "Scan text" not in plans


def test_unreadable_files_are_errors_of_their_own(spark, tmp_path):
    icartt(tmp_path / "good.ict", "time, lat", ["1, 2"])
    text = (tmp_path / "good.ict").read_bytes() * 200
    (tmp_path / "cut.ict.gz").write_bytes(gzip.compress(text)[:-40])
    (tmp_path / "not.ict.gz").write_bytes(b"this is no archive")
    (tmp_path / "whole.ict.gz").write_bytes(gzip.compress((tmp_path / "good.ict").read_bytes()))
    tables = open_files(spark, str(tmp_path), ICARTT, "*ict*")
    wanted = {("cut.ict.gz", "file cannot be read"), ("not.ict.gz", "file cannot be read")}
    assert {(r.file_name, r.error) for r in tables.errors().collect()} == wanted
    rows = tables.late_rows({"time": "time"}, {"lat": lambda n: n.contains("lat")})
    assert sorted((r.source_file, r.lat) for r in rows.collect()) == [("good.ict", 2.0), ("whole.ict.gz", 2.0)]
    assert {(r.file_name, r.error) for r in tables.errors().collect()} == wanted


def test_files_without_a_required_column_are_errors(spark, tmp_path):
    icartt(tmp_path / "a.ict", "UT, x", ["1, 2"])
    icartt(tmp_path / "b.ict", "time, x", ["1, 2"])
    need = (F.array_contains("names", "UT"), "no UT column")
    tables = open_files(spark, str(tmp_path), ICARTT, "*.ict", require=need)
    assert [(r.file_name, r.error) for r in tables.errors().collect()] == [("b.ict", "no UT column")]
    assert [r.source_file for r in tables.rows({"x": "x"}).collect()] == ["a.ict"]


def test_binary_records_unpack_piece_by_piece(spark, monkeypatch):
    monkeypatch.setattr(records, "BATCH_RECORDS", 7)
    data = np.arange(200, dtype=">i4").tobytes()
    packed = gzip.compress(data)
    damaged = packed[:20] + bytes(reversed(packed[20:40])) + packed[40:]
    contents = {
        "plain": data, "packed": packed, "members": gzip.compress(data[:100]) + gzip.compress(data[100:]), "cut": packed[:-9],
        "damaged": damaged, "odd": gzip.compress(data + b"x"), "empty": b"", "none": None, "nothing": gzip.compress(b""),
    }
    df = spark.createDataFrame([(k, v and bytearray(v)) for k, v in contents.items()], "path string, content binary")
    found = {}
    for row in records.decode_records(df, ["a", "b"]).collect():
        found.setdefault(row.path, []).append((row.row_no, row.a, row.b, row.error))
    whole = [(i, 2 * i, 2 * i + 1, None) for i in range(100)]
    assert all(sorted(found[k]) == whole for k in ("plain", "packed", "members"))
    assert {k: found[k][0][3].split(":")[0] for k in ("cut", "damaged", "odd")} == {
        "cut": "cannot unpack", "damaged": "cannot unpack", "odd": "length is not a whole number of records"
    }
    assert not {"empty", "none", "nothing"} & set(found) and all(len(found[k]) == 1 for k in ("cut", "damaged", "odd"))


def test_record_files_are_listed_once(spark, tmp_path, monkeypatch):
    """A listing of many folders is a job of its own."""
    loads, load = [], DataFrameReader.load

    def counted(self, *args, **options):
        loads.append(args)
        return load(self, *args, **options)

    monkeypatch.setattr(DataFrameReader, "load", counted)
    (tmp_path / "a").write_bytes(bytes(8))
    assert open_records(spark, str(tmp_path), ["x", "y"]).count() == 1 and len(loads) == 1
    with pytest.raises(FileNotFoundError):
        open_records(spark, str(tmp_path), ["x", "y"], "*.none")


def test_tasks_write_many_small_files(spark, tmp_path):
    """Each task opens its files itself; Spark's writer had a folder, a checksum and a rename by the driver for each."""
    folder = tmp_path / "raw files"
    rows = spark.range(3000).select(
        F.concat(F.lit("f"), (F.col("id") % 300).cast("string"), F.when(F.col("id") % 2 == 0, ".gz").otherwise("")).alias("name"),
        "id", F.col("id").cast("string").alias("value"),
    )
    lines = rows.repartition(4, "name").sortWithinPartitions("name", "id")
    assert save_lines(lines, f"file:{folder}".replace(" ", "%20"))
    assert sorted(os.listdir(folder)) == sorted(f"f{k}" + ("" if k % 2 else ".gz") for k in range(300))
    for k in (7, 298):
        held = (folder / (f"f{k}" + ("" if k % 2 else ".gz"))).read_bytes()
        held = held if k % 2 else gzip.decompress(held)
        assert held.decode() == "".join(f"{n}\n" for n in range(k, 3000, 300))
    assert save_lines(rows.limit(0), f"file:{tmp_path}/none") and not save_lines(lines, "viewfs://store/raw")


def test_wanted_columns_of_records(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(struct.pack(">6i", 1, 2, 3, 4, 5, 6))
    (tmp_path / "b.bin").write_bytes(b"12345")
    rows = open_records(spark, str(tmp_path), ["x", "y", "z"], wanted=["z", "x"])
    assert rows.columns == ["path", "row_no", "error", "z", "x", "source_file"]
    found = {(r.source_file, r.row_no, r.z, r.x, r.error is None) for r in rows.collect()}
    assert found == {("a.bin", 0, 3, 1, True), ("a.bin", 1, 6, 4, True), ("b.bin", None, None, None, False)}


def test_text_of_a_file_is_split_once(spark, tmp_path):
    """As an expression the text was split again at each mention of its lines: about twenty times a file."""
    (tmp_path / "a.dat").write_text("4 1001\n2011 04 25\nTime qty\ns -\n1 2\n3 4\n3 4 5\n")
    tables = open_files(spark, str(tmp_path), NAMES_BEFORE_LAST)
    plan = tables.rows({"time": "Time"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(replace(") == 1
    late = tables.late_rows({"time": "Time"}, {"qty": lambda n: n.contains("qty")}, sentinels=(4.0,))
    assert {(r.time, r.qty) for r in late.collect()} == {(1.0, 2.0), (3.0, None)}
    assert [(r.file_name, r.n_rows) for r in tables.corrupt_counts().collect()] == [("a.dat", 1)] and not tables.errors().count()
