"""Every registered query against its SQL counterpart, and the plans of the heavy ones."""

import pytest

import __spark_entry__ as entry
from check_queries import compare, oracle_connection
from rimeweave.oracle import ORACLE
from rimeweave.queries import QUERIES, SUPPLIERS_PER_FILE, _icartt_tables, _mc3e_files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, oracle, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(got, oracle.execute(entry.oracle_sql()[name]).df()) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLE) == set(QUERIES)
    assert set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries()) >= set(QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_corrupt_rows_complete_the_good_ones(spark):
    """Corrupt and good rows together are all lines."""
    tables = _icartt_tables(spark, SF)
    bad, good = tables.corrupt_rows().count(), tables.rows({"qty": "qty"}).count()
    assert bad > 0 and bad + good == spark.read.parquet(f"{SF}/lineitem.parquet").count()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans(spark, name):
    """No nested loops, no Python outside the binary decoder."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert name == "ingest_fixed_binary" or "Python" not in plan


def test_scans_are_pruned(spark):
    plan = entry.queries()["guard_feet"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in plan


@pytest.fixture(scope="module")
def late_keys(tmp_path_factory):
    """Line items with keys around 999999, which is also a fill value."""
    folder = tmp_path_factory.mktemp("late")
    con = oracle_connection(SF)
    con.execute(f"""copy (select * replace (l_orderkey + 999990 as l_orderkey, if(l_linenumber = 1, 999999, l_partkey) as l_partkey)
        from lineitem where l_orderkey < 100) to '{folder}/lineitem.parquet'""")
    con.execute(f"copy supplier to '{folder}/supplier.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["campaign_mc3e", "ingest_fixed_names", "ingest_whitespace"])
def test_a_time_may_equal_a_fill_value(spark, late_keys, name):
    got = entry.queries()[name](spark, late_keys).toPandas()
    assert compare(got, oracle_connection(late_keys).execute(entry.oracle_sql()[name]).df()) == ""


def test_suppliers_share_raw_files(spark, oracle):
    """Each raw file costs its writer processes of the file system, so only files with a bad header are small."""
    bad, good = oracle.execute(f"""select count(distinct (l_suppkey, l_orderkey // 200000)) filter (l_suppkey % 7 = 0),
        count(distinct (l_suppkey // {SUPPLIERS_PER_FILE}, l_orderkey // 200000)) filter (l_suppkey % 7 <> 0) from lineitem""").fetchone()
    assert spark.read.format("binaryFile").load(_mc3e_files(spark, SF)).select("path").count() == bad + good


def test_body_lines_stay_out_of_the_header_shuffle(spark):
    """Lines are compared with the last header line of all files before the files' headers are gathered."""
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    plan = _icartt_tables(spark, SF).rows({"qty": "qty"})._jdf.queryExecution().optimizedPlan().toString()
    assert "max(_h" in plan and "scalar-subquery" in plan
