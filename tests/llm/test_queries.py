"""Registered queries of the subpackage against SQL, and their shapes."""

import pytest

import __spark_entry__ as entry
from check_queries import compare, oracle_connection
from rimeweave.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert compare(got, oracle_connection(SF).execute(ORACLE[name]).df()) == ""


def test_all_operators_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", ["op9_substring_dedup", "op10_near_dedup", "op12_ngram_join"])
def test_a_row_for_every_document(spark, name):
    got = QUERIES[name](spark, SF)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(
        r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()
    )
