"""The registered queries with SQL, on the smallest tables; all of them keep every row."""
import os

import oracle_compare
import pytest

from logcase.llm import registered

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@needs_data
def test_queries_match_their_sql(spark):
    recs = oracle_compare.compare(spark, SF, sorted(registered.ORACLE_SQL))
    assert not [r for r in recs if not r["ok"]]


@needs_data
@pytest.mark.parametrize("name", sorted(registered.QUERIES.keys() - registered.ORACLE_SQL.keys()))
def test_other_queries_return_every_document(spark, name):
    out = registered.QUERIES[name](spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert out.columns[0] == "doc_id" and out.where("doc_id is null").count() == 0
