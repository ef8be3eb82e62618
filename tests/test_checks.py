"""Every registered query of the log side against its DuckDB oracle on the smallest tables."""
import os

import pytest

import oracle_compare

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_all_registered_queries_match_oracle(spark):
    import __spark_entry__ as E
    from logcase.plans import checks, checks_edges, checks_files
    assert set(E.oracle_sql()) <= set(E.queries())
    names = [*checks.QUERIES, *checks_edges.QUERIES, *checks_files.QUERIES]
    assert set(names) <= set(E.oracle_sql())
    recs = oracle_compare.compare(spark, SF, names)
    bad = [r for r in recs if r["ok"] is False]
    assert not bad, bad
    assert E.entry(spark).count() > 0
