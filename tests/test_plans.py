"""The registered queries: contract, and what their plans must not do."""

import re

import pytest

import __spark_entry__ as entry

QUERIES = entry.REGISTRY


def test_contract(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.limit(1).count() == 1 and "rrf_score" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_pairs_everything(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoopJoin", plan)
    scanned = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert all(len(columns.split(",")) <= 8 for columns in scanned)


def test_filters_reach_the_scan(spark, small):
    plan = QUERIES["bm25_filtered"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "upper(lang" in plan and "question" not in plan.split("FileScan")[-1]


def test_filings_are_cut_into_items_once(spark, small, monkeypatch):
    written = []
    monkeypatch.setattr("trawl.plans.queries.readers.write_filings", lambda filed, path: written.append(filed))
    monkeypatch.setattr("trawl.plans.queries.readers.read_filings", lambda spark, path: written[0])
    QUERIES["filing_files"](spark, small)
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
