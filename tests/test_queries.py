"""All registered queries with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from folio.operators import evaluation
from folio.plans import passages, registry, search

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE_SQL = {**registry.QUERIES, **search.QUERIES, **passages.QUERIES}, {**registry.ORACLE_SQL, **search.ORACLE_SQL, **passages.ORACLE_SQL}


@pytest.fixture(scope="module")
def sql():
    found = duckdb.connect()
    for table in os.listdir(DATA):
        found.execute(f"create view {table.removesuffix('.parquet')} as select * from '{DATA}/{table}'")
    return found


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sql, name):
    got = QUERIES[name](spark, DATA)
    want = sql.sql(ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = sorted(repr([r[c] for c in order]) for r in got.collect())
    at = [want.columns.index(c) for c in order]
    assert rows == sorted(repr([r[i] for i in at]) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_passage_metrics_join_few_results(spark, monkeypatch):
    names, plans = [], []
    stored = passages.stored
    monkeypatch.setattr(passages, "stored", lambda df, name: names.append(name) or stored(df, name))
    monkeypatch.setattr(evaluation, "passage_metrics", lambda found, targets, own=evaluation.passage_metrics: plans.append(found._jdf.queryExecution().executedPlan().toString()) or own(found, targets))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert passages.passage_metrics(spark, DATA).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {"results", "places", "targets"} <= set(names)
    assert "BroadcastHashJoin [pos#" in plans[0]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stage_metrics_rank_no_documents(spark, monkeypatch):
    monkeypatch.setattr(registry, "_firsts", lambda *x: pytest.fail("the documents' first ranks are not needed"))
    assert passages.stage_metrics(spark, DATA).count() == 1
