"""Every query with a SQL form against DuckDB, and the shape of some plans."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskflow.operators import metrics, velocity
from riskflow.sources.fixture import scored, transactions
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def test_every_check_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in result.fetchall()), key=repr)
    assert got == want


def test_entry_point(spark):
    assert entry.entry(spark).count() > 0


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_batch_plans_hold_no_python(spark):
    for name in ("velocity_all_entities", "freq_encoded", "drift_ks", "row_validation", "scored_decisions"):
        plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_history_of_six_entities_takes_two_shuffles(spark):
    df = velocity.velocity(transactions(spark, SMALL), windows=None, strategy="windows")
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_scan_reads_only_needed_columns_and_filters_reach_it(spark):
    df = scored(spark, SMALL).where(F.col("event_timestamp") > "2024-01-20")
    plan = metrics.ranking(df)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "ts)" in plan and "user_id" not in plan


def test_ordered_totals_share_one_scan(spark):
    plan = executed(metrics.ranking(scored(spark, SMALL)))
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan
