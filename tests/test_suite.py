"""Every query of the engine against the same query in SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from rangeframe import suite
from tests.conftest import SF


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return c


def plain(names, rows):
    """Columns by name and rows in one order; binary values as bytes, times without a zone."""
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(repr(tuple(r[k] for k in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query(spark, db, name):
    run, sql = suite.QUERIES[name]
    got = run(spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if sql is None:
        assert got.columns
        return
    want = db.execute(sql)
    names = [c[0] for c in want.description]
    assert plain(got.columns, rows) == plain(names, want.fetchall())


def test_batch_put_covers_the_whole_table(spark):
    assert suite.QUERIES["batch_put_report"][0](spark, SF).count() == spark.read.parquet(f"{SF}/customer.parquet").count()


def test_split_median_of_many_partitions(spark, tmp_path):
    """Over more orders than the sample behind range partitions holds."""
    spark.range(0, 150_001, 1, 8).select((F.col("id") * 7919 % 150_001).alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    want = duckdb.sql(suite.QUERIES["region_split_median"][1].replace("orders", f"'{tmp_path}/orders.parquet/*.parquet'")).fetchall()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert [tuple(r) for r in suite.QUERIES["region_split_median"][0](spark, str(tmp_path)).collect()] == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_flagship(spark):
    assert suite.flagship(spark, SF).count() == 1


def test_pushdown(spark):
    from rangeframe.operators import access

    rows = access.scan(suite.tables.orders(spark, SF), "o_orderkey", 10, 20, ["o_custkey"], "o_totalprice > 5")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,10)" in plan and "LessThan(o_orderkey,20)" in plan and "GreaterThan(o_totalprice,5.0)" in plan
    assert "o_comment" not in plan and "o_orderstatus" not in plan


def test_colocated_join_has_no_shuffle(spark):
    df = suite.tables.join_colocated(spark, SF)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_region_pruning(spark):
    engine = suite.tables.orders_engine(spark, SF, 200)
    files = engine.table("orders", 250, 350).inputFiles()
    assert files and all("region_id=orders-000001" in f for f in files)
