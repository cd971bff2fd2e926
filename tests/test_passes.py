"""Queries that need a large step several times compute it once: how often plans read the trades."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators.versioned import VersionedTable
from tidemark.plans import daily, screen, streams
from tidemark.sources import market, tables


def scans(rows, name):
    """How often the plan of ``rows`` names the table's file; parts that are written before are not in it."""
    return rows._jdf.queryExecution().optimizedPlan().toString().count(f"{name}#")


def test_positions_are_evaluated_from_what_was_written(spark, sf_dir):
    assert scans(daily.cohort_eval(spark, sf_dir), "l_suppkey") == 0


def test_a_price_plan_reads_the_pool_once(spark, sf_dir):
    assert scans(screen.operation_plan(spark, sf_dir), "l_suppkey") == 0


def test_a_cascade_makes_its_rows_once(spark, sf_dir, monkeypatch):
    made = []
    monkeypatch.setattr(VersionedTable, "write", lambda self, batch, number, order, like: made.append(scans(batch, "l_suppkey")))
    monkeypatch.setattr(streams, "cascade", lambda tables, values, number: made.append(scans(values, "l_suppkey")))
    monkeypatch.setattr(VersionedTable, "read", lambda self: market.theme_days(spark, sf_dir).withColumn("tag", F.col("reason")))
    streams.purge_cascade(spark, sf_dir)
    assert made == [0, 0, 0, 0]


@pytest.mark.parametrize("again", [False, True])
def test_rows_without_a_key_stay_single(spark, tmp_path, again):
    """A stored row whose key has a null gives way to the batch's, as any other does."""
    schema = "k long, v long"
    table = VersionedTable(spark, f"file://{tmp_path}/t", spark.createDataFrame([], schema).schema, ("k",), 2)
    table.write(spark.createDataFrame([(None, 1), (1, 1)], schema), 0, [F.desc("v")])
    for _ in range(2 if again else 1):
        table.write(spark.createDataFrame([(None, 2), (1, 2)], schema), 1, [F.desc("v")])
    assert sorted(tuple(r) for r in table.read().select("k", "v").na.fill(-1, ["k"]).collect()) == [(-1, 2), (1, 2)]


def test_a_merge_is_dealt_out_in_proportion(spark, tmp_path, monkeypatch):
    """With ``like``, a batch leaves in as many files a bucket as there are tasks, the first one and those merged with stored rows."""
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    rows = spark.range(2000).selectExpr("id as k", "id as v")
    table = VersionedTable(spark, f"file://{tmp_path}/t", rows.schema, ("k",), 1)
    for number in range(2):
        table.write(rows, number, [F.desc("v")], like=rows)
        assert len(list((tmp_path / "t" / "table" / f"batch={number}" / "bucket=0").glob("*.parquet"))) == 20
    assert table.read().count() == 2000
