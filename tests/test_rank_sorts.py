"""Ranks within a group: one sort a value, which halves what a task holds, and the same ranks as by two."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import pct_rank
from tidemark.plans.research import daily_ic


def sorts(rows, key):
    return rows._jdf.queryExecution().executedPlan().toString().count(f"Sort [{key}#")


def test_one_sort_a_value(spark, sf_dir):
    assert sorts(daily_ic(spark, sf_dir), "trade_date") == 2  # of the day's returns and of its labels


def test_ranks_equal_those_of_both_directions(spark):
    values = [1.0, 1.0, 2.5, -3.0, 0.0, -0.0, None, float("nan"), float("nan"), float("inf")]
    rows = spark.createDataFrame([(g, i, values[(i * 7 + g) % len(values)] if g < 3 else None) for g in range(4) for i in range(37)], "g int, i int, x double")
    by, x = Window.partitionBy("g"), F.col("x")
    up, down = F.rank().over(by.orderBy(x.asc_nulls_last())), F.rank().over(by.orderBy(x.desc_nulls_last()))
    both = F.when(x.isNotNull(), (up + F.count(x).over(by) + 1 - down) / 2 / F.count(x).over(by))
    assert rows.select(pct_rank(x, F.col("g")).alias("p"), both.alias("q")).where("not (p <=> q)").count() == 0
