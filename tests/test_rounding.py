"""Rounding as SQL does it, and steps of many expressions in parts that are compiled."""

from __future__ import annotations

import duckdb
import pytest

from tidemark.functions.scalars import rounded
from tidemark.operators import rolling
from tidemark.sources.market import panel

VALUES = [0.0, -0.0, 0.5, -0.5, 1.5, 2.675, -2.675, 1.0000005, 0.1234565, -0.1234565, 1e-9, 123456.7890125, 3e9 + 0.123456789, 1e14, -1e16, 1e300, 5e-324, None]


@pytest.mark.parametrize("digits", [0, 2, 4, 6, 8, 12])
def test_rounds_as_sql(spark, digits):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, x double").repartition(2)
    got = {r["i"]: r["y"] for r in rows.select("i", (rounded(rows.x, digits) + 0.0).alias("y")).collect()}
    want = dict(duckdb.connect().execute(f"SELECT i, round(x, {digits}) + 0.0 FROM (SELECT unnest(range({len(VALUES)})) AS i, unnest(?::DOUBLE[]) AS x)", [VALUES]).fetchall())
    assert all(got[i] == want[i] if want[i] is None or abs(VALUES[i]) * 10**digits < 1e15 else got[i] == pytest.approx(want[i], rel=1e-12) for i in want)


def test_not_a_number_and_infinity_stay(spark):
    got = [r[0] for r in spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),)], "x double").select(rounded(rolling.F.col("x"), 6)).collect()]
    assert got[0] != got[0] and got[1:] == [float("inf"), float("-inf")]


def test_features_are_not_interpreted(spark, sf_dir):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    rolling.features(panel(spark, sf_dir), (rolling.correlations,))
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
