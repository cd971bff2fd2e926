"""The factor table with some of its columns equals the same columns of the whole table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.plans import factors


@pytest.fixture(scope="module")
def whole(spark, sf_dir):
    return factors.factor_table(spark, sf_dir).cache()


def rows(df, names):
    shown = df.select("symbol", *[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.select(*names).dtypes])
    return sorted(map(str, shown.collect()))


@pytest.mark.parametrize(
    "names",
    [("close", "ret_20"), ("theme_tags", "name"), ("listed_days", "turnover_value_20"), ("lhb_net_buy_rel",), ("pe_industry_value", "market_cap"), ("industry_score",), ("industry_score", "pe_ttm", "roe_avg"), ("positive_profit_streak", "theme_days_20", "industry")],
)
def test_some_columns_equal_those_of_the_whole_table(spark, sf_dir, whole, names):
    found = factors.factor_table(spark, sf_dir, *names)
    assert found.columns == ["symbol", *names]
    assert rows(found, names) == rows(whole, names)


def test_sources_that_no_column_needs_are_not_read(spark, sf_dir):
    plan = lambda *names: factors.factor_table(spark, sf_dir, *names)._jdf.queryExecution().optimizedPlan().toString()
    few, more = plan("close", "ret_20"), plan("close", "lhb_net_buy_20", "roe_avg")
    assert few.count("Relation") < more.count("Relation")
    assert "event_id" not in few and "event_id" in more
