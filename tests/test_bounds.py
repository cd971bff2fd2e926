"""Steps whose memory must not grow with the tables: tasks in proportion to the rows."""

from __future__ import annotations

import pytest

from tidemark.plans.factors import tag_heat
from tidemark.plans.research import daily_ic
from tidemark.sources import market, tables


@pytest.mark.parametrize("made", [market.panel, market.theme_days, daily_ic, tag_heat])
def test_tasks_grow_with_the_rows(spark, sf_dir, monkeypatch, made):
    n = tables.table(spark, sf_dir, "lineitem").count()
    for rows in (n // 12, n // 48):
        monkeypatch.setattr(tables, "TASK_ROWS", rows)
        found = made(spark, sf_dir)
        assert found.rdd.getNumPartitions() == -(-n // rows)
