"""The model comparison: what its rows cost on disk."""

from __future__ import annotations

import pytest

from tidemark.operators import rolling
from tidemark.plans import models
from tidemark.sources.market import panel


class Stop(Exception):
    pass


def shuffles(rows):
    return rows._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_all_features_take_the_shuffle_of_the_trades_only(spark, sf_dir):
    """Wide rows are dealt out neither before their windows nor behind them."""
    assert shuffles(rolling.features(panel(spark, sf_dir))) == 1


def test_learners_rows_are_small_and_take_the_shuffle_of_the_trades_only(spark, sf_dir, monkeypatch):
    """Labels come from the windows that the features have, not from a join; the 157 features themselves are not written."""
    seen = []

    def stop(rows, name):
        assert {kind for _, kind in rows.dtypes} == {"date", "double", "bigint"} and len(rows.columns) <= 5 + 2 * 14
        seen.append(shuffles(rows))
        raise Stop

    monkeypatch.setattr(models, "materialise", stop)
    with pytest.raises(Stop):
        models.model_comparison(spark, sf_dir)
    assert seen == [1]


def test_kept_columns_stay_with_their_rows(spark, sf_dir):
    rows = panel(spark, sf_dir).withColumns(rolling.label_columns())
    kept = rolling.features(rows, (rolling.ranks, rolling.stats), (5,), keep=("label", "label_end", "eligible"))
    plain = rolling.features(panel(spark, sf_dir), (rolling.ranks, rolling.stats), (5,)).join(rolling.forward_labels(panel(spark, sf_dir)), ["symbol", "trade_date"]).select(kept.columns)
    assert kept.count() == plain.count() > 0
    assert kept.exceptAll(plain).isEmpty()
