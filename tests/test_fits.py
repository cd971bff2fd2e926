"""A grid of fits is purged, stops early, refuses thin folds, and does nothing twice."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.operators import fits

FOLD = fits.Fold("f", "2024-01-01", "2024-03-01", "2024-04-01", "2024-05-01")


@pytest.fixture(scope="module")
def data(spark):
    rng, rows = np.random.default_rng(1), []
    for pool in "ab":
        for n in range(120):
            day = dt.date(2024, 1, 1) + dt.timedelta(days=n)
            for s in range(12):
                x = rng.normal(size=2)
                rows.append((pool, f"s{s}", day, day + dt.timedelta(days=6), float(2 * x[0] + (x[1] > 0) + rng.normal() / 5), x.tolist()))
    return spark.createDataFrame(rows, "pool string, symbol string, trade_date date, label_end date, label double, x array<double>").withColumn("features", array_to_vector("x"))


def test_labels_end_before_the_next_part(data):
    parts = {r["part"]: r for r in data.withColumn("part", FOLD.part()).groupBy("part").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"), F.max("label_end").alias("e")).collect()}
    assert parts["train"]["e"] < dt.date(2024, 3, 1) <= parts["valid"]["a"] and parts["valid"]["e"] < dt.date(2024, 4, 1) <= parts["test"]["a"]
    assert parts["test"]["b"] == dt.date(2024, 4, 29)


def test_a_finished_fold_is_not_fitted_again(spark, data, tmp_path):
    root, models = f"file://{tmp_path}/grid", {"lasso": fits.lasso(0.01), "trees": fits.trees(most=30, tolerance=0.05)}
    run = lambda plan: fits.fit_grid(data, ["a", "b"], [FOLD], models, root, plan)
    first, receipts, made = run({"v": 1})
    assert made == 4 and {r["pool"] for r in receipts} == {"a", "b"} and all(1 <= r["notes"]["trees"]["trees"] < 30 for r in receipts)
    again, same, none = run({"v": 1})
    assert none == 0 and same == receipts and sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    assert {(r["pool"], r["model"]): r["count"] for r in first.groupBy("pool", "model").count().collect()} == {(p, m): 29 * 12 for p in "ab" for m in models}
    assert first.where("model = 'lasso'").agg(F.corr("label", "prediction")).first()[0] > 0.9
    (tmp_path / "grid" / next(p.name for p in (tmp_path / "grid").iterdir()) / "b-f" / "receipt.json").unlink()  # the driver died before the receipt
    third, receipts, made = run({"v": 1})
    assert made == 2 and len(receipts) == 2 and third.count() == first.count()
    assert run({"v": 2})[2] == 4


def test_lasso_is_the_closed_form(data):
    score, notes = fits.lasso(0.3)(data.select("label", array_to_vector(F.slice("x", 1, 1)).alias("features"), F.col("x")[0].alias("x0"), F.lit("train").alias("part")))
    xy, xx = data.agg(F.avg(F.col("label") * F.col("x")[0]), F.avg(F.col("x")[0] ** 2)).first()
    assert notes["coefficients"][0] == pytest.approx((xy - 0.3) / xx, rel=1e-5)


def test_thin_folds_are_refused(data, tmp_path):
    with pytest.raises(fits.TooFewRows, match="a, f"):
        fits.fit_grid(data.limit(300), ["a"], [FOLD], {"lasso": fits.lasso(0.1)}, f"file://{tmp_path}/thin", {})
    assert not (tmp_path / "thin").exists()
