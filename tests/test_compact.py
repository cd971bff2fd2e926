"""Rows of learners in small, against the learners on the rows themselves."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from tidemark.operators import compact
from tidemark.operators.fits import TooFewRows

FIRST = dt.date(2024, 3, 1)


@pytest.fixture(scope="module")
def made(spark):
    """Features of several kinds, as plain numbers and as rows: dependent, few values, missing, no variance."""
    rng = np.random.default_rng(3)
    n = 1200
    x = rng.normal(size=(n, 15)) * 0.02 + 0.001
    x[:, 3] = x[:, 1] - x[:, 2]
    x[:, 4] = rng.integers(0, 6, n) / 5
    x[:, 5] = 0.0
    y = 0.8 * x[:, 0] - 0.6 * x[:, 7] + rng.normal(size=n) * 0.02
    gone = rng.random(n) < 0.1
    ends = [FIRST + dt.timedelta(days=int(d)) for d in rng.integers(-40, 20, n)]
    rows = [(int(k), e, float(label), [None if g and i == 9 else float("nan") if g and i == 10 else float(v) for i, v in enumerate(row)]) for k, (e, label, row, g) in enumerate(zip(ends, y, x, gone, strict=True))]
    x[gone, 9], x[gone, 10] = 0.0, 0.0
    df = spark.createDataFrame(rows, "key long, label_end date, label double, features array<double>").repartition(5)
    return x, y, np.array([e < FIRST for e in ends]), df


def test_a_lasso_needs_the_sums_only(spark, made):
    x, y, train, df = made
    sums, _ = compact.summed(df, {"a": FIRST.isoformat()}, df.count())
    z = np.column_stack([np.ones(train.sum()), x[train], y[train]])
    np.testing.assert_allclose(sums["a"], z.T @ z, rtol=1e-12)
    filled = F.transform("features", lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    raw = df.where(F.col("label_end") < F.lit(FIRST)).select("label", array_to_vector(filled).alias("features"))
    own = {"elasticNetParam": 1.0, "regParam": 0.0005, "fitIntercept": False}
    want = LinearRegression(**own).fit(raw).coefficients.toArray()
    got = LinearRegression(**own, weightCol="weight").fit(compact.points(spark, sums["a"])).coefficients.toArray()
    assert (np.abs(want) > 1e-3).sum() >= 2 and got[5] == want[5] == 0.0
    np.testing.assert_allclose(x @ got, x @ want, atol=1e-5)


def test_rows_come_back_as_bins(spark, made):
    x, y, train, df = made
    _, cuts = compact.summed(df, {"a": FIRST.isoformat()}, df.count())
    assert [len(c) for c in cuts["a"]][:6] == [31, 31, 31, 31, 5, 0]
    small = compact.narrowed(df, {"a": np.arange(15.0)}, cuts)
    got = small.select("key", "label", "linear_a", compact.bins("a", 15).alias("features")).orderBy("key").collect()
    want = np.column_stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts["a"])])
    np.testing.assert_array_equal(np.array([r["features"].toArray() for r in got]), want)
    assert want.max() == compact.BINS - 1
    np.testing.assert_allclose([r["linear_a"] for r in got], x @ np.arange(15.0))
    # Trees over bins fit as well as trees over the features.
    filled = F.transform("features", lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    errors = []
    for rows in (df.select("label", array_to_vector(filled).alias("features")), small.select("label", compact.bins("a", 15).alias("features"))):
        model = GBTRegressor(maxIter=5, maxDepth=3, stepSize=0.2, seed=7).fit(rows)
        errors.append(model.transform(rows).agg(F.avg(F.pow(F.col("prediction") - F.col("label"), 2))).first()[0])
    assert abs(errors[1] - errors[0]) < 0.02 * errors[0]


def test_thresholds_do_not_follow_the_files(made):
    _, _, _, df = made
    found = [compact.summed(df.repartition(n), {"a": FIRST.isoformat()}, df.count())[1] for n in (2, 7)]
    assert found[0] == found[1]


def test_a_fold_without_rows_is_refused(made):
    with pytest.raises(TooFewRows):
        compact.summed(made[3], {"a": "1990-01-01"}, 10)
