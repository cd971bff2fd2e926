"""Formulas against the builders, against pandas, and what the language refuses."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import formulas, rolling

SCHEMA = "symbol string, trade_date date, n int, open double, high double, low double, close double, volume long, amount double"


@pytest.fixture(scope="module")
def bars(spark):
    rng, rows = np.random.default_rng(5), []
    for symbol, length in (("a", 620), ("b", 70), ("c", 3)):
        close = 20.0
        for n in range(length):
            opened = close * (1 + rng.normal() / 90)
            close = round(opened * (1 + rng.normal() / 60), 3)
            high, low = max(opened, close) * 1.01, min(opened, close) * 0.98
            rows.append((symbol, dt.date(2024, 1, 1) + dt.timedelta(days=n), n + 1, opened, high, low, close, int(rng.integers(1, 50)), close * 1e4))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def by_key(df):
    return df.toPandas().sort_values(["symbol", "trade_date"]).reset_index(drop=True)


def test_all_features_equal_the_builders(bars):
    texts = formulas.feature_formulas()
    assert len(texts) == 157
    got, want = by_key(formulas.evaluate(bars, texts)), by_key(rolling.features(bars))
    assert set(texts) | {"symbol", "trade_date"} == set(want.columns) and len(got) == len(want) == 693
    for name in texts:
        a, b = got[name].to_numpy(float), want[name].to_numpy(float)
        off = np.isnan(a) != np.isnan(b)
        # Without movement the builders' shares are 0 over a tiny number or nothing at all.
        assert off.sum() <= 3 * 3, (name, np.flatnonzero(off))
        np.testing.assert_allclose(a[~off], b[~off], rtol=1e-7, atol=1e-7, err_msg=name)


def test_nested_windows_against_pandas(bars):
    texts = {"x": "Max(Mean(Ref($close, 2), 30), 300) / Min($low, 1)", "y": "Sum(Std($close / Ref($close, 1) - 1, 8) > 0.02, 260)", "z": "Quantile($volume, 9, 0.35) - -Rank(0 - $close, 11)", "w": "IdxMin(Mean($high, 3), 7)", "v": "Corr(Mean($close, 4), $volume, 33)"}
    got, frame = by_key(formulas.evaluate(bars, texts)), by_key(bars)
    want = []
    for _, g in frame.groupby("symbol"):
        roll = lambda s, n: s.rolling(n, min_periods=1)
        ret = g.close / g.close.shift(1) - 1
        m3 = roll(g.high, 3).mean()
        want.append(pd.DataFrame({
            "x": roll(roll(g.close.shift(2), 30).mean(), 300).max() / g.low,
            "y": roll((roll(ret, 8).std() > 0.02).astype(float), 260).sum(),
            "z": roll(g.volume.astype(float), 9).quantile(0.35) + roll(-g.close, 11).rank(pct=True),
            "w": roll(m3, 7).apply(lambda a: a.argmin() + 1, raw=True),
            "v": roll(roll(g.close, 4).mean(), 33).corr(g.volume),
        }))
    want = pd.concat(want)
    for name in texts:
        np.testing.assert_allclose(got[name].to_numpy(float)[2:], want[name].to_numpy(float)[2:], rtol=1e-7, atol=1e-7, err_msg=name)


def test_equal_parts_are_one_column():
    parts = [formulas.parse("Mean($close, 5) / Mean($close, 5)"), formulas.parse("1 + Mean(close,5)")]
    assert len(formulas.Compiler(parts).windowed) == 1
    assert formulas.reach(formulas.parse("Mean(Ref($close, 3), 10) + Max($low, 12)")) == 12
    assert formulas.depth(formulas.parse("Max(Mean(Ref($close, 3), 10), 2)")) == 3
    assert formulas._chain({60, 5}) == [(1, 0), (2, 1), (4, 2), (5, 4), (10, 5), (20, 10), (40, 20), (60, 40)]


@pytest.mark.parametrize(
    "text",
    ["", "$close +", "__import__('os')", "$close.real", "$secret", "Mean($close)", "Mean($close, 0)", "Mean($close, 2.5)", "Mean($close, $volume)", "Mean($close, 9999999)", "Quantile($close, 5, 1.5)", "Mean($close, n=5)", "[1,2]", "$close if 1 else 2", "lambda: 1", "$close ** 2", "$close and $open", "1 < $close < 2", "$close == 1", "Median($close, 5)", "'text'", "True", "1e400", "(" * 300 + "1" + ")" * 300, "+".join(["$close"] * 4000), "(yield)", "$close[0]", "f'{1}'"],
)
def test_what_is_not_in_the_language_is_refused(text):
    with pytest.raises(formulas.FormulaError):
        formulas.parse(text)


def test_missing_values_and_filters(spark):
    rows = [("a", dt.date(2024, 1, d), d, 1.0, 2.0, 1.0, c, 5, 1.0) for d, c in enumerate([1.0, None, 3.0, 0.0, 5.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = by_key(formulas.evaluate(df, {"m": "Mean($close, 2)", "r": "Ref($close, 1)", "up": "$close > Ref($close, 1)", "div": "1 / $close", "big": "Greater($close, 2)", "i": "IdxMax($close, 3)"}))
    none = float("nan")
    for name, want in {"m": [1, 1, 3, 1.5, 2.5], "r": [none, 1, none, 3, 0], "up": [0, 0, 0, 0, 1], "div": [1, none, 1 / 3, none, 0.2], "big": [2, none, 3, 2, 5], "i": [1, 1, 3, 2, 3]}.items():
        np.testing.assert_allclose(got[name].to_numpy(float), want, err_msg=name)
    assert [r["close"] for r in formulas.matching(df, "$close > 2", ("close",)).orderBy("trade_date").collect()] == [3.0, 5.0]
    assert formulas.matching(df, "Mean($close, 3) > 100").count() == 0
    assert formulas.evaluate(df.limit(0), {"m": "Mean($close, 2)"}).count() == 0
