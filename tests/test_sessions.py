"""Factors of one day against full windows on a calendar with week-ends, holidays and suspended names."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import factors
from tidemark.operators.sessions import history_cuts, history_index, recent, session_back, session_index

SCHEMA = "symbol string, trade_date date, close double, volume long, amount double"
HOLIDAYS = {dt.date(2024, 10, d) for d in range(1, 8)} | {dt.date(2025, 1, 28) + dt.timedelta(days=n) for n in range(8)}


def business_days(n: int, start: dt.date = dt.date(2023, 6, 1)) -> list[dt.date]:
    out, day = [], start
    while len(out) < n:
        if day.weekday() < 5 and day not in HOLIDAYS:
            out.append(day)
        day += dt.timedelta(days=1)
    return out


@pytest.fixture(scope="module")
def calendar() -> list[dt.date]:
    return business_days(520)


@pytest.fixture(scope="module")
def market(spark, calendar):
    """Plain names, one suspended for long in the middle, one back on the last day only, one new, one gone, one that misses the last day."""
    gone = {"steady": set(), "other": set(), "suspended": set(range(150, 420)), "back": set(range(210, 519)), "new": set(range(330)), "left": set(range(300, 520)), "absent": {519}, "late-left": set(range(490, 520))}
    rng, rows = np.random.default_rng(3), []
    for symbol, out in gone.items():
        close = 10.0
        for n, day in enumerate(calendar):
            close *= 1 + rng.normal() * 0.02
            if n not in out:
                rows.append((symbol, day, None if (symbol == "other" and n == 500) else close, int(rng.integers(1, 9_000)), close * 1_000))
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_day_factors_equal_full_windows(spark, market, calendar):
    day = F.lit(calendar[-1])
    part = recent(market, day, F.lit(calendar[40]))
    got = factors.bar_factors(part, day)
    want = factors.price_factors(market).join(factors.risk_factors(market), ["symbol", "trade_date"]).join(factors.momentum_factors(market), ["symbol", "trade_date"]).where(F.col("trade_date") == day)
    names = [c for c in want.columns if c in got.columns and c not in ("symbol", "trade_date")]
    a = {r["symbol"]: r for r in got.collect()}
    b = {r["symbol"]: r for r in want.collect()}
    assert set(a) == set(b) == {"steady", "other", "suspended", "back", "new"} and len(names) > 15
    for symbol, row in b.items():
        for name in names:
            assert (a[symbol][name] is None) == (row[name] is None), (symbol, name)
            assert row[name] is None or a[symbol][name] == pytest.approx(row[name], abs=1e-9), (symbol, name)
    # The case that a look-back over calendar days lost: 250 rows need about 365 days.
    assert a["steady"]["close_position_250"] is not None and a["suspended"]["close_position_250"] is not None and a["back"]["dist_to_52w_high"] is None
    base = {r["symbol"]: r["c"] for r in market.where(F.col("trade_date") <= calendar[40]).groupBy("symbol").agg(F.max_by("close", "trade_date").alias("c")).collect()}
    last = {r["symbol"]: r["close"] for r in market.where(F.col("trade_date") == day).collect()}
    assert a["steady"]["ret_since_base"] == pytest.approx(last["steady"] / base["steady"] - 1)


def test_recent_reads_no_more_than_it_needs(market, calendar):
    part = recent(market, F.lit(calendar[-1]))
    kept = {r["symbol"]: (r["n"], r["earlier"]) for r in part.groupBy("symbol", "earlier").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = {r["symbol"]: r["n"] for r in market.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert "left" not in kept  # no row in the last 61 sessions
    for symbol, (n, earlier) in kept.items():
        assert n + earlier == whole[symbol] and n >= min(251, whole[symbol]) and n <= 251 + 23
    assert kept["steady"][1] > 200


def test_cuts_of_an_empty_or_short_history(spark, market, calendar):
    none = market.where("false")
    assert recent(none, F.lit(calendar[-1])).count() == 0
    cuts = history_cuts(history_index(market.where(F.col("symbol") == "new"), None), 10_000).first()
    assert cuts["earlier"] == 0 and cuts["since"] == calendar[330].replace(day=1) and cuts["base_close"] is None


def test_sessions_are_dates_with_rows(spark, market, calendar):
    index = {r["trade_date"]: r["session"] for r in session_index(market).collect()}
    assert index == {d: n + 1 for n, d in enumerate(calendar)}
    back = lambda day, n: spark.range(1).select(session_back(market, F.lit(day), n).alias("d")).first()["d"]
    assert back(calendar[-1], 20) == calendar[-20]
    assert back(calendar[-1] + dt.timedelta(days=30), 1) == calendar[-1]
    assert back(calendar[3], 20) == calendar[0] and back(dt.date(2020, 1, 1), 5) is None


def test_listed_days_count_sessions(spark, calendar):
    """The window of 20 sessions holds listings that 20 calendar days would miss."""
    day, symbols = F.lit(calendar[-1]), spark.createDataFrame([("a",), ("b",), ("c",)], "symbol string")
    listed = [("z", d, "x") for d in calendar] + [("a", calendar[-20], "x+y"), ("a", calendar[-21], "x"), ("b", calendar[-1], "y")]
    themes = spark.createDataFrame(listed, "symbol string, trade_date date, reason string")
    got = {r["symbol"]: r["theme_days_20"] for r in factors.theme_factors(symbols, themes, day, session_back(themes, day, 20)).collect()}
    assert got == {"a": 1, "b": 1, "c": 0}
    trades = themes.withColumn("net_buy", F.lit(2).cast("decimal(18,4)")).withColumn("event_id", F.monotonically_increasing_id())
    got = {r["symbol"]: (r["lhb_count_20"], r["lhb_net_buy_20"]) for r in factors.capital_factors(symbols, trades, day, session_back(trades, day, 20)).collect()}
    assert got == {"a": (1, 2.0), "b": (1, 2.0), "c": (0, 0.0)}
