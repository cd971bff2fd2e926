"""Operators on small tables: missing values, accounting, causality, idempotence, conservation."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import full, nullable_mean, pct_rank
from tidemark.operators import daily, factors
from tidemark.operators.asof import strict_asof
from tidemark.operators.funnel import Spec, SpecError, funnel, parse_range
from tidemark.operators.keyed import insert_absent, replace_days, split_tags, upsert
from tidemark.operators.replay import Account, Rules, affordable, capped_weights, play
from tidemark.operators.scores import WEIGHTS, WeightError, checked_weights, pool_scores


@pytest.fixture(scope="module")
def small_panel(spark):
    start = dt.date(2025, 1, 1)
    rows = []
    for k, symbol in enumerate(("000001", "000002")):
        for n in range(300):
            close = float(10 + 0.01 * n * (k + 1) + 0.3 * np.sin(n * (k + 2)))
            rows.append((symbol, start + dt.timedelta(days=n), n, close, close * 1.01, close * 0.99, close, close, 1000, 10_000.0 + n))
    return spark.createDataFrame(rows, "symbol string, trade_date date, n int, open double, high double, low double, close double, pre_close double, volume long, amount double")


@pytest.mark.parametrize(
    ("raw", "want"),
    [(1.5, (1.5, None)), (">1.5", (1.5, None)), (">= 1.5", (1.5, None)), ("<2", (None, 2.0)), ("<=2", (None, 2.0)), ([None, 3], (None, 3.0)), ((1, 3), (1.0, 3.0)), ({"min": 1}, (1.0, None)), ({"min": 1, "max": 0}, (1.0, 0.0)), ("7", (7.0, None))],
)
def test_range_forms(raw, want):
    assert parse_range(raw) == want


@pytest.mark.parametrize("raw", [True, "x", float("nan"), float("inf"), [3, 1], [1], {}, {"low": 1}, [None, None], None])
def test_range_rejects(raw):
    with pytest.raises(SpecError):
        parse_range(raw)


def test_spec_rejects_unknown_and_position_sort():
    for bad in ({"nope": 1}, {"filters": {"nope": 1}}, {"sort_by": "pos"}, {"limit": 0}, {"limit": True}, {"sort_by": "nope"}):
        with pytest.raises(SpecError):
            Spec.from_dict(bad, {"ret", "pos"}, {"pos"})


def test_funnel_adds_up_and_keeps_missing_apart(spark):
    rows = spark.createDataFrame([("a", None, 1.0), ("b", "X", None), ("c", "ST x", 1.0), ("d", "y", 0.1)], "symbol string, name string, ret double").withColumn("theme_tags", F.lit(None).cast("string"))
    found = {r["reason"]: r["n"] for r in funnel(rows, Spec.from_dict({"ret": 0.5}, {"ret"})).collect()}
    assert found == {"kept": 1, "ret: missing": 1, "risk name": 1, "ret: out of range": 1}
    absent = {r["reason"]: r["n"] for r in funnel(rows, Spec({"gone": (0.0, None)}, exclude_risk_names=False)).collect()}
    assert absent == {"gone: absent": 4}


def test_whole_tags_only(spark):
    rows = spark.createDataFrame([("a", "算力|CPO"), ("b", "算力租赁"), ("c", None)], "name string, theme_tags string")
    any_of = funnel(rows, Spec(themes_any=("算力",))).collect()
    assert {r["reason"]: r["n"] for r in any_of} == {"kept": 1, "theme missing": 2}
    none_of = funnel(rows, Spec(themes_none=("算力",))).collect()
    assert {r["reason"]: r["n"] for r in none_of} == {"kept": 2, "theme excluded": 1}


def test_pct_rank_ties_and_missing(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 3.0), (4, None)], "i int, x double")
    got = {r["i"]: r["p"] for r in rows.select("i", pct_rank(F.col("x")).alias("p")).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 1.0, 4: None}


def test_nullable_mean(spark):
    row = spark.range(1).select(nullable_mean(F.lit(1.0), F.lit(None).cast("double"), F.lit(3.0)).alias("a"), nullable_mean(F.lit(None).cast("double")).alias("b")).first()
    assert (row["a"], row["b"]) == (2.0, None)


def test_full_window_only(spark, small_panel):
    got = small_panel.where("symbol = '000001'").select("n", full(F.avg, F.col("close"), factors.rows_back(20), 20).alias("m")).collect()
    assert [r["n"] for r in got if r["m"] is not None] == list(range(19, 300))


def test_factors_do_not_look_ahead(spark, small_panel):
    cut = F.lit("2025-09-15").cast("date")
    changed = small_panel.withColumn("close", F.when(F.col("trade_date") > cut, F.col("close") * 9).otherwise(F.col("close")))
    for make in (factors.price_factors, factors.risk_factors, factors.momentum_factors):
        before = make(small_panel).where(F.col("trade_date") <= cut)
        after = make(changed).where(F.col("trade_date") <= cut)
        assert before.exceptAll(after).count() == 0 and before.count() == after.count()


def test_daily_features_by_hand(spark, small_panel):
    day = F.lit("2025-10-07").cast("date")
    p = daily.Protocol()
    got = {r["symbol"]: r for r in daily.daily_features(small_panel, day, p).collect()}
    rows = [r for r in small_panel.where("symbol = '000002'").orderBy("trade_date").collect() if r["trade_date"] <= dt.date(2025, 10, 7)][-250:]
    c = np.array([r["close"] for r in rows])
    r = c[1:] / c[:-1] - 1
    assert got["000002"]["trend"] == pytest.approx(c[-21] / c[-121] - 1)
    assert got["000002"]["stability"] == pytest.approx(-r[-60:].std())
    assert got["000002"]["pullback"] == pytest.approx(-(c[-1] / c[-6] - 1))
    assert got["000002"]["ma120"] == pytest.approx(c[-120:].mean())


def test_upsert_insert_and_day_replace(spark):
    schema = "k int, day string, v int"
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], schema), spark.createDataFrame([(2, "b", 5), (2, "b", 9), (3, "b", 3)], schema)
    order = [F.desc("v")]
    once = upsert(old, new, ["k"], order)
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "b", 9), (3, "b", 3)]
    assert sorted(map(tuple, upsert(once, new, ["k"], order).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, insert_absent(old, new, ["k"], order).collect())) == [(1, "a", 1), (2, "b", 2), (3, "b", 3)]
    assert sorted(map(tuple, replace_days(old, new, "day").collect())) == [(1, "a", 1), (2, "b", 5), (2, "b", 9), (3, "b", 3)]


def test_split_tags_keeps_order(spark):
    row = spark.range(1).select(split_tags(F.lit("白酒+ 央企、白酒,,CPO|x/y")).alias("t")).first()
    assert row["t"] == ["白酒", "央企", "CPO", "x", "y"]


def test_asof_is_strict_and_goes_stale(spark):
    day = lambda n: dt.date(2025, 1, n)
    observed = spark.createDataFrame([("s", day(1), 100.0), ("s", day(2), 110.0), ("s", day(5), 220.0)], "id string, day date, level double")
    grid = spark.createDataFrame([("s", day(n)) for n in (1, 2, 3, 6, 20)], "id string, day date")
    got = {r["day"].day: r["level"] for r in strict_asof(grid, observed, ["id"], "day", ["level"], 7).collect()}
    assert got == {1: None, 2: 100.0, 3: 110.0, 6: 220.0, 20: None}


def test_scores_are_renormalised_over_what_is_there(spark):
    rows = spark.createDataFrame([("a", 0.1, None), ("b", 0.2, 5.0), ("c", None, None)], "symbol string, ret_20 double, turnover_value_20 double")
    got = {r["symbol"]: (r["score"], r["score_coverage"]) for r in pool_scores(rows, {"momentum": 0.6, "liquidity": 0.4}).collect()}
    assert got["a"] == (pytest.approx(0.5), pytest.approx(0.6)) and got["b"] == (pytest.approx(1.0), pytest.approx(1.0)) and got["c"] == (None, None)


@pytest.mark.parametrize("weights", [{"close_position_20": 1}, {"nope": 1}, {"risk": -1}, {"risk": 0}, {"risk": float("inf")}])
def test_weights_are_checked(weights):
    with pytest.raises(WeightError):
        checked_weights(weights)
    assert sum(checked_weights(WEIGHTS).values()) == pytest.approx(1.0)


def test_capped_weights():
    w = capped_weights(np.array([10.0, 1.0, 1.0, 1.0, 1.0]), 0.3)
    assert w.sum() == pytest.approx(1) and w.max() == pytest.approx(0.3) and w[1] == pytest.approx(0.175)
    assert capped_weights(np.array([1.0, 1.0]), 0.1) == pytest.approx([0.5, 0.5])


def test_orders_keep_what_the_account_is_worth():
    account = Account(2, 0.001)
    account.trade(0, 0.4, 10.0)
    account.trade(0, -0.1, 10.0)
    assert account.value() + account.paid == pytest.approx(1.0) and account.traded == pytest.approx(0.5)
    weights = np.array([0.5, 0.5])
    goal = affordable(np.zeros(2), weights, 1.0, 0.0, 1.0, 0.001)
    assert goal * 1.001 == pytest.approx(1.0)


def test_replay_blocks_limit_down_and_counts_fees():
    day = lambda o, c, p: {"open": np.array(o), "high": np.array(c) * 1.01, "low": np.array(c) * 0.99, "close": np.array(c), "prior": np.array(p), "volume": np.ones(2), "risk": np.zeros(2, bool), "growth": np.zeros(2, bool), "vol": np.ones(2), "rank": np.array([1.0, 2.0]), "exposure": 1.0}
    days = [day([10.0, 10.0], [10.0, 10.0], [10.0, 10.0]), day([8.0, 10.0], [8.0, 10.0], [10.0, 10.0])]
    days[1]["rank"] = np.array([np.nan, 1.0])
    path, account, blocked = play(days, Rules(1, 1, 1), 0.001)
    assert blocked == 1 and account.held.sum() == 0
    assert path[-1] == pytest.approx(0.8 / 1.001 * 0.999)


def test_buy_fills_match_the_lot_loop(spark):
    p = daily.Protocol()
    rng = np.random.default_rng(3)
    quotes = [(f"{i:06d}", "x", float(o), 10.0, 100) for i, o in enumerate(np.r_[rng.uniform(0.01, 60, 300), 0.004, 199.0, 200.0])]
    quotes = [(s, n, o, o, v) for s, n, o, _, v in quotes]
    rows = spark.createDataFrame(quotes, "symbol string, name string, open double, pre_close double, volume int")
    for r in daily.buy_fills(rows, F.lit(20_000.0), p).collect():
        q = int(20_000 / (r["open"] * 100)) * 100
        while q > 0 and q * r["open"] + max(q * r["open"] * 0.002, 5) > 20_000:
            q -= 100
        assert r["quantity"] == q, r
