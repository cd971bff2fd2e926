"""Ranks, quantiles and last states by ranges against the same over whole groups, with hot values and keys."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import pct_rank
from tidemark.operators import ranges
from tidemark.operators.asof import strict_asof


@pytest.fixture(scope="module", autouse=True)
def small_ranges_stay(spark):
    """Tables this small would be put together into one range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([1.0, 1.0, 2.5, None, float("nan"), round(rng.gauss(0, 1), 2)])) for _ in range(3_000)]
    rows += [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g string, x double")


def test_ranks_and_quantiles_equal_those_of_whole_groups(spark, values):
    clean = values.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    want = {r["i"]: r["p"] for r in clean.select("i", pct_rank(F.col("x"), F.col("g")).alias("p")).collect()}
    got = {r["i"]: r["pct"] for r in ranges.percentile_ranks(values, ["g"], "x").collect()}
    assert set(got) == set(want)
    assert all((got[i] is None) == (p is None) and (p is None or got[i] == pytest.approx(p, abs=1e-12)) for i, p in want.items())
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.987, "e": 1.0}
    want = {r["g"]: r for r in clean.groupBy("g").agg(F.count("x").alias("n"), *[F.percentile("x", s).alias(k) for k, s in shares.items()]).where("n > 0").collect()}
    got = {r["g"]: r for r in ranges.quantiles(values, ["g"], "x", shares).collect()}
    assert set(got) == set(want) and all(got[g][k] == pytest.approx(want[g][k], abs=1e-12) for g in want for k in shares)
    whole = ranges.quantiles(values, [], "x", shares).first()
    assert all(whole[k] == pytest.approx(v) for k, v in clean.agg(*[F.percentile("x", s).alias(k) for k, s in shares.items()]).first().asDict().items())


def test_one_group_is_many_ranges(spark):
    rows = spark.range(20_000).select(F.lit("all").alias("g"), (F.col("id") * 7919 % 20_000).cast("double").alias("x"))
    cut = ranges.in_ranges(rows, ["g", "x"])
    sizes = [r["n"] for r in cut.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 3 and max(sizes) < 12_000
    assert ranges.percentile_ranks(rows, ["g"], "x").agg(F.sum("pct")).first()[0] == pytest.approx(20_001 / 2)


def test_empty_ranges(values):
    none = values.where("false")
    assert ranges.percentile_ranks(none, ["g"], "x").count() == 0 and ranges.quantiles(none, ["g"], "x", {"m": 0.5}).count() == 0


@pytest.fixture(scope="module")
def histories(spark):
    """One key with most rows, keys without observations, observations before the grid only, and a null key."""
    rng, day = random.Random(4), dt.date(2020, 1, 1)
    keys = ["hot"] * 20 + ["a", "b", None]
    grid = sorted({(rng.choice(keys), day + dt.timedelta(days=rng.randrange(2_000))) for _ in range(1_500)} | {("alone", day), ("old", day + dt.timedelta(days=1_900))}, key=str)
    seen = sorted({(rng.choice(keys), day + dt.timedelta(days=rng.randrange(2_000))) for _ in range(150)} | {("old", day), ("unasked", day)}, key=str)
    return (spark.createDataFrame(grid, "k string, at date").repartition(3), spark.createDataFrame([(*s, float(n)) for n, s in enumerate(seen)], "k string, at date, v double").repartition(2), grid, [(*s, float(n)) for n, s in enumerate(seen)])


@pytest.mark.parametrize("strict", [True, False])
def test_last_states_of_one_long_history(histories, strict):
    grid, observed, asked, seen = histories
    want = {}
    for k, at in asked:
        held = [(d, v) for key, d, v in seen if key == k and (d < at if strict else d <= at)]
        want[(k, at)] = max(held) if held else (None, None)
    got = ranges.last_states(grid, observed, ["k"], "at", ["v"], strict).collect()
    assert len(got) == len(asked) and {(r["k"], r["at"]): (r["seen_at"], r["v"]) for r in got} == want


def test_last_states_equal_the_join_by_key(histories):
    grid, observed, _, _ = histories
    known = observed.where("k is not null"), grid.where("k is not null")
    a = ranges.last_states(known[1], known[0], ["k"], "at", ["v"], True, F.lit(30)).collect()
    b = strict_asof(known[1], known[0], ["k"], "at", ["v"], 30).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and any(r["v"] is None for r in a) and any(r["v"] is not None for r in a)


@pytest.mark.parametrize("few", [10, 10_000])
def test_quantiles_by_brackets_order_few_rows(spark, values, monkeypatch, few):
    rows = values.select(F.col("x").alias("a"), (F.col("x") * 1e300).alias("b"), F.when(F.col("i") == 7, 1e12).otherwise(F.col("i") * 7919 % 3001).cast("double").alias("c"), F.lit(None).cast("double").alias("d"), F.lit(2.5).alias("e"))
    ordered, whole = [], ranges.ordered_counts
    monkeypatch.setattr(ranges, "ordered_counts", lambda held, *rest: (ordered.append(held.where("column = 'c' and x is not null").count()), whole(held, *rest))[1])
    monkeypatch.setattr(ranges, "FEW", few)
    monkeypatch.setattr(ranges, "CELLS", 64)
    clean = rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in rows.columns])
    for share in (0.0, 0.37, 0.5, 0.9, 1.0):
        want = clean.agg(*[F.percentile(c, share).alias(c) for c in rows.columns]).first().asDict()
        got = ranges.column_quantile(rows, rows.columns, share)
        assert set(got) == set(want) and all((got[c] is None) == (want[c] is None) and (want[c] is None or got[c] == pytest.approx(want[c], rel=1e-12)) for c in want)
    assert all(n < 100 for n in ordered) == (few == 10)
