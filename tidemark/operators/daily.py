"""Daily picks: three-factor features, gated selection with an industry cap, fills, cohorts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import change, pct_rank, true
from tidemark.session import materialise


@dataclass(frozen=True)
class Protocol:
    """The frozen rules of the daily model."""

    selection_count: int | None = 5
    holding_sessions: int = 20
    trend: float = 0.4
    stability: float = 0.4
    pullback: float = 0.2
    minimum_price: float = 3.0
    minimum_amount_20: float = 1e8
    maximum_per_industry: int | None = 1
    minimum_market_breadth: float = 0.40
    initial_capital: float = 100_000.0
    lot_size: int = 100
    cost_bps_per_side: float = 20.0
    minimum_cost_per_order: float = 5.0
    bars: int = 250


UNKNOWN_INDUSTRY = "行业未识别"
LIMIT_UP, LIMIT_DOWN, PRIOR_TOLERANCE = 1.095, 0.905, 0.005


def daily_features(panel: DataFrame, day: Column, p: Protocol) -> DataFrame:
    """Features of symbols whose last ``bars`` bars are all valid and end on ``day``; no later bar is seen."""
    back = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    rows = panel.where(F.col("trade_date") <= day).withColumn("k", F.row_number().over(back) - 1).where(F.col("k") <= p.bars - 1)
    rows = rows.withColumn("r", F.when(F.col("k") < p.bars - 1, change(F.col("close"), F.lead("close").over(back))))
    valid = F.least("open", "high", "low", "close", "amount") > 0
    at = lambda n: F.max(F.when(F.col("k") == n, F.col("close")))
    last = lambda x: F.max(F.when(F.col("k") == 0, x))
    ordered = (F.col("low") <= F.least("open", "close")) & (F.greatest("open", "close") <= F.col("high"))
    by = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("history_days"), F.count_if(true(valid)).alias("n_valid"), F.max("trade_date").alias("last_date"),
        at(0).alias("close"), (at(20) / at(120) - 1).alias("trend"),
        (-F.stddev_pop(F.when(F.col("k") < 60, F.col("r")))).alias("stability"),
        (-(at(0) / at(5) - 1)).alias("pullback"),
        F.avg(F.when(F.col("k") < 120, F.col("close"))).alias("ma120"),
        F.avg(F.when(F.col("k") < 20, F.col("amount"))).alias("amount_20"),
        last((F.col("volume") > 0) & (F.col("amount") > 0)).alias("active"), last(ordered).alias("valid_ohlc"),
    )
    return by.where((F.col("history_days") == p.bars) & (F.col("n_valid") == p.bars) & (F.col("last_date") == day)).drop("n_valid", "last_date")


def daily_name(name: Column) -> Column:
    """A name without a mark of risk in any case; a missing name fails."""
    return name.isNotNull() & ~F.coalesce(name.rlike("(?i)ST|退"), F.lit(False))


def tests(day: Column, p: Protocol) -> list[tuple[str, Column]]:
    """The conjunctive tests in order; the first is also the base of the market's breadth."""
    c = F.col
    base = daily_name(c("name")) & (F.datediff(day, c("listed_date")) >= 365) & c("active") & c("valid_ohlc")
    return [
        ("base", true(base)),
        ("price and liquidity", true((c("close") >= p.minimum_price) & (c("amount_20") >= p.minimum_amount_20))),
        ("trend", true((c("trend") > 0) & (c("close") > c("ma120")))),
        ("complete", c("trend").isNotNull() & c("stability").isNotNull() & c("pullback").isNotNull()),
    ]


def daily_funnel(rows: DataFrame, day: Column, p: Protocol) -> DataFrame:
    """One row: cumulative counts after each test, and the breadth, in a single aggregate."""
    passed, out = F.lit(True), []
    for i, (_, test) in enumerate(tests(day, p)):
        passed = passed & test
        out.append(F.count_if(passed).alias(f"after_{i + 1}"))
    base = tests(day, p)[0][1]
    return rows.agg(F.count(F.lit(1)).alias("universe"), *out, F.avg(F.when(base, F.when(F.col("close") > F.col("ma120"), 1.0).otherwise(0.0))).alias("breadth"))


def daily_picks(rows: DataFrame, day: Column, p: Protocol) -> DataFrame:
    """Up to ``selection_count`` symbols by score, at most ``maximum_per_industry`` of each industry; None is no limit.

    Nothing is picked on a day whose breadth is under the gate. The order is the
    same for all industries, so a rank within the industry equals taking them
    greedily.
    """
    rows = materialise(rows, "daily-rows")  # one row a symbol, read for the breadth and for the pool
    passed = F.lit(True)
    for _, test in tests(day, p):
        passed = passed & test
    gate = daily_funnel(rows, day, p).select(F.coalesce(F.col("breadth") >= p.minimum_market_breadth, F.lit(False))).scalar()
    pool = rows.where(passed & gate).withColumn("industry", F.coalesce(F.nullif(F.trim("industry"), F.lit("")), F.lit(UNKNOWN_INDUSTRY)))
    parts = {"trend": p.trend, "stability": p.stability, "pullback": p.pullback}
    pool = pool.select("*", *[pct_rank(F.col(n)).alias(f"rank_{n}") for n in parts])
    pool = pool.withColumn("score", F.col("rank_trend") * p.trend + F.col("rank_stability") * p.stability + F.col("rank_pullback") * p.pullback)
    within = F.row_number().over(Window.partitionBy("industry").orderBy(F.desc("score"), "symbol"))
    capped = pool.withColumn("nth", within)
    if p.maximum_per_industry is not None:
        capped = capped.where(F.col("nth") <= p.maximum_per_industry)
    return capped if p.selection_count is None else capped.orderBy(F.desc("score"), "symbol").limit(p.selection_count)


def order_cost(notional: Column, p: Protocol) -> Column:
    return F.when(notional > 0, F.greatest(notional * (p.cost_bps_per_side / 10_000), F.lit(p.minimum_cost_per_order))).otherwise(0.0)


def buy_fills(quotes: DataFrame, budget: Column, p: Protocol) -> DataFrame:
    """Quantity, cost, spending and reason of an order at the open: the most whole lots whose price and cost fit the budget.

    A cost is a share of the price or the least cost, so that the most lots are
    the smaller of two quotients; one lot to either side makes up for rounding.
    """
    c = F.col
    name = F.upper(F.coalesce("name", F.lit("")))
    reason = (
        F.when(name.contains("ST") | name.contains("退"), "risk name")
        .when(~true((c("open") > 0) & (c("pre_close") > 0) & (c("volume") > 0)), "no valid open")
        .when(c("open") / c("pre_close") >= LIMIT_UP, "limit up")
    )
    lot = c("open") * p.lot_size
    value = lambda n: n * p.lot_size * c("open")
    n = F.floor(F.least(budget / (lot * (1 + p.cost_bps_per_side / 10_000)), (budget - p.minimum_cost_per_order) / lot))
    fits = lambda k: (k > 0) & (value(k) + order_cost(value(k), p) <= budget)
    fits = F.when(fits(n + 1), n + 1).when(fits(n), n).when(fits(n - 1), n - 1).otherwise(0)
    rows = quotes.withColumn("refused", reason).withColumn("quantity", F.when(c("refused").isNull(), fits * p.lot_size).otherwise(0))
    rows = rows.withColumn("refused", F.when(c("refused").isNull() & (c("quantity") == 0), "less than a lot").otherwise(c("refused")))
    cost = order_cost(c("quantity") * c("open"), p)
    return rows.withColumn("cost", F.when(c("quantity") > 0, cost).otherwise(0.0)).withColumn("spent", c("quantity") * F.coalesce("open", F.lit(0.0)) + c("cost")).withColumn("reason", F.coalesce("refused", F.lit("filled"))).drop("refused")


def pool_return(pool: DataFrame, entry: DataFrame, exits: DataFrame, p: Protocol) -> DataFrame:
    """Mean net return of all pool symbols; NULL if a quote is missing, blocked entries count 0."""
    rate = p.cost_bps_per_side / 10_000
    a = entry.select("symbol", F.col("open").alias("a_open"), F.col("pre_close").alias("a_prior"), F.col("volume").alias("a_volume"), F.upper("name").alias("a_name"))
    b = exits.select("symbol", F.col("close").alias("b_close"))
    rows = pool.select("symbol").join(a, "symbol", "left").join(b, "symbol", "left")
    blocked = (F.col("a_open") <= 0) | (F.col("a_prior") <= 0) | (F.col("a_volume") <= 0) | (F.col("a_open") / F.col("a_prior") >= LIMIT_UP) | F.coalesce(F.col("a_name").contains("ST"), F.lit(False))
    net = F.when(blocked, 0.0).otherwise(F.col("b_close") / F.col("a_open") * (1 - rate) / (1 + rate) - 1)
    gap = F.count_if(F.col("a_open").isNull() | F.col("b_close").isNull())
    return rows.agg(F.count(F.lit(1)).alias("n"), F.when(gap == 0, F.avg(net)).alias("pool_return"))


def evaluate_positions(fills: DataFrame, panel: DataFrame, p: Protocol) -> DataFrame:
    """Each filled position from its entry to the first day on which it can be left at or after the target.

    ``fills``: symbol, entry_date, price, quantity, cost. A position whose
    previous close jumps against the last seen close is put up for review; one
    whose exits are all blocked stays so; one before its target is held. All
    days of a position are ranked in one window, no loop over days.
    """
    days = panel.join(fills.select("symbol", "entry_date", "price", "quantity", F.col("cost").alias("entry_cost")), "symbol").where(F.col("trade_date") >= F.col("entry_date"))
    own = Window.partitionBy("symbol", "entry_date").orderBy("trade_date")
    days = days.withColumn("k", F.row_number().over(own)).withColumn("seen", F.lag("close").over(own))
    jump = true((F.col("seen") > 0) & (F.col("pre_close") > 0) & (F.abs(F.col("pre_close") / F.col("seen") - 1) > PRIOR_TOLERANCE))
    can_exit = true((F.col("k") >= p.holding_sessions) & (F.col("volume") > 0) & (F.col("close") / F.col("pre_close") > LIMIT_DOWN))
    first = lambda test: F.min(F.when(test, F.col("k")))
    by = days.withColumn("jump", jump).withColumn("can_exit", can_exit).groupBy("symbol", "entry_date", "price", "quantity", "entry_cost").agg(
        first(F.col("jump")).alias("jump_k"), first(F.col("can_exit")).alias("exit_k"), F.max("k").alias("last_k"),
        F.min_by("trade_date", F.when(F.col("can_exit"), F.col("k"))).alias("exit_date"), F.min_by("close", F.when(F.col("can_exit"), F.col("k"))).alias("exit_price"),
        F.max_by("close", F.when(F.col("k") <= 60, F.col("k"))).alias("last_close"),
    )
    reviewed = F.coalesce(F.col("jump_k") <= F.coalesce("exit_k", F.col("last_k")), F.lit(False))
    status = F.when(reviewed, "corporate_action_review").when(F.col("exit_k").isNotNull(), "closed").when(F.col("last_k") >= p.holding_sessions, "exit_blocked").otherwise("holding")
    by = by.withColumn("status", status)
    closed = F.col("status") == "closed"
    value = F.col("quantity") * F.col("exit_price")
    proceeds = value - order_cost(value, p)
    spent = F.col("quantity") * F.col("price") + F.col("entry_cost")
    return by.select("symbol", "entry_date", "quantity", "price", "status", F.when(closed, F.col("exit_date")).alias("exit_date"), F.when(closed, F.col("exit_price")).alias("exit_price"), F.when(closed, proceeds / spent - 1).alias("net_return"))
