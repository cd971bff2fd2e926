"""Factor tables over the daily panel: price, momentum, risk, themes, capital, statements, valuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import change, full, nullable_mean, pct_rank, ratio
from tidemark.operators.keyed import split_tags


def _columns() -> tuple[Column, Column, Column]:
    """Close, volume and amount."""
    return F.col("close"), F.col("volume").cast("double"), F.col("amount")


def rows_back(n: int):
    """The current row and the ``n - 1`` before it, by symbol in date order."""
    return Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(1 - n, 0)


def at_last(rows: DataFrame, day: Column) -> DataFrame:
    return rows.where(F.col("trade_date") == day)


def price_columns() -> dict[str, Column]:
    """Position in the range, distances from highs and means, history; windows must be full."""
    C, _, A = _columns()
    out = {"history_days": F.row_number().over(Window.partitionBy("symbol").orderBy("trade_date"))}
    for n in (20, 60, 250):
        w = rows_back(n)
        low = full(F.min, C, w, n)
        out[f"close_position_{n}"] = ratio(C - low, full(F.max, C, w, n) - low)
    out["dist_to_52w_high"] = ratio(C, full(F.max, C, rows_back(250), 250)) - 1
    for n in (20, 60):
        out[f"ma{n}_dev"] = ratio(C, full(F.avg, C, rows_back(n), n)) - 1
    out["turnover_value_20"] = full(F.avg, A, rows_back(20), 20)
    return out


def momentum_columns() -> dict[str, Column]:
    """Daily return, returns over windows and volume trend, without the market."""
    C, V, _ = _columns()
    by = Window.partitionBy("symbol").orderBy("trade_date")
    trend = full(F.avg, V, rows_back(5), 5) / F.nullif(full(F.avg, V, rows_back(20), 20), F.lit(0.0))
    return {"r": change(C, F.lag("close", 1).over(by)), **{f"ret_{n}": change(C, F.lag("close", n).over(by)) for n in (20, 60)}, "volume_trend_20": trend}


def steps(panel: DataFrame) -> DataFrame:
    """The panel with daily returns and the sign of daily moves, on which the risk columns build."""
    C, _, _ = _columns()
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("trade_date"))
    return panel.withColumns({"step_r": change(C, before), "sign": F.signum(C - before)})


def deepest_fall(path: Column) -> Column:
    """The deepest fall of a path of closes from the highest one before, as a fraction; zero at best."""
    start = F.struct(F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("fall"))
    step = lambda s, x: F.struct(F.greatest(s["top"], x).alias("top"), F.least(s["fall"], x / F.greatest(s["top"], x) - 1).alias("fall"))
    return F.aggregate(path, start, step, lambda s: s["fall"])


def risk_columns() -> dict[str, Column]:
    """Volatility, downside volatility, drawdown and signed amount pressure, from ``steps``."""
    _, _, A = _columns()
    r, w20, w60 = F.col("step_r"), rows_back(20), rows_back(60)
    enough = F.count(r).over(w20) == 20
    return {
        "realized_vol_20": F.when(enough, F.stddev_pop(r).over(w20)),
        "downside_vol_20": F.when(enough, F.coalesce(F.stddev_pop(F.when(r < 0, r)).over(w20), F.lit(0.0))),
        "max_drawdown_60": F.when(F.count("close").over(w60) == 60, deepest_fall(F.collect_list("close").over(w60))),
        "signed_amount_pressure_20": F.when(F.count("sign").over(w20) == 20, ratio(F.sum(F.col("sign") * A).over(w20), F.sum("amount").over(w20))),
    }


def _with(panel: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    return panel.select(*keys, *[c.alias(k) for k, c in columns.items()])


def price_factors(panel: DataFrame) -> DataFrame:
    return _with(panel, ["symbol", "trade_date", "close", "amount"], price_columns())


def risk_factors(panel: DataFrame) -> DataFrame:
    return _with(steps(panel), ["symbol", "trade_date"], risk_columns())


def market_curve(returns: DataFrame) -> DataFrame:
    """``trade_date, market_20, market_60`` from equal-weight means of ``r``; one row a day, so its window never sees symbols."""
    days = returns.groupBy("trade_date").agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("m"))
    time = Window.orderBy("trade_date")
    return days.select("trade_date", *[F.when(F.row_number().over(time) > n, F.exp(F.sum(F.log1p("m")).over(time.rowsBetween(1 - n, 0))) - 1).alias(f"market_{n}") for n in (20, 60)])


def against_market(rows: DataFrame, curve: DataFrame) -> DataFrame:
    """Returns against the market of the same date, and their rank across symbols."""
    joined = rows.join(curve, "trade_date")
    relative = {f"relative_ret_{n}": F.col(f"ret_{n}") - F.col(f"market_{n}") for n in (20, 60)}
    return joined.withColumns(relative | {"ret_rank_20": pct_rank(F.col("ret_20"), F.col("trade_date"))}).drop("market_20", "market_60")


def momentum_factors(panel: DataFrame) -> DataFrame:
    """Returns, returns against the equal-weight market, their rank across symbols, volume trend."""
    rows = _with(panel, ["symbol", "trade_date"], momentum_columns())
    return against_market(rows, market_curve(rows)).select("symbol", "trade_date", "ret_20", "ret_60", "relative_ret_20", "relative_ret_60", "ret_rank_20", "volume_trend_20")


def counted_back(panel: DataFrame) -> DataFrame:
    """The panel with ``k``, the place of a row counted back from its symbol's last one, and the close before it."""
    back = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    return panel.withColumns({"k": F.row_number().over(back), "before": F.lead("close").over(back)})


def day_factors(rows: DataFrame, day: Column) -> DataFrame:
    """The price, momentum and risk factors of ``day`` alone, from ``counted_back`` rows that end on it.

    One day needs no sliding frames: every window is a condition on ``k`` inside
    one aggregate by symbol. Symbols without a row on the day have none.
    """
    C, V, A = _columns()
    k = F.col("k")
    r, sign = change(C, F.col("before")), F.signum(C - F.col("before"))

    def whole(aggregate, column: Column, n: int) -> Column:
        return F.when(F.count(F.when(k <= n, column)) == n, aggregate(F.when(k <= n, column)))

    def at(n: int, column: Column) -> Column:
        return F.max(F.when(k == n, column))

    close = at(1, C)
    out = {"history_days": (F.count(F.lit(1)) + F.coalesce(F.max("earlier"), F.lit(0))).cast("int"), "close": close, "amount": at(1, A)}
    for n in (20, 60, 250):
        out[f"close_position_{n}"] = ratio(close - whole(F.min, C, n), whole(F.max, C, n) - whole(F.min, C, n))
    out["dist_to_52w_high"] = ratio(close, whole(F.max, C, 250)) - 1
    out |= {f"ma{n}_dev": ratio(close, whole(F.avg, C, n)) - 1 for n in (20, 60)}
    out |= {f"ret_{n}": change(close, at(n + 1, C)) for n in (20, 60)}
    enough = F.count(F.when(k <= 20, r)) == 20
    path = F.transform(F.sort_array(F.collect_list(F.when((k <= 60) & C.isNotNull(), F.struct((-k).alias("at"), C.alias("close"))))), lambda x: x["close"])
    out |= {
        "turnover_value_20": whole(F.avg, A, 20), "volume_trend_20": ratio(whole(F.avg, V, 5), whole(F.avg, V, 20)), "ret_since_base": change(close, F.max("base_close")),
        "realized_vol_20": F.when(enough, F.stddev_pop(F.when(k <= 20, r))),
        "downside_vol_20": F.when(enough, F.coalesce(F.stddev_pop(F.when((k <= 20) & (r < 0), r)), F.lit(0.0))),
        "max_drawdown_60": F.when(F.count(F.when(k <= 60, C)) == 60, deepest_fall(path)),
        "signed_amount_pressure_20": F.when(F.count(F.when(k <= 20, sign)) == 20, ratio(F.sum(F.when(k <= 20, sign * A)), F.sum(F.when(k <= 20, A)))),
    }
    by = rows.groupBy("symbol").agg(F.max("trade_date").alias("trade_date"), *[c.alias(name) for name, c in out.items()])
    return by.where(F.col("trade_date") == day)


def day_against_market(factors: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds returns against the equal-weight market of the day, and their rank; the curve comes from the same rows."""
    curve = market_curve(rows.select("trade_date", change(F.col("close"), F.col("before")).alias("r")))
    return against_market(factors, curve)


def bar_factors(panel: DataFrame, day: Column) -> DataFrame:
    """All price, momentum and risk factors on one day from the ``sessions.recent`` part of the panel."""
    rows = counted_back(panel)
    return day_against_market(day_factors(rows, day), rows).drop("trade_date")


def theme_factors(symbols: DataFrame, themes: DataFrame, day: Column, since: Column) -> DataFrame:
    """Tags of the day and their heat, and listed days in the window that begins on ``since``.

    On a day with rows an unlisted symbol has 0; without any row it has NULL.
    """
    window = themes.where((F.col("trade_date") >= since) & (F.col("trade_date") <= day))
    today = window.where(F.col("trade_date") == day).select("symbol", split_tags(F.col("reason")).alias("tags"))
    tags = today.select("symbol", F.explode("tags").alias("tag"))
    counts = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("heat"))
    heat = tags.join(counts, "tag").groupBy("symbol").agg(F.max("heat").alias("hot"), F.sum("heat").alias("all_heat"))
    days = window.groupBy("symbol").agg(F.count_distinct("trade_date").alias("days"))
    any_today, any_days = today.agg(F.count(F.lit(1)) > 0).scalar(), window.agg(F.count(F.lit(1)) > 0).scalar()
    out = symbols.join(today, "symbol", "left").join(heat, "symbol", "left").join(days, "symbol", "left")
    return out.select(
        "symbol",
        F.when(F.size("tags") > 0, F.array_join("tags", "|")).alias("theme_tags"),
        F.when(any_today, F.coalesce("hot", F.lit(0))).alias("theme_heat_max"),
        F.when(any_today, F.coalesce("all_heat", F.lit(0))).alias("theme_heat_sum"),
        F.when(any_days, F.coalesce("days", F.lit(0))).alias("theme_days_20"),
    )


def capital_factors(symbols: DataFrame, unusual: DataFrame, day: Column, since: Column) -> DataFrame:
    """Days on the unusual-trading list and net buying in the window from ``since``; sums of nothing stay NULL."""
    window = unusual.where((F.col("trade_date") >= since) & (F.col("trade_date") <= day))
    by = window.groupBy("symbol").agg(
        F.count_distinct("trade_date").alias("days"),
        F.sum("net_buy").cast("double").alias("net"),
        F.max_by("net_buy", F.when(F.col("net_buy").isNotNull(), F.struct("trade_date", "event_id"))).cast("double").alias("last"),
        F.min_by("net_buy", F.when(F.col("net_buy").isNotNull(), F.struct("trade_date", "event_id"))).cast("double").alias("first"),
    )
    today = window.where(F.col("trade_date") == day).groupBy("symbol").agg(F.sum("net_buy").cast("double").alias("main_net_inflow"))
    any_rows = window.agg(F.count(F.lit(1)) > 0).scalar()
    return symbols.join(by, "symbol", "left").join(today, "symbol", "left").select(
        "symbol", "main_net_inflow",
        F.when(any_rows, F.coalesce("days", F.lit(0))).alias("lhb_count_20"),
        F.when(any_rows, F.when(F.col("days").isNull(), 0.0).otherwise(F.col("net"))).alias("lhb_net_buy_20"),
        change(F.col("last"), F.col("first")).alias("net_chg_20"),
    )


#: Items of the latest statement; the last one, debt, counts against safety.
QUALITY_ITEMS = ("roe_avg", "gross_profit_margin", "net_profit_margin", "current_ratio", "quick_ratio", "cash_ratio", "ebit_to_interest", "cfo_to_or", "cfo_to_np", "cfo_to_gr", "liability_to_asset")


def growth_factors(statements: DataFrame, day: Column, periods: int = 8) -> DataFrame:
    """Year-on-year changes, their acceleration, and streaks of positive quarters, as published by ``day``."""
    items = ["revenue", "net_profit", "shares", "eps", *QUALITY_ITEMS]
    newest = statements.where(F.col("pub_date") <= day).groupBy("symbol", "stat_date").agg(F.max_by(F.struct(*items), "pub_date").alias("s"))
    known = newest.select("symbol", "stat_date", "s.*")  # a restated quarter counts once, as last published
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("stat_date")))
    recent = known.withColumn("rn", place).where(F.col("rn") <= periods)
    # The same quarter one year earlier, by date and not by position.
    before = known.select("symbol", F.last_day(F.add_months("stat_date", 12)).alias("stat_date"), F.col("revenue").alias("revenue_before"), F.col("net_profit").alias("profit_before"), F.col("eps").alias("eps_before"))
    rows = recent.join(before, ["symbol", "stat_date"], "left")
    rows = rows.withColumn("revenue_yoy", change(F.col("revenue"), F.col("revenue_before"))).withColumn("profit_yoy", ratio(F.col("net_profit") - F.col("profit_before"), F.abs("profit_before")))
    rows = rows.withColumn("eps_yoy", ratio(F.col("eps") - F.col("eps_before"), F.abs("eps_before")))

    def streak(value: str) -> Column:
        stop = F.min(F.when(~F.coalesce(F.col(value) > 0, F.lit(False)), F.col("rn")))
        return F.nullif(F.coalesce(stop - 1, F.count(F.lit(1))), F.lit(0))

    def at(value: str, n: int) -> Column:
        return F.max(F.when(F.col("rn") == n, F.col(value)))

    return rows.groupBy("symbol").agg(
        at("revenue_yoy", 1).alias("revenue_yoy"),
        at("profit_yoy", 1).alias("profit_yoy"),
        (at("revenue_yoy", 1) - at("revenue_yoy", 2)).alias("revenue_acceleration"),
        at("eps_yoy", 1).alias("eps_yoy"),
        (at("profit_yoy", 1) - at("profit_yoy", 2)).alias("profit_acceleration"),
        (at("eps_yoy", 1) - at("eps_yoy", 2)).alias("eps_acceleration"),
        *[at(q, 1).alias(q) for q in QUALITY_ITEMS[:-1]],
        (-at(QUALITY_ITEMS[-1], 1)).alias("financial_safety_value"),
        streak("net_profit").cast("int").alias("positive_profit_streak"),
        streak("revenue_yoy").cast("int").alias("positive_growth_streak"),
        F.max(F.when(F.col("rn") == 1, F.col("shares"))).alias("shares"),
        F.sum(F.when(F.col("rn") <= 4, F.col("net_profit"))).alias("profit_ttm"),
        F.sum(F.when(F.col("rn") <= 4, F.col("shares"))).alias("shares_ttm"),
    )


def valuation_factors(rows: DataFrame) -> DataFrame:
    """PE scores and market size from ``symbol, industry, close, shares, profit_ttm, shares_ttm``."""
    pe = ratio(F.col("close"), ratio(F.col("profit_ttm"), F.col("shares_ttm").cast("double"))) * 50
    rows = rows.withColumn("pe_ttm", pe).withColumn("cut", F.when(F.col("pe_ttm") > 0, F.greatest(F.least("pe_ttm", F.lit(200.0)), F.lit(0.5))))
    own = Window.partitionBy("industry")
    middle = F.percentile(F.when(F.col("pe_ttm") > 0, F.col("pe_ttm")), 0.5).over(own)
    clipped = F.greatest(F.least(middle, F.lit(200.0)), F.lit(0.5))
    cap = F.col("close") * F.col("shares")
    rows = rows.withColumns({"pe_ttm_value": -F.ln("cut"), "pe_industry_value": -F.ln(F.col("cut") / clipped), "market_cap": cap})
    return rows.withColumn("industry_leader_score", pct_rank(F.when(F.col("market_cap") > 0, F.col("market_cap")), F.col("industry"))).drop("cut")


def industry_scores(rows: DataFrame) -> DataFrame:
    """A score for each industry from its members' momentum, breadth and growth: ranks over industries."""
    by = rows.groupBy("industry").agg(
        F.avg("ret_60").alias("momentum"),
        F.avg(F.when(F.col("ret_20") > 0, 1.0).when(F.col("ret_20").isNotNull(), 0.0)).alias("breadth"),
        F.avg("revenue_yoy").alias("growth"),
        F.avg("profit_yoy").alias("profit_growth"),
        F.avg("eps_yoy").alias("eps_growth"),
        F.count(F.lit(1)).alias("members"),
    )
    ranked = by.select("industry", "members", *[pct_rank(F.col(c)).alias(f"{c}_rank") for c in ("momentum", "breadth", "growth", "profit_growth", "eps_growth")])
    trend = nullable_mean(F.col("momentum_rank"), F.col("breadth_rank"))
    grown = nullable_mean(F.col("growth_rank"), F.col("profit_growth_rank"), F.col("eps_growth_rank"))
    return ranked.select("industry", "members", nullable_mean(trend, grown).alias("industry_score"))
