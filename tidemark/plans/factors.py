"""Factor queries at the last common date of the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import factors as ops
from tidemark.operators.sessions import recent, session_back
from tidemark.plans.registry import query
from tidemark.session import materialise
from tidemark.sources.market import as_of, instruments, panel, statements, theme_days, unusual_trades, with_

PRICE_SQL = """price AS MATERIALIZED (SELECT symbol, trade_date, close, amount, row_number() OVER s AS history_days,
  CASE WHEN count(close) OVER w20 = 20 THEN (close - min(close) OVER w20) / nullif(max(close) OVER w20 - min(close) OVER w20, 0) END AS close_position_20,
  CASE WHEN count(close) OVER w60 = 60 THEN (close - min(close) OVER w60) / nullif(max(close) OVER w60 - min(close) OVER w60, 0) END AS close_position_60,
  CASE WHEN count(close) OVER w250 = 250 THEN (close - min(close) OVER w250) / nullif(max(close) OVER w250 - min(close) OVER w250, 0) END AS close_position_250,
  CASE WHEN count(close) OVER w250 = 250 THEN close / max(close) OVER w250 - 1 END AS dist_to_52w_high,
  CASE WHEN count(close) OVER w20 = 20 THEN close / avg(close) OVER w20 - 1 END AS ma20_dev,
  CASE WHEN count(close) OVER w60 = 60 THEN close / avg(close) OVER w60 - 1 END AS ma60_dev,
  CASE WHEN count(amount) OVER w20 = 20 THEN avg(amount) OVER w20 END AS turnover_value_20
  FROM panel WINDOW s AS (PARTITION BY symbol ORDER BY trade_date), w20 AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING),
    w60 AS (PARTITION BY symbol ORDER BY trade_date ROWS 59 PRECEDING), w250 AS (PARTITION BY symbol ORDER BY trade_date ROWS 249 PRECEDING))"""

MOMENTUM_SQL = """lagged2 AS (SELECT symbol, trade_date, close, volume, close / nullif(lag(close) OVER s, 0) - 1 AS r, close / nullif(lag(close, 20) OVER s, 0) - 1 AS ret_20, close / nullif(lag(close, 60) OVER s, 0) - 1 AS ret_60,
  CASE WHEN count(volume) OVER w5 = 5 THEN avg(volume) OVER w5 END / nullif(CASE WHEN count(volume) OVER w20 = 20 THEN avg(volume) OVER w20 END, 0) AS volume_trend_20
  FROM panel WINDOW s AS (PARTITION BY symbol ORDER BY trade_date), w5 AS (PARTITION BY symbol ORDER BY trade_date ROWS 4 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING)),
market AS (SELECT trade_date, coalesce(avg(r), 0) AS m FROM lagged2 GROUP BY 1),
curve AS (SELECT trade_date, CASE WHEN row_number() OVER (ORDER BY trade_date) > 20 THEN exp(sum(ln(1 + m)) OVER (ORDER BY trade_date ROWS 19 PRECEDING)) - 1 END AS market_20,
  CASE WHEN row_number() OVER (ORDER BY trade_date) > 60 THEN exp(sum(ln(1 + m)) OVER (ORDER BY trade_date ROWS 59 PRECEDING)) - 1 END AS market_60 FROM market),
momentum AS MATERIALIZED (SELECT symbol, trade_date, ret_20, ret_60, ret_20 - market_20 AS relative_ret_20, ret_60 - market_60 AS relative_ret_60,
  CASE WHEN ret_20 IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date, ret_20 IS NULL ORDER BY ret_20) + (count(*) OVER (PARTITION BY trade_date, ret_20) - 1) / 2.0::DOUBLE) / count(ret_20) OVER (PARTITION BY trade_date) END AS ret_rank_20,
  volume_trend_20 FROM lagged2 JOIN curve USING (trade_date))"""

RISK_SQL = """stepped AS (SELECT symbol, trade_date, close, amount, close / nullif(lag(close) OVER s, 0) - 1 AS r, sign(close - lag(close) OVER s) AS sgn FROM panel WINDOW s AS (PARTITION BY symbol ORDER BY trade_date)),
risk AS (SELECT symbol, trade_date, CASE WHEN count(r) OVER w20 = 20 THEN stddev_pop(r) OVER w20 END AS realized_vol_20,
  CASE WHEN count(r) OVER w20 = 20 THEN coalesce(stddev_pop(CASE WHEN r < 0 THEN r END) OVER w20, 0) END AS downside_vol_20,
  CASE WHEN count(close) OVER w60 = 60 THEN list_reduce(list(close) OVER w60, lambda a, x: a) END AS probe, list(close) OVER w60 AS path, count(close) OVER w60 AS n60,
  CASE WHEN count(sgn) OVER w20 = 20 THEN sum(sgn * amount) OVER w20 / nullif(sum(amount) OVER w20, 0) END AS signed_amount_pressure_20
  FROM stepped WINDOW w20 AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING), w60 AS (PARTITION BY symbol ORDER BY trade_date ROWS 59 PRECEDING))"""

FALL_SQL = "CASE WHEN n60 = 60 THEN list_min(list_transform(range(1, 61), lambda i: path[i] / list_max(path[1:i]) - 1)) END"

AT_SQL = "trade_date = (SELECT d FROM as_of)"


def shown(df: DataFrame, digits: int = 6, by=F.round) -> DataFrame:
    """Doubles with ``digits`` decimals, six by default, rounded by Spark or by another function."""
    return df.withColumns({c: by(F.col(c), digits) + 0.0 for c, kind in df.dtypes if kind == "double"})


def sql6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


#: From the last close up to this day the long return is counted.
BASE_DAY = "1996-06-30"


def recent_panel(spark: SparkSession, d: str):
    """The part of the panel that the factors of its last common day need, and that day."""
    rows = materialise(panel(spark, d), "panel")  # read for the day, for earlier rows and for the windows, with the date in its scan
    last = as_of(rows)
    return recent(rows, last, day(BASE_DAY)), last


PRICE_NAMES = ("close_position_20", "close_position_60", "close_position_250", "dist_to_52w_high", "ma20_dev", "ma60_dev", "turnover_value_20")
RISK_NAMES = ("realized_vol_20", "downside_vol_20", "max_drawdown_60", "signed_amount_pressure_20")
MOMENTUM_NAMES = ("ret_20", "ret_60", "relative_ret_20", "relative_ret_60", "ret_rank_20", "volume_trend_20")


@query("price_factors", with_("panel") + f", {PRICE_SQL} SELECT symbol, history_days::INT AS history_days, {sql6(*PRICE_NAMES)} FROM price WHERE {AT_SQL}")
def price_factors(spark: SparkSession, d: str) -> DataFrame:
    rows, last = recent_panel(spark, d)
    return shown(ops.day_factors(ops.counted_back(rows), last).select("symbol", "history_days", *PRICE_NAMES))


@query("momentum_factors", with_("panel") + f", {MOMENTUM_SQL} SELECT symbol, {sql6(*MOMENTUM_NAMES)} FROM momentum WHERE {AT_SQL}")
def momentum_factors(spark: SparkSession, d: str) -> DataFrame:
    rows, last = recent_panel(spark, d)
    return shown(ops.bar_factors(rows, last).select("symbol", *MOMENTUM_NAMES))


@query("risk_factors", with_("panel") + f", {RISK_SQL} SELECT symbol, {sql6('realized_vol_20', 'downside_vol_20')}, round({FALL_SQL}, 6) + 0.0 AS max_drawdown_60, {sql6('signed_amount_pressure_20')} FROM risk WHERE {AT_SQL}")
def risk_factors(spark: SparkSession, d: str) -> DataFrame:
    rows, last = recent_panel(spark, d)
    return shown(ops.day_factors(ops.counted_back(rows), last).select("symbol", *RISK_NAMES))


@query("rolling_drawdown", with_("panel") + f", {RISK_SQL} SELECT symbol, trade_date, round({FALL_SQL}, 6) + 0.0 AS max_drawdown_60 FROM risk WHERE n60 = 60", dates="trade_date")
def rolling_drawdown(spark: SparkSession, d: str) -> DataFrame:
    """The trailing drawdown at every row, by a fold over the window's closes."""
    rows = ops.risk_factors(panel(spark, d))
    return shown(rows.where(F.col("max_drawdown_60").isNotNull()).select("symbol", "trade_date", "max_drawdown_60"))


THEME_DAY = "1999-06-01"
THEMES_SQL = f"""win AS (SELECT * FROM themes WHERE trade_date <= DATE '{THEME_DAY}'
  AND trade_date >= (SELECT min(s) FROM (SELECT DISTINCT trade_date AS s FROM themes WHERE trade_date <= DATE '{THEME_DAY}' ORDER BY 1 DESC LIMIT 20))),
today AS (SELECT symbol, list_distinct(list_filter(list_transform(string_split_regex(reason, '[+、,，/|]'), lambda x: trim(x)), lambda x: x <> '')) AS tags0, string_split_regex(reason, '[+、,，/|]') AS raw FROM win WHERE trade_date = DATE '{THEME_DAY}'),
today2 AS (SELECT symbol, list_filter(raw, lambda x, i: x <> '' AND list_position(raw, x) = i) AS tags FROM today),
tagged AS (SELECT symbol, unnest(tags) AS tag FROM today2), heats AS (SELECT tag, count(*) AS heat FROM tagged GROUP BY 1),
heat AS (SELECT symbol, max(heat) AS hot, sum(heat)::BIGINT AS all_heat FROM tagged JOIN heats USING (tag) GROUP BY 1),
tdays AS (SELECT symbol, count(DISTINCT trade_date) AS days FROM win GROUP BY 1),
theme AS (SELECT i.symbol, array_to_string(tags, '|') AS theme_tags, CASE WHEN (SELECT count(*) FROM today) > 0 THEN coalesce(hot, 0) END AS theme_heat_max,
  CASE WHEN (SELECT count(*) FROM today) > 0 THEN coalesce(all_heat, 0) END AS theme_heat_sum, CASE WHEN (SELECT count(*) FROM win) > 0 THEN coalesce(days, 0) END AS theme_days_20
  FROM instruments i LEFT JOIN today2 USING (symbol) LEFT JOIN heat USING (symbol) LEFT JOIN tdays USING (symbol))"""


def day(text: str):
    return F.lit(text).cast("date")


#: Sessions of the windows of listed days.
LISTED_SESSIONS = 20


def theme_window(spark: SparkSession, d: str, symbols: DataFrame) -> DataFrame:
    rows = theme_days(spark, d)
    return ops.theme_factors(symbols, rows, day(THEME_DAY), session_back(rows, day(THEME_DAY), LISTED_SESSIONS))


@query("theme_factors", with_("themes", "instruments") + f", {THEMES_SQL} SELECT * FROM theme")
def theme_factors(spark: SparkSession, d: str) -> DataFrame:
    return theme_window(spark, d, instruments(spark, d).select("symbol"))


@query("tag_heat", with_("themes") + """, tags AS (SELECT DISTINCT trade_date, symbol, tag FROM (SELECT trade_date, symbol, unnest(string_split_regex(reason, '[+、,，/|]')) AS tag FROM themes) WHERE tag <> ''),
heats AS (SELECT trade_date, tag, count(*) AS heat FROM tags GROUP BY 1, 2)
SELECT trade_date, symbol, max(heat) AS heat_max, sum(heat)::BIGINT AS heat_sum, count(*) AS n_tags FROM tags JOIN heats USING (trade_date, tag) GROUP BY 1, 2""", dates="trade_date")
def tag_heat(spark: SparkSession, d: str) -> DataFrame:
    """Heat of each symbol's own tags on each day.

    Heats are one row a day and tag, which grows with time only; they go to
    the rows, which stay dealt out by symbol.
    """
    tags = theme_days(spark, d).select("trade_date", "symbol", F.explode(ops.split_tags(F.col("reason"))).alias("tag"))
    heats = tags.groupBy("trade_date", "tag").agg(F.count(F.lit(1)).alias("heat"))
    return tags.join(F.broadcast(heats), ["trade_date", "tag"]).groupBy("trade_date", "symbol").agg(F.max("heat").alias("heat_max"), F.sum("heat").alias("heat_sum"), F.count(F.lit(1)).alias("n_tags"))


@query("top_tags", with_("themes") + ", tags AS (SELECT DISTINCT trade_date, symbol, tag FROM (SELECT trade_date, symbol, unnest(string_split_regex(reason, '[+、,，/|]')) AS tag FROM themes) WHERE tag <> '') SELECT trade_date, tag, n, place FROM (SELECT trade_date, tag, count(*) AS n, row_number() OVER (PARTITION BY trade_date ORDER BY count(*) DESC, tag)::INT AS place FROM tags GROUP BY 1, 2) WHERE place <= 3", dates="trade_date")
def top_tags(spark: SparkSession, d: str) -> DataFrame:
    """The three most frequent tags of each day."""
    from pyspark.sql import Window

    tags = theme_days(spark, d).select("trade_date", F.explode(ops.split_tags(F.col("reason"))).alias("tag")).groupBy("trade_date", "tag").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("n"), "tag"))
    return tags.withColumn("place", place).where("place <= 3")


CAPITAL_DAY = "2024-01-25"
CAPITAL_SQL = f"""uwin AS (SELECT * FROM unusual WHERE trade_date <= DATE '{CAPITAL_DAY}'
  AND trade_date >= (SELECT min(s) FROM (SELECT DISTINCT trade_date AS s FROM unusual WHERE trade_date <= DATE '{CAPITAL_DAY}' ORDER BY 1 DESC LIMIT 20))),
ucap AS (SELECT symbol, count(DISTINCT trade_date) AS days, sum(net_buy)::DOUBLE AS net, arg_max(net_buy, (trade_date, event_id)) FILTER (WHERE net_buy IS NOT NULL)::DOUBLE AS last, arg_min(net_buy, (trade_date, event_id)) FILTER (WHERE net_buy IS NOT NULL)::DOUBLE AS first FROM uwin GROUP BY 1),
capital AS (SELECT i.symbol, CASE WHEN (SELECT count(*) FROM uwin) > 0 THEN coalesce(days, 0) END AS lhb_count_20,
  CASE WHEN (SELECT count(*) FROM uwin) > 0 THEN CASE WHEN days IS NULL THEN 0.0 ELSE net END END AS lhb_net_buy_20, (SELECT sum(net_buy)::DOUBLE FROM uwin u WHERE u.symbol = i.symbol AND trade_date = DATE '{CAPITAL_DAY}') AS main_net_inflow, last / nullif(first, 0) - 1 AS net_chg_20 FROM instruments i LEFT JOIN ucap USING (symbol))"""


def capital_window(spark: SparkSession, d: str, symbols: DataFrame) -> DataFrame:
    rows = unusual_trades(spark, d)
    return ops.capital_factors(symbols, rows, day(CAPITAL_DAY), session_back(rows, day(CAPITAL_DAY), LISTED_SESSIONS))


@query("capital_factors", with_("unusual", "instruments") + f", {CAPITAL_SQL} SELECT symbol, lhb_count_20, {sql6('lhb_net_buy_20', 'main_net_inflow', 'net_chg_20')} FROM capital")
def capital_factors(spark: SparkSession, d: str) -> DataFrame:
    return shown(capital_window(spark, d, instruments(spark, d).select("symbol")))


STATEMENT_DAY = "2000-12-31"
GROWTH_NAMES = ("revenue_yoy", "profit_yoy", "eps_yoy", "revenue_acceleration", "profit_acceleration", "eps_acceleration", *ops.QUALITY_ITEMS[:-1], "financial_safety_value")
GROWTH_SQL = f"""known AS (SELECT * FROM statements WHERE pub_date <= DATE '{STATEMENT_DAY}' QUALIFY row_number() OVER (PARTITION BY symbol, stat_date ORDER BY pub_date DESC) = 1),
recent AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY stat_date DESC, pub_date DESC)::INT AS rn FROM known QUALIFY rn <= 8),
yoy AS (SELECT r.*, r.revenue / nullif(b.revenue, 0) - 1 AS revenue_yoy, (r.net_profit - b.net_profit) / nullif(abs(b.net_profit), 0) AS profit_yoy, (r.eps - b.eps) / nullif(abs(b.eps), 0) AS eps_yoy
  FROM recent r LEFT JOIN known b ON b.symbol = r.symbol AND last_day((b.stat_date + INTERVAL 12 MONTH)::DATE) = r.stat_date),
growth AS (SELECT symbol, max(revenue_yoy) FILTER (WHERE rn = 1) AS revenue_yoy, max(profit_yoy) FILTER (WHERE rn = 1) AS profit_yoy,
  max(revenue_yoy) FILTER (WHERE rn = 1) - max(revenue_yoy) FILTER (WHERE rn = 2) AS revenue_acceleration,
  max(eps_yoy) FILTER (WHERE rn = 1) AS eps_yoy, max(profit_yoy) FILTER (WHERE rn = 1) - max(profit_yoy) FILTER (WHERE rn = 2) AS profit_acceleration,
  max(eps_yoy) FILTER (WHERE rn = 1) - max(eps_yoy) FILTER (WHERE rn = 2) AS eps_acceleration, {', '.join(f'max({q}) FILTER (WHERE rn = 1) AS {q}' for q in ops.QUALITY_ITEMS[:-1])}, -max(liability_to_asset) FILTER (WHERE rn = 1) AS financial_safety_value,
  nullif(coalesce(min(CASE WHEN NOT coalesce(net_profit > 0, false) THEN rn END) - 1, count(*)), 0)::INT AS positive_profit_streak,
  nullif(coalesce(min(CASE WHEN NOT coalesce(revenue_yoy > 0, false) THEN rn END) - 1, count(*)), 0)::INT AS positive_growth_streak,
  max(shares) FILTER (WHERE rn = 1) AS shares, sum(net_profit) FILTER (WHERE rn <= 4) AS profit_ttm, sum(shares) FILTER (WHERE rn <= 4) AS shares_ttm FROM yoy GROUP BY 1)"""


@query("fundamental_growth", with_("statements") + f", {GROWTH_SQL} SELECT symbol, {sql6(*GROWTH_NAMES)}, positive_profit_streak, positive_growth_streak FROM growth")
def fundamental_growth(spark: SparkSession, d: str) -> DataFrame:
    return shown(ops.growth_factors(statements(spark, d), day(STATEMENT_DAY)).drop("shares", "profit_ttm", "shares_ttm"))


VALUATION_SQL = """valued AS (SELECT symbol, industry, close, shares, (close / nullif(profit_ttm / nullif(shares_ttm, 0), 0)) * 50 AS pe_ttm, close * shares AS market_cap
  FROM growth JOIN instruments USING (symbol) JOIN (SELECT symbol, close FROM panel WHERE trade_date = (SELECT d FROM as_of)) USING (symbol)),
valuation AS (SELECT *, -ln(greatest(least(CASE WHEN pe_ttm > 0 THEN pe_ttm END, 200.0), 0.5)) AS pe_raw FROM valued),
medians AS (SELECT industry, quantile_cont(pe_ttm, 0.5) FILTER (WHERE pe_ttm > 0) AS mid FROM valued GROUP BY 1),
valuations AS (SELECT symbol, industry, pe_ttm, CASE WHEN pe_ttm > 0 THEN -ln(greatest(least(pe_ttm, 200.0), 0.5)) END AS pe_ttm_value,
  CASE WHEN pe_ttm > 0 THEN -ln(greatest(least(pe_ttm, 200.0), 0.5) / greatest(least(mid, 200.0), 0.5)) END AS pe_industry_value, market_cap,
  CASE WHEN market_cap > 0 THEN (rank() OVER (PARTITION BY industry, market_cap > 0 ORDER BY market_cap) + (count(*) OVER (PARTITION BY industry, market_cap) - 1) / 2.0::DOUBLE) / count(CASE WHEN market_cap > 0 THEN 1 END) OVER (PARTITION BY industry) END AS industry_leader_score
  FROM valued JOIN medians USING (industry))"""


def valued(spark: SparkSession, d: str) -> DataFrame:
    rows = materialise(panel(spark, d), "panel")  # read for the day and, with the date in its scan, for its closes
    last = ops.at_last(rows, as_of(rows)).select("symbol", "close")
    grown = ops.growth_factors(statements(spark, d), day(STATEMENT_DAY))
    return ops.valuation_factors(grown.join(instruments(spark, d).select("symbol", "industry"), "symbol").join(last, "symbol"))


@query("valuation_factors", with_("panel", "instruments", "statements") + f", {GROWTH_SQL}, {VALUATION_SQL} SELECT symbol, industry, {sql6('pe_ttm', 'pe_ttm_value', 'pe_industry_value', 'market_cap', 'industry_leader_score')} FROM valuations")
def valuation_factors(spark: SparkSession, d: str) -> DataFrame:
    return shown(valued(spark, d).select("symbol", "industry", "pe_ttm", "pe_ttm_value", "pe_industry_value", "market_cap", "industry_leader_score"))


def sql_rank(x: str, part: str = "") -> str:
    """The percentile rank's SQL."""
    p = f"PARTITION BY {part}, " if part else "PARTITION BY "
    whole = f"OVER (PARTITION BY {part})" if part else "OVER ()"
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({p}{x} IS NULL ORDER BY {x}) + (count(*) OVER ({p}{x}) - 1) / 2.0::DOUBLE) / count({x}) {whole} END"


def sql_mean(*xs: str) -> str:
    return f"(({' + '.join(f'coalesce({x}, 0)' for x in xs)}) / nullif({' + '.join(f'({x} IS NOT NULL)::INT' for x in xs)}, 0))"


INDUSTRY_SQL = f"""members AS (SELECT i.symbol, industry, ret_20, ret_60, revenue_yoy, profit_yoy, eps_yoy FROM instruments i LEFT JOIN (SELECT * FROM momentum WHERE {AT_SQL}) USING (symbol) LEFT JOIN growth USING (symbol)),
industries AS (SELECT industry, avg(ret_60) AS momentum, avg(CASE WHEN ret_20 > 0 THEN 1.0 WHEN ret_20 IS NOT NULL THEN 0.0 END) AS breadth, avg(revenue_yoy) AS growth, avg(profit_yoy) AS profit_growth, avg(eps_yoy) AS eps_growth, count(*) AS members FROM members GROUP BY 1),
iranks AS (SELECT industry, members, {sql_rank('momentum')} AS m, {sql_rank('breadth')} AS b, {sql_rank('growth')} AS g, {sql_rank('profit_growth')} AS p, {sql_rank('eps_growth')} AS e FROM industries),
istates AS (SELECT industry, members, {sql_mean('m', 'b')} AS trend, {sql_mean('g', 'p', 'e')} AS grown FROM iranks),
industry_scored AS (SELECT industry, members, {sql_mean('trend', 'grown')} AS industry_score FROM istates)"""


def members(spark: SparkSession, d: str) -> DataFrame:
    rows, at = recent_panel(spark, d)
    last = ops.day_factors(ops.counted_back(rows), at).select("symbol", "ret_20", "ret_60")
    grown = ops.growth_factors(statements(spark, d), day(STATEMENT_DAY)).select("symbol", "revenue_yoy", "profit_yoy", "eps_yoy")
    return instruments(spark, d).select("symbol", "industry").join(last, "symbol", "left").join(grown, "symbol", "left")


@query("industry_scores", with_("panel", "instruments", "statements") + f", {MOMENTUM_SQL}, {GROWTH_SQL}, {INDUSTRY_SQL} SELECT industry, members, {sql6('industry_score')} FROM industry_scored")
def industry_scores(spark: SparkSession, d: str) -> DataFrame:
    return shown(ops.industry_scores(members(spark, d)))


VALUATION_NAMES = ("pe_ttm", "pe_ttm_value", "pe_industry_value", "market_cap", "industry_leader_score")
STATEMENT_NAMES = {*GROWTH_NAMES, "positive_profit_streak", "positive_growth_streak", "shares", "profit_ttm", "shares_ttm"}
#: Columns of the windows of listed days, and of the tables that are derived from others of the row.
LISTED_NAMES = {theme_window: {"theme_tags", "theme_heat_max", "theme_heat_sum", "theme_days_20"}, capital_window: {"lhb_count_20", "lhb_net_buy_20", "main_net_inflow", "net_chg_20"}}
NEEDS = {"lhb_net_buy_rel": ("lhb_net_buy_20", "turnover_value_20"), "listed_days": ("listed_date",), "industry_score": ("industry", "ret_20", "ret_60", "revenue_yoy", "profit_yoy", "eps_yoy")} | {
    n: ("industry", "close", "shares", "profit_ttm", "shares_ttm") for n in VALUATION_NAMES
}


def factor_table(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """The wide table ``symbol x factor`` at the panel's last common date; all joins share the symbol.

    With ``names`` it has the symbol and those columns only. Sources that none
    of them needs are not read, and what is written between has no others.
    """
    rows, last = recent_panel(spark, d)
    symbols = instruments(spark, d)
    bars_only = ops.bar_factors(rows, last)
    asked = {"symbol", *names}
    held = asked | {n for name in names for n in NEEDS.get(name, ())}
    wanted = lambda *columns: not names or bool(held & set(columns))
    base = symbols.join(bars_only, "symbol")
    if wanted(*STATEMENT_NAMES):
        base = base.join(ops.growth_factors(statements(spark, d), day(STATEMENT_DAY)), "symbol", "left")
    if names:
        base = base.select(*[c for c in base.columns if c in held])
    valued_too, scored_too = wanted(*VALUATION_NAMES), wanted("industry_score")
    if scored_too:
        base = materialise(base, "factor-base")  # one row a symbol, for the table and for its industries
    scores = ops.industry_scores(base).drop("members") if scored_too else None
    if valued_too:
        base = ops.valuation_factors(base)
    if scored_too:
        base = base.join(scores, "industry", "left")
    for window, columns in LISTED_NAMES.items():
        if wanted(*columns):
            base = base.join(window(spark, d, symbols.select("symbol")), "symbol", "left")
    if wanted("lhb_net_buy_rel"):
        base = base.withColumn("lhb_net_buy_rel", F.col("lhb_net_buy_20") / F.nullif("turnover_value_20", F.lit(0.0)))
    if wanted("listed_days"):
        base = base.withColumn("listed_days", F.datediff(day(STATEMENT_DAY), "listed_date"))
    return base.select("symbol", *dict.fromkeys(n for n in names if n != "symbol")) if names else base


FACTOR_CTES = with_("panel", "instruments", "statements", "themes", "unusual") + f", {PRICE_SQL}, {MOMENTUM_SQL}, {RISK_SQL}, {THEMES_SQL}, {CAPITAL_SQL}, {GROWTH_SQL}, {VALUATION_SQL}, {INDUSTRY_SQL}, " + f"""
wide AS (SELECT i.symbol, i.name, i.industry, i.market, p.close, p.amount, p.history_days, {', '.join('p.' + n for n in PRICE_NAMES)}, {', '.join('m.' + n for n in MOMENTUM_NAMES)},
  r.realized_vol_20, r.downside_vol_20, {FALL_SQL} AS max_drawdown_60, r.signed_amount_pressure_20, t.theme_tags, t.theme_heat_max, t.theme_heat_sum, t.theme_days_20,
  c.lhb_count_20, c.lhb_net_buy_20, c.main_net_inflow, c.net_chg_20, {', '.join('g.' + n for n in GROWTH_NAMES)}, p.close / nullif(b.base_close, 0) - 1 AS ret_since_base, g.positive_profit_streak, g.positive_growth_streak,
  v.pe_ttm, v.pe_ttm_value, v.pe_industry_value, v.market_cap, v.industry_leader_score, s.industry_score, c.lhb_net_buy_20 / nullif(p.turnover_value_20, 0) AS lhb_net_buy_rel,
  (DATE '{STATEMENT_DAY}' - i.listed_date)::INT AS listed_days
  FROM instruments i JOIN (SELECT * FROM price WHERE {AT_SQL}) p USING (symbol) LEFT JOIN (SELECT * FROM momentum WHERE {AT_SQL}) m USING (symbol) LEFT JOIN (SELECT * FROM risk WHERE {AT_SQL}) r USING (symbol)
  LEFT JOIN (SELECT symbol, arg_max(close, trade_date) AS base_close FROM panel WHERE trade_date <= DATE '{BASE_DAY}' GROUP BY 1) b USING (symbol)
  LEFT JOIN theme t USING (symbol) LEFT JOIN capital c USING (symbol) LEFT JOIN growth g USING (symbol) LEFT JOIN valuations v USING (symbol) LEFT JOIN industry_scored s ON s.industry = i.industry)"""

WIDE_NAMES = (*PRICE_NAMES, *MOMENTUM_NAMES, "realized_vol_20", "downside_vol_20", "max_drawdown_60", "signed_amount_pressure_20", "lhb_net_buy_20", "main_net_inflow", "net_chg_20", *GROWTH_NAMES, "ret_since_base", "pe_ttm", "pe_ttm_value", "pe_industry_value", "market_cap", "industry_leader_score", "industry_score", "lhb_net_buy_rel")
WIDE_PLAIN = ("symbol", "name", "industry", "market", "history_days", "theme_tags", "theme_heat_max", "theme_heat_sum", "theme_days_20", "lhb_count_20", "positive_profit_streak", "positive_growth_streak", "listed_days")


@query("factor_table", FACTOR_CTES + f" SELECT {', '.join(n if n != 'history_days' else 'history_days::INT AS history_days' for n in WIDE_PLAIN)}, {sql6(*WIDE_NAMES)} FROM wide")
def factor_table_query(spark: SparkSession, d: str) -> DataFrame:
    return shown(factor_table(spark, d).select(*WIDE_PLAIN, *WIDE_NAMES))
