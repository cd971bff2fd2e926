"""Queries of the daily model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import iso_date
from tidemark.operators import daily as ops
from tidemark.plans.factors import shown, sql6
from tidemark.plans.registry import query
from tidemark.session import materialise
from tidemark.sources.market import instruments, panel, with_

#: The frozen rules with liquidity and breadth for the synthetic tables.
PROTOCOL = ops.Protocol(minimum_amount_20=60_000.0, minimum_market_breadth=0.2, lot_size=10)
DAY = "1997-03-31"
LISTED = "2000-03-31"

FEATURE_CTES = with_("panel", "instruments") + f""",
back AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) - 1 AS k, lead(close) OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS older FROM panel WHERE trade_date <= DATE '{DAY}'),
feats AS (SELECT symbol, count(*) AS history_days, count(*) FILTER (WHERE least(open, high, low, close, amount) > 0) AS n_valid, max(trade_date) AS last_date, max(close) FILTER (WHERE k = 0) AS close,
  max(close) FILTER (WHERE k = 20) / max(close) FILTER (WHERE k = 120) - 1 AS trend, -stddev_pop(close / nullif(older, 0) - 1) FILTER (WHERE k < 60) AS stability,
  -(max(close) FILTER (WHERE k = 0) / max(close) FILTER (WHERE k = 5) - 1) AS pullback, avg(close) FILTER (WHERE k < 120) AS ma120, avg(amount) FILTER (WHERE k < 20) AS amount_20,
  bool_or(volume > 0 AND amount > 0) FILTER (WHERE k = 0) AS active, bool_or(low <= least(open, close) AND greatest(open, close) <= high) FILTER (WHERE k = 0) AS valid_ohlc
  FROM back WHERE k <= 249 GROUP BY 1),
features AS (SELECT * FROM feats WHERE history_days = 250 AND n_valid = 250 AND last_date = DATE '{DAY}'),
joined AS (SELECT f.*, i.name, i.industry, i.listed_date, (i.name IS NOT NULL AND NOT regexp_matches(i.name, '(?i)ST|退') AND DATE '{LISTED}' - i.listed_date >= 365 AND active AND valid_ohlc) AS t1,
  (close >= 3 AND amount_20 >= {PROTOCOL.minimum_amount_20}) AS t2, (trend > 0 AND close > ma120) AS t3, (trend IS NOT NULL AND stability IS NOT NULL AND pullback IS NOT NULL) AS t4
  FROM features f LEFT JOIN instruments i USING (symbol)),
gate AS (SELECT count(*) AS universe, count(*) FILTER (WHERE t1) AS after_1, count(*) FILTER (WHERE t1 AND t2) AS after_2, count(*) FILTER (WHERE t1 AND t2 AND t3) AS after_3, count(*) FILTER (WHERE t1 AND t2 AND t3 AND t4) AS after_4,
  avg(CASE WHEN t1 THEN (close > ma120)::INT END) AS breadth FROM joined)"""


def day():
    return iso_date(DAY)


def listed_day():
    return iso_date(LISTED)


def features(spark: SparkSession, d: str) -> DataFrame:
    return ops.daily_features(panel(spark, d), day(), PROTOCOL)


def joined(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).join(instruments(spark, d).select("symbol", "name", "industry", "listed_date"), "symbol", "left")


@query("daily_features", FEATURE_CTES + f" SELECT symbol, history_days, active, valid_ohlc, {sql6('close', 'trend', 'stability', 'pullback', 'ma120', 'amount_20')} FROM features")
def daily_features(spark: SparkSession, d: str) -> DataFrame:
    return shown(features(spark, d))


@query("daily_funnel", FEATURE_CTES + f" SELECT universe, after_1, after_2, after_3, after_4, {sql6('breadth')} FROM gate")
def daily_funnel(spark: SparkSession, d: str) -> DataFrame:
    return shown(ops.daily_funnel(joined(spark, d), listed_day(), PROTOCOL))


def _rank(x: str) -> str:
    return f"(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE) / count(*) OVER ()"


PICK_CTES = FEATURE_CTES + f""",
dpool AS (SELECT * FROM joined WHERE t1 AND t2 AND t3 AND t4 AND (SELECT breadth >= {PROTOCOL.minimum_market_breadth} FROM gate)),
dranks AS (SELECT *, {_rank('trend')} AS rank_trend, {_rank('stability')} AS rank_stability, {_rank('pullback')} AS rank_pullback FROM dpool),
dscores AS (SELECT *, rank_trend * 0.4::DOUBLE + rank_stability * 0.4::DOUBLE + rank_pullback * 0.2::DOUBLE AS score FROM dranks),
picks AS (SELECT * FROM dscores QUALIFY row_number() OVER (PARTITION BY industry ORDER BY score DESC, symbol) <= 1 ORDER BY score DESC, symbol LIMIT 5)"""


@query("daily_picks", PICK_CTES + f" SELECT symbol, industry, {sql6('score', 'rank_trend', 'rank_stability', 'rank_pullback')} FROM picks")
def daily_picks(spark: SparkSession, d: str) -> DataFrame:
    return shown(ops.daily_picks(joined(spark, d), listed_day(), PROTOCOL).select("symbol", "industry", "score", "rank_trend", "rank_stability", "rank_pullback"))


@query("pool_control", PICK_CTES + f""", quotes AS (SELECT p.*, i.name FROM panel p LEFT JOIN instruments i USING (symbol)),
ctl AS (SELECT a.open, b.close, CASE WHEN a.open <= 0 OR a.pre_close <= 0 OR a.volume <= 0 OR a.open / a.pre_close >= 1.095 OR contains(upper(a.name), 'ST') THEN 0 ELSE b.close / a.open * (1 - 0.002::DOUBLE) / (1 + 0.002::DOUBLE) - 1 END AS net
  FROM dpool LEFT JOIN (SELECT * FROM quotes WHERE trade_date = DATE '{DAY}' + 1) a USING (symbol) LEFT JOIN (SELECT * FROM quotes WHERE trade_date = DATE '{DAY}' + 20) b USING (symbol))
SELECT count(*) AS n, round(CASE WHEN count(*) FILTER (WHERE open IS NULL OR close IS NULL) = 0 THEN avg(net) END, 6) + 0.0 AS pool_return FROM ctl""")
def pool_control(spark: SparkSession, d: str) -> DataFrame:
    """The pool held from the next open for twenty sessions, as the picks' control."""
    passed = F.lit(True)
    for _, test in ops.tests(listed_day(), PROTOCOL):
        passed = passed & test
    quotes = panel(spark, d).join(instruments(spark, d).select("symbol", "name"), "symbol", "left")
    at = lambda n: quotes.where(F.col("trade_date") == F.date_add(day(), n))
    return shown(ops.pool_return(joined(spark, d).where(passed), at(1), at(20), PROTOCOL))


@query("buy_fills", with_("panel", "instruments") + f""", q AS (SELECT symbol, CASE WHEN n % 9 = 0 THEN name || ' ST' ELSE name END AS name, CASE WHEN n % 7 = 0 THEN open * 1.12 ELSE open END AS open, pre_close, CASE WHEN n % 11 = 0 THEN 0 ELSE volume END AS volume, trade_date
  FROM panel LEFT JOIN instruments USING (symbol)),
r AS (SELECT *, CASE WHEN contains(upper(coalesce(name, '')), 'ST') OR contains(coalesce(name, ''), '退') THEN 'risk name' WHEN NOT coalesce(open > 0 AND pre_close > 0 AND volume > 0, false) THEN 'no valid open' WHEN open / pre_close >= 1.095 THEN 'limit up' END AS refused, floor(4000 / (open * 10))::BIGINT AS lots FROM q),
f AS (SELECT *, CASE WHEN refused IS NULL THEN coalesce(list_max(list_filter(range(0, lots + 1), lambda n: n = 0 OR n * 10 * open + greatest(n * 10 * open * 0.002::DOUBLE, 5.0) <= 4000)), 0) * 10 ELSE 0 END AS quantity FROM r)
SELECT symbol, trade_date, quantity, round(CASE WHEN quantity > 0 THEN greatest(quantity * open * 0.002::DOUBLE, 5.0) ELSE 0 END, 6) + 0.0 AS cost, round(quantity * open + CASE WHEN quantity > 0 THEN greatest(quantity * open * 0.002::DOUBLE, 5.0) ELSE 0 END, 6) + 0.0 AS spent,
  coalesce(refused, CASE WHEN quantity = 0 THEN 'less than a lot' END, 'filled') AS reason FROM f""", dates="trade_date")
def buy_fills(spark: SparkSession, d: str) -> DataFrame:
    """An order at every open of the panel, with refusals for names, halts and limit-up opens."""
    n = F.col("n")
    rows = panel(spark, d).join(instruments(spark, d).select("symbol", "name"), "symbol", "left")
    quotes = rows.select("symbol", "trade_date", F.when(n % 9 == 0, F.concat("name", F.lit(" ST"))).otherwise(F.col("name")).alias("name"), F.when(n % 7 == 0, F.col("open") * 1.12).otherwise(F.col("open")).alias("open"), "pre_close", F.when(n % 11 == 0, 0).otherwise(F.col("volume")).alias("volume"))
    return shown(ops.buy_fills(quotes, F.lit(4000.0), PROTOCOL).select("symbol", "trade_date", "quantity", "cost", "spent", "reason"))


@query("cohort_eval", PICK_CTES + f""", entry AS (SELECT p.symbol, p.trade_date AS entry_date, p.open AS price, 100 AS quantity, greatest(100 * p.open * 0.002::DOUBLE, 5.0) AS entry_cost FROM dscores s JOIN panel p USING (symbol) WHERE p.trade_date = DATE '{DAY}' + 1),
path AS (SELECT e.*, p.trade_date, p.close, p.pre_close, p.volume, row_number() OVER (PARTITION BY symbol ORDER BY p.trade_date) AS k, lag(p.close) OVER (PARTITION BY symbol ORDER BY p.trade_date) AS seen FROM entry e JOIN panel p USING (symbol) WHERE p.trade_date >= e.entry_date),
marks AS (SELECT symbol, entry_date, price, quantity, entry_cost, min(k) FILTER (WHERE seen > 0 AND pre_close > 0 AND abs(pre_close / seen - 1) > 0.005) AS jump_k, min(k) FILTER (WHERE k >= 20 AND volume > 0 AND close / pre_close > 0.905) AS exit_k, max(k) AS last_k,
  arg_min(trade_date, k) FILTER (WHERE k >= 20 AND volume > 0 AND close / pre_close > 0.905) AS exit_date, arg_min(close, k) FILTER (WHERE k >= 20 AND volume > 0 AND close / pre_close > 0.905) AS exit_price FROM path GROUP BY ALL),
st AS (SELECT *, CASE WHEN coalesce(jump_k <= coalesce(exit_k, last_k), false) THEN 'corporate_action_review' WHEN exit_k IS NOT NULL THEN 'closed' WHEN last_k >= 20 THEN 'exit_blocked' ELSE 'holding' END AS status FROM marks)
SELECT symbol, entry_date, quantity, round(price, 6) + 0.0 AS price, status, CASE WHEN status = 'closed' THEN exit_date END AS exit_date, round(CASE WHEN status = 'closed' THEN exit_price END, 6) + 0.0 AS exit_price,
  round(CASE WHEN status = 'closed' THEN (quantity * exit_price - greatest(quantity * exit_price * 0.002::DOUBLE, 5.0)) / (quantity * price + entry_cost) - 1 END, 6) + 0.0 AS net_return FROM st""", dates="entry_date exit_date")
def cohort_eval(spark: SparkSession, d: str) -> DataFrame:
    """Positions of the whole pool, entered at the next open."""
    uncapped = ops.Protocol(**{**PROTOCOL.__dict__, "selection_count": None, "maximum_per_industry": None})
    picked = ops.daily_picks(joined(spark, d), listed_day(), uncapped).select("symbol")
    later = panel(spark, d).where(F.col("trade_date") > day()).select("symbol", "trade_date", "open", "close", "pre_close", "volume")
    later = materialise(later, "later-panel")  # read for the entries and for all days after them
    entry = picked.join(later.where(F.col("trade_date") == F.date_add(day(), 1)), "symbol")
    fills = entry.select("symbol", F.col("trade_date").alias("entry_date"), F.col("open").alias("price"), F.lit(100).alias("quantity")).withColumn("cost", ops.order_cost(F.col("quantity") * F.col("price"), PROTOCOL))
    return shown(ops.evaluate_positions(fills, later, PROTOCOL))
