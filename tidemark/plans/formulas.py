"""Queries whose features and filter are given as formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.scalars import rounded
from tidemark.operators import formulas as ops
from tidemark.plans.factors import shown
from tidemark.plans.registry import query
from tidemark.sources.market import panel, with_

#: Features that no builder of the rolling module has: other windows, windows in windows, other fields.
OWN_FORMULAS = {
    "cross": "Mean($close, 7) / Mean($close, 21) - 1",
    "smooth_move": "Mean($close / Ref($close, 1) - 1, 13) * 100",
    "range_of_mean": "(Max(Mean($close, 5), 12) - Min(Mean($close, 5), 12)) / $close",
    "amount_share": "$amount / Sum($amount, 9)",
    "rising_days": "Sum($close > Ref($close, 3), 15)",
    "body": "Mean(Abs($close - $open) / Greater($high - $low, 0.01), 6)",
    "volume_place": "Rank($volume, 17)",
    "spread": "Std(Log($volume + 1), 25)",
}

FORMULA_SQL = with_("panel") + """,
moved AS (SELECT symbol, trade_date, n, open, high, low, close, volume::DOUBLE AS volume, amount, close / lag(close) OVER s - 1 AS move, avg(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS 4 PRECEDING) AS m5,
  CASE WHEN close > lag(close, 3) OVER s THEN 1.0 ELSE 0.0 END::DOUBLE AS rise, abs(close - open) / greatest(high - low, 0.01) AS share, ln(volume::DOUBLE + 1) AS lv FROM panel WINDOW s AS (PARTITION BY symbol ORDER BY trade_date)),
made AS (SELECT symbol, trade_date, avg(close) OVER (s ROWS 6 PRECEDING) / avg(close) OVER (s ROWS 20 PRECEDING) - 1 AS "cross", avg(move) OVER (s ROWS 12 PRECEDING) * 100 AS smooth_move,
  (max(m5) OVER (s ROWS 11 PRECEDING) - min(m5) OVER (s ROWS 11 PRECEDING)) / close AS range_of_mean, amount / sum(amount) OVER (s ROWS 8 PRECEDING) AS amount_share, sum(rise) OVER (s ROWS 14 PRECEDING) AS rising_days,
  avg(share) OVER (s ROWS 5 PRECEDING) AS body, list(volume) OVER (s ROWS 16 PRECEDING) AS seen, volume, stddev_samp(lv) OVER (s ROWS 24 PRECEDING) AS spread FROM moved WINDOW s AS (PARTITION BY symbol ORDER BY trade_date))
SELECT symbol, trade_date, round("cross", 6) + 0.0 AS "cross", round(smooth_move, 6) + 0.0 AS smooth_move, round(range_of_mean, 6) + 0.0 AS range_of_mean, round(amount_share, 6) + 0.0 AS amount_share, round(rising_days, 6) + 0.0 AS rising_days, round(body, 6) + 0.0 AS body,
  round((len(list_filter(seen, lambda x: x < volume)) + (len(list_filter(seen, lambda x: x = volume)) + 1) / 2.0::DOUBLE) / len(seen), 6) + 0.0 AS volume_place, round(spread, 6) + 0.0 AS spread FROM made"""


@query("formula_features", FORMULA_SQL, dates="trade_date")
def formula_features(spark: SparkSession, d: str) -> DataFrame:
    return shown(ops.evaluate(panel(spark, d), OWN_FORMULAS), by=rounded)


#: Rows over their mean of 20 rows by a twentieth, on more volume than ten rows before.
OWN_FILTER = "($close > Mean($close, 20) * 1.05) * ($volume > Ref($volume, 10))"


@query("formula_filter", with_("panel") + """ SELECT symbol, trade_date, close FROM (SELECT symbol, trade_date, close, avg(close) OVER (s ROWS 19 PRECEDING) AS m, volume > lag(volume, 10) OVER s AS more FROM panel WINDOW s AS (PARTITION BY symbol ORDER BY trade_date)) WHERE close > m * 1.05 AND more""", dates="trade_date")
def formula_filter(spark: SparkSession, d: str) -> DataFrame:
    return ops.matching(panel(spark, d), OWN_FILTER, ("close",))
