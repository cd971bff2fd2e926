"""Forward measurement: a journal of picks against later closes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.keyed import latest_per_key
from tidemark.plans.factors import shown, sql6
from tidemark.plans.registry import query
from tidemark.sources.market import panel, with_

HORIZONS = (1, 5, 20)

JOURNAL_SQL = """ret AS (SELECT symbol, trade_date, close / nullif(lag(close, 20) OVER (PARTITION BY symbol ORDER BY trade_date), 0) - 1 AS ret_20 FROM panel),
ranked AS (SELECT symbol, trade_date AS as_of, row_number() OVER (PARTITION BY trade_date ORDER BY ret_20 DESC, symbol) AS up, row_number() OVER (PARTITION BY trade_date ORDER BY ret_20, symbol) AS down FROM ret WHERE ret_20 IS NOT NULL AND day(trade_date) IN (1, 15)),
journal AS (SELECT 'up' AS spec, as_of, symbol FROM ranked WHERE up <= 5 UNION ALL SELECT 'down', as_of, symbol FROM ranked WHERE down <= 5),
cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS pos FROM (SELECT DISTINCT trade_date FROM panel)),
targets AS (SELECT c.trade_date AS as_of, h.h AS horizon, e.trade_date AS exit_date FROM cal c CROSS JOIN (VALUES (1), (5), (20)) h(h) JOIN cal e ON e.pos = c.pos + h.h),
uni AS (SELECT t.as_of, t.horizon, avg(b.close / a.close - 1) AS universe_ret FROM targets t JOIN panel a ON a.trade_date = t.as_of JOIN panel b ON b.trade_date = t.exit_date AND b.symbol = a.symbol WHERE day(t.as_of) IN (1, 15) GROUP BY 1, 2),
runs AS (SELECT spec, as_of, h.h AS horizon FROM (SELECT DISTINCT spec, as_of FROM journal) CROSS JOIN (VALUES (1), (5), (20)) h(h)),
per_run AS (SELECT r.spec, r.as_of, r.horizon, count(b.close) AS n, count(*) AS n_requested, avg(b.close / a.close - 1) AS pick_ret, any_value(u.universe_ret) AS universe_ret
  FROM runs r JOIN journal j ON j.spec = r.spec AND j.as_of = r.as_of LEFT JOIN targets t ON t.as_of = r.as_of AND t.horizon = r.horizon LEFT JOIN panel a ON a.symbol = j.symbol AND a.trade_date = r.as_of
  LEFT JOIN panel b ON b.symbol = j.symbol AND b.trade_date = t.exit_date LEFT JOIN uni u ON u.as_of = r.as_of AND u.horizon = r.horizon GROUP BY 1, 2, 3)"""


def journal(spark: SparkSession, d: str) -> DataFrame:
    """``spec, as_of, symbol``: the five best and the five worst 20-day returns of two days a month."""
    by = Window.partitionBy("symbol").orderBy("trade_date")
    rows = panel(spark, d).select("symbol", "trade_date", (F.col("close") / F.nullif(F.lag("close", 20).over(by), F.lit(0.0)) - 1).alias("ret_20"))
    rows = rows.where(F.col("ret_20").isNotNull() & F.dayofmonth("trade_date").isin(1, 15))
    day = Window.partitionBy("trade_date")
    rows = rows.select("symbol", F.col("trade_date").alias("as_of"), F.row_number().over(day.orderBy(F.desc("ret_20"), "symbol")).alias("up"), F.row_number().over(day.orderBy("ret_20", "symbol")).alias("down"))
    specs = F.filter(F.array(F.when(F.col("up") <= 5, F.lit("up")), F.when(F.col("down") <= 5, F.lit("down"))), lambda x: x.isNotNull())
    return rows.select(F.explode(specs).alias("spec"), "as_of", "symbol")


def targets(rows: DataFrame) -> DataFrame:
    """``as_of, horizon, exit_date`` from the calendar's own index; unfinished holdings have no row."""
    days = rows.select("trade_date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("trade_date")))
    ahead = days.select(F.col("trade_date").alias("as_of"), "pos", F.explode(F.array(*map(F.lit, HORIZONS))).alias("horizon"))
    return ahead.withColumn("pos", F.col("pos") + F.col("horizon")).join(days, "pos").select("as_of", "horizon", F.col("trade_date").alias("exit_date"))


def forward(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """``symbol, as_of, horizon, ret`` for the wanted dates: two equi-joins on (symbol, date)."""
    aims = targets(rows).join(dates, "as_of", "left_semi")
    entry = rows.select("symbol", F.col("trade_date").alias("as_of"), F.col("close").alias("a")).join(aims, "as_of")
    return entry.join(rows.select("symbol", F.col("trade_date").alias("exit_date"), F.col("close").alias("b")), ["symbol", "exit_date"]).select("symbol", "as_of", "horizon", (F.col("b") / F.nullif("a", F.lit(0.0)) - 1).alias("ret"))


def per_run(spark: SparkSession, d: str) -> DataFrame:
    rows, picks = panel(spark, d), journal(spark, d)
    moved = forward(rows, picks.select("as_of").distinct())
    universe = moved.groupBy("as_of", "horizon").agg(F.avg("ret").alias("universe_ret"))
    wanted = picks.withColumn("horizon", F.explode(F.array(*map(F.lit, HORIZONS))))
    by = wanted.join(moved, ["symbol", "as_of", "horizon"], "left").groupBy("spec", "as_of", "horizon").agg(F.count("ret").alias("n"), F.count(F.lit(1)).alias("n_requested"), F.avg("ret").alias("pick_ret"))
    return by.join(universe, ["as_of", "horizon"], "left").withColumn("excess", F.col("pick_ret") - F.col("universe_ret"))


@query("forward_per_run", with_("panel") + f", {JOURNAL_SQL} SELECT spec, as_of, horizon, n, n_requested, {sql6('pick_ret', 'universe_ret')}, round(pick_ret - universe_ret, 6) + 0.0 AS excess FROM per_run", dates="as_of")
def forward_per_run(spark: SparkSession, d: str) -> DataFrame:
    return shown(per_run(spark, d))


@query("forward_summary", with_("panel") + f", {JOURNAL_SQL} SELECT spec, horizon, count(DISTINCT as_of) AS runs, count(pick_ret - universe_ret) AS measured, round(avg(pick_ret), 6) + 0.0 AS pick_ret, round(avg(universe_ret), 6) + 0.0 AS universe_ret, round(avg(pick_ret - universe_ret), 6) + 0.0 AS excess_mean, round(stddev_samp(pick_ret - universe_ret), 6) + 0.0 AS excess_std FROM per_run GROUP BY 1, 2")
def forward_summary(spark: SparkSession, d: str) -> DataFrame:
    """What cannot be measured yet is left out, never counted as zero."""
    return shown(per_run(spark, d).groupBy("spec", "horizon").agg(F.count_distinct("as_of").alias("runs"), F.count("excess").alias("measured"), F.avg("pick_ret").alias("pick_ret"), F.avg("universe_ret").alias("universe_ret"), F.avg("excess").alias("excess_mean"), F.stddev_samp("excess").alias("excess_std")))


@query("journal_latest", with_("panel") + f", {JOURNAL_SQL}, runs2 AS (SELECT spec, as_of, string_agg(symbol, ',' ORDER BY symbol) AS symbols, (dayofyear(as_of) * 7) % 5 AS attempt FROM journal GROUP BY 1, 2), " + """
keyed AS (SELECT spec, date_trunc('month', as_of)::DATE AS month, as_of, attempt, symbols, left(sha256(spec || '|' || symbols), 16) AS record_id FROM runs2)
SELECT spec, month, as_of, attempt, symbols, record_id FROM keyed QUALIFY row_number() OVER (PARTITION BY spec, month ORDER BY attempt DESC, as_of DESC) = 1""", dates="month as_of")
def journal_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last attempt of each month and screen, with a fingerprint of what it picked."""
    runs = journal(spark, d).groupBy("spec", "as_of").agg(F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("symbols"))
    runs = runs.withColumns({"month": F.trunc("as_of", "month"), "attempt": (F.dayofyear("as_of") * 7) % 5, "record_id": F.substring(F.sha2(F.concat_ws("|", "spec", "symbols"), 256), 1, 16)})
    return latest_per_key(runs, ["spec", "month"], [F.desc("attempt"), F.desc("as_of")])
