"""Projections of the driver's tables onto the engine's model: bars, panel, statements, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import rounded
from tidemark.sources.tables import dealt_by, table

PANEL_START = "1996-01-01"


def symbol_of(key: Column) -> Column:
    """A six-character symbol, padded with zeros."""
    return F.lpad(key.cast("string"), 6, "0")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by symbol from trades.

    A symbol has hardly more than one trade a day, so partial aggregates would
    save nothing: trades are dealt out by symbol once, and the day's aggregate
    and all windows by symbol run where they lie.
    """
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    price, trades = F.col("l_extendedprice"), table(spark, sf_dir, "lineitem")
    trades = trades.select(symbol_of(F.col("l_suppkey")).alias("symbol"), F.to_date("l_shipdate").alias("trade_date"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return (
        dealt_by(trades, "symbol", like=table(spark, sf_dir, "lineitem"))
        .groupBy("symbol", "trade_date")
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.sum(rounded(F.col("l_quantity")).cast("bigint")).alias("volume"),
            F.sum(price.cast("decimal(18,2)")).cast("double").alias("amount"),
        )
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense daily panel: each symbol's bars re-dated to consecutive days, with a tame price path."""
    by = Window.partitionBy("symbol").orderBy("trade_date")
    n = F.col("n")
    wave = lambda a, m, k: ((n * a) % m - k) / F.lit(1009.0)
    steps = bars(spark, sf_dir).select(
        "symbol", "trade_date", "volume", "amount",
        F.row_number().over(by).alias("n"),
        ((rounded(F.col("close") * 100).cast("bigint") * 7919) % 2001 - 1000).alias("step"),
    )
    walked = steps.withColumn("walk", F.sum("step").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    closes = walked.withColumn("close", rounded(F.lit(100.0) * F.exp(F.col("walk") / F.lit(50000.0)), 4))
    closes = closes.withColumn("pre_close", F.lag("close").over(by))
    opened = closes.withColumn("open", F.coalesce("pre_close", "close") * (1 + wave(37, 11, 5)))
    return opened.select(
        "symbol",
        F.date_add(F.lit(PANEL_START).cast("date"), n).alias("trade_date"),
        "n",
        "open",
        (F.greatest("open", "close") * (1 + wave(13, 7, 0))).alias("high"),
        (F.least("open", "close") * (1 - wave(17, 7, 0))).alias("low"),
        "close", "pre_close", "volume", "amount",
    )


def as_of(rows: DataFrame) -> Column:
    """The last panel date on which every symbol has a bar, as a scalar subquery."""
    last = rows.groupBy("symbol").agg(F.max("trade_date").alias("d")).agg(F.min("d"))
    return last.scalar()


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``symbol, name, industry, market, listed_date``."""
    listed = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min(F.to_date("l_shipdate")).alias("listed_date"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.join(listed, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return rows.select(symbol_of(F.col("s_suppkey")).alias("symbol"), F.col("s_name").alias("name"), F.col("n_name").alias("industry"), F.col("r_name").alias("market"), "listed_date")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statements by symbol; published 45 days after the quarter's end."""
    day = F.to_date("l_shipdate")
    end = F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    item = lambda share: F.sum((F.col("l_extendedprice").cast("decimal(18,2)") * F.col(share).cast("decimal(18,2)")).cast("decimal(38,4)")).cast("double")
    revenue = F.sum((F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)"))).cast("decimal(38,4)"))
    rows = table(spark, sf_dir, "lineitem").groupBy(symbol_of(F.col("l_suppkey")).alias("symbol"), end.alias("stat_date")).agg(
        revenue.cast("double").alias("revenue"),
        (revenue - F.count(F.lit(1)) * 48000).cast("double").alias("net_profit"),
        F.sum(F.round("l_quantity").cast("bigint")).alias("shares"),
        item("l_discount").alias("cost"), item("l_tax").alias("tax"),
    )
    return rows.select("symbol", "stat_date", F.date_add("stat_date", 45).alias("pub_date"), "revenue", "net_profit", "shares", *[F.expr(x).alias(k) for k, x in STATEMENT_RATIOS.items()])


#: Ratios of a statement from its items; the same text serves both engines.
STATEMENT_RATIOS = {
    "eps": "net_profit / nullif(shares, 0)", "roe_avg": "net_profit / nullif(shares * 1000, 0)", "gross_profit_margin": "(revenue - cost) / nullif(revenue, 0)",
    "net_profit_margin": "net_profit / nullif(revenue, 0)", "current_ratio": "revenue / nullif(tax * 20, 0)", "quick_ratio": "(revenue - cost) / nullif(tax * 20, 0)",
    "cash_ratio": "cost / nullif(tax, 0)", "ebit_to_interest": "(net_profit + tax) / nullif(cost, 0)", "cfo_to_or": "(revenue - tax) / nullif(revenue, 0)",
    "cfo_to_np": "(revenue - tax) / nullif(net_profit, 0)", "cfo_to_gr": "(revenue - cost - tax) / nullif(revenue, 0)", "liability_to_asset": "tax / nullif(revenue + tax, 0)",
}


def theme_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``trade_date, symbol, reason``: the parts sold by a symbol on a day, joined with plus signs."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.split("p_type", " ")[0].alias("kind"))
    trades = table(spark, sf_dir, "lineitem")
    rows = trades.select(symbol_of(F.col("l_suppkey")).alias("symbol"), F.to_date("l_shipdate").alias("trade_date"), "l_partkey")
    words = dealt_by(rows, "l_partkey", like=trades).join(part, F.col("l_partkey") == F.col("p_partkey")).select("trade_date", "symbol", F.concat_ws("+", "kind", "p_brand").alias("one"))
    return dealt_by(words, "symbol", like=trades).groupBy("trade_date", "symbol").agg(F.array_join(F.array_sort(F.collect_set("one")), "、").alias("reason"))


def unusual_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``trade_date, symbol, explanation, net_buy``: events as an exchange's list of unusual trading."""
    kind, value = F.col("event_type"), F.col("value").cast("decimal(18,4)")
    net = F.when(F.col("event_id") % 11 != 0, F.when(F.col("event_id") % 2 == 0, value).otherwise(-value))
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("trade_date"), symbol_of(F.col("user_id")).alias("symbol"), kind.alias("explanation"), net.alias("net_buy"), "event_id")


# SQL twins for DuckDB -----------------------------------------------------------------------------

SQL = {
    "bars": """bars AS (
  SELECT lpad(l_suppkey::VARCHAR, 6, '0') AS symbol, l_shipdate::DATE AS trade_date,
         min_by(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open,
         max(l_extendedprice) AS high, min(l_extendedprice) AS low,
         max_by(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close,
         sum(round(l_quantity)::BIGINT)::BIGINT AS volume, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS amount
  FROM lineitem GROUP BY 1, 2)""",
    "panel": """steps AS (
  SELECT symbol, trade_date, volume, amount, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS n,
         (round(close * 100)::BIGINT * 7919) % 2001 - 1000 AS step FROM bars),
closes AS (
  SELECT symbol, n, volume, amount, round(100.0::DOUBLE * exp((sum(step) OVER (PARTITION BY symbol ORDER BY n))::DOUBLE / 50000.0::DOUBLE), 4) AS close FROM steps),
lagged AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY n) AS pre_close FROM closes),
opened AS (SELECT *, coalesce(pre_close, close) * (1 + ((n * 37) % 11 - 5)::DOUBLE / 1009.0::DOUBLE) AS open FROM lagged),
panel AS MATERIALIZED (
  SELECT symbol, (DATE '1996-01-01' + n::INT) AS trade_date, n::INT AS n, open,
         greatest(open, close) * (1 + ((n * 13) % 7)::DOUBLE / 1009.0::DOUBLE) AS high,
         least(open, close) * (1 - ((n * 17) % 7)::DOUBLE / 1009.0::DOUBLE) AS low, close, pre_close, volume, amount
  FROM opened),
as_of AS (SELECT min(d) AS d FROM (SELECT max(trade_date) AS d FROM panel GROUP BY symbol))""",
    "instruments": """instruments AS (
  SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS symbol, s_name AS name, n_name AS industry, r_name AS market, listed_date
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_suppkey, min(l_shipdate::DATE) AS listed_date FROM lineitem GROUP BY 1) l ON s_suppkey = l_suppkey)""",
    "statements": """statements AS (
  SELECT symbol, stat_date, stat_date + 45 AS pub_date, revenue, net_profit, shares, """ + ", ".join(f"{x} AS {k}" for k, x in STATEMENT_RATIOS.items()) + """ FROM (
  SELECT symbol, stat_date, revenue::DOUBLE AS revenue, (revenue - lines * 48000)::DOUBLE AS net_profit, shares, cost::DOUBLE AS cost, tax::DOUBLE AS tax
  FROM (SELECT lpad(l_suppkey::VARCHAR, 6, '0') AS symbol, last_day((date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH)::DATE) AS stat_date,
               sum((l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2)))::DECIMAL(38,4)) AS revenue, count(*) AS lines,
               sum((l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(18,2))::DECIMAL(38,4)) AS cost, sum((l_extendedprice::DECIMAL(18,2) * l_tax::DECIMAL(18,2))::DECIMAL(38,4)) AS tax,
               sum(round(l_quantity)::BIGINT)::BIGINT AS shares FROM lineitem GROUP BY 1, 2)))""",
    "themes": """themes AS (
  SELECT trade_date, symbol, string_agg(one, '、' ORDER BY one) AS reason FROM (
    SELECT DISTINCT l_shipdate::DATE AS trade_date, lpad(l_suppkey::VARCHAR, 6, '0') AS symbol, string_split(p_type, ' ')[1] || '+' || p_brand AS one
    FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2)""",
    "unusual": """unusual AS (
  SELECT ts::DATE AS trade_date, lpad(user_id::VARCHAR, 6, '0') AS symbol, event_type AS explanation, event_id,
         CASE WHEN event_id % 11 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN value::DECIMAL(18,4) ELSE -value::DECIMAL(18,4) END END AS net_buy
  FROM events)""",
}


def with_(*names: str) -> str:
    """A WITH clause of the named projections; ``panel`` brings ``bars`` along."""
    wanted = [n for n in SQL if n in names or (n == "bars" and "panel" in names)]
    return "WITH " + ",\n".join(SQL[n] for n in wanted)
