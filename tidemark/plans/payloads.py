"""Vendor payloads as text: whole responses are parsed, checked, and refused as a whole where they are of another day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.factors import shown
from tidemark.plans.registry import query
from tidemark.sources import vendor as ops
from tidemark.sources.market import theme_days, unusual_trades, with_
from tidemark.sources.tables import table

# Payloads are made from the tables: one response for each day, with faults on some days.


def theme_payloads(spark: SparkSession, d: str) -> DataFrame:
    """``asked, payload``: a JSON list of each day's themes; days 7 echo the day before, on days 11 no row has a change."""
    change = F.when(F.dayofmonth("trade_date") != 11, F.length("reason") / 10)
    row = F.struct(
        F.col("symbol").alias("code"), F.col("reason"), F.round(change, 1).cast("string").alias("change_pct"),
        F.date_format(F.date_sub("trade_date", F.when(F.dayofmonth("trade_date") == 7, 1).otherwise(0)), "yyyyMMdd").alias("date"),
    )
    by = theme_days(spark, d).groupBy("trade_date").agg(F.collect_list(row).alias("data"))
    return by.select(F.col("trade_date").alias("asked"), F.to_json(F.struct("data")).alias("payload"))


@query("theme_list_status", with_("themes") + " SELECT trade_date AS asked, CASE WHEN day(trade_date) = 7 THEN 'REJECTED' WHEN day(trade_date) = 11 THEN 'REJECTED' ELSE 'OK' END AS status, CASE WHEN day(trade_date) = 7 THEN 'other day' WHEN day(trade_date) = 11 THEN 'no change in any row' END AS problem, count(*) AS n_rows FROM themes GROUP BY 1", dates="asked")
def theme_list_status(spark: SparkSession, d: str) -> DataFrame:
    """The verdict on each response: the echoed date of all rows, and a change in at least one."""
    return ops.theme_verdicts(theme_payloads(spark, d))


@query("theme_list_rows", with_("themes") + " SELECT trade_date, symbol, reason, round(length(reason) / 10.0::DOUBLE, 1) AS change_pct FROM themes WHERE day(trade_date) NOT IN (7, 11)", dates="trade_date")
def theme_list_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the responses that passed."""
    payloads = theme_payloads(spark, d)
    passed = ops.theme_verdicts(payloads).where("status = 'OK'").select("asked")
    return ops.theme_rows(payloads.join(passed, "asked", "left_semi")).select(F.col("asked").alias("trade_date"), "symbol", "reason", "change_pct")


def trade_payloads(spark: SparkSession, d: str) -> DataFrame:
    """The primary list of unusual trades as JSON lines with vendor names and numbers as text; days 13 fail, days 17 are empty."""
    rows = unusual_trades(spark, d)
    stamp = F.date_format(F.date_sub("trade_date", F.when(F.col("event_id") % 29 == 0, 1).otherwise(0)), "yyyy-MM-dd")
    line = F.to_json(F.struct(F.col("symbol").alias("SECURITY_CODE"), stamp.alias("TRADE_DATE"), F.coalesce(F.col("net_buy").cast("string"), F.lit("-")).alias("BILLBOARD_NET_AMT"), F.col("explanation").alias("EXPLANATION")))
    return rows.select("trade_date", "event_id", line.alias("line"))


PRIMARY_SQL = with_("unusual") + ", p AS (SELECT trade_date, symbol, explanation, net_buy::DOUBLE AS net_buy FROM unusual WHERE event_id % 29 <> 0)"


@query("unusual_primary", PRIMARY_SQL + " SELECT trade_date, symbol, explanation, round(net_buy, 4) + 0.0 AS net_buy FROM p", dates="trade_date")
def unusual_primary(spark: SparkSession, d: str) -> DataFrame:
    """Renamed and typed rows; a row of another date is refused, a number that is none is NULL."""
    return ops.unusual_rows(trade_payloads(spark, d), "trade_date").select("trade_date", "symbol", "explanation", F.round("net_buy", 4).alias("net_buy"))


@query("unusual_fallback", PRIMARY_SQL + """, f AS (SELECT trade_date, symbol, array_to_string(list_sort(list_distinct(list(explanation))), '|') AS explanation FROM unusual GROUP BY 1, 2)
SELECT trade_date, 'primary' AS source, count(*) AS n FROM p WHERE day(trade_date) NOT IN (13, 17) GROUP BY 1 UNION ALL SELECT trade_date, 'fallback', count(*) FROM f WHERE day(trade_date) = 13 GROUP BY 1""", dates="trade_date")
def unusual_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The second source counts only for days on which the first failed, not for days on which it had no rows."""
    lines = trade_payloads(spark, d).withColumn("line", F.when(F.dayofmonth("trade_date") == 13, "<error>").otherwise(F.col("line"))).where(F.dayofmonth("trade_date") != 17)
    grouped = unusual_trades(spark, d).groupBy("trade_date", "symbol").agg(F.array_join(F.array_sort(F.collect_set("explanation")), "|").alias("explanation"), F.lit(None).cast("double").alias("net_buy"))
    rows = ops.primary_or_fallback(lines, "trade_date", grouped)
    return rows.groupBy("trade_date", "source").agg(F.count(F.lit(1)).alias("n"))


@query("fallback_page_rows", with_("unusual") + " SELECT trade_date, symbol, array_to_string(list_sort(list_distinct(list(explanation))), '|') AS explanation, count(*) AS n_rows FROM unusual GROUP BY 1, 2", dates="trade_date")
def fallback_page_rows(spark: SparkSession, d: str) -> DataFrame:
    """A page's table: the header row names the columns, event-only rows have no money, explanations of a symbol are joined."""
    cells = F.concat(F.lit("<tr><td>"), "symbol", F.lit("</td><td class='x'> <b>"), "explanation", F.lit("</b></td><td>--</td></tr>"))
    html = F.concat(F.lit("<html><!-- <tr><td>old</td></tr> --><table><tr><th>代码</th><th>解读</th><th>净买额</th></tr>"), F.array_join(F.collect_list(cells), "\n"), F.lit("</table></html>"))
    pages = unusual_trades(spark, d).groupBy("trade_date", F.pmod("event_id", F.lit(64)).alias("part")).agg(html.alias("html"))
    return ops.page_events(pages, "trade_date", "html")


@query("margin_rows", "SELECT c_custkey AS id, lpad((c_custkey % 1000000)::VARCHAR, 6, '0') AS symbol, round(c_acctbal, 2) + 0.0 AS balance, CASE WHEN c_custkey % 6 <> 0 THEN c_nationkey::BIGINT END AS volume FROM customer")
def margin_rows(spark: SparkSession, d: str) -> DataFrame:
    """Margin balances by symbol: vendor names, thousands separators, and marks for missing numbers."""
    money = F.format_number("c_acctbal", 2)
    raw = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 1000000).cast("string").alias("标的证券代码"), money.alias("融资余额"), F.when(F.col("c_custkey") % 6 == 0, "--").otherwise(F.col("c_nationkey").cast("string")).alias("融券余量"))
    return ops.margin_rows(raw)


@query("sector_snapshot", "SELECT n_name AS sector, count(*) AS members, round(avg(c_acctbal), 4) + 0.0 AS change_pct, CASE WHEN count(*) % 3 <> 0 THEN count(*) END AS leaders FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def sector_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """A sector list under vendor names, with whole numbers that may be missing."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("m"))
    raw = rows.select(F.col("n_name").alias("板块名称"), F.concat(F.col("n").cast("string"), F.lit(".0")).alias("公司家数"), F.col("m").cast("string").alias("涨跌幅"), F.when(F.col("n") % 3 != 0, F.col("n").cast("string")).otherwise("nan").alias("上涨家数"))
    return ops.sector_rows(raw)


@query("vendor_valuation", with_("panel") + " SELECT trade_date, symbol, round(close / 7, 6) + 0.0 AS pe_ttm, (volume * 3)::BIGINT AS market_cap FROM panel WHERE n % 10 <> 0", dates="trade_date")
def vendor_valuation(spark: SparkSession, d: str) -> DataFrame:
    """A vendor's valuations: renamed, and kept only where the vendor's own date is the day that was asked for."""
    from tidemark.sources.market import panel

    stale = F.when(F.col("n") % 10 == 0, 1).otherwise(0)
    raw = panel(spark, d).select(F.col("trade_date").alias("asked"), F.col("symbol").alias("code"), F.date_format(F.date_sub("trade_date", stale), "yyyy-MM-dd").alias("date"), (F.col("close") / 7).cast("string").alias("peTTM"), (F.col("volume") * 3).cast("string").alias("totalMarketCap"))
    return shown(ops.valuation_rows(raw))


@query("membership_status", """WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS day, o_custkey % 97 AS member FROM orders), sized AS (SELECT day, count(*) AS n_rows, count(DISTINCT member) AS n_members FROM m GROUP BY 1)
SELECT day, n_rows, n_members, CASE WHEN n_members < 90 THEN 'too few' WHEN n_rows > n_members THEN 'repeated' ELSE 'OK' END AS status FROM sized""", dates="day")
def membership_status(spark: SparkSession, d: str) -> DataFrame:
    """A dated list of members passes only with the expected number of members, each once."""
    rows = table(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("day"), (F.col("o_custkey") % 97).alias("member"))
    return ops.membership_status(rows, "day", "member", 90)


@query("membership_asof", with_("panel") + """, m AS (SELECT symbol, trade_date AS valid_from, n % 3 = 1 AS member FROM panel WHERE n % 60 = 1)
SELECT p.trade_date, count(*) AS n, round(sum(round(p.close * 10000)::BIGINT) / count(*), 3) + 0.0 AS mean_close FROM panel p ASOF JOIN m ON p.symbol = m.symbol AND p.trade_date >= m.valid_from WHERE m.member GROUP BY 1""", dates="trade_date")
def membership_asof(spark: SparkSession, d: str) -> DataFrame:
    """Bars joined with the membership that held on their day: the last state on or before it."""
    from tidemark.sources.market import panel

    rows = panel(spark, d)
    states = rows.where("n % 60 = 1").select("symbol", F.col("trade_date").alias("valid_from"), (F.col("n") % 3 == 1).alias("member"))
    held = ops.state_on(rows.select("symbol", "trade_date", "close"), states, "symbol", "trade_date", "valid_from", "member")
    return shown(held.where("member").groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round(F.col("close") * 10000).cast("bigint")) / F.count(F.lit(1)), 3).alias("mean_close")))
