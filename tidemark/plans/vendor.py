"""Payload parsers and write rules over synthetic payloads made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import sinks
from tidemark.plans.factors import shown
from tidemark.plans.registry import query
from tidemark.sources import vendor as ops
from tidemark.sources.market import instruments, panel, with_
from tidemark.sources.tables import table


@query("kline_parse", with_("panel") + " SELECT symbol, trade_date, round(open, 6) + 0.0 AS open, round(close, 6) + 0.0 AS close, (volume * 100)::BIGINT AS volume, round(amount * 10000, 2) + 0.0 AS amount, round(lag(close) OVER (PARTITION BY symbol ORDER BY trade_date), 6) + 0.0 AS pre_close FROM panel", dates="trade_date")
def kline_parse(spark: SparkSession, d: str) -> DataFrame:
    """Bars packed into one JSON document a symbol, and parsed again with their units."""
    row = F.array(*[F.col(c).cast("string") for c in ("trade_date", "open", "close", "high", "low", "volume", "amount")])
    packed = panel(spark, d).groupBy("symbol").agg(F.to_json(F.struct(F.first("symbol").alias("code"), F.collect_list(row).alias("rows"))).alias("payload"))
    rows = ops.kline_rows(packed)
    return shown(rows.select("symbol", "trade_date", "open", "close", "volume", F.round("amount", 2).alias("amount"), "pre_close"))


@query("quote_lines", """WITH q AS (SELECT o_orderkey, o_orderkey % 23 AS k, o_totalprice, o_orderdate FROM orders)
SELECT lpad(o_orderkey::VARCHAR, 18, '0') AS symbol, CASE WHEN k = 3 THEN 'malformed stamp' WHEN k = 5 THEN 'other day' WHEN k = 7 THEN 'before the close' ELSE 'accepted' END AS status, CASE WHEN k IN (7, 11) THEN CASE k WHEN 11 THEN 0 ELSE 700 END ELSE (k * 100) END::BIGINT AS volume FROM q""")
def quote_lines(spark: SparkSession, d: str) -> DataFrame:
    """Quotes as separated text, with bad stamps, other days, early stamps and halts among them."""
    k = F.col("o_orderkey") % 23
    stamp = F.when(k == 3, "2024010").when(k == 5, "20231229150005").when(k.isin(7, 11), "20240102103000").otherwise("20240102150003")
    lot = F.when(k == 11, 0).otherwise(k)
    line = F.concat_ws("~", F.lpad(F.col("o_orderkey").cast("string"), 18, "0"), F.lit("name"), F.when(k == 11, "0").otherwise("10.5"), F.lit("10.6"), F.lit("10.4"), lot.cast("string"), stamp)
    lines = table(spark, d, "orders").select(line.alias("line"))
    return ops.quote_rows(lines, F.lit("2024-01-02").cast("date")).select("symbol", "status", "volume")


@query("industry_alias", """WITH raw AS (SELECT 'sh' || lpad(s_suppkey::VARCHAR, 6, '0') || '.x' AS c, CASE WHEN s_suppkey % 9 = 0 THEN '  ' ELSE ' ' || n_name || ' ' END AS i, s_suppkey * 2 AS nth FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT lpad(s_suppkey::VARCHAR, 6, '0'), 'later', s_suppkey * 2 + 1 FROM supplier WHERE s_suppkey % 4 = 0)
SELECT regexp_extract(c, '(\\d{6})', 1) AS symbol, arg_max(trim(i), nth) AS industry FROM raw WHERE trim(i) <> '' GROUP BY 1""")
def industry_alias(spark: SparkSession, d: str) -> DataFrame:
    """Codes inside text under another header, blank industries, and a later row that wins."""
    key = F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    first = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("sh"), key, F.lit(".x")).alias("股票代码"), F.when(F.col("s_suppkey") % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), "n_name", F.lit(" "))).alias("所属行业"), (F.col("s_suppkey") * 2).alias("nth"))
    later = table(spark, d, "supplier").where("s_suppkey % 4 = 0").select(key.alias("股票代码"), F.lit("later").alias("所属行业"), (F.col("s_suppkey") * 2 + 1).alias("nth"))
    return ops.industry_rows(first.unionByName(later), "nth")


@query("page_rows")
def page_rows(spark: SparkSession, d: str) -> DataFrame:
    """The text of each paragraph, heading, item and table row of the raw pages."""
    return ops.table_cells(table(spark, d, "pages"), "page_id", "html")


@query("index_merge", with_("panel") + """, old AS (SELECT symbol, trade_date, close, volume FROM panel WHERE trade_date <= DATE '1997-03-15'), new AS (SELECT symbol, trade_date, CASE WHEN n % 5 = 0 THEN NULL ELSE close + 1 END AS close, volume FROM panel WHERE trade_date > DATE '1997-02-15')
SELECT symbol, trade_date, round(coalesce(new.close, old.close), 6) + 0.0 AS close, coalesce(new.volume, old.volume) AS volume FROM old FULL OUTER JOIN new USING (symbol, trade_date)""", dates="trade_date")
def index_merge(spark: SparkSession, d: str) -> DataFrame:
    """The stored part of the panel and a newer part that overlaps it by four weeks; together they are the whole panel."""
    rows, at = panel(spark, d).select("symbol", "trade_date", "close", "volume", "n"), F.col("trade_date")
    new = rows.where(at > F.lit("1997-02-15").cast("date")).withColumn("close", F.when(F.col("n") % 5 != 0, F.col("close") + 1)).drop("n")
    old = rows.where(at <= F.lit("1997-03-15").cast("date")).drop("n")
    return shown(ops.merge_by_key(old, new, ["symbol", "trade_date"]))


@query("both_exchanges", """WITH a AS (SELECT ts::DATE AS day, user_id, max(value) AS v FROM events WHERE event_type = 'view' AND day(ts) % 4 <> 0 GROUP BY 1, 2), b AS (SELECT ts::DATE AS day, user_id, max(value) AS v FROM events WHERE event_type = 'click' AND day(ts) % 5 <> 0 GROUP BY 1, 2),
u AS (SELECT *, 0 AS side FROM a UNION ALL SELECT *, 1 FROM b)
SELECT day, user_id, arg_min(v, side) AS v FROM u WHERE day IN (SELECT day FROM a INTERSECT SELECT day FROM b) GROUP BY 1, 2""", dates="day")
def both_exchanges(spark: SparkSession, d: str) -> DataFrame:
    """Two lists count only on days on which both came; the first list's row of a key stays."""
    rows = table(spark, d, "events").select(F.to_date("ts").alias("day"), "user_id", "event_type", F.col("value").alias("v"))
    side = lambda kind, m: rows.where((F.col("event_type") == kind) & (F.dayofmonth("day") % m != 0)).groupBy("day", "user_id").agg(F.max("v").alias("v"))
    return ops.both_or_nothing(side("view", 4), side("click", 5), ["day", "user_id"], "day")


@query("json_props", "SELECT event_type, count(*) AS n, sum((props::JSON->>'k')::BIGINT)::BIGINT AS total, max((props::JSON->>'k')::BIGINT) AS most FROM events GROUP BY 1")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """Nested values by a typed parse; what does not parse is NULL."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


@query("session_dates", "SELECT strftime((ts + INTERVAL 8 HOUR)::DATE - CASE WHEN (ts + INTERVAL 8 HOUR)::TIME < TIME '15:30:00' THEN 1 ELSE 0 END, '%Y-%m-%d') AS session, count(*) AS n FROM events GROUP BY 1")
def session_dates(spark: SparkSession, d: str) -> DataFrame:
    """Local trading dates of instants: before the close an observation belongs to the day before."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Shanghai")
    early = F.date_format(local, "HH:mm") < "15:30"
    return table(spark, d, "events").groupBy(F.date_format(F.date_sub(F.to_date(local), F.when(early, 1).otherwise(0)), "yyyy-MM-dd").alias("session")).agg(F.count(F.lit(1)).alias("n"))


@query("statement_chain", """WITH s AS (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS symbol, s_suppkey, s_nationkey FROM supplier),
p AS (SELECT l_suppkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS profit FROM lineitem GROUP BY 1), g AS (SELECT l_suppkey, count(*) AS growth FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT c_nationkey, count(*) AS balance FROM customer WHERE c_acctbal > 5000 GROUP BY 1)
SELECT symbol, profit, growth, balance FROM s LEFT JOIN p ON p.l_suppkey = s_suppkey LEFT JOIN g ON g.l_suppkey = s_suppkey LEFT JOIN b ON c_nationkey = s_nationkey""")
def statement_chain(spark: SparkSession, d: str) -> DataFrame:
    """Chained left joins whose right sides must be unique."""
    lines = table(spark, d, "lineitem")
    key = F.col("l_suppkey").alias("s_suppkey")
    profit = lines.groupBy(key).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("profit"))
    growth = lines.where("l_returnflag = 'R'").groupBy(key).agg(F.count(F.lit(1)).alias("growth"))
    balance = table(spark, d, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count(F.lit(1)).alias("balance"))
    out = table(spark, d, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol"), "s_suppkey", "s_nationkey")
    for right, on in ((profit, "s_suppkey"), (growth, "s_suppkey"), (balance, "s_nationkey")):
        out = sinks.validated_join(out, right, [on])
    return out.select("symbol", "profit", "growth", "balance")


@query("first_complete_snapshot", with_("instruments") + ", old AS (SELECT symbol, 'old' AS source FROM instruments WHERE symbol NOT LIKE '%7') SELECT * FROM old WHERE (SELECT count(*) FROM old) >= 0.95 * (SELECT count(*) FROM supplier) UNION ALL SELECT symbol, 'new' FROM instruments WHERE (SELECT count(*) FROM old) < 0.95 * (SELECT count(*) FROM supplier)")
def first_complete_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot that covers too few symbols gives way to the next."""
    rows = instruments(spark, d).select("symbol")
    expected = table(spark, d, "supplier").count()
    return sinks.first_complete(rows.where(~F.col("symbol").endswith("7")).withColumn("source", F.lit("old")), rows.withColumn("source", F.lit("new")), expected)


@query("verified_documents", "WITH h AS (SELECT doc_id, text, CASE WHEN doc_id % 6 = 0 THEN sha256(text || ' ') ELSE sha256(text) END AS digest FROM documents) SELECT count(*) AS n, count(*) FILTER (WHERE sha256(text) = digest) AS intact FROM h")
def verified_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents against their recorded hashes."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.sha2(F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")).cast("binary"), 256).alias("digest"))
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("intact", sinks.verified(rows, "text", "digest").agg(F.count(F.lit(1))).scalar())


@query("main_board", "SELECT lpad((c_custkey * 7919 % 700000)::VARCHAR, 6, '0') AS symbol, count(*) AS n FROM customer WHERE regexp_full_match(lpad((c_custkey * 7919 % 700000)::VARCHAR, 6, '0'), '(60|00)[0-9]{4}') GROUP BY 1")
def main_board(spark: SparkSession, d: str) -> DataFrame:
    symbol = F.lpad((F.col("c_custkey") * 7919 % 700000).cast("string"), 6, "0")
    return table(spark, d, "customer").select(symbol.alias("symbol")).where(F.col("symbol").rlike("^(60|00)[0-9]{4}$")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("oldest_pending", "SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 4 = 0 ORDER BY n_chars, doc_id LIMIT 30")
def oldest_pending(spark: SparkSession, d: str) -> DataFrame:
    """The first thirty of the pending rows in order: a report."""
    return table(spark, d, "documents").where("doc_id % 4 = 0").orderBy("n_chars", "doc_id").limit(30).select("doc_id", "source", "n_chars")
