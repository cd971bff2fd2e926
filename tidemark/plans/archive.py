"""Archive queries: scans, calendars, keyed writes, point-in-time reads, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import r6
from tidemark.operators import gates
from tidemark.operators.keyed import insert_absent, latest_per_key, replace_days, split_tags, upsert
from tidemark.operators.ranges import last_states
from tidemark.operators.sinks import stale_snapshots
from tidemark.plans.registry import query
from tidemark.sources.market import bars, instruments, panel, statements, theme_days, unusual_trades, with_
from tidemark.sources.tables import table


@query("bars_projection", with_("bars") + " SELECT * FROM bars", dates="trade_date")
def bars_projection(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d)


@query("panel_projection", with_("panel") + " SELECT symbol, trade_date, open, high, low, close, pre_close, volume, amount FROM panel", dates="trade_date")
def panel_projection(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).drop("n")


@query("bars_window", with_("bars") + """
SELECT * FROM bars WHERE trade_date BETWEEN (SELECT min(trade_date) FROM (SELECT DISTINCT trade_date FROM bars WHERE trade_date <= DATE '2000-06-30' ORDER BY 1 DESC LIMIT 60)) AND DATE '2000-06-30'""", dates="trade_date")
def bars_window(spark: SparkSession, d: str) -> DataFrame:
    """The bars of the last 60 trading days up to a date; the calendar comes first, then one filtered scan."""
    rows = bars(spark, d)
    end = F.lit("2000-06-30").cast("date")
    days = rows.where(F.col("trade_date") <= end).select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(60)
    return rows.where((F.col("trade_date") >= days.agg(F.min("trade_date")).scalar()) & (F.col("trade_date") <= end))


@query("trade_calendar", with_("bars") + """
SELECT trade_date, (row_number() OVER (ORDER BY trade_date) - 1)::INT AS day_index, n_symbols, lag(trade_date) OVER (ORDER BY trade_date) AS prev_date
FROM (SELECT trade_date, count(DISTINCT symbol) AS n_symbols FROM bars GROUP BY 1)""", dates="trade_date prev_date")
def trade_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Distinct dates with a dense index; the window runs over one row a day."""
    days = bars(spark, d).groupBy("trade_date").agg(F.count_distinct("symbol").alias("n_symbols"))
    by = Window.orderBy("trade_date")
    return days.select("trade_date", (F.row_number().over(by) - 1).alias("day_index"), "n_symbols", F.lag("trade_date").over(by).alias("prev_date"))


@query("latest_complete_date", with_("bars") + """
SELECT max(trade_date) AS latest, max(trade_date) FILTER (WHERE trade_date < (SELECT max(trade_date) FROM bars)) AS latest_complete, count(*) AS n_rows FROM bars""", dates="latest latest_complete")
def latest_complete_date(spark: SparkSession, d: str) -> DataFrame:
    """The last date, and the last one that is over while its session still runs, by the gate of the close."""
    days = bars(spark, d).groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))
    whole = days.agg(F.max("trade_date").alias("latest"), F.array_sort(F.collect_list("trade_date")).alias("days"), F.sum("n").alias("n_rows"))  # the calendar, a day each
    running = F.to_timestamp(F.concat(F.date_format("latest", "yyyy-MM-dd"), F.lit(" 14:00:00")))
    return whole.select("latest", gates.latest_complete(F.col("days"), running).alias("latest_complete"), "n_rows")


@query("symbol_tail_bars", with_("bars") + " SELECT * FROM bars WHERE symbol = '000003' AND trade_date <= DATE '2001-01-31' QUALIFY row_number() OVER (ORDER BY trade_date DESC) <= 40", dates="trade_date")
def symbol_tail_bars(spark: SparkSession, d: str) -> DataFrame:
    rows = bars(spark, d).where((F.col("symbol") == "000003") & (F.col("trade_date") <= F.lit("2001-01-31").cast("date")))
    return rows.orderBy(F.desc("trade_date")).limit(40).orderBy("trade_date")


@query("market_asof_states", """WITH p AS (SELECT ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT epoch_us(e.ts) AS at_us, epoch_us(p.ts) AS seen_us, p.value FROM (SELECT ts FROM events WHERE event_type = 'error') e ASOF LEFT JOIN p ON e.ts > p.ts""")
def market_asof_states(spark: SparkSession, d: str) -> DataFrame:
    """For each error the last purchase before it, whoever made it: one history of all rows, cut into ranges of time.

    Of purchases at one time the largest counts.
    """
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    bought = events.where("event_type = 'purchase'").groupBy("ts").agg(F.max("value").alias("value"))
    found = last_states(events.where("event_type = 'error'"), bought, [], "ts", ["value"])
    return found.select(F.unix_micros("ts").alias("at_us"), F.unix_micros("seen_at").alias("seen_us"), "value")


@query("key_asof_states", """WITH p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.user_id, epoch_us(e.ts) AS at_us, CASE WHEN e.ts::DATE - p.ts::DATE <= 7 THEN epoch_us(p.ts) END AS seen_us, CASE WHEN e.ts::DATE - p.ts::DATE <= 7 THEN p.value END AS value
FROM (SELECT user_id, ts FROM events WHERE event_type IN ('view', 'purchase')) e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def key_asof_states(spark: SparkSession, d: str) -> DataFrame:
    """For each view or purchase the user's last purchase up to it, none if over seven days old; a user may have any share of the rows."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    found = last_states(events.where("event_type IN ('view', 'purchase')"), bought, ["user_id"], "ts", ["value"], strict=False, max_age=F.lit(7))
    return found.select("user_id", F.unix_micros("ts").alias("at_us"), F.unix_micros("seen_at").alias("seen_us"), "value")


@query("closes_on_date", with_("panel") + " SELECT symbol, close FROM panel WHERE trade_date = DATE '1996-06-03'")
def closes_on_date(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).where(F.col("trade_date") == F.lit("1996-06-03").cast("date")).select("symbol", "close")


@query("closes_asof_dates", with_("bars") + """
SELECT symbol, base_a, base_b FROM (SELECT symbol, max_by(close, trade_date) AS base_a FROM bars WHERE trade_date <= DATE '1996-03-31' GROUP BY 1)
FULL OUTER JOIN (SELECT symbol, max_by(close, trade_date) AS base_b FROM bars WHERE trade_date <= DATE '2000-12-31' GROUP BY 1) USING (symbol)""")
def closes_asof_dates(spark: SparkSession, d: str) -> DataFrame:
    """The last close on or before two dates. One conditional aggregate stands for two reads and a full outer join."""
    early, late = F.lit("1996-03-31").cast("date"), F.lit("2000-12-31").cast("date")
    rows, day = bars(spark, d).where(F.col("trade_date") <= late), F.col("trade_date")
    return rows.groupBy("symbol").agg(
        F.max_by("close", F.when(day <= early, day)).alias("base_a"),
        F.max_by("close", day).alias("base_b"),
    )


NEW_BARS = """incoming AS (SELECT symbol, trade_date, open * 1.01 AS open, high, low, close, volume + 100 AS volume, amount FROM bars WHERE trade_date >= DATE '2001-06-01')"""


@query("upsert_bars", with_("bars") + f", {NEW_BARS}, stored AS (SELECT * FROM bars WHERE trade_date < DATE '2001-07-01')" + """
SELECT symbol, trade_date, round(open, 6) + 0.0 AS open, high, low, close, volume, amount FROM (
  SELECT s.* FROM stored s ANTI JOIN incoming i USING (symbol, trade_date) UNION ALL SELECT * FROM incoming)""", dates="trade_date")
def upsert_bars(spark: SparkSession, d: str) -> DataFrame:
    """Incoming bars win over stored ones with the same key."""
    rows, day = bars(spark, d), F.col("trade_date")
    new = rows.where(day >= F.lit("2001-06-01").cast("date")).withColumns({"open": F.col("open") * 1.01, "volume": F.col("volume") + 100})
    merged = upsert(rows.where(day < F.lit("2001-07-01").cast("date")), new, ["symbol", "trade_date"], [F.desc("volume")])
    return merged.withColumn("open", r6(F.col("open")))


@query("insert_ignore", """
WITH src AS (SELECT doc_id, source AS exchange, text AS title, n_chars FROM documents WHERE doc_id IS NOT NULL),
stored AS (SELECT * FROM src WHERE doc_id % 3 <> 0), incoming AS (SELECT doc_id, exchange, 'new: ' || title AS title, n_chars FROM src)
SELECT * FROM stored UNION ALL SELECT i.* FROM incoming i ANTI JOIN stored USING (exchange, doc_id)""")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Announcements whose key is new are added; stored ones stay as they are."""
    rows = table(spark, d, "documents").where("doc_id is not null").select("doc_id", F.col("source").alias("exchange"), F.col("text").alias("title"), "n_chars")
    new = rows.withColumn("title", F.concat(F.lit("new: "), "title"))
    return insert_absent(rows.where("doc_id % 3 <> 0"), new, ["exchange", "doc_id"], [F.asc("title")])


TAGS = """tags AS (SELECT DISTINCT trade_date, symbol, trim(tag) AS tag FROM (
  SELECT trade_date, symbol, unnest(string_split_regex(reason, '[+、,，/|]')) AS tag FROM {0}) WHERE trim(tag) <> '')"""


@query("day_replace_tags", with_("themes") + ", fresh AS (SELECT trade_date, symbol, 'PROMO+' || reason AS reason FROM themes WHERE trade_date >= DATE '2001-06-01' AND symbol < '000060'), replaced AS (SELECT t.* FROM themes t ANTI JOIN (SELECT DISTINCT trade_date FROM fresh) USING (trade_date) UNION ALL SELECT * FROM fresh), " + TAGS.format("replaced") + " SELECT trade_date, tag, count(*)::INT AS stock_count FROM tags GROUP BY 1, 2", dates="trade_date")
def day_replace_tags(spark: SparkSession, d: str) -> DataFrame:
    """Whole days are replaced, and the tag counts are made anew."""
    rows = theme_days(spark, d)
    new = rows.where((F.col("trade_date") >= F.lit("2001-06-01").cast("date")) & (F.col("symbol") < "000060")).withColumn("reason", F.concat(F.lit("PROMO+"), "reason"))
    tags = replace_days(rows, new).select("trade_date", F.explode(split_tags(F.col("reason"))).alias("tag"))
    return tags.groupBy("trade_date", "tag").agg(F.count(F.lit(1)).cast("int").alias("stock_count"))


@query("purge_day", with_("themes") + ", " + TAGS.format("themes") + " SELECT tag, count(*) AS rows_left FROM tags WHERE trade_date <> DATE '1998-03-03' GROUP BY 1")
def purge_day(spark: SparkSession, d: str) -> DataFrame:
    rows = theme_days(spark, d).where(F.col("trade_date") != F.lit("1998-03-03").cast("date"))
    return rows.select(F.explode(split_tags(F.col("reason"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("rows_left"))


@query("coverage_report", with_("bars", "statements", "unusual") + """
SELECT 'bars' AS name, count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, min(trade_date) AS first_date, max(trade_date) AS last_date FROM bars
UNION ALL SELECT 'statements', count(*), count(DISTINCT symbol), min(stat_date), max(stat_date) FROM statements
UNION ALL SELECT 'unusual', count(*), count(DISTINCT symbol), min(trade_date), max(trade_date) FROM unusual""", dates="first_date last_date")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    def cover(name: str, rows: DataFrame, day: str) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("symbol").alias("n_symbols"), F.min(day).alias("first_date"), F.max(day).alias("last_date")).select(F.lit(name).alias("name"), "*")

    out = cover("bars", bars(spark, d), "trade_date").unionByName(cover("statements", statements(spark, d), "stat_date"))
    return out.unionByName(cover("unusual", unusual_trades(spark, d), "trade_date"))


@query("symbol_spans", with_("bars") + " SELECT symbol, count(DISTINCT trade_date) AS n_days, min(trade_date) AS first_date, max(trade_date) AS last_date FROM bars GROUP BY 1", dates="first_date last_date")
def symbol_spans(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).groupBy("symbol").agg(F.count_distinct("trade_date").alias("n_days"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


@query("known_symbols", with_("bars") + " SELECT symbol FROM bars UNION SELECT lpad(user_id::VARCHAR, 6, '0') FROM events")
def known_symbols(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).select("symbol").union(unusual_trades(spark, d).select("symbol")).distinct()


@query("snapshot_quality", with_("unusual") + """, snap AS (SELECT trade_date, CASE WHEN day(trade_date) % 11 <> 0 THEN net_buy END AS change, CASE WHEN day(trade_date) % 7 = 0 THEN NULL
  WHEN day(trade_date) % 5 = 0 AND event_id % 3 = 0 THEN strftime(trade_date - 1, '%Y-%m-%d') ELSE strftime(trade_date, '%Y-%m-%d') END AS source_date FROM unusual)
SELECT trade_date, count(*) AS n_rows, count(change) AS n_values, min(source_date) AS source_date FROM snap
GROUP BY 1 HAVING count(change) = 0 OR min(source_date) IS NULL OR min(source_date) <> strftime(trade_date, '%Y-%m-%d')""", dates="trade_date")
def snapshot_quality(spark: SparkSession, d: str) -> DataFrame:
    """Days whose snapshot is another day's: none of its rows has a value, or the source names no day or another one."""
    at = F.dayofmonth("trade_date")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    told = F.when(at % 7 == 0, None).when((at % 5 == 0) & (F.col("event_id") % 3 == 0), iso(F.date_sub("trade_date", 1))).otherwise(iso("trade_date"))
    rows = unusual_trades(spark, d).select("trade_date", F.when(at % 11 != 0, F.col("net_buy")).alias("change"), told.alias("source_date"))
    return stale_snapshots(rows, "trade_date", "change", "source_date")


RUNS = """runs AS (SELECT event_id AS run_id, 'task' || user_id % 7 AS task, ts::DATE AS target, ts AS started_at,
  CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'EMPTY' WHEN 'click' THEN 'REJECTED' ELSE 'OK' END AS status FROM events)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as a ledger of archive runs."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "FAILED").when(kind == "view", "EMPTY").when(kind == "click", "REJECTED").otherwise("OK")
    return table(spark, d, "events").select(
        F.col("event_id").alias("run_id"), F.concat(F.lit("task"), (F.col("user_id") % 7).cast("string")).alias("task"),
        F.to_date("ts").alias("target"), F.col("ts").alias("started_at"), status.alias("status"),
    )


@query("latest_run_status", f"WITH {RUNS} SELECT task, target, status, run_id FROM runs QUALIFY row_number() OVER (PARTITION BY task, target ORDER BY started_at DESC, run_id DESC) = 1", dates="target")
def latest_run_status(spark: SparkSession, d: str) -> DataFrame:
    return latest_per_key(runs(spark, d), ["task", "target"], [F.desc("started_at"), F.desc("run_id")]).select("task", "target", "status", "run_id")


@query("retryable_dates", f"""WITH {RUNS}, latest AS (SELECT task, target, status FROM runs QUALIFY row_number() OVER (PARTITION BY task, target ORDER BY started_at DESC, run_id DESC) = 1),
days AS (SELECT target, row_number() OVER (ORDER BY target DESC) AS age FROM (SELECT DISTINCT target FROM runs)),
tasks AS (SELECT DISTINCT task FROM runs)
SELECT t.task, d.target, coalesce(l.status, 'NEVER') AS status FROM tasks t CROSS JOIN days d LEFT JOIN latest l ON l.task = t.task AND l.target = d.target
WHERE l.status IS NULL OR l.status IN ('FAILED', 'REJECTED') OR (l.status = 'EMPTY' AND d.age <= 5)""", dates="target")
def retryable_dates(spark: SparkSession, d: str) -> DataFrame:
    """Days to fetch again: never run, failed or rejected, or empty within the last five days.

    The calendar and the task list are one row a day and a task; the days are
    laid out for each task by exploding the calendar's array.
    """
    ledger = runs(spark, d)
    latest = latest_per_key(ledger, ["task", "target"], [F.desc("started_at"), F.desc("run_id")]).select("task", "target", "status")
    days = ledger.select("target").distinct().agg(F.reverse(F.array_sort(F.collect_list("target"))).alias("days"))
    laid = ledger.select("task").distinct().withColumn("days", days.scalar()).select("task", F.posexplode("days").alias("age", "target"))
    found = laid.join(latest, ["task", "target"], "left")
    retry = F.col("status").isNull() | F.col("status").isin("FAILED", "REJECTED") | ((F.col("status") == "EMPTY") & (F.col("age") < 5))
    return found.where(retry).select("task", "target", F.coalesce("status", F.lit("NEVER")).alias("status"))


@query("recent_runs", f"WITH {RUNS} SELECT run_id, task, status, started_at + INTERVAL 8 HOUR AS local_time FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 50")
def recent_runs(spark: SparkSession, d: str) -> DataFrame:
    local = F.col("started_at") + F.expr("interval 8 hours")
    return runs(spark, d).orderBy(F.desc("started_at"), F.desc("run_id")).limit(50).select("run_id", "task", "status", local.alias("local_time"))


@query("valuation_asof", with_("panel", "statements") + """, prof AS (SELECT symbol, sum(net_profit) AS profit, sum(shares) AS shares FROM statements WHERE pub_date <= DATE '2000-12-31' AND stat_date > DATE '1999-12-31' GROUP BY 1)
SELECT symbol, p.trade_date, close, round(close / nullif(profit / nullif(shares, 0), 0), 6) + 0.0 AS pe_ttm
FROM (SELECT symbol, max(trade_date) AS trade_date, max_by(close, trade_date) AS close FROM panel WHERE trade_date <= DATE '1996-12-31' GROUP BY 1) p LEFT JOIN prof USING (symbol)""", dates="trade_date")
def valuation_asof(spark: SparkSession, d: str) -> DataFrame:
    """The latest close on or before a date, over the profit per share of the last four published quarters."""
    day = lambda x: F.lit(x).cast("date")
    price = panel(spark, d).where(F.col("trade_date") <= day("1996-12-31")).groupBy("symbol").agg(F.max("trade_date").alias("trade_date"), F.max_by("close", "trade_date").alias("close"))
    prof = statements(spark, d).where((F.col("pub_date") <= day("2000-12-31")) & (F.col("stat_date") > day("1999-12-31"))).groupBy("symbol").agg(F.sum("net_profit").alias("profit"), F.sum("shares").alias("shares"))
    zero = lambda c: F.nullif(c, F.lit(0.0))
    return price.join(prof, "symbol", "left").select("symbol", "trade_date", "close", r6(F.col("close") / zero(F.col("profit") / zero(F.col("shares").cast("double")))).alias("pe_ttm"))


@query("financial_asof", with_("statements") + " SELECT symbol, stat_date, pub_date, revenue, net_profit FROM statements WHERE pub_date <= DATE '2000-03-31' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY pub_date DESC, stat_date DESC) = 1", dates="stat_date pub_date")
def financial_asof(spark: SparkSession, d: str) -> DataFrame:
    """What was published by a date: the cut is on publication, and so is the order."""
    known = statements(spark, d).where(F.col("pub_date") <= F.lit("2000-03-31").cast("date"))
    return latest_per_key(known, ["symbol"], [F.desc("pub_date"), F.desc("stat_date")]).select("symbol", "stat_date", "pub_date", "revenue", "net_profit")


@query("financial_history", with_("statements") + " SELECT symbol, stat_date, pub_date, revenue, net_profit, row_number() OVER (PARTITION BY symbol ORDER BY stat_date DESC, pub_date DESC)::INT AS place FROM statements WHERE pub_date <= DATE '2000-03-31' QUALIFY place <= 5", dates="stat_date pub_date")
def financial_history(spark: SparkSession, d: str) -> DataFrame:
    """The last five disclosed periods, ordered by period."""
    known = statements(spark, d).where(F.col("pub_date") <= F.lit("2000-03-31").cast("date"))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("stat_date"), F.desc("pub_date")))
    return known.withColumn("place", place).where("place <= 5").select("symbol", "stat_date", "pub_date", "revenue", "net_profit", "place")


@query("instrument_master", with_("instruments") + " SELECT symbol, name, industry, market, listed_date, CASE WHEN DATE '2000-12-31' - listed_date >= 0 THEN (DATE '2000-12-31' - listed_date)::INT END AS listed_days FROM instruments", dates="listed_date")
def instrument_master(spark: SparkSession, d: str) -> DataFrame:
    """Listing age counts from the as-of date; a later listing has none."""
    age = F.datediff(F.lit("2000-12-31").cast("date"), "listed_date")
    return instruments(spark, d).withColumn("listed_days", F.when(age >= 0, age))


@query("refresh_batch", with_("statements") + """, state AS (SELECT symbol, max(stat_date) AS last_period, list_sort(list(DISTINCT stat_date)) AS periods FROM statements GROUP BY 1)
SELECT symbol, last_period, len(periods)::INT AS n_periods FROM state WHERE DATE '2002-02-15' - last_period >= 30 ORDER BY last_period, symbol LIMIT 20""", dates="last_period")
def refresh_batch(spark: SparkSession, d: str) -> DataFrame:
    """The symbols that are due, the oldest first."""
    state = statements(spark, d).groupBy("symbol").agg(F.max("stat_date").alias("last_period"), F.size(F.collect_set("stat_date")).alias("n_periods"))
    due = state.where(F.datediff(F.lit("2002-02-15").cast("date"), "last_period") >= 30)
    return due.orderBy("last_period", "symbol").limit(20)
