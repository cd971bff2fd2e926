"""Streaming queries over the events; each is drained and read as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.versioned import VersionedTable, cascade
from tidemark.plans.registry import query
from tidemark.session import materialise, scratch_path
from tidemark.sources import paged
from tidemark.sources.market import theme_days, with_
from tidemark.sources.tables import table
from tidemark.streaming import events as ops
from tidemark.streaming.late import split_late_by_key


@query("stream_hourly", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value::DECIMAL(18,4))::DOUBLE, 4) AS total FROM events GROUP BY 1, 2")
def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling hours by kind of event, as the stream leaves them at its end."""
    out = ops.drain(ops.windowed_counts(ops.events(spark, d), "ts", ["event_type"], "1 hour", "2 hours"), "complete")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_overlap_dedup", "SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1")
def stream_overlap_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every event is read twice, as by an overlapping cursor, and counts once."""
    stream = ops.events(spark, d)
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out = ops.drain(ops.once_per_key(twice, "event_id", "ts", "5 days"), "append")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("stream_latest_upsert", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def stream_latest_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of each user and kind, by merging each batch into a table."""
    return ops.latest_by_upsert(ops.events(spark, d).select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("stream_late_rows", """WITH a AS (SELECT 1 AS part, ts::DATE AS day, event_id FROM events WHERE ts < TIMESTAMP '2024-01-11'), b AS (SELECT 2, ts::DATE, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-21'),
c AS (SELECT 3, ts::DATE, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-21' OR ts < TIMESTAMP '2024-01-05')
SELECT CASE WHEN part = 3 AND day < DATE '2024-01-05' THEN 'late' ELSE 'in time' END AS kind, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY 1""", dates="first_day last_day")
def stream_late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Three files come one by one, the stream is stopped and goes on in between; old rows of the third are late."""
    root = ops.stream_root(spark, "late")
    rows, ts = table(spark, d, "events"), F.col("ts").cast("timestamp")
    cut = lambda x: F.lit(x).cast("timestamp")
    parts = (ts < cut("2024-01-11"), (ts >= cut("2024-01-11")) & (ts < cut("2024-01-21")), (ts >= cut("2024-01-21")) | (ts < cut("2024-01-05")))
    for number, part in enumerate(parts):
        rows.where(part).coalesce(1).write.parquet(f"{root}/in/{number}")
        stream = spark.readStream.schema(ops.SCHEMA).parquet(f"{root}/in/*").withColumn("ts", F.col("ts").cast("timestamp"))
        in_time, late = ops.split_late(stream, "ts", 5, root)
    both = in_time.select(F.lit("in time").alias("kind"), "ts").unionByName(late.select(F.lit("late").alias("kind"), "ts"))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.to_date("ts")).alias("first_day"), F.max(F.to_date("ts")).alias("last_day"))


@query("stream_late_by_user", """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 13 = 0 THEN ts - INTERVAL 7 DAY ELSE ts END AS told FROM events),
m AS (SELECT *, max(told) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM e)
SELECT coalesce(told < newest - INTERVAL 5 DAY, false) AS is_late, told::DATE AS day, count(*) AS n, sum(event_id)::BIGINT AS ids FROM m GROUP BY 1, 2""", dates="day")
def stream_late_by_user(spark: SparkSession, d: str) -> DataFrame:
    """Every thirteenth event tells of a week ago; it is late if its user has newer ones by more than five days."""
    stream = ops.events(spark, d).withColumn("told", F.when(F.col("event_id") % 13 == 0, F.col("ts") - F.expr("INTERVAL 7 DAYS")).otherwise(F.col("ts")))
    in_time, late = split_late_by_key(stream.select("event_id", "user_id", "told"), "user_id", "told", "event_id", 5, ops.stream_root(spark, "late-by-user"))
    both = in_time.withColumn("is_late", F.lit(False)).unionByName(late.withColumn("is_late", F.lit(True)))
    return both.groupBy("is_late", F.to_date("told").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def order_pages(spark: SparkSession, d: str, until: str) -> DataFrame:
    """Orders as announcements of five exchanges, one page a month, newest first."""
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, d, "orders").where(day <= F.lit(until).cast("date")).select(F.substring("o_orderpriority", 1, 1).alias("exchange"), day.alias("day"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"))
    newest = rows.groupBy("exchange").agg(F.max("day").alias("newest"))
    back = F.months_between(F.trunc("newest", "month"), F.trunc("day", "month")).cast("int")
    return rows.join(newest, "exchange").withColumn("page", back + 1)


#: The first reading of the cursors ends here, the second at the end of all orders.
FIRST_UNTIL, PAGES_SINCE = "1999-06-20", "2000-03-15"


@query("paged_since", f"""SELECT substr(o_orderpriority, 1, 1) AS exchange, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, min(o_orderdate)::DATE AS first_day, sum(o_orderkey)::BIGINT AS ids FROM orders WHERE o_orderdate >= DATE '{PAGES_SINCE}' GROUP BY 1, 2""", dates="month first_day")
def paged_since(spark: SparkSession, d: str) -> DataFrame:
    """A filter on the day stops the paging: older pages are not opened."""
    paged.register(spark)
    root = scratch_path(spark, "pages")
    paged.write_pages(order_pages(spark, d, "9999-12-31"), root)
    rows = spark.read.format("paged_announcements").load(root).where(F.col("day") >= F.lit(PAGES_SINCE).cast("date"))
    return rows.groupBy("exchange", F.trunc("day", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.sum(F.col("announcement_id").cast("long")).alias("ids"))


@query("cursor_stream", """SELECT substr(o_orderpriority, 1, 1) AS exchange, count(*) AS n, max(o_orderdate)::DATE AS last_day, sum(o_orderkey)::BIGINT AS ids FROM orders GROUP BY 1""", dates="last_day")
def cursor_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream with a cursor for each exchange, read twice; the second reading begins five days before each cursor, and known keys stay."""
    paged.register(spark)
    pages, root = scratch_path(spark, "pages"), ops.stream_root(spark, "cursor-stream")
    for until in (FIRST_UNTIL, "9999-12-31"):
        paged.write_pages(order_pages(spark, d, until), pages)
        stream = spark.readStream.format("paged_announcements").load(pages)
        found = ops.insert_ignored(stream, ["exchange", "announcement_id"], "page", root)
    return found.groupBy("exchange").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("last_day"), F.sum(F.col("announcement_id").cast("long")).alias("ids"))


@query("purge_cascade", with_("themes") + """, stored AS (SELECT trade_date, symbol, reason FROM themes WHERE NOT (month(trade_date) = 6 AND day(trade_date) < 8) OR symbol < '000003'),
tags AS (SELECT DISTINCT trade_date, symbol, split_part(reason, '、', 1) AS tag FROM themes WHERE NOT (month(trade_date) = 6 AND day(trade_date) < 8))
SELECT year, n, n_tags FROM (SELECT year(trade_date)::INT AS year, count(*) AS n FROM stored GROUP BY 1) JOIN (SELECT year(trade_date)::INT AS year, count(*) AS n_tags FROM tags GROUP BY 1) USING (year)""")
def purge_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Days are purged from a table and from the tags that hang on it; a later batch brings some of the rows back."""
    rows, day = materialise(theme_days(spark, d), "theme-days"), F.col("trade_date")  # read by every batch
    tag = F.substring_index("reason", "、", 1)
    bad = (F.month("trade_date") == 6) & (F.dayofmonth("trade_date") < 8)
    tables = [VersionedTable(spark, scratch_path(spark, "themes"), rows.schema, ("trade_date", "symbol")), VersionedTable(spark, scratch_path(spark, "tags"), rows.select(day, "symbol", tag.alias("tag")).schema, ("trade_date", "symbol", "tag"))]
    tables[0].write(rows, 0, [F.asc("reason")], like=rows)
    tables[1].write(rows.select(day, "symbol", tag.alias("tag")), 0, [F.asc("tag")], like=rows)
    cascade(tables, rows.where(bad).select("trade_date"), 1)
    tables[0].write(rows.where(bad & (F.col("symbol") < "000003")), 2, [F.asc("reason")], like=rows)
    years = [t.read().groupBy(F.year("trade_date").alias("year")).agg(F.count(F.lit(1)).alias(name)) for t, name in zip(tables, ("n", "n_tags"), strict=True)]
    return years[0].join(years[1], "year")
