"""Queries of the cross-market network: order priorities as factors, regions as sectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import change
from tidemark.operators import network as ops
from tidemark.plans.factors import shown, sql6
from tidemark.plans.registry import query
from tidemark.sources.tables import table

#: Days of the correlations' window.
WINDOW_DAYS = 120

LEVEL_SQL = """sec AS (SELECT r_name AS id, o_orderdate::DATE AS day, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS amount, count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
levels AS (SELECT id, day, amount, 100::DOUBLE + (round(amount)::BIGINT % 997)::DOUBLE / 100::DOUBLE AS level FROM sec),
fac AS (SELECT o_orderpriority AS id, o_orderdate::DATE AS day, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS amount FROM orders GROUP BY 1, 2),
observed AS (SELECT id, day, 100::DOUBLE + (round(amount)::BIGINT % 991)::DOUBLE / 100::DOUBLE AS level FROM fac)"""


def levels(spark: SparkSession, d: str) -> DataFrame:
    """``id, day, amount, level`` of the sectors."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    by = rows.groupBy(F.col("r_name").alias("id"), F.to_date("o_orderdate").alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("amount"))
    return by.withColumn("level", 100.0 + (F.round("amount").cast("bigint") % 997).cast("double") / 100.0)


def observed(spark: SparkSession, d: str) -> DataFrame:
    """``id, day, level`` of the factors; a factor has a gap on a day without orders."""
    by = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("id"), F.to_date("o_orderdate").alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("amount"))
    return by.select("id", "day", (100.0 + (F.round("amount").cast("bigint") % 991).cast("double") / 100.0).alias("level"))


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Each factor on each day of the sectors' calendar; the calendar is one array, which grows with time and not with rows."""
    calendar = table(spark, d, "orders").agg(F.collect_set(F.to_date("o_orderdate"))).scalar()
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("id")).distinct().select("id", F.explode(calendar).alias("day"))


CHANGE_SQL = LEVEL_SQL + """,
grid AS (SELECT f.id, g.day FROM (SELECT DISTINCT id FROM observed) f CROSS JOIN (SELECT DISTINCT day FROM levels) g),
asof0 AS (SELECT g.id, g.day, o.day AS seen_at, o.level FROM grid g ASOF LEFT JOIN observed o ON g.id = o.id AND g.day > o.day),
asof1 AS (SELECT id, day, CASE WHEN day - seen_at <= 7 THEN seen_at END AS seen_at, CASE WHEN day - seen_at <= 7 THEN level END AS level FROM asof0),
changes AS (SELECT id, day, level / nullif(lag(level) OVER (PARTITION BY id ORDER BY day), 0) - 1 AS change FROM asof1),
returns AS (SELECT id, day, level / nullif(lag(level) OVER (PARTITION BY id ORDER BY day), 0) - 1 AS ret FROM levels)"""


@query("lagged_changes", f"WITH {CHANGE_SQL} SELECT id, day, {sql6('change')} FROM changes", dates="day")
def lagged_changes(spark: SparkSession, d: str) -> DataFrame:
    return shown(ops.lagged_changes(grid(spark, d), observed(spark, d)))


def returns(spark: SparkSession, d: str) -> DataFrame:
    return levels(spark, d).select("id", "day", change(F.col("level"), F.lag("level").over(Window.partitionBy("id").orderBy("day"))).alias("ret"))


RELATION_SQL = CHANGE_SQL + """,
rel0 AS (SELECT c.id AS factor, r.id AS sector, count(*) AS n, covar_pop(change, ret) / nullif(stddev_pop(change) * stddev_pop(ret), 0) AS r FROM changes c JOIN returns r USING (day) WHERE change IS NOT NULL AND ret IS NOT NULL AND day > (SELECT max(day) FROM levels) - 120 GROUP BY 1, 2),
rel1 AS (SELECT factor, sector, n, CASE WHEN n >= 20 THEN greatest(least(r, 1.0), -1.0) END AS rho FROM rel0),
relations AS (SELECT factor, sector, n, rho, tanh(atanh(greatest(least(rho, 0.999999), -0.999999)) - 1.96 / sqrt(nullif(greatest(n - 3, 0), 0))) AS low, tanh(atanh(greatest(least(rho, 0.999999), -0.999999)) + 1.96 / sqrt(nullif(greatest(n - 3, 0), 0))) AS high, coalesce(abs(rho) >= 0.3, false) AS connected FROM rel1)"""


def relations(spark: SparkSession, d: str) -> DataFrame:
    """Correlations over the last ``WINDOW_DAYS`` days that the sectors have."""
    last = table(spark, d, "orders").agg(F.max(F.to_date("o_orderdate"))).scalar()
    return ops.network(ops.lagged_changes(grid(spark, d), observed(spark, d)), returns(spark, d), F.date_sub(last, WINDOW_DAYS - 1))


@query("correlation_network", f"WITH {RELATION_SQL} SELECT factor, sector, n, {sql6('rho', 'low', 'high')}, connected FROM relations")
def correlation_network(spark: SparkSession, d: str) -> DataFrame:
    return shown(relations(spark, d))


@query("network_summary", f"WITH {RELATION_SQL} SELECT count(*) AS possible, count(rho) AS valid, count(*) FILTER (WHERE connected) AS n_connected, round(count(*) FILTER (WHERE connected) / nullif(count(rho), 0), 6) + 0.0 AS density, round(avg(abs(rho)) FILTER (WHERE connected), 6) + 0.0 AS average_strength, arg_max(factor, (abs(rho), factor, sector)) AS factor, arg_max(sector, (abs(rho), factor, sector)) AS sector FROM relations WHERE rho IS NOT NULL")
def network_summary(spark: SparkSession, d: str) -> DataFrame:
    return shown(ops.network_summary(relations(spark, d).where("rho is not null")))


BASKET_SQL = LEVEL_SQL + """,
common AS (SELECT day FROM levels GROUP BY 1 HAVING count(DISTINCT id) = 5),
b AS (SELECT l.*, level / nullif(lag(level) OVER w, 0) - 1 AS ret, CASE WHEN row_number() OVER w >= 20 THEN level > avg(level) OVER (PARTITION BY id ORDER BY day ROWS 19 PRECEDING) END AS above, amount / sum(amount) OVER (PARTITION BY day) AS share FROM levels l JOIN common USING (day) WINDOW w AS (PARTITION BY id ORDER BY day)),
basket AS (SELECT day, avg(above::INT) * 100 AS breadth, stddev_pop(ret) * 100 AS dispersion, sum(share * share) AS hhi FROM b WHERE above IS NOT NULL GROUP BY 1)"""


@query("basket_history", f"WITH {BASKET_SQL} SELECT day, {sql6('breadth', 'dispersion', 'hhi')} FROM basket", dates="day")
def basket_history(spark: SparkSession, d: str) -> DataFrame:
    return shown(ops.basket(levels(spark, d), 5))


@query("basket_synchrony", f"WITH {CHANGE_SQL}, p AS (SELECT a.day, a.id AS a, b.id AS b, a.ret AS x, b.ret AS y FROM returns a JOIN returns b ON a.day = b.day AND a.id < b.id WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL), " + """
q AS (SELECT day, CASE WHEN count(*) OVER w >= 20 THEN covar_pop(x, y) OVER w / nullif(stddev_pop(x) OVER w * stddev_pop(y) OVER w, 0) END AS rho FROM p WINDOW w AS (PARTITION BY a, b ORDER BY day ROWS 59 PRECEDING))
SELECT day, count(rho) AS n_pairs, round(avg((round(abs(rho), 9) >= 0.3)::INT) FILTER (WHERE rho IS NOT NULL), 6) + 0.0 AS synchrony FROM q GROUP BY 1""", dates="day")
def basket_synchrony(spark: SparkSession, d: str) -> DataFrame:
    return shown(ops.synchrony(returns(spark, d)))


@query("midrank_percentile", f"WITH {LEVEL_SQL}, h AS (SELECT id, day, level, list(level) OVER (PARTITION BY id ORDER BY day ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) AS past FROM levels) SELECT id, day, round(CASE WHEN len(past) >= 60 THEN 100 * (len(list_filter(past, lambda x: x < level)) + 0.5::DOUBLE * len(list_filter(past, lambda x: x = level))) / len(past) END, 6) + 0.0 AS pct FROM h", dates="day")
def midrank_percentile(spark: SparkSession, d: str) -> DataFrame:
    return shown(levels(spark, d).select("id", "day", ops.midrank_percentile("level", ["id"], "day").alias("pct")))


@query("source_summary", f"WITH {LEVEL_SQL}, o AS (SELECT *, lag(level) OVER (PARTITION BY id ORDER BY day) AS previous FROM observed) SELECT id, max(day) AS last_day, round(arg_max(level, day), 6) + 0.0 AS level, round(arg_max(level / previous - 1, day), 6) + 0.0 AS change, ((SELECT max(day) FROM observed) + 2 - max(day))::INT AS age_days, (SELECT max(day) FROM observed) + 2 - max(day) > 4 AS stale FROM o GROUP BY 1", dates="last_day")
def source_summary(spark: SparkSession, d: str) -> DataFrame:
    """Last level of each source, its change, its age two days after the last day of all, and whether it is stale."""
    today = F.date_add(table(spark, d, "orders").agg(F.max(F.to_date("o_orderdate"))).scalar(), 2)
    rows = observed(spark, d).withColumn("change", change(F.col("level"), F.lag("level").over(Window.partitionBy("id").orderBy("day"))))
    age = F.datediff(today, F.max("day"))
    return shown(rows.groupBy("id").agg(F.max("day").alias("last_day"), F.max_by("level", "day").alias("level"), F.max_by("change", "day").alias("change"), age.alias("age_days"), (age > 4).alias("stale")))


@query("clean_series", """WITH raw AS (SELECT o_orderpriority AS id, CASE WHEN o_orderkey % 17 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day_text, CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' ELSE o_totalprice::DECIMAL(18,2)::VARCHAR END AS close_text, o_orderkey AS seq FROM orders),
c AS (SELECT id, try_cast(day_text AS DATE) AS day, try_cast(close_text AS DOUBLE) AS close, seq FROM raw)
SELECT id, day, arg_max(close, seq) AS close FROM c WHERE day IS NOT NULL AND day <= DATE '2000-01-01' AND close > 0 GROUP BY 1, 2""", dates="day")
def clean_series(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a valid past date and a positive number; the last duplicate wins."""
    key = F.col("o_orderkey")
    raw = table(spark, d, "orders").select(F.col("o_orderpriority").alias("id"), F.when(key % 17 == 0, "bad").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day_text"), F.when(key % 13 == 0, "n/a").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("close_text"), key.alias("seq"))
    rows = raw.select("id", F.col("day_text").try_cast("date").alias("day"), F.col("close_text").try_cast("double").alias("close"), "seq")
    good = rows.where(F.col("day").isNotNull() & (F.col("day") <= F.lit("2000-01-01").cast("date")) & (F.col("close") > 0))
    return good.groupBy("id", "day").agg(F.max_by("close", "seq").alias("close"))
