"""Checks of coverage and consistency, calendars and windows, evaluation summaries, and tables that go out and come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import gates, reports, sinks
from tidemark.operators.keyed import insert_absent, replace_whole_days
from tidemark.operators.windows import choose_windows
from tidemark.plans import daily, forward
from tidemark.plans.factors import shown
from tidemark.plans.registry import ORACLES, query
from tidemark.session import scratch_path
from tidemark.sources.market import bars, panel, theme_days, with_
from tidemark.sources.tables import table


def date_of(text: str):
    return F.lit(text).cast("date")


# Coverage and consistency ---------------------------------------------------------------------------


@query("daily_coverage", with_("panel") + " SELECT trade_date, count(*) AS n_rows, count(pre_close) AS n_values, round(count(pre_close) / count(*), 6) + 0.0 AS share FROM panel GROUP BY 1", dates="trade_date")
def daily_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each day, and how many of them have a value."""
    return shown(panel(spark, d).groupBy("trade_date").agg(F.count(F.lit(1)).alias("n_rows"), F.count("pre_close").alias("n_values"), (F.count("pre_close") / F.count(F.lit(1))).alias("share")))


@query("duplicate_consistency", """WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_shipdate) AS dates FROM lineitem GROUP BY 1, 2)
SELECT count(*) AS n_keys, count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE parts > 1) AS other_part, count(*) FILTER (WHERE dates > 1) AS other_date FROM k""")
def duplicate_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Keys that stand in several rows, and those whose rows do not agree.

    Rows agree if least and greatest are the same, which needs no distinct counts.
    """
    differs = lambda c: F.max(c) > F.min(c)
    keys = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.count(F.lit(1)) > 1).alias("r"), differs("l_partkey").alias("p"), differs("l_shipdate").alias("s"))
    return keys.agg(F.count(F.lit(1)).alias("n_keys"), F.count_if("r").alias("repeated"), F.count_if("p").alias("other_part"), F.count_if("s").alias("other_date"))


@query("announcement_ids", "SELECT doc_id, left(sha256(concat_ws('|', source, lang, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'second ' || text END)), 24) AS record_id FROM documents")
def announcement_ids(spark: SparkSession, d: str) -> DataFrame:
    """Announcements of two exchanges name their title differently; the id is a hash of the normalised fields."""
    rows = table(spark, d, "documents")
    raw = rows.select("doc_id", "source", "lang", F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("title"), F.when(F.col("doc_id") % 2 != 0, F.concat(F.lit("second "), "text")).alias("announcementTitle"))
    title = F.coalesce("title", "announcementTitle")
    return raw.select("doc_id", F.substring(F.sha2(F.concat_ws("|", "source", "lang", title).cast("binary"), 256), 1, 24).alias("record_id"))


@query("xml_rates", "SELECT n_name AS name, date_trunc('month', o_orderdate)::DATE AS day, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS rate, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2", dates="day")
def xml_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates in XML entries, one document a nation, parsed with a typed schema."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    by = rows.groupBy("n_name", F.trunc("o_orderdate", "month").alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("rate"), F.count(F.lit(1)).alias("n"))
    entry = F.concat(F.lit("<entry><day>"), F.col("day").cast("string"), F.lit("T00:00:00</day><rate>"), F.col("rate").cast("string"), F.lit("</rate><n>"), F.col("n").cast("string"), F.lit("</n></entry>"))
    feed = by.groupBy("n_name").agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("xml"))
    parsed = feed.select(F.col("n_name").alias("name"), F.explode(F.from_xml("xml", "entry array<struct<day: string, rate: double, n: bigint>>")["entry"]).alias("e"))
    return parsed.select("name", F.substring("e.day", 1, 10).try_cast("date").alias("day"), F.col("e.rate").alias("rate"), F.col("e.n").alias("n"))


# Calendars and windows ------------------------------------------------------------------------------

NOWS = ("2024-01-05 15:29:59", "2024-01-05 15:30:00", "2024-01-20 09:00:00", "2024-02-10 12:00:00")


@query("latest_complete_session", "WITH n(now) AS (VALUES " + ", ".join(f"(TIMESTAMP '{x}')" for x in NOWS) + "), s AS (SELECT DISTINCT ts::DATE AS day FROM events) SELECT strftime(now, '%Y-%m-%d %H:%M:%S') AS at, max(day) FILTER (WHERE day < now::DATE OR (day = now::DATE AND now::TIME >= TIME '15:30:00')) AS day FROM s, n GROUP BY 1", dates="day")
def latest_complete_session(spark: SparkSession, d: str) -> DataFrame:
    """The last session that is over at an instant: today's counts only from 15:30 on."""
    days = table(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    at = days.select("day", F.explode(F.array(*[F.lit(x) for x in NOWS])).alias("at"))
    now = F.to_timestamp("at", "yyyy-MM-dd HH:mm:ss")
    over = (F.col("day") < F.to_date(now)) | ((F.col("day") == F.to_date(now)) & (F.date_format(now, "HH:mm") >= "15:30"))
    return at.groupBy("at").agg(F.max(F.when(over, F.col("day"))).alias("day"))


@query("history_span", with_("bars") + """, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS pos FROM (SELECT DISTINCT trade_date FROM bars)),
b AS (SELECT symbol, trade_date, lag(trade_date, 249) OVER (PARTITION BY symbol ORDER BY trade_date) AS older FROM bars)
SELECT symbol, count(*) AS n, count(*) FILTER (WHERE c.pos - o.pos <= 299) AS n_dense, min(c.pos - o.pos) AS least_span, max(c.pos - o.pos) AS most_span FROM b JOIN cal c USING (trade_date) JOIN cal o ON o.trade_date = older GROUP BY 1""")
def history_span(spark: SparkSession, d: str) -> DataFrame:
    """How many sessions the last 250 bars of a symbol span: the date and the one 249 bars before, each joined with the calendar."""
    rows = bars(spark, d).select("symbol", "trade_date", F.lag("trade_date", 249).over(Window.partitionBy("symbol").orderBy("trade_date")).alias("older")).where("older is not null")
    days = bars(spark, d).select("trade_date").distinct()
    calendar = days.withColumn("pos", F.row_number().over(Window.orderBy("trade_date")))  # one row a day
    joined = rows.join(calendar, "trade_date").join(calendar.select(F.col("trade_date").alias("older"), F.col("pos").alias("from")), "older")
    span = F.col("pos") - F.col("from")
    return joined.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(span <= 299).alias("n_dense"), F.min(span).alias("least_span"), F.max(span).alias("most_span"))


ANCHORS = ("1996-03-01", "1996-03-20", "1996-08-15", "1997-02-01")
TAKEN = ("1996-02-01", "1996-03-05")


@query("validation_windows", with_("panel") + ", cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS pos FROM (SELECT trade_date FROM panel GROUP BY 1 HAVING count(*) >= 2)), " + "\n".join(
    f"w{i} AS (SELECT '{a}' AS anchor, pos, trade_date AS first_day FROM cal c WHERE trade_date >= DATE '{a}' AND pos > 1 AND pos + 29 <= (SELECT max(pos) FROM cal) AND NOT EXISTS (SELECT 1 FROM cal o WHERE o.pos BETWEEN c.pos AND c.pos + 29 AND o.trade_date BETWEEN DATE '{TAKEN[0]}' AND DATE '{TAKEN[1]}')"
    + "".join(f" AND NOT EXISTS (SELECT 1 FROM w{j} WHERE abs(w{j}.pos - c.pos) < 30)" for j in range(i)) + " ORDER BY pos LIMIT 1),"
    for i, a in enumerate(ANCHORS)
).rstrip(",") + " SELECT anchor, first_day, c.trade_date AS last_day, s.trade_date AS signal_day FROM (" + " UNION ALL ".join(f"SELECT * FROM w{i}" for i in range(len(ANCHORS))) + ") w JOIN cal c ON c.pos = w.pos + 29 JOIN cal s ON s.pos = w.pos - 1", dates="first_day last_day signal_day")
def validation_windows(spark: SparkSession, d: str) -> DataFrame:
    """Thirty-session windows from anchors, greedily: none overlaps an earlier one or the days already used."""
    days = [r["trade_date"] for r in panel(spark, d).groupBy("trade_date").count().where("count >= 2").select("trade_date").orderBy("trade_date").collect()]  # the calendar, a row a day
    chosen = choose_windows([str(x) for x in days], ANCHORS, TAKEN, 30)
    rows = [(w["anchor"], w["days"][0], w["days"][-1], w["before"]) for w in chosen]
    return spark.createDataFrame(rows, "anchor string, first_day string, last_day string, signal_day string")


@query("window_disjointness", f"""WITH w AS (SELECT anchor, strptime(first_day, '%Y-%m-%d')::DATE AS a, strptime(last_day, '%Y-%m-%d')::DATE AS b FROM ({ORACLES['validation_windows']})),
""" + with_("panel").removeprefix("WITH ") + f""", held AS (SELECT DISTINCT anchor, trade_date FROM w JOIN panel ON trade_date BETWEEN a AND b), used AS (SELECT DISTINCT trade_date FROM panel WHERE trade_date BETWEEN DATE '{TAKEN[0]}' AND DATE '{TAKEN[1]}')
SELECT anchor, count(*) AS n_days, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM held o WHERE o.trade_date = h.trade_date AND o.anchor <> h.anchor)) AS shared, count(*) FILTER (WHERE trade_date IN (SELECT trade_date FROM used)) AS seen_before FROM held h GROUP BY 1""")
def window_disjointness(spark: SparkSession, d: str) -> DataFrame:
    """The sessions of each validation window, and how many of them another window or the days seen before have: none may."""
    windows = validation_windows(spark, d)
    days = panel(spark, d).select("trade_date").distinct()
    inside = F.col("trade_date").between(F.col("first_day").cast("date"), F.col("last_day").cast("date"))
    held = windows.join(days, inside).select("anchor", "trade_date")  # a few windows against the calendar
    taken = F.col("trade_date").between(date_of(TAKEN[0]), date_of(TAKEN[1]))
    shared = held.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))
    return held.join(shared, "trade_date").groupBy("anchor").agg(F.count(F.lit(1)).alias("n_days"), F.count_if(F.col("n") > 1).alias("shared"), F.count_if(taken).alias("seen_before"))


#: Minutes after an event at which the gates are asked about its day.
LATER = (0, 360, 1020, 4320)


@query("session_gates", "WITH n AS (SELECT ts::DATE AS day, m AS minutes, ts + to_minutes(m) AS now FROM events, (VALUES " + ", ".join(f"({m})" for m in LATER) + """) v(m)), g AS (SELECT minutes, isodow(day) AS dow, day = now::DATE AND now::TIME >= TIME '15:30:00' AS current, day < now::DATE OR (day = now::DATE AND now::TIME >= TIME '15:30:00') AS closed,
  day + INTERVAL '15 hours 30 minutes' <= now AND now < day + (CASE isodow(day) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END)::INT + INTERVAL '9 hours 30 minutes' AS forward, isodow(now::DATE) < 6 AND now::TIME >= TIME '09:30:00' AND now::TIME < TIME '15:30:00' AS blocked FROM n)
SELECT minutes, dow::INT AS dow, count(*) AS n, count(*) FILTER (WHERE current) AS current_ready, count(*) FILTER (WHERE closed) AS closed_ready, count(*) FILTER (WHERE forward) AS forward_ready, count(*) FILTER (WHERE blocked) AS fetch_blocked FROM g GROUP BY 1, 2""")
def session_gates(spark: SparkSession, d: str) -> DataFrame:
    """All four gates for the day of each event, at four instants after it, counted by week-day."""
    rows = table(spark, d, "events").select("ts", F.to_date("ts").alias("day"), F.explode(F.array(*map(F.lit, LATER))).alias("minutes"))
    rows = rows.select("day", "minutes", (F.col("ts").cast("timestamp") + F.make_dt_interval(mins=F.col("minutes"))).alias("now"))
    day, now = F.col("day"), F.col("now")
    found = {"current_ready": gates.current_ready(day, now), "closed_ready": gates.closed_ready(day, now), "forward_ready": gates.forward_ready(day, now), "fetch_blocked": gates.fetch_blocked(now)}
    return rows.groupBy("minutes", (F.weekday("day") + 1).alias("dow")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in found.items()])


# Evaluation -----------------------------------------------------------------------------------------


@query("cohort_summary", f"""SELECT count(*) AS positions, count(*) FILTER (WHERE status = 'closed') AS matured, count(*) FILTER (WHERE status = 'exit_blocked') AS blocked, count(*) FILTER (WHERE status = 'corporate_action_review') AS gaps, count(*) FILTER (WHERE status = 'holding') AS pending,
  round(avg(net_return), 6) + 0.0 AS mean_net_return, round(min(net_return), 6) + 0.0 AS worst, round(avg((net_return > 0)::INT), 6) + 0.0 AS win_rate,
  CASE WHEN count(*) FILTER (WHERE status IN ('exit_blocked', 'corporate_action_review')) > 0 THEN 'review' WHEN count(net_return) >= 20 THEN CASE WHEN avg(net_return) > 0 THEN 'reached' ELSE 'missed' END ELSE 'collecting' END AS acceptance FROM ({ORACLES['cohort_eval']})""")
def cohort_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts by state, mean, worst and win rate of the matured positions, and whether the sample may be judged."""
    rows, net = daily.cohort_eval(spark, d), F.col("net_return")
    state = lambda *names: F.count_if(F.col("status").isin(*names))
    verdict = F.when(state("exit_blocked", "corporate_action_review") > 0, "review").when(F.count(net) >= 20, F.when(F.avg(net) > 0, "reached").otherwise("missed")).otherwise("collecting")
    return shown(rows.agg(F.count(F.lit(1)).alias("positions"), state("closed").alias("matured"), state("exit_blocked").alias("blocked"), state("corporate_action_review").alias("gaps"), state("holding").alias("pending"), F.avg(net).alias("mean_net_return"), F.min(net).alias("worst"), F.avg(F.when(net > 0, 1.0).when(net.isNotNull(), 0.0)).alias("win_rate"), verdict.alias("acceptance")))


@query("batch_maturity", with_("panel") + f", {forward.JOURNAL_SQL} SELECT horizon, count(DISTINCT (spec, as_of)) AS batches, count(*) FILTER (WHERE n = n_requested) AS matured, sum(n)::BIGINT AS measured, sum(n_requested)::BIGINT AS requested FROM per_run GROUP BY 1")
def batch_maturity(spark: SparkSession, d: str) -> DataFrame:
    """Batches of picks by horizon, and how many of them can be measured in full."""
    by = forward.per_run(spark, d).groupBy("horizon")
    return by.agg(F.count_distinct(F.struct("spec", "as_of")).alias("batches"), F.count_if(F.col("n") == F.col("n_requested")).alias("matured"), F.sum("n").alias("measured"), F.sum("n_requested").alias("requested"))


# Tables that go out and come back -------------------------------------------------------------------


@query("evaluation_files", with_("panel") + f", {forward.JOURNAL_SQL} SELECT 'run' AS kind, count(*) AS n, sum(n)::BIGINT AS measured, round(sum(round(pick_ret, 6)), 4) + 0.0 AS total FROM per_run UNION ALL SELECT 'horizon', count(DISTINCT (spec, horizon)), sum(n)::BIGINT, round(sum(round(pick_ret, 6)), 4) + 0.0 FROM per_run")
def evaluation_files(spark: SparkSession, d: str) -> DataFrame:
    """Two CSV files, by run and by horizon, written, read back with their types, and counted."""
    runs = shown(forward.per_run(spark, d).select("spec", "as_of", "horizon", "n", "n_requested", "pick_ret"))
    horizons = runs.groupBy("spec", "horizon").agg(F.sum("n").alias("n"), F.sum("pick_ret").alias("pick_ret"))
    root = scratch_path(spark, "evaluation")
    reports.write_csv(runs, f"{root}/runs", ["spec", "as_of", "horizon"])
    reports.write_csv(horizons, f"{root}/horizons", ["spec", "horizon"])
    total = lambda kind, schema: reports.read_csv(spark, f"{root}/{kind}s", schema).agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("measured"), F.round(F.sum("pick_ret"), 4).alias("total")).select(F.lit(kind).alias("kind"), "*")
    return total("run", "spec string, as_of date, horizon int, n bigint, n_requested bigint, pick_ret double").unionByName(total("horizon", "spec string, horizon int, n bigint, pick_ret double"))


@query("latest_report", with_("panel") + " SELECT trade_date AS as_of, symbol, round(close, 4) + 0.0 AS close FROM panel WHERE trade_date = DATE '1996-03-15'", dates="as_of")
def latest_report(spark: SparkSession, d: str) -> DataFrame:
    """Of several daily reports the one of the latest date is read, and of two for a date the newer file."""
    root, rows = scratch_path(spark, "reports"), panel(spark, d)
    for number, (day, factor) in enumerate((("1996-03-15", 2.0), ("1996-03-14", 1.0), ("1996-03-15", 1.0))):
        out = rows.where(F.col("trade_date") == date_of(day)).select(F.col("trade_date").alias("as_of"), "symbol", F.round(F.col("close") * factor, 4).alias("close"))
        reports.write_csv(out, f"{root}/report-{number}", ["symbol"])
    return reports.latest_report(spark, f"{root}/report-*", "as_of date, symbol string, close double")


LEDGER = "record_id string, run_date string, kind string, status string, n_rows bigint"


@query("run_ledger", """WITH r AS (SELECT strftime(ts::DATE, '%Y-%m-%d') AS run_date, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT run_date, kind, CASE WHEN n % 7 = 0 THEN 'FAILED' WHEN n % 5 = 0 THEN 'EMPTY' WHEN n % 3 = 0 THEN 'REJECTED' ELSE 'OK' END AS status, CASE WHEN n % 5 = 0 AND n % 7 <> 0 THEN 0 ELSE n END AS n_rows FROM r)
SELECT left(sha256(concat_ws('|', run_date, kind, status, n_rows::VARCHAR)), 16) AS record_id, run_date, kind, status, n_rows FROM s""")
def run_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Runs appended to a ledger in two parts, one of them twice; records without an id get one from their content when they are read."""
    by = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_date"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    status = F.when(n % 7 == 0, "FAILED").when(n % 5 == 0, "EMPTY").when(n % 3 == 0, "REJECTED").otherwise("OK")
    rows = by.select("run_date", "kind", status.alias("status"), F.when(status == "EMPTY", 0).otherwise(n).alias("n_rows"))
    path, early = scratch_path(spark, "ledger"), F.col("run_date") < "2024-01-15"
    named = rows.where(~early).withColumn("record_id", sinks.fingerprint("run_date", "kind", "status", "n_rows"))
    sinks.append_ledger(rows.where(early), path)
    for _ in range(2):  # as a job that is retried: the second time adds nothing
        sinks.append_ledger(named, path, "late-january")
    return sinks.read_ledger(spark, path, LEDGER)


@query("verified_directory", "SELECT date_trunc('month', o_orderdate)::DATE AS day, count(*) AS n_orders FROM orders GROUP BY 1 HAVING month(day) <> 6", dates="day")
def verified_directory(spark: SparkSession, d: str) -> DataFrame:
    """A directory of JSON documents with their hashes; those that were changed after hashing are left out."""
    by = table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    body = F.to_json(F.struct(F.col("day").cast("string").alias("day"), "n"))
    changed = F.when(F.month("day") == 6, F.concat(body, F.lit(" "))).otherwise(body)
    root = scratch_path(spark, "evidence")
    by.select(changed.alias("body"), F.sha2(body.cast("binary"), 256).alias("digest")).write.json(root)
    found = sinks.verified(spark.read.schema("body string, digest string").json(f"{root}/*.json"), "body", "digest")
    return found.select(F.from_json("body", "day date, n bigint").alias("b")).select(F.col("b.day").alias("day"), F.col("b.n").alias("n_orders"))


@query("globbed_panel", with_("panel") + " SELECT year(trade_date)::INT AS year, count(*) AS n, max(trade_date) AS last_day, round(sum(round(close * 100)::BIGINT) / 100.0::DOUBLE, 2) + 0.0 AS total FROM panel WHERE month(trade_date) IN (2, 3) GROUP BY 1", dates="last_day")
def globbed_panel(spark: SparkSession, d: str) -> DataFrame:
    """A panel in many files by year and month, of which a pattern and a pushed filter read some."""
    root = scratch_path(spark, "panel-by-month")
    sinks.write_table(panel(spark, d).select("symbol", "trade_date", "close", F.year("trade_date").alias("year"), F.month("trade_date").alias("month")), root, "year", "month")
    rows = spark.read.option("basePath", root).parquet(f"{root}/year=*/month=[23]").where(F.col("close") > 0)
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.max("trade_date").alias("last_day"), (F.sum(F.round(F.col("close") * 100).cast("bigint")) / 100.0).alias("total"))


@query("view_join", "SELECT r_name AS region, weight, count(*) AS n FROM (VALUES ('ASIA', 0.5::DOUBLE), ('EUROPE', 0.25::DOUBLE), ('AFRICA', 0.25::DOUBLE)) w(name, weight) JOIN region ON r_name = name JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def view_join(spark: SparkSession, d: str) -> DataFrame:
    """A frame made in memory as a relation of a SQL text."""
    weights = spark.createDataFrame([("ASIA", 0.5), ("EUROPE", 0.25), ("AFRICA", 0.25)], "name string, weight double")
    return spark.sql("SELECT r_name AS region, weight, count(*) AS n FROM {w} JOIN {r} ON r_name = name JOIN {n} ON n_regionkey = r_regionkey GROUP BY 1, 2", w=weights, r=table(spark, d, "region"), n=table(spark, d, "nation"))


@query("guarded_day_replace", with_("themes") + """, fresh AS (SELECT trade_date, symbol, 'NEW+' || reason AS reason FROM themes WHERE trade_date >= DATE '2001-06-01'), good AS (SELECT trade_date FROM fresh GROUP BY 1 HAVING count(*) >= 20)
SELECT trade_date, count(*) AS n, count(*) FILTER (WHERE contains(reason, 'NEW+')) AS n_new FROM (SELECT t.* FROM themes t ANTI JOIN good USING (trade_date) UNION ALL SELECT f.* FROM fresh f SEMI JOIN good USING (trade_date)) GROUP BY 1""", dates="trade_date")
def guarded_day_replace(spark: SparkSession, d: str) -> DataFrame:
    """A day is replaced only by at least twenty rows; a thinner answer leaves the day as it was."""
    rows = theme_days(spark, d)
    new = rows.where(F.col("trade_date") >= date_of("2001-06-01")).withColumn("reason", F.concat(F.lit("NEW+"), "reason"))
    return replace_whole_days(rows, new).groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason").contains("NEW+")).alias("n_new"))


@query("cursor_overlap", """WITH stored AS (SELECT event_id, event_type, ts FROM events WHERE ts < TIMESTAMP '2024-01-20' AND event_id % 10 <> 3), cur AS (SELECT event_type, max(ts)::DATE - 5 AS since FROM stored GROUP BY 1),
fetched AS (SELECT e.event_id, e.event_type, e.ts FROM events e JOIN cur USING (event_type) WHERE e.ts::DATE >= since), merged AS (SELECT * FROM stored UNION ALL SELECT f.* FROM fetched f ANTI JOIN stored USING (event_id))
SELECT event_type, since, count(*) AS n, (SELECT count(*) FROM fetched f WHERE f.event_type = m.event_type) AS n_fetched FROM merged m JOIN cur USING (event_type) GROUP BY 1, 2""", dates="since")
def cursor_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Each exchange goes on from its own last row, five days back, and what comes twice is ignored."""
    rows = table(spark, d, "events").select("event_id", "event_type", "ts")
    stored = rows.where((F.col("ts") < F.lit("2024-01-20").cast("timestamp")) & (F.col("event_id") % 10 != 3))
    cursor = stored.groupBy("event_type").agg(F.date_sub(F.to_date(F.max("ts")), 5).alias("since"))
    fetched = rows.join(cursor, "event_type").where(F.to_date("ts") >= F.col("since")).select(*rows.columns)
    merged = insert_absent(stored, fetched, ["event_id"], [F.asc("ts")]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return merged.join(cursor, "event_type").join(fetched.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_fetched")), "event_type").select("event_type", "since", "n", "n_fetched")

