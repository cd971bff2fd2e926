"""Research queries: direction scores, rank tests, robust and paired aggregates, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import change, correlation, pct_rank
from tidemark.operators import factors, rolling
from tidemark.operators.keyed import latest_per_key
from tidemark.plans.factors import MOMENTUM_SQL, PRICE_SQL, RISK_SQL, recent_panel, shown, sql6, sql_rank
from tidemark.plans.registry import query
from tidemark.sources.market import bars, instruments, panel, with_
from tidemark.sources.tables import dealt_by, table

COSTS = (0, 10, 20)

RESULT_SQL = """res0 AS (SELECT o_orderpriority AS candidate, date_trunc('quarter', o_orderdate)::DATE AS start, sum(round(o_totalprice)::BIGINT)::BIGINT AS t FROM orders GROUP BY 1, 2),
results AS (SELECT candidate, start, c AS cost_bps, ((t * 7919) % 2001 - 1000)::DOUBLE / 20011::DOUBLE - c::DOUBLE / 10000::DOUBLE AS excess FROM res0 CROSS JOIN (VALUES (0), (10), (20)) v(c))"""


def results(spark: SparkSession, d: str) -> DataFrame:
    """``candidate, start, cost_bps, excess``: accounts by order priority and quarter, at three costs."""
    by = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("candidate"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("start")).agg(F.sum(F.round("o_totalprice").cast("bigint")).alias("t"))
    rows = by.withColumn("cost_bps", F.explode(F.array(*map(F.lit, COSTS))))
    gain = ((F.col("t") * 7919) % 2001 - 1000).cast("double") / 20011.0 - F.col("cost_bps").cast("double") / 10000.0
    return rows.select("candidate", "start", "cost_bps", gain.alias("excess"))


ROBUST_SQL = RESULT_SQL + """,
years AS (SELECT candidate, cost_bps, min(m) AS worst_year, count(*) AS years, count(*) FILTER (WHERE m > 0) AS good_years FROM (SELECT candidate, cost_bps, year(start) AS y, avg(excess) AS m FROM results GROUP BY 1, 2, 3) GROUP BY 1, 2),
robust AS (SELECT candidate, cost_bps, count(*) AS windows, avg(excess) AS mean, quantile_cont(excess, 0.5) AS median, min(excess) AS low, max(excess) AS high, avg((excess > 1e-10)::INT) AS win_share,
  (sum(excess) - max(excess)) / nullif(count(*) - 1, 0) AS drop_best, (sum(excess) - min(excess)) / nullif(count(*) - 1, 0) AS drop_worst FROM results GROUP BY 1, 2)"""


def robust(rows: DataFrame) -> DataFrame:
    """Mean, median, extremes, wins, means without the best and without the worst window, and the worst year."""
    x, n = F.col("excess"), F.count(F.lit(1))
    by = rows.groupBy("candidate", "cost_bps").agg(
        n.alias("windows"), F.avg(x).alias("mean"), F.percentile(x, 0.5).alias("median"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(F.when(x > 1e-10, 1.0).otherwise(0.0)).alias("win_share"),
        ((F.sum(x) - F.max(x)) / F.nullif(n - 1, F.lit(0))).alias("drop_best"), ((F.sum(x) - F.min(x)) / F.nullif(n - 1, F.lit(0))).alias("drop_worst"),
    )
    years = rows.groupBy("candidate", "cost_bps", F.year("start").alias("y")).agg(F.avg(x).alias("m")).groupBy("candidate", "cost_bps").agg(F.min("m").alias("worst_year"), F.count(F.lit(1)).alias("years"), F.count_if(F.col("m") > 0).alias("good_years"))
    return by.join(years, ["candidate", "cost_bps"])


@query("robust_aggregate", f"WITH {ROBUST_SQL} SELECT candidate, cost_bps, windows, {sql6('mean', 'median', 'low', 'high', 'win_share', 'drop_best', 'drop_worst', 'worst_year')}, years, good_years FROM robust JOIN years USING (candidate, cost_bps)")
def robust_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return shown(robust(results(spark, d)))


@query("gates_finalists", f"WITH {ROBUST_SQL}, g AS (SELECT candidate, cost_bps, mean, drop_best, low > -0.06 AND years > 0 AS depth_ok, win_share >= 0.4 AS wins_ok FROM robust JOIN years USING (candidate, cost_bps)) SELECT candidate, cost_bps, {sql6('mean', 'drop_best')}, depth_ok, wins_ok FROM g QUALIFY row_number() OVER (PARTITION BY cost_bps ORDER BY (depth_ok AND wins_ok) DESC, round(drop_best, 9) DESC, round(mean, 9) DESC, candidate) = 1")
def gates_finalists(spark: SparkSession, d: str) -> DataFrame:
    """The first candidate of each cost: those that pass the gates, then by robustness and mean."""
    rows = robust(results(spark, d)).select("candidate", "cost_bps", "mean", "drop_best", ((F.col("low") > -0.06) & (F.col("years") > 0)).alias("depth_ok"), (F.col("win_share") >= 0.4).alias("wins_ok"))
    order = [F.desc(F.col("depth_ok") & F.col("wins_ok")), F.desc(F.round("drop_best", 9)), F.desc(F.round("mean", 9)), F.asc("candidate")]
    return shown(latest_per_key(rows, ["cost_bps"], order))


PAIRS = (("urgent-high", "1-URGENT", "2-HIGH"), ("medium-low", "3-MEDIUM", "5-LOW"))


@query("paired_effects", f"WITH {RESULT_SQL}, p(pair, base, alt) AS (VALUES {', '.join(str(x) for x in PAIRS)}), e AS (SELECT pair, a.start, a.cost_bps, b.excess - a.excess AS effect FROM p JOIN results a ON a.candidate = base JOIN results b ON b.candidate = alt AND b.start = a.start AND b.cost_bps = a.cost_bps)," + """
m AS (SELECT pair, count(*) FILTER (WHERE cost_bps = 10) AS windows, avg(effect) FILTER (WHERE cost_bps = 10) AS mean, quantile_cont(effect, 0.5) FILTER (WHERE cost_bps = 10) AS median, avg((effect > 1e-12)::INT) FILTER (WHERE cost_bps = 10) AS share, avg(effect) FILTER (WHERE cost_bps = 20) AS stress,
  (sum(effect) FILTER (WHERE cost_bps = 10) - max(effect) FILTER (WHERE cost_bps = 10)) / (count(*) FILTER (WHERE cost_bps = 10) - 1) AS drop_best FROM e GROUP BY 1),
y AS (SELECT pair, min(v) AS worst_year FROM (SELECT pair, year(start) AS yr, avg(effect) AS v FROM e WHERE cost_bps = 10 GROUP BY 1, 2) GROUP BY 1)
SELECT pair, windows, round(mean, 6) + 0.0 AS mean, round(median, 6) + 0.0 AS median, round(share, 6) + 0.0 AS share, round(stress, 6) + 0.0 AS stress, round(drop_best, 6) + 0.0 AS drop_best, round(worst_year, 6) + 0.0 AS worst_year,
  CASE WHEN mean > 1e-12 AND median > 1e-12 AND share + 1e-12 >= 2 / 3.0 AND worst_year >= -1e-12 AND stress >= -1e-12 AND drop_best > 1e-12 THEN 'consistent_positive' ELSE 'mixed' END AS status FROM m JOIN y USING (pair)""")
def paired_effects(spark: SparkSession, d: str) -> DataFrame:
    """Differences of two candidates on the same window and cost, and whether they are consistently positive."""
    rows = results(spark, d)
    pair = F.lit(None).cast("string")
    for name, a, b in PAIRS:
        pair = F.when(F.col("candidate").isin(a, b), name).otherwise(pair)
    sides = rows.withColumn("pair", pair).where(F.col("pair").isNotNull())
    side = F.when(F.col("candidate").isin([b for _, _, b in PAIRS]), F.col("excess")).otherwise(-F.col("excess"))
    effects = sides.groupBy("pair", "start", "cost_bps").agg(F.sum(side).alias("effect"), F.count(F.lit(1)).alias("n")).where("n = 2")
    at = lambda cost: F.when(F.col("cost_bps") == cost, F.col("effect"))
    main = at(10)
    by = effects.groupBy("pair").agg(F.count(main).alias("windows"), F.avg(main).alias("mean"), F.percentile(main, 0.5).alias("median"), F.avg(F.when(main > 1e-12, 1.0).when(main.isNotNull(), 0.0)).alias("share"), F.avg(at(20)).alias("stress"), ((F.sum(main) - F.max(main)) / (F.count(main) - 1)).alias("drop_best"))
    years = effects.where("cost_bps = 10").groupBy("pair", F.year("start").alias("yr")).agg(F.avg("effect").alias("v")).groupBy("pair").agg(F.min("v").alias("worst_year"))
    c = F.col
    good = (c("mean") > 1e-12) & (c("median") > 1e-12) & (c("share") + 1e-12 >= 2 / 3) & (c("worst_year") >= -1e-12) & (c("stress") >= -1e-12) & (c("drop_best") > 1e-12)
    return shown(by.join(years, "pair").withColumn("status", F.when(good, "consistent_positive").otherwise("mixed")))


#: Indices and bases that accounts are compared with: code, name, basis, and what it gained in a window.
INDICES = (("000300", "large", "price", 0.004), ("000300", "large", "total", 0.009), ("000905", "middle", "price", -0.003), ("000905", "middle", "total", 0.001))
INDEX_KEYS = ("pool", "execution", "cost_bps", "profile", "index_code", "index_name", "basis")


@query("index_comparison", f"""WITH {RESULT_SQL}, i(index_code, index_name, basis, gain) AS (VALUES {', '.join(f"('{c}', '{n}', '{b}', {g}::DOUBLE)" for c, n, b, g in INDICES)}),
a AS (SELECT CASE WHEN candidate < '3' THEN 'front' ELSE 'back' END AS pool, CASE WHEN quarter(start) % 2 = 1 THEN 'open' ELSE 'close' END AS execution, cost_bps, candidate AS profile, index_code, index_name, basis, CASE WHEN year(start) < 1998 THEN 'development' ELSE 'historical' END AS cohort, excess, gain, excess - gain AS over FROM results, i)
SELECT {', '.join(INDEX_KEYS)}, coalesce(cohort, 'all') AS cohort, count(*) AS windows, {', '.join(f'round({x}, 6) + 0.0 AS {k}' for k, x in {'mean_return': 'avg(excess)', 'mean_index': 'avg(gain)', 'mean_over': 'avg(over)', 'median_over': 'quantile_cont(over, 0.5)', 'worst_over': 'min(over)', 'worst_return': 'min(excess)'}.items())}, count(*) FILTER (WHERE over > 1e-10) AS positive
FROM a GROUP BY GROUPING SETS (({', '.join(INDEX_KEYS)}, cohort), ({', '.join(INDEX_KEYS)}))""")
def index_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Accounts against indices by seven keys, for two cohorts and all of them together, in one pass by grouping sets."""
    indices = F.explode(F.array(*[F.struct(F.lit(c).alias("index_code"), F.lit(n).alias("index_name"), F.lit(b).alias("basis"), F.lit(g).alias("gain")) for c, n, b, g in INDICES]))
    c = F.col
    rows = results(spark, d).select("*", indices.alias("i")).select(
        F.when(c("candidate") < "3", "front").otherwise("back").alias("pool"), F.when(F.quarter("start") % 2 == 1, "open").otherwise("close").alias("execution"), "cost_bps", c("candidate").alias("profile"), "i.*",
        F.when(F.year("start") < 1998, "development").otherwise("historical").alias("cohort"), "excess", (c("excess") - c("i.gain")).alias("over"),
    )
    keys = [c(k) for k in INDEX_KEYS]
    by = rows.groupingSets([[*keys, c("cohort")], keys], *INDEX_KEYS, "cohort").agg(
        F.count(F.lit(1)).alias("windows"), F.avg("excess").alias("mean_return"), F.avg("gain").alias("mean_index"), F.avg("over").alias("mean_over"), F.percentile("over", 0.5).alias("median_over"),
        F.min("over").alias("worst_over"), F.min("excess").alias("worst_return"), F.count_if(c("over") > 1e-10).alias("positive"),
    )
    return shown(by.withColumn("cohort", F.coalesce("cohort", F.lit("all"))))


@query("pivot_costs", f"WITH {RESULT_SQL} SELECT candidate, round(avg(excess) FILTER (WHERE cost_bps = 0), 6) + 0.0 AS cost_0, round(avg(excess) FILTER (WHERE cost_bps = 10), 6) + 0.0 AS cost_10, round(avg(excess) FILTER (WHERE cost_bps = 20), 6) + 0.0 AS cost_20 FROM results GROUP BY 1")
def pivot_costs(spark: SparkSession, d: str) -> DataFrame:
    wide = results(spark, d).groupBy("candidate").pivot("cost_bps", list(COSTS)).agg(F.avg("excess"))
    return shown(wide.select("candidate", *[F.col(str(c)).alias(f"cost_{c}") for c in COSTS]))


@query("experiment_grid", f"WITH {RESULT_SQL}, g AS (SELECT candidate, cost_bps, w, style FROM (SELECT DISTINCT candidate, cost_bps FROM results) CROSS JOIN range(1, 15) t(w) CROSS JOIN (VALUES ('equal'), ('inverse_vol')) s(style)) SELECT candidate, cost_bps, w::INT AS window_no, style, left(sha256(candidate || '|' || cost_bps || '|' || w || '|' || style), 12) AS account_key FROM g")
def experiment_grid(spark: SparkSession, d: str) -> DataFrame:
    """The plan of all accounts, from arrays of the dimensions."""
    base = results(spark, d).select("candidate", "cost_bps").distinct()
    rows = base.withColumn("window_no", F.explode(F.sequence(F.lit(1), F.lit(14)))).withColumn("style", F.explode(F.array(F.lit("equal"), F.lit("inverse_vol"))))
    key = F.sha2(F.concat_ws("|", "candidate", F.col("cost_bps").cast("string"), F.col("window_no").cast("string"), "style"), 256)
    return rows.withColumn("account_key", F.substring(key, 1, 12))


IC_SQL = with_("panel") + """,
ic0 AS (SELECT symbol, trade_date, close / nullif(lag(close, 20) OVER s, 0) - 1 AS x, lead(open, 6) OVER s / nullif(lead(open, 1) OVER s, 0) - 1 AS y FROM panel WINDOW s AS (PARTITION BY symbol ORDER BY trade_date)),
ic1 AS (SELECT * FROM ic0 WHERE x IS NOT NULL AND y IS NOT NULL),
""" + f"ic2 AS (SELECT trade_date, y, {sql_rank('x', 'trade_date')} AS rx, {sql_rank('y', 'trade_date')} AS ry FROM ic1), " + """
ics AS (SELECT trade_date, count(*) AS n, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 12) + 0.0 AS ic, avg(y) FILTER (WHERE rx >= 0.9) - avg(y) FILTER (WHERE rx <= 0.1) AS spread FROM ic2 GROUP BY 1)"""


def daily_ic(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of the 20-day return with the next label, and the decile spread, by day."""
    rows = panel(spark, d)
    by = rolling.order()
    x, y = change(F.col("close"), F.lag("close", 20).over(by)), change(F.lead("open", 6).over(by), F.lead("open", 1).over(by))
    pairs = rows.select("trade_date", x.alias("x"), y.alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    pairs = dealt_by(pairs, "trade_date", like=table(spark, d, "lineitem"))
    ranked = pairs.select("trade_date", "y", pct_rank(F.col("x"), F.col("trade_date")).alias("rx"), pct_rank(F.col("y"), F.col("trade_date")).alias("ry"))
    spread = F.avg(F.when(F.col("rx") >= 0.9, F.col("y"))) - F.avg(F.when(F.col("rx") <= 0.1, F.col("y")))
    return ranked.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"), (F.round(correlation(F.col("rx"), F.col("ry")), 12) + 0.0).alias("ic"), spread.alias("spread"))


@query("rank_ic", IC_SQL + f" SELECT trade_date, n, {sql6('ic', 'spread')} FROM ics WHERE n > 2", dates="trade_date")
def rank_ic(spark: SparkSession, d: str) -> DataFrame:
    return shown(daily_ic(spark, d).where("n > 2"))


@query("ic_summary", IC_SQL + " SELECT count(ic) AS days, round(avg(ic), 6) + 0.0 AS mean_ic, round(quantile_cont(ic, 0.5), 6) + 0.0 AS median_ic, round(avg((ic > 0)::INT), 6) + 0.0 AS positive_share FROM ics WHERE n > 2")
def ic_summary(spark: SparkSession, d: str) -> DataFrame:
    ic = F.col("ic")
    return shown(daily_ic(spark, d).where("n > 2").agg(F.count(ic).alias("days"), F.avg(ic).alias("mean_ic"), F.percentile(ic, 0.5).alias("median_ic"), F.avg(F.when(ic > 0, 1.0).when(ic.isNotNull(), 0.0)).alias("positive_share")))


SCORERS = ("trend5", "reverse5", "reverse20", "trend60", "trend60_skip5", "trend_pullback", "reverse_risk", "dual_reverse", "regime_switch")
DIR_SQL = with_("panel") + f""", {PRICE_SQL}, {RISK_SQL},
dir0 AS (SELECT symbol, trade_date, close / nullif(lag(close, 5) OVER s, 0) - 1 AS ret_5, close / nullif(lag(close, 20) OVER s, 0) - 1 AS ret_20, close / nullif(lag(close, 60) OVER s, 0) - 1 AS ret_60, lag(close, 5) OVER s / nullif(lag(close, 60) OVER s, 0) - 1 AS ret_60_skip5 FROM panel WINDOW s AS (PARTITION BY symbol ORDER BY trade_date)),
dir1 AS (SELECT d.*, p.turnover_value_20, -r.realized_vol_20 AS v, -r.downside_vol_20 AS dv, p.ma60_dev FROM dir0 d JOIN price p USING (symbol, trade_date) JOIN risk r USING (symbol, trade_date) WHERE trade_date = (SELECT d FROM as_of) AND ret_60 IS NOT NULL AND ret_60_skip5 IS NOT NULL),
dir2 AS (SELECT symbol, {sql_rank('ret_5')} AS k5, {sql_rank('(-ret_5)')} AS b5, {sql_rank('(-ret_20)')} AS b20, {sql_rank('ret_60')} AS k60, {sql_rank('ret_60_skip5')} AS ks, ({sql_rank('v')} + {sql_rank('dv')}) / 2 AS risk, {sql_rank('turnover_value_20')} AS t, avg((ma60_dev > 0)::INT) OVER () > 0.5 AS above FROM dir1),
dir3 AS (SELECT symbol, k5 AS trend5, b5 AS reverse5, b20 AS reverse20, k60 AS trend60, ks AS trend60_skip5, 0.5 * ks + 0.3 * b5 + 0.2 * risk AS trend_pullback, 0.5 * b5 + 0.3 * risk + 0.2 * t AS reverse_risk, 0.5 * b5 + 0.5 * b20 AS dual_reverse, above FROM dir2)"""


@query("direction_scores", DIR_SQL + f" SELECT symbol, {sql6(*SCORERS[:-1])}, round(CASE WHEN above THEN trend_pullback ELSE reverse_risk END, 6) + 0.0 AS regime_switch FROM dir3")
def direction_scores(spark: SparkSession, d: str) -> DataFrame:
    """Linear mixes of ranks, and one that switches with the market's regime."""
    rows = panel(spark, d)
    last = rows.groupBy("symbol").agg(F.max("trade_date").alias("x")).agg(F.min("x")).scalar()
    by = rolling.order()
    lag = lambda n: F.lag("close", n).over(by)
    moves = rows.select("symbol", "trade_date", change(F.col("close"), lag(5)).alias("ret_5"), change(F.col("close"), lag(20)).alias("ret_20"), change(F.col("close"), lag(60)).alias("ret_60"), change(lag(5), lag(60)).alias("ret_60_skip5"))
    price = factors.price_factors(rows).select("symbol", "trade_date", "turnover_value_20", "ma60_dev")
    risk = factors.risk_factors(rows).select("symbol", "trade_date", (-F.col("realized_vol_20")).alias("v"), (-F.col("downside_vol_20")).alias("dv"))
    pool = moves.where(F.col("trade_date") == last).join(price, ["symbol", "trade_date"]).join(risk, ["symbol", "trade_date"]).where(F.col("ret_60").isNotNull() & F.col("ret_60_skip5").isNotNull())
    above = pool.agg(F.avg(F.when(F.col("ma60_dev") > 0, 1.0).otherwise(0.0)) > 0.5).scalar()
    r = pool.select("symbol", pct_rank(F.col("ret_5")).alias("k5"), pct_rank(-F.col("ret_5")).alias("b5"), pct_rank(-F.col("ret_20")).alias("b20"), pct_rank(F.col("ret_60")).alias("k60"), pct_rank(F.col("ret_60_skip5")).alias("ks"), ((pct_rank(F.col("v")) + pct_rank(F.col("dv"))) / 2).alias("risk"), pct_rank(F.col("turnover_value_20")).alias("t"))
    c = F.col
    out = r.select("symbol", c("k5").alias("trend5"), c("b5").alias("reverse5"), c("b20").alias("reverse20"), c("k60").alias("trend60"), c("ks").alias("trend60_skip5"), (0.5 * c("ks") + 0.3 * c("b5") + 0.2 * c("risk")).alias("trend_pullback"), (0.5 * c("b5") + 0.3 * c("risk") + 0.2 * c("t")).alias("reverse_risk"), (0.5 * c("b5") + 0.5 * c("b20")).alias("dual_reverse"))
    return shown(out.withColumn("regime_switch", F.when(above, c("trend_pullback")).otherwise(c("reverse_risk"))))


@query("pool_eligibility", with_("panel", "instruments") + f", {PRICE_SQL}, {MOMENTUM_SQL}, el AS (SELECT p.symbol, history_days >= 250 AND turnover_value_20 >= 20000 AND NOT contains(name, 'ST') AS eligible, ret_60 IS NOT NULL AND volume_trend_20 IS NOT NULL AND volume_trend_20 < 1.15 AND close_position_250 IS NOT NULL AS complete FROM price p JOIN momentum m USING (symbol, trade_date) JOIN instruments i ON i.symbol = p.symbol WHERE trade_date = (SELECT d FROM as_of)) SELECT count(*) AS universe, count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE eligible AND NOT complete) AS incomplete, count(*) FILTER (WHERE eligible AND complete) AS pool FROM el")
def pool_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the eligible rows, of those without complete factors, and of the pool; one aggregate by symbol over the rows it needs."""
    rows, last = recent_panel(spark, d)
    wide = factors.day_factors(factors.counted_back(rows), last).join(instruments(spark, d).select("symbol", "name"), "symbol")
    c = F.col
    ok = (c("history_days") >= 250) & (c("turnover_value_20") >= 20000) & ~c("name").contains("ST")
    full = c("ret_60").isNotNull() & c("volume_trend_20").isNotNull() & F.coalesce(c("volume_trend_20") < 1.15, F.lit(False)) & c("close_position_250").isNotNull()
    return wide.agg(F.count(F.lit(1)).alias("universe"), F.count_if(ok).alias("eligible"), F.count_if(ok & ~full).alias("incomplete"), F.count_if(ok & full).alias("pool"))


@query("executable_list", with_("panel") + """, ranked AS (SELECT symbol, row_number() OVER (ORDER BY close / pre_close DESC, symbol) AS place FROM panel WHERE trade_date = DATE '1996-09-30'),
nxt AS (SELECT r.symbol, place, CASE WHEN n.symbol IS NULL OR NOT (n.open > 0 AND n.volume > 0) THEN 'no valid open' WHEN n.close / n.pre_close - 1 >= 0.012 THEN 'limit up' ELSE 'executable' END AS reason FROM ranked r LEFT JOIN (SELECT * FROM panel WHERE trade_date = DATE '1996-10-01') n USING (symbol)),
up AS (SELECT *, count(*) FILTER (WHERE reason = 'executable') OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS good FROM nxt)
SELECT reason, count(*) AS n, min(place) AS first_place FROM up WHERE good < 25 OR (good = 25 AND reason = 'executable') GROUP BY 1""")
def executable_list(spark: SparkSession, d: str) -> DataFrame:
    """Walk the ranking on the next day until 25 names can be bought, and count what stood in the way."""
    rows, date = panel(spark, d), lambda x: F.lit(x).cast("date")
    ranked = rows.where(F.col("trade_date") == date("1996-09-30")).select("symbol", F.row_number().over(Window.orderBy(F.desc(F.col("close") / F.col("pre_close")), "symbol")).alias("place"))
    nxt = rows.where(F.col("trade_date") == date("1996-10-01")).select("symbol", "open", "close", "pre_close", "volume")
    good = (F.col("open") > 0) & (F.col("volume") > 0)
    reason = F.when(~F.coalesce(good, F.lit(False)), "no valid open").when(F.col("close") / F.col("pre_close") - 1 >= 0.012, "limit up").otherwise("executable")
    walked = ranked.join(nxt, "symbol", "left").withColumn("reason", reason).withColumn("good", F.count(F.when(F.col("reason") == "executable", 1)).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    seen = walked.where((F.col("good") < 25) | ((F.col("good") == 25) & (F.col("reason") == "executable")))
    return seen.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place"))


@query("prior_close_gaps", with_("bars") + ", g AS (SELECT symbol, trade_date, open / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY trade_date), 0) - 1 AS gap FROM bars) SELECT symbol, count(gap) AS n, count(*) FILTER (WHERE abs(gap) > 0.5) AS jumps, round(max(abs(gap)), 6) + 0.0 AS largest FROM g GROUP BY 1")
def prior_close_gaps(spark: SparkSession, d: str) -> DataFrame:
    gap = change(F.col("open"), F.lag("close").over(rolling.order()))
    rows = bars(spark, d).select("symbol", gap.alias("gap"))
    return shown(rows.groupBy("symbol").agg(F.count("gap").alias("n"), F.count_if(F.abs("gap") > 0.5).alias("jumps"), F.max(F.abs("gap")).alias("largest")))


@query("drift_detector", with_("panel") + ", inc AS (SELECT symbol, trade_date, CASE WHEN symbol LIKE '%3' AND n < 400 THEN close * 1.01 ELSE close * 1.0005 END AS close FROM panel WHERE n > 380) SELECT i.symbol, count(*) AS overlap, count(*) FILTER (WHERE abs(i.close / p.close - 1) > 0.002) AS drifted, min(i.trade_date) FILTER (WHERE abs(i.close / p.close - 1) > 0.002) AS first_drift FROM inc i JOIN panel p USING (symbol, trade_date) GROUP BY 1 HAVING drifted > 0", dates="first_drift")
def drift_detector(spark: SparkSession, d: str) -> DataFrame:
    """Symbols whose incoming closes differ from the stored ones: to be fetched again as a whole."""
    rows = panel(spark, d)
    new = rows.where("n > 380").select("symbol", "trade_date", F.when(F.col("symbol").endswith("3") & (F.col("n") < 400), F.col("close") * 1.01).otherwise(F.col("close") * 1.0005).alias("incoming"))
    off = F.abs(F.col("incoming") / F.col("close") - 1) > 0.002
    return new.join(rows, ["symbol", "trade_date"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("overlap"), F.count_if(off).alias("drifted"), F.min(F.when(off, F.col("trade_date"))).alias("first_drift")).where("drifted > 0")


@query("ohlc_audit", with_("panel") + " SELECT count(*) AS n_rows, count(DISTINCT (symbol, trade_date)) AS n_keys, count(*) FILTER (WHERE low > least(open, close) OR high < greatest(open, close)) AS invalid, count(*) FILTER (WHERE volume = 0) AS inactive FROM panel")
def ohlc_audit(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    bad = (c("low") > F.least("open", "close")) | (c("high") < F.greatest("open", "close"))
    return panel(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("symbol", "trade_date").alias("n_keys"), F.count_if(bad).alias("invalid"), F.count_if(c("volume") == 0).alias("inactive"))


INDEX_SQL = with_("panel") + ", idx AS (SELECT trade_date, avg(close) AS level FROM panel GROUP BY 1 HAVING count(*) >= 10)"


def index(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).groupBy("trade_date").agg(F.avg("close").alias("level"), F.count(F.lit(1)).alias("n")).where("n >= 10").drop("n")


@query("regime_labels", INDEX_SQL + ", m AS (SELECT trade_date, level, level / nullif(lag(level, 30) OVER s, 0) - 1 AS move, CASE WHEN count(level) OVER w60 = 60 THEN level > avg(level) OVER w60 END AS above_ma60, CASE WHEN row_number() OVER s > 20 THEN stddev_pop(r) OVER w20 * sqrt(252) END AS vol FROM (SELECT *, level / nullif(lag(level) OVER (ORDER BY trade_date), 0) - 1 AS r FROM idx) WINDOW s AS (ORDER BY trade_date), w60 AS (ORDER BY trade_date ROWS 59 PRECEDING), w20 AS (ORDER BY trade_date ROWS 19 PRECEDING)) SELECT trade_date, CASE WHEN move >= 0.05 THEN 'up' WHEN move <= -0.05 THEN 'down' WHEN move IS NOT NULL THEN 'sideways' END AS regime, above_ma60, round(vol, 6) + 0.0 AS vol, round(CASE WHEN vol IS NOT NULL THEN least(1, 0.15 / nullif(vol, 0)) END, 6) + 0.0 AS exposure FROM m", dates="trade_date")
def regime_labels(spark: SparkSession, d: str) -> DataFrame:
    """Market regime, side of the 60-day mean, and exposure by a volatility target; one row a day."""
    s = Window.orderBy("trade_date")
    rows = index(spark, d).withColumn("r", change(F.col("level"), F.lag("level").over(s)))
    move = change(F.col("level"), F.lag("level", 30).over(s))
    w60 = s.rowsBetween(-59, 0)
    vol = F.when(F.row_number().over(s) > 20, F.stddev_pop("r").over(s.rowsBetween(-19, 0)) * F.sqrt(F.lit(252)))
    out = rows.select("trade_date", F.when(move >= 0.05, "up").when(move <= -0.05, "down").when(move.isNotNull(), "sideways").alias("regime"), F.when(F.count("level").over(w60) == 60, F.col("level") > F.avg("level").over(w60)).alias("above_ma60"), vol.alias("vol"))
    return shown(out.withColumn("exposure", F.when(F.col("vol").isNotNull(), F.least(F.lit(1.0), 0.15 / F.nullif("vol", F.lit(0.0))))))


@query("nav_drawdown", with_("panel") + " SELECT symbol, round(min(close / 100 / greatest(1, peak) - 1), 6) + 0.0 AS drawdown, count(*) AS days FROM (SELECT symbol, close, max(close / 100) OVER (PARTITION BY symbol ORDER BY trade_date) AS peak FROM panel) GROUP BY 1")
def nav_drawdown(spark: SparkSession, d: str) -> DataFrame:
    """Deepest fall of a value path from its running top, the initial value included."""
    nav = F.col("close") / 100
    rows = panel(spark, d).select("symbol", nav.alias("nav"), F.max(nav).over(rolling.order().rowsBetween(Window.unboundedPreceding, 0)).alias("peak"))
    return shown(rows.groupBy("symbol").agg(F.min(F.col("nav") / F.greatest(F.lit(1.0), F.col("peak")) - 1).alias("drawdown"), F.count(F.lit(1)).alias("days")))


TRADE_SQL = with_("panel") + """, trades AS (SELECT symbol, trade_date, CASE WHEN n % 40 = 5 THEN 10 WHEN n % 40 = 25 THEN -10 ELSE 0 END AS qty, close FROM panel),
led AS (SELECT symbol, trade_date, close, sum(qty) OVER w AS held, sum(-qty * close - abs(qty * close) * 0.001) OVER w AS cash FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING))"""


@query("ledger_audit", TRADE_SQL + " SELECT symbol, round(arg_max(cash + held * close, trade_date), 6) + 0.0 AS final_value, round(min(cash), 6) + 0.0 AS least_cash, max(held)::BIGINT AS most_held, count(*) FILTER (WHERE held < 0) AS oversold FROM led GROUP BY 1")
def ledger_audit(spark: SparkSession, d: str) -> DataFrame:
    """Rebuild holdings, cash and value from signed trades by running sums."""
    n = F.col("n")
    trades = panel(spark, d).select("symbol", "trade_date", "close", F.when(n % 40 == 5, 10).when(n % 40 == 25, -10).otherwise(0).alias("qty"))
    run = rolling.order().rowsBetween(Window.unboundedPreceding, 0)
    flow = -F.col("qty") * F.col("close") - F.abs(F.col("qty") * F.col("close")) * 0.001
    led = trades.select("symbol", "trade_date", "close", F.sum("qty").over(run).alias("held"), F.sum(flow).over(run).alias("cash"))
    return shown(led.groupBy("symbol").agg(F.max_by(F.col("cash") + F.col("held") * F.col("close"), "trade_date").alias("final_value"), F.min("cash").alias("least_cash"), F.max("held").alias("most_held"), F.count_if(F.col("held") < 0).alias("oversold")))


@query("fee_ledger", TRADE_SQL + " SELECT CASE WHEN qty > 0 THEN 'buy' ELSE 'sell' END AS side, year(trade_date)::INT AS year, count(*) AS orders, round(sum(abs(qty) * close), 4) + 0.0 AS notional, round(sum(abs(qty) * close * 0.001), 4) + 0.0 AS fees FROM trades WHERE qty <> 0 GROUP BY 1, 2")
def fee_ledger(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    trades = panel(spark, d).select("trade_date", "close", F.when(n % 40 == 5, 10).when(n % 40 == 25, -10).alias("qty")).where(F.col("qty").isNotNull())
    value = F.abs("qty") * F.col("close")
    return trades.groupBy(F.when(F.col("qty") > 0, "buy").otherwise("sell").alias("side"), F.year("trade_date").alias("year")).agg(F.count(F.lit(1)).alias("orders"), (F.round(F.sum(value), 4) + 0.0).alias("notional"), (F.round(F.sum(value * 0.001), 4) + 0.0).alias("fees"))


@query("cycle_closed_form", with_("panel") + ", cyc AS (SELECT a.symbol, (a.n // 20)::INT AS cycle, b.close / a.open AS gross FROM panel a JOIN panel b ON b.symbol = a.symbol AND b.n = a.n + 19 WHERE a.n % 20 = 1), m AS (SELECT cycle, avg(gross) AS g, count(*) AS n FROM cyc GROUP BY 1) SELECT count(*) AS cycles, min(n) AS least_symbols, round(exp(sum(ln(g * (1 - 0.001) * (1 - 0.001)))) - 1, 6) + 0.0 AS net_return FROM m")
def cycle_closed_form(spark: SparkSession, d: str) -> DataFrame:
    """The product of the cycles' mean returns less fees: what an unblocked account earns.

    A cycle is averaged over the symbols that have all of it; the least number of them is returned.
    """
    rows = panel(spark, d)
    entry = rows.where("n % 20 = 1").select("symbol", F.floor(F.col("n") / 20).alias("cycle"), (F.col("n") + 19).alias("n"), F.col("open").alias("a"))
    cycles = entry.join(rows.select("symbol", "n", F.col("close").alias("b")), ["symbol", "n"])
    by = cycles.groupBy("cycle").agg(F.avg(F.col("b") / F.col("a")).alias("g"), F.count(F.lit(1)).alias("n"))
    return shown(by.agg(F.count(F.lit(1)).alias("cycles"), F.min("n").alias("least_symbols"), (F.exp(F.sum(F.ln(F.col("g") * 0.999 * 0.999))) - 1).alias("net_return")))


@query("index_windows", INDEX_SQL + " SELECT w.name, round(arg_max(level, trade_date) / arg_min(level, trade_date) - 1, 6) + 0.0 AS index_return, count(*) AS days FROM idx JOIN (VALUES ('w1', DATE '1996-03-01', DATE '1996-06-30'), ('w2', DATE '1996-07-01', DATE '1996-12-31')) w(name, a, b) ON trade_date BETWEEN a AND b GROUP BY 1")
def index_windows(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("trade_date")
    inside = lambda a, b: at.between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    rows = index(spark, d).withColumn("name", F.when(inside("1996-03-01", "1996-06-30"), "w1").when(inside("1996-07-01", "1996-12-31"), "w2")).where("name is not null")
    return shown(rows.groupBy("name").agg((F.max_by("level", "trade_date") / F.min_by("level", "trade_date") - 1).alias("index_return"), F.count(F.lit(1)).alias("days")))


