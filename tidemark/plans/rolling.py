"""Queries of the 157 rolling features, their labels and scalers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import rounded
from tidemark.operators import rolling as ops
from tidemark.operators.ranges import column_quantile, percentile_ranks, quantiles
from tidemark.plans.factors import shown
from tidemark.plans.registry import query
from tidemark.session import materialise
from tidemark.sources.market import panel, with_

BASE_SQL = with_("panel") + f""",
base AS (SELECT symbol, trade_date, n, open, high, low, close, volume::DOUBLE AS volume, close / lag(close) OVER s AS ret, close - lag(close) OVER s AS delta, volume::DOUBLE - lag(volume) OVER s AS vdelta,
  abs(close / lag(close) OVER s - 1) * volume AS weighted, ln(volume::DOUBLE + 1) AS log_v, ln(volume::DOUBLE / nullif(lag(volume) OVER s, 0) + 1) AS log_ratio,
  CASE WHEN close > lag(close) OVER s THEN 1.0 ELSE 0.0 END::DOUBLE AS up, CASE WHEN close < lag(close) OVER s THEN 1.0 ELSE 0.0 END::DOUBLE AS down FROM panel WINDOW s AS (PARTITION BY symbol ORDER BY trade_date))"""

KBAR_SQL = {
    "KMID": "(close - open) / open", "KLEN": "(high - low) / open", "KMID2": "(close - open) / (high - low + 1e-12)", "KUP": "(high - greatest(open, close)) / open", "KUP2": "(high - greatest(open, close)) / (high - low + 1e-12)",
    "KLOW": "(least(open, close) - low) / open", "KLOW2": "(least(open, close) - low) / (high - low + 1e-12)", "KSFT": "(2 * close - high - low) / open", "KSFT2": "(2 * close - high - low) / (high - low + 1e-12)",
    "OPEN0": "open / close", "HIGH0": "high / close", "LOW0": "low / close",
}


def _corr(x: str, y: str) -> str:
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"round(covar_pop({a}, {b}) OVER w, 12) / nullif(round(stddev_pop({a}) OVER w * stddev_pop({b}) OVER w, 12), 0)"


_GAIN, _LOSS, _ALL = "sum(greatest({0}, 0 * {0})) OVER w", "sum(greatest(-{0}, 0 * {0})) OVER w", "(sum(abs({0})) OVER w + 1e-12)"
FAMILY_SQL = {
    "stats": {"ROC": "lag(close, {n}) OVER s / close", "MA": "avg(close) OVER w / close", "STD": "stddev_samp(close) OVER w / close", "MAX": "max(high) OVER w / close", "MIN": "min(low) OVER w / close"},
    "ols": {"BETA": "regr_slope(close, n) OVER w / close", "RSQR": "CASE WHEN regr_syy(close, n) OVER w > 1e-12 THEN regr_r2(close, n) OVER w END", "RESI": "(close - (regr_intercept(close, n) OVER w + regr_slope(close, n) OVER w * n)) / close"},
    "quantiles": {"QTLU": "quantile_cont(close, 0.8) OVER w / close", "QTLD": "quantile_cont(close, 0.2) OVER w / close"},
    "ranks": {"RANK": "(len(list_filter(list(close) OVER w, lambda x: x < close)) + (len(list_filter(list(close) OVER w, lambda x: x = close)) + 1) / 2.0::DOUBLE) / len(list(close) OVER w)"},
    "extremes": {"RSV": "(close - min(low) OVER w) / (max(high) OVER w - min(low) OVER w + 1e-12)", "IMAX": "list_position(list(high) OVER w, max(high) OVER w) / {n}::DOUBLE", "IMIN": "list_position(list(low) OVER w, min(low) OVER w) / {n}::DOUBLE", "IMXD": "list_position(list(high) OVER w, max(high) OVER w) / {n}::DOUBLE - list_position(list(low) OVER w, min(low) OVER w) / {n}::DOUBLE"},
    "correlations": {"CORR": _corr("close", "log_v"), "CORD": _corr("ret", "log_ratio")},
    "counts": {"CNTP": "avg(up) OVER w", "CNTN": "avg(down) OVER w", "CNTD": "avg(up) OVER w - avg(down) OVER w"} | {k: f"{v} / {_ALL}".replace("{0}", "delta") for k, v in {"SUMP": _GAIN, "SUMN": _LOSS, "SUMD": f"({_GAIN} - {_LOSS})"}.items()},
    "volumes": {"VMA": "avg(volume) OVER w / (volume + 1e-12)", "VSTD": "stddev_samp(volume) OVER w / (volume + 1e-12)", "WVMA": "stddev_samp(weighted) OVER w / (avg(weighted) OVER w + 1e-12)"} | {k: f"{v} / {_ALL}".replace("{0}", "vdelta") for k, v in {"VSUMP": _GAIN, "VSUMN": _LOSS, "VSUMD": f"({_GAIN} - {_LOSS})"}.items()},
}


def family_sql(name: str, windows=ops.WINDOWS, digits: int = 6) -> str:
    """Each window as one SELECT over its own frame, joined by key; with more digits than six, halves of the last one go up."""
    nudge = " + 1e-12" if digits > 6 else ""
    parts = [
        f"w{n} AS (SELECT symbol, trade_date, {', '.join(f'round({x.replace("{n}", str(n))}{nudge}, {digits}) + 0.0 AS {k}{n}' for k, x in FAMILY_SQL[name].items())} FROM base WINDOW s AS (PARTITION BY symbol ORDER BY trade_date), w AS (PARTITION BY symbol ORDER BY trade_date ROWS {n - 1} PRECEDING))"
        for n in windows
    ]
    joins = " ".join(f"JOIN w{n} USING (symbol, trade_date)" for n in windows[1:])
    return f"{BASE_SQL}, {', '.join(parts)} SELECT * FROM w{windows[0]} {joins}"


@query("kbar_shapes", BASE_SQL + f" SELECT symbol, trade_date, {', '.join(f'round({x}, 6) + 0.0 AS {k}' for k, x in KBAR_SQL.items())} FROM base", dates="trade_date")
def kbar_shapes(spark: SparkSession, d: str) -> DataFrame:
    return shown(panel(spark, d).select("symbol", "trade_date", *[c.alias(k) for k, c in ops.kbar().items()]))


def _family(name: str, registered: str) -> None:
    digits = 8 if name in ("quantiles", "stats") else 6  # ratios of prices end on a five just behind the last place now and then

    @query(registered, family_sql(name, digits=digits), dates="trade_date")
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = ops.features(panel(spark, d), (getattr(ops, name),))
        if digits > 6:
            rows = rows.withColumns({c: F.col(c) + 1e-12 for c, kind in rows.dtypes if kind == "double"})
        return shown(rows, digits, rounded)


for _name, _registered in (("stats", "rolling_stats"), ("ols", "rolling_ols"), ("quantiles", "rolling_quantiles"), ("ranks", "rolling_rank"), ("extremes", "rolling_rsv_argext"), ("correlations", "rolling_corr"), ("counts", "updown_counts"), ("volumes", "volume_features")):
    _family(_name, _registered)


LABEL_SQL = with_("panel") + """,
labels0 AS (SELECT symbol, trade_date, lead(open, 6) OVER s / nullif(lead(open, 1) OVER s, 0) - 1 AS label, lead(trade_date, 6) OVER s AS label_end, count(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS 64 PRECEDING) >= 60 AS eligible FROM panel WINDOW s AS (PARTITION BY symbol ORDER BY trade_date))"""


@query("forward_labels", LABEL_SQL + " SELECT symbol, trade_date, round(label, 6) + 0.0 AS label, label_end, eligible FROM labels0", dates="trade_date label_end")
def forward_labels(spark: SparkSession, d: str) -> DataFrame:
    return shown(ops.forward_labels(panel(spark, d)))


@query("label_zscore", LABEL_SQL + " SELECT symbol, trade_date, round((label - avg(label) OVER d) / nullif(stddev_pop(label) OVER d, 0), 6) + 0.0 AS z FROM labels0 WHERE label IS NOT NULL WINDOW d AS (PARTITION BY trade_date)", dates="trade_date")
def label_zscore(spark: SparkSession, d: str) -> DataFrame:
    """Labels against the cross-section of their day."""
    rows = ops.forward_labels(panel(spark, d)).where(F.col("label").isNotNull())
    day = Window.partitionBy("trade_date")
    return shown(rows.select("symbol", "trade_date", ((F.col("label") - F.avg("label").over(day)) / F.nullif(F.stddev_pop("label").over(day), F.lit(0.0))).alias("z")))


SCALED = ("KMID", "KLEN", "KUP", "KLOW", "KSFT")


@query("mad_scaler", BASE_SQL + ", k AS (" + " UNION ALL ".join(f"SELECT '{k}' AS feature, {KBAR_SQL[k]} AS x FROM base" for k in SCALED) + "), m AS (SELECT feature, quantile_cont(x, 0.5) AS center FROM k GROUP BY 1) SELECT feature, round(any_value(center), 6) + 0.0 AS center, round(quantile_cont(abs(x - center), 0.5) * 1.4826, 6) + 0.0 AS scale FROM k JOIN m USING (feature) GROUP BY 1")
def mad_scaler(spark: SparkSession, d: str) -> DataFrame:
    """Median and scaled median deviation of each feature; exact, by brackets around the medians, and no task sees a whole feature."""
    columns = ops.kbar()
    wide = materialise(panel(spark, d).select(*[columns[k].alias(k) for k in SCALED]), "scaled-features")
    center = column_quantile(wide, list(SCALED), 0.5)
    away = wide.select(*[F.abs(F.col(k) - F.lit(c).cast("double")).alias(k) for k, c in center.items()])
    scale = column_quantile(away, list(SCALED), 0.5)
    row = lambda k: F.struct(F.lit(k).alias("feature"), F.lit(center[k]).cast("double").alias("center"), F.lit(scale[k]).cast("double").alias("middle"))
    found = wide.limit(1).select(F.explode(F.array(*map(row, SCALED))).alias("f")).select("f.*").where("center is not null")
    return shown(found.select("feature", "center", (F.col("middle") * 1.4826).alias("scale")))


@query("panel_ranks", with_("panel") + ", r AS (SELECT symbol, trade_date, (rank() OVER (ORDER BY close) + (count(*) OVER (PARTITION BY close) - 1) / 2.0::DOUBLE) / count(*) OVER () AS p FROM panel) SELECT symbol, trade_date, round(p, 9) + 0.0 AS close_rank FROM r", dates="trade_date")
def panel_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The rank of every close among all of the panel: one group, cut into ranges."""
    ranked = percentile_ranks(panel(spark, d).select("symbol", "trade_date", "close"), [], "close", "close_rank")
    return shown(ranked.drop("close"), 9)


@query("market_quantiles", with_("panel") + ", x AS (SELECT close / nullif(pre_close, 0) - 1 AS r FROM panel) SELECT count(r) AS n, round(quantile_cont(r, 0.01), 9) + 0.0 AS q01, round(quantile_cont(r, 0.25), 9) + 0.0 AS q25, round(quantile_cont(r, 0.5), 9) + 0.0 AS q50, round(quantile_cont(r, 0.99), 9) + 0.0 AS q99 FROM x")
def market_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles of all daily returns of the panel, as one group."""
    r = materialise(panel(spark, d).select((F.col("close") / F.nullif("pre_close", F.lit(0.0)) - 1).alias("r")), "returns")
    found = quantiles(r, [], "r", {"q01": 0.01, "q25": 0.25, "q50": 0.5, "q99": 0.99})
    return shown(found.withColumn("n", r.agg(F.count("r")).scalar()), 9)


FOLDS = (("train", "1996-03-01", "1996-08-01"), ("valid", "1996-08-01", "1996-11-01"), ("test", "1996-11-01", "1997-02-01"))


@query("purged_folds", LABEL_SQL + ", f(fold, a, b) AS (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in FOLDS) + ") SELECT fold, count(*) AS n_rows, count(DISTINCT trade_date) AS n_days, min(trade_date) AS first_day, max(label_end) AS last_label FROM labels0 JOIN f ON trade_date >= a AND trade_date < b AND (label_end < b OR fold = 'test') WHERE eligible AND label IS NOT NULL GROUP BY 1", dates="first_day last_label")
def purged_folds(spark: SparkSession, d: str) -> DataFrame:
    """Rows by fold; a label must end before the next fold begins, except in the last."""
    at, end = F.col("trade_date"), F.col("label_end")
    fold = F.lit(None).cast("string")
    for name, a, b in FOLDS:
        inside = (at >= F.lit(a).cast("date")) & (at < F.lit(b).cast("date"))
        fold = F.when(inside & (F.lit(name == "test") | (end < F.lit(b).cast("date"))), name).otherwise(fold)
    rows = ops.forward_labels(panel(spark, d)).where(F.col("eligible") & F.col("label").isNotNull()).withColumn("fold", fold).where(F.col("fold").isNotNull())
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("trade_date").alias("n_days"), F.min("trade_date").alias("first_day"), F.max("label_end").alias("last_label"))


@query("fold_plan", with_("panel") + """, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS pos FROM (SELECT DISTINCT trade_date FROM panel)), sig AS (SELECT pos AS p FROM cal WHERE pos IN (200, 300, 400))
SELECT s.p::INT AS signal, max(CASE WHEN c.pos = s.p - 7 - 63 - 7 - 252 + 252 THEN c.trade_date END) AS valid_from, max(CASE WHEN c.pos = s.p - 8 THEN c.trade_date END) AS valid_to, max(CASE WHEN c.pos = greatest(1, s.p - 77 - 252) THEN c.trade_date END) AS train_from,
  count(*) FILTER (WHERE c.pos < s.p - 77 AND (c.pos - 65) % 5 = 0 AND c.pos >= 65) AS train_days FROM sig s CROSS JOIN cal c GROUP BY 1""", dates="valid_from valid_to train_from")
def fold_plan(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of training and validation before each signal, by position in the calendar, and the sampled training days."""
    days = panel(spark, d).select("trade_date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("trade_date")))
    rows = days.select("trade_date", "pos", F.explode(F.array(*[F.lit(s) for s in (200, 300, 400)])).alias("signal"))
    at = lambda p: F.max(F.when(F.col("pos") == p, F.col("trade_date")))
    s, pos = F.col("signal"), F.col("pos")
    return rows.groupBy("signal").agg(at(s - 77).alias("valid_from"), at(s - 8).alias("valid_to"), at(F.greatest(F.lit(1), s - 329)).alias("train_from"), F.count_if((pos < s - 77) & ((pos - 65) % 5 == 0) & (pos >= 65)).alias("train_days"))
