"""Model comparison on purged folds with the engine's own learners."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import correlation, pct_rank
from tidemark.operators import compact, rolling
from tidemark.operators.fits import Fold, fit_grid, lasso
from tidemark.plans.factors import shown
from tidemark.plans.registry import query
from tidemark.plans.rolling import LABEL_SQL
from tidemark.session import materialise, scratch_path
from tidemark.sources.market import SQL, instruments, panel
from tidemark.sources.tables import table

#: First day of each fold's test and of the one after it; training ends before the first.
FOLDS = (("1996-09-01", "1996-12-01"), ("1996-12-01", "1997-03-01"))


@query("model_comparison")
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Mean daily rank correlation, by fold, of a lasso and of boosted trees on days after their training, labels purged.

    All rolling features are inputs. They are made twice and never written: once
    for the sums that a lasso needs and the thresholds of the trees, once for the
    lasso's predictions and the bins between the thresholds. What is written
    is a tenth of them; the trees pass over it many times.
    """
    known = panel(spark, d).withColumns(rolling.label_columns())
    # No fold trains or is tested on later days, and features only look back.
    known = known.where(F.col("trade_date") < F.lit(max(b for _, b in FOLDS)).cast("date"))
    own = ("trade_date", "label_end", "label")
    rows = rolling.features(known, keep=("label_end", "label", "eligible")).where(F.col("eligible") & F.col("label").isNotNull())
    names = [c for c in rows.columns if c not in ("symbol", "eligible", *own)]
    rows = rows.select(*own, (F.xxhash64("symbol", "trade_date").bitwiseAND(F.lit(2**31 - 1))).alias("key"), F.array(*names).alias("features"))
    sums, cuts = compact.summed(rows, {str(k): a for k, (a, _) in enumerate(FOLDS, 1)}, table(spark, d, "lineitem").count())
    lasso_of = LinearRegression(elasticNetParam=1.0, regParam=0.0005, fitIntercept=False, weightCol="weight")
    linear = {k: lasso_of.fit(compact.points(spark, s)).coefficients.toArray() for k, s in sums.items()}
    data = materialise(compact.narrowed(rows.drop("key"), linear, cuts), "model-rows")
    out = None
    for fold, (a, b) in enumerate(FOLDS, 1):
        first, after = F.lit(a).cast("date"), F.lit(b).cast("date")
        train, test = data.where(F.col("label_end") < first), data.where((F.col("trade_date") >= first) & (F.col("trade_date") < after))
        trees_of = GBTRegressor(maxIter=5, maxDepth=3, stepSize=0.2, seed=7)
        binned = lambda part, fold=fold: part.select("trade_date", "label", compact.bins(str(fold), len(names)).alias("features"))
        scores = {"lasso": test.withColumn("prediction", F.col(f"linear_{fold}")), "trees": trees_of.fit(binned(train)).transform(binned(test))}
        for name, score in scores.items():
            scored = score.select("trade_date", pct_rank(F.col("prediction"), F.col("trade_date")).alias("p"), pct_rank(F.col("label"), F.col("trade_date")).alias("y"))
            ic = scored.groupBy("trade_date").agg(correlation(F.col("p"), F.col("y")).alias("ic"))
            row = ic.agg(F.lit(fold).alias("fold"), F.lit(name).alias("model"), F.count("ic").alias("days"), F.avg("ic").alias("mean_ic"))
            out = row if out is None else out.unionByName(row)
    return shown(out)


POOLS = ("ASIA", "EUROPE", "AMERICA")
GRID_FOLDS = (Fold("a", "1996-03-01", "1996-07-01", "1996-08-15", "1996-10-01"), Fold("b", "1996-05-01", "1996-09-01", "1996-10-15", "1996-12-01"))
STRENGTH = 0.002
_PARTS = "\n UNION ALL ".join(
    f"""SELECT market AS pool, '{f.name}' AS fold, x, y, CASE WHEN trade_date >= DATE '{f.train}' AND trade_date < DATE '{f.valid}' AND label_end < DATE '{f.valid}' THEN 'train'
  WHEN trade_date >= DATE '{f.valid}' AND trade_date < DATE '{f.test}' AND label_end < DATE '{f.test}' THEN 'valid' WHEN trade_date >= DATE '{f.test}' AND trade_date < DATE '{f.end}' THEN 'test' END AS part FROM g"""
    for f in GRID_FOLDS
)


@query("lasso_grid", LABEL_SQL + ",\n" + SQL["instruments"] + f""",
g AS (SELECT market, p.trade_date, label_end, (close - open) / open * 100 AS x, label * 100 AS y FROM panel p JOIN labels0 l USING (symbol, trade_date) JOIN instruments i ON i.symbol = p.symbol WHERE eligible AND label IS NOT NULL AND market IN {POOLS}),
parts AS ({_PARTS}), f AS (SELECT pool, fold, count(*) FILTER (WHERE part = 'train') AS n_train, count(*) FILTER (WHERE part = 'valid') AS n_valid, count(*) FILTER (WHERE part = 'test') AS n_test, avg(x * y) FILTER (WHERE part = 'train') AS xy, avg(x * x) FILTER (WHERE part = 'train') AS xx FROM parts WHERE part IS NOT NULL GROUP BY 1, 2),
b AS (SELECT *, sign(xy) * greatest(abs(xy) - {STRENGTH}, 0) / xx AS slope FROM f)
SELECT pool, fold, n_train, n_valid, n_test, round(slope, 4) + 0.0 AS slope, round(slope * (SELECT sum(x) FROM parts WHERE parts.pool = b.pool AND parts.fold = b.fold AND part = 'test') / n_test, 3) + 0.0 AS mean_prediction FROM b""")
def lasso_grid(spark: SparkSession, d: str) -> DataFrame:
    """A lasso of the next days' return on the day's own, by pool and fold; with one feature it has a closed form.

    The grid is run twice over one folder, as after a restart: the second run
    finds all receipts, fits nothing and reads what the first has published.
    """
    rows, c = panel(spark, d), F.col
    labels = rolling.forward_labels(rows).where(c("eligible") & c("label").isNotNull())
    data = rows.select("symbol", "trade_date", ((c("close") - c("open")) / c("open") * 100).alias("x")).join(labels, ["symbol", "trade_date"]).join(instruments(spark, d).select("symbol", c("market").alias("pool")), "symbol")
    data = data.where(c("pool").isin(*POOLS)).select("pool", "symbol", "trade_date", "label_end", (c("label") * 100).alias("label"), array_to_vector(F.array("x")).alias("features"))
    data, root = materialise(data, "grid-rows"), scratch_path(spark, "grid")
    for _ in range(2):
        predictions, receipts, _made = fit_grid(data, list(POOLS), list(GRID_FOLDS), {"lasso": lasso(STRENGTH)}, root, {"features": ["x"], "strength": STRENGTH}, (100, 20))
    known = spark.createDataFrame([(r["pool"], r["fold"], r["rows"]["train"], r["rows"]["valid"], r["rows"]["test"], r["notes"]["lasso"]["coefficients"][0]) for r in receipts], "pool string, fold string, n_train long, n_valid long, n_test long, slope double")
    means = predictions.groupBy("pool", "fold").agg(F.avg("prediction").alias("mean_prediction"))
    return shown(known.withColumn("slope", F.round("slope", 4) + 0.0), 4).join(shown(means, 3), ["pool", "fold"])
