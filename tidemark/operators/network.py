"""Cross-market network: lagged changes, correlations with intervals, basket series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import change, correlation
from tidemark.operators.asof import strict_asof

MAX_AGE, MIN_SAMPLES, THRESHOLD = 7, 20, 0.30


def lagged_changes(grid: DataFrame, observed: DataFrame) -> DataFrame:
    """Levels strictly before each grid day, differenced on the grid; a stale level breaks two changes."""
    found = strict_asof(grid, observed, ["id"], "day", ["level"], MAX_AGE)
    before = F.lag("level").over(Window.partitionBy("id").orderBy("day"))
    return found.select("id", "day", change(F.col("level"), before).alias("change"))


def network(changes: DataFrame, returns: DataFrame, since: Column) -> DataFrame:
    """``factor, sector, n, rho, low, high, connected`` over the days since ``since``: one join on the day."""
    a = changes.where((F.col("day") >= since) & F.col("change").isNotNull()).select(F.col("id").alias("factor"), "day", F.col("change").alias("x"))
    b = returns.where(F.col("ret").isNotNull()).select(F.col("id").alias("sector"), "day", F.col("ret").alias("y"))
    by = a.join(b, "day").groupBy("factor", "sector").agg(F.count(F.lit(1)).alias("n"), correlation(F.col("x"), F.col("y")).alias("r"))
    rho = F.when(F.col("n") >= MIN_SAMPLES, F.greatest(F.least("r", F.lit(1.0)), F.lit(-1.0)))
    z, margin = F.atanh(F.greatest(F.least("rho", F.lit(0.999999)), F.lit(-0.999999))), 1.96 / F.sqrt(F.nullif(F.greatest(F.col("n") - 3, F.lit(0)), F.lit(0)))
    out = by.withColumn("rho", rho)
    return out.select("factor", "sector", "n", "rho", F.tanh(z - margin).alias("low"), F.tanh(z + margin).alias("high"), F.coalesce(F.abs("rho") >= THRESHOLD, F.lit(False)).alias("connected"))


def network_summary(relations: DataFrame) -> DataFrame:
    strongest = F.max_by(F.struct("factor", "sector"), F.struct(F.abs("rho"), "factor", "sector"))
    by = relations.agg(F.count(F.lit(1)).alias("possible"), F.count("rho").alias("valid"), F.count_if("connected").alias("n_connected"), F.avg(F.when(F.col("connected"), F.abs("rho"))).alias("average_strength"), strongest.alias("s"))
    return by.select("possible", "valid", "n_connected", (F.col("n_connected") / F.nullif("valid", F.lit(0))).alias("density"), "average_strength", F.col("s.factor").alias("factor"), F.col("s.sector").alias("sector"))


def basket(levels: DataFrame, size: int) -> DataFrame:
    """Per common day: breadth over the 20-day mean, dispersion of returns, concentration of amounts."""
    common = levels.groupBy("day").agg(F.count_distinct("id").alias("n")).where(F.col("n") == size).select("day")
    rows = levels.join(common, "day")
    by = Window.partitionBy("id").orderBy("day")
    rows = rows.withColumns({
        "ret": change(F.col("level"), F.lag("level").over(by)),
        "above": F.when(F.row_number().over(by) >= 20, (F.col("level") > F.avg("level").over(by.rowsBetween(-19, 0))).cast("double")),
        "share": F.col("amount") / F.sum("amount").over(Window.partitionBy("day")),
    })
    return rows.where(F.col("above").isNotNull()).groupBy("day").agg((F.avg("above") * 100).alias("breadth"), (F.stddev_pop("ret") * 100).alias("dispersion"), F.sum(F.col("share") * F.col("share")).alias("hhi"))


def synchrony(returns: DataFrame) -> DataFrame:
    """Share of pairs whose trailing 60-day correlation reaches the threshold, by day."""
    a, b = returns.where("ret is not null").select("day", F.col("id").alias("a"), F.col("ret").alias("x")), returns.where("ret is not null").select("day", F.col("id").alias("b"), F.col("ret").alias("y"))
    w = Window.partitionBy("a", "b").orderBy("day").rowsBetween(-59, 0)
    pairs = a.join(b, "day").where("a < b")
    sd = F.stddev_pop("x").over(w) * F.stddev_pop("y").over(w)
    rho = F.when(F.count(F.lit(1)).over(w) >= MIN_SAMPLES, F.covar_pop("x", "y").over(w) / F.nullif(sd, F.lit(0.0)))
    return pairs.select("day", rho.alias("rho")).groupBy("day").agg(F.count("rho").alias("n_pairs"), F.avg(F.when(F.col("rho").isNotNull(), (F.round(F.abs("rho"), 9) >= THRESHOLD).cast("double"))).alias("synchrony"))


def midrank_percentile(value: str, by: list[str], order: str, back: int = 252, least: int = 60) -> Column:
    """Where a value stands among up to ``back`` earlier ones, itself not included; NULL with fewer than ``least``."""
    past = F.collect_list(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-back, -1))
    below = F.size(F.filter(past, lambda x: x < F.col(value))) + 0.5 * F.size(F.filter(past, lambda x: x == F.col(value)))
    return F.when(F.size(past) >= least, 100 * below / F.size(past))
