"""As-of joins as one sort over the union of both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def strict_asof(grid: DataFrame, observed: DataFrame, by: list[str], at: str, values: list[str], max_age_days: int) -> DataFrame:
    """For each grid row the last observation strictly before it, NULL if older than ``max_age_days``.

    Both sides are put together and sorted once per key; a grid row takes the
    last observed struct among the rows before it. At one date observations sort
    after the grid, which makes the comparison strict.
    """
    seen = F.struct(F.col(at).alias("seen_at"), *values)
    left = grid.select(*by, at, F.lit(0).alias("side"), F.lit(None).cast(observed.select(seen.alias("s")).schema["s"].dataType).alias("s"))
    right = observed.select(*by, at, F.lit(1).alias("side"), seen.alias("s"))
    order = Window.partitionBy(*by).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, -1)
    found = left.unionByName(right).withColumn("s", F.last("s", ignorenulls=True).over(order)).where("side = 0")
    fresh = F.datediff(at, F.col("s.seen_at")) <= max_age_days
    return found.select(*by, at, *[F.when(fresh, F.col(f"s.{c}")).alias(c) for c in ["seen_at", *values]])


def state_on(rows: DataFrame, states: DataFrame, by: str, at: str, since: str, value: str) -> DataFrame:
    """``rows`` with the last ``value`` whose ``since`` is on or before their date; one sort over both sides, no row is multiplied."""
    carried = [c for c in rows.columns if c not in (by, at)]
    left = rows.select(by, at, F.lit(1).alias("_side"), F.lit(None).cast(states.schema[value].dataType).alias(value), F.struct(*carried).alias("_row"))
    right = states.select(by, F.col(since).alias(at), F.lit(0).alias("_side"), value, F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    order = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    held = left.unionByName(right).withColumn(value, F.last(value, ignorenulls=True).over(order)).where("_side = 1")
    return held.select(by, at, *[F.col(f"_row.{c}").alias(c) for c in carried], value)


def last_before(rows: DataFrame, keys: list[str], at: str, day, value: str, name: str) -> DataFrame:
    """``keys, name``: the value of the latest row on or before ``day``; a plain aggregate."""
    return rows.where(F.col(at) <= day).groupBy(*keys).agg(F.max_by(value, at).alias(name))
