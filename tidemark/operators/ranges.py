"""Order over groups of any size: ranks, quantiles and last states by ranges of rows instead of one task a group."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise


def in_ranges(rows: DataFrame, columns: list[str], name: str = "part") -> DataFrame:
    """``rows`` dealt out by ranges of the columns, with the number of the range; written, so that numbers stay what they are.

    Ranges follow each other in the columns' order. Their number follows
    ``spark.sql.shuffle.partitions``, so they shrink as a cluster grows; a
    group of any size is cut into as many ranges as its share of the rows.
    """
    return materialise(rows.repartitionByRange(*columns).withColumn(name, F.spark_partition_id()), "ranges")


def ordered_counts(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """``group, value, n, before, total``: each different value of a group, how many rows have it, and how many have less.

    NULL and NaN do not count. Equal values are added up first, where they are,
    so a value that many rows share is one row here. Then each range counts by
    itself, and what the ranges before it hold is added: the sums by range are
    one row for each range and group in it.
    """
    x = F.col(value)
    held = rows.where(x.isNotNull() & ~F.isnan(x.cast("double"))).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    cut = in_ranges(held, [*group, value])
    inside = Window.partitionBy("part", *group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("part", *group).agg(F.sum("n").alias("sum"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1) if group else Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = sums.select("part", *group, F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset"), F.sum("sum").over(whole).alias("total"))
    counted = cut.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    on = [F.col("a.part") == F.col("b.part"), *[F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]]
    joined = counted.alias("a").join(offsets.alias("b"), on)
    return joined.select(*[F.col(f"a.{g}").alias(g) for g in group], F.col(f"a.{value}").alias(value), "n", (F.col("inside") + F.col("offset")).alias("before"), "total")


def quantiles(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of each group: one column for each share.

    Of the counts, only the two values around each quantile's place are kept;
    no task sees a group. A group without a value has no row.
    """
    counts = ordered_counts(rows, group, value)
    first, last = F.col("before"), F.col("before") + F.col("n") - 1
    x = F.col(value).cast("double")
    out = []
    for name, share in shares.items():
        place = (F.col("total") - 1) * F.lit(float(share))
        low, high = F.floor(place), F.ceil(place)
        at = lambda p: F.max(F.when((first <= p) & (p <= last), x))
        below, above = at(low), at(high)  # noqa: B023
        out.append((below + (above - below) * F.max(place - low)).alias(name))
    return counts.groupBy(*group).agg(*out)


#: Cells that a bracket is cut into, rows that may be left in it before they are ordered, and rounds of cutting.
CELLS, FEW, ROUNDS = 4096, 100_000, 3


def _inside(x: Column, low: float, high: float) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (x >= F.lit(low)) & (x <= F.lit(high))


def column_quantile(rows: DataFrame, columns: list[str], share: float) -> dict[str, float | None]:
    """The exact interpolated quantile of each column, without ordering the rows; NULL and NaN do not count.

    The values between the least and the largest are counted by cells of equal
    width. The cells that hold the quantile's place are the next bracket, until
    few rows lie in it; only these are put in order, by ranges. Equal values
    may leave many rows there, which are one row each after counting. Brackets
    are one row a column on the driver; ``rows`` should be a table as read.
    """
    x = {c: F.col(c).cast("double") for c in columns}
    seen = {c: F.when(~F.isnan(v), v) for c, v in x.items()}
    first = rows.agg(*[f(v).alias(f"{k}_{i}") for i, v in enumerate(seen.values()) for k, f in (("n", F.count), ("low", F.min), ("high", F.max))]).first()
    place = {c: (first[f"n_{i}"] - 1) * share for i, c in enumerate(columns) if first[f"n_{i}"]}
    brackets = {c: (0, first[f"n_{i}"], first[f"low_{i}"], first[f"high_{i}"]) for i, c in enumerate(columns) if c in place}
    for _ in range(ROUNDS):
        wide = {c: b for c, b in brackets.items() if b[1] > FEW and b[2] < b[3] and math.isfinite(b[3] - b[2])}
        if not wide:
            break
        brackets |= _cut(rows, x, wide, place)
    kept = F.array(*[F.struct(F.lit(c).alias("column"), F.when(_inside(x[c], low, high), x[c]).alias("x")) for c, (_, _, low, high) in brackets.items()])
    found = dict.fromkeys(columns)
    if not brackets:
        return found
    counts = ordered_counts(rows.select(F.explode(kept).alias("f")).select("f.*"), ["column"], "x")
    first_at, last_at = F.col("before"), F.col("before") + F.col("n") - 1
    at = lambda p: (first_at <= p) & (last_at >= p)
    low_of, high_of = (reduce(lambda w, c: w.when(F.col("column") == c, F.lit(f(place[c]) - brackets[c][0])), place, F.when(F.lit(False), F.lit(0))) for f in (math.floor, math.ceil))
    for r in counts.groupBy("column").agg(F.max(F.when(at(low_of), F.col("x"))).alias("below"), F.max(F.when(at(high_of), F.col("x"))).alias("above")).collect():
        found[r["column"]] = r["below"] + (r["above"] - r["below"]) * (place[r["column"]] - math.floor(place[r["column"]]))
    return found


def _cut(rows: DataFrame, x: dict[str, Column], brackets: dict[str, tuple], place: dict[str, float]) -> dict[str, tuple]:
    """For each column the part of its bracket that holds the place: rows below it, rows in it, its least and largest value."""
    parts = []
    for c, (_, _, low, high) in brackets.items():
        cell = F.least(F.floor((x[c] - F.lit(low)) / F.lit(high - low) * CELLS), F.lit(CELLS - 1)).cast("int")
        parts.append(F.struct(F.lit(c).alias("column"), F.when(_inside(x[c], low, high), cell).alias("cell"), x[c].alias("x")))
    cells = rows.select(F.explode(F.array(*parts)).alias("f")).select("f.*").where("cell is not null")
    cells = cells.groupBy("column", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    cells = cells.withColumn("end", F.sum("n").over(Window.partitionBy("column").orderBy("cell")))  # CELLS rows a column at most
    begin, out = F.col("end") - F.col("n"), {}
    for c, (before, *_rest) in brackets.items():
        out[c] = (F.col("column") == c) & (begin <= math.ceil(place[c]) - before) & (F.col("end") > math.floor(place[c]) - before)
    held = cells.where(reduce(lambda a, b: a | b, out.values())).groupBy("column").agg(F.min(begin).alias("begin"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return {r["column"]: (brackets[r["column"]][0] + r["begin"], r["n"], r["low"], r["high"]) for r in held.collect()}


def percentile_ranks(rows: DataFrame, group: list[str], value: str, name: str = "pct") -> DataFrame:
    """``rows`` with the percentile rank of a value in its group, ties at their mean, in (0, 1]; NULL and NaN stay without one.

    The ranks of the different values are joined back by group and value: a
    value that many rows share meets one row, so it can be split.
    """
    rank = (F.col("before") + (F.col("n") + 1) / 2) / F.col("total")
    ranks = materialise(ordered_counts(rows, group, value).select(*group, value, rank.alias(name)), "ranks")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group] + [F.col(f"a.{value}") == F.col(f"b.{value}")]
    return rows.alias("a").join(ranks.alias("b"), on, "left").select("a.*", f"b.{name}")


def last_states(grid: DataFrame, observed: DataFrame, by: list[str], at: str, values: list[str], strict: bool = True, max_age: Column | None = None) -> DataFrame:
    """For each grid row the last observation of its key before it, or up to it unless ``strict``; NULL where there is none.

    Returns ``by, at, seen_at`` and the values. Both sides are put together and
    cut into ranges of (key, time), so that the history of one key may lie in
    many tasks. A range carries the last state of each key on to those after
    it: that is one row for each range and key in it, and a key within one
    range needs none. ``max_age`` in days drops older states. Keys may be
    NULL; equal times of one key's observations leave open which is last.
    """
    seen = F.struct(F.col(at).alias("seen_at"), *values)
    kind = observed.select(seen.alias("s")).schema["s"].dataType
    sides = (1, 0) if not strict else (0, 1)  # the side that comes first at one time
    left = grid.select(*by, at, F.lit(sides[0]).alias("side"), F.lit(None).cast(kind).alias("s"))
    right = observed.select(*by, at, F.lit(sides[1]).alias("side"), seen.alias("s"))
    cut = in_ranges(left.unionByName(right), [*by, at, "side"])
    before = Window.partitionBy("part", *by).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn("held", F.last("s", ignorenulls=True).over(before)).where(F.col("side") == sides[0])
    newest = F.max_by("s", F.when(F.col("s").isNotNull(), F.struct(at, "side")))
    ends = cut.groupBy("part", *by).agg(newest.alias("end"))
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", *by, F.last("end", ignorenulls=True).over(earlier).alias("carried")).where("carried is not null")
    on = [F.col("a.part") == F.col("b.part"), *[F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]]
    found = inside.alias("a").join(carried.alias("b"), on, "left").select(*[F.col(f"a.{k}").alias(k) for k in by], F.col(f"a.{at}").alias(at), F.coalesce("a.held", "b.carried").alias("s"))
    fresh = F.lit(True) if max_age is None else F.datediff(at, F.col("s.seen_at")) <= max_age
    return found.select(*by, at, *[F.when(fresh, F.col(f"s.{c}")).alias(c) for c in ("seen_at", *values)])
