"""Column helpers with the engine's missing-value rules: NULL is never zero."""

from __future__ import annotations

import re
from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def r6(column: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(column, 6) + F.lit(0.0)


def missing(column: Column) -> Column:
    """NaN becomes NULL; done once, when rows enter the engine."""
    return F.when(~F.isnan(column), column)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; NULL where b is zero or missing."""
    return a / F.nullif(b, F.lit(0.0))


def change(now: Column, before: Column) -> Column:
    """Relative change from ``before`` to ``now``."""
    return ratio(now, before) - 1


def nullable_mean(*columns: Column) -> Column:
    """Mean of the values that are present; NULL if none is."""
    seen = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in columns])
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    return total / F.nullif(seen, F.lit(0))


def weighted_mean(parts: dict[str, float], prefix: str = "") -> tuple[Column, Column]:
    """Weighted mean over present columns, weights renormalised, and the share of weight present (NULL at zero)."""
    seen = reduce(lambda a, b: a + b, [F.when(F.col(prefix + n).isNotNull(), w).otherwise(0.0) for n, w in parts.items()])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(prefix + n), F.lit(0.0)) * w for n, w in parts.items()])
    return total / F.nullif(seen, F.lit(0.0)), F.nullif(seen, F.lit(0.0)) / sum(parts.values())


def clamp(column: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(column, F.lit(high)), F.lit(low))


def true(condition: Column) -> Column:
    """A condition that a missing value does not meet."""
    return F.coalesce(condition, F.lit(False))


def count_true(*conditions: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.when(true(c), 1).otherwise(0) for c in conditions])


def full(aggregate, column: Column, window: WindowSpec, rows: int) -> Column:
    """``aggregate(column)`` over the window, or NULL unless it holds ``rows`` values."""
    return F.when(F.count(column).over(window) == rows, aggregate(column).over(window))


def pct_rank(column: Column, *partition: Column) -> Column:
    """Percentile rank with average ties in (0, 1]; NULL stays NULL and does not count.

    The mean of the least and the greatest rank of a value. The greatest is the
    number of values up to it: missing values sort last, so that they are in no
    count that is used, and one sort serves all windows.
    """
    from pyspark.sql import Window

    whole = Window.partitionBy(*partition)
    n, rising = F.count(column).over(whole), whole.orderBy(column.asc_nulls_last())
    up_to = F.count(column).over(rising.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(column.isNotNull(), (F.rank().over(rising) + up_to) / 2 / n)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; NULL where a side does not vary."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def iso_date(text: str) -> Column:
    """A typed date from text that is an ISO date from end to end; anything else is refused before a plan is made of it."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"not a date: {text!r}")
    return F.lit(date.fromisoformat(text))


def rounded(x: Column, digits: int = 0) -> Column:
    """``x`` with ``digits`` decimals, halves away from zero, as SQL rounds doubles: scaled, rounded, and scaled back.

    Spark's own rounding of a double goes through its decimal text, which costs
    a hundred times as much; it is left for values of more than 15 digits.
    """
    scale = float(10**digits)
    near = F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale
    return F.when(F.abs(x) < 1e15 / scale, near).otherwise(F.round(x, digits))
