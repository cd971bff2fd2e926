"""Keyed tables: latest rows, de-duplication, upsert and insert-if-absent, day replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column], keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each key in ``order``; Spark limits groups before the window's shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= keep).drop("_place")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Old rows whose key is not in ``new``, and the new rows; a key twice in ``new`` keeps the first in ``order``."""
    incoming = latest_per_key(new, keys, order)
    return old.join(incoming.select(*keys), keys, "left_anti").select(*old.columns).unionByName(incoming.select(*old.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Old rows, and the new rows whose key is not there yet."""
    incoming = latest_per_key(new, keys, order)
    return old.unionByName(incoming.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def replace_days(old: DataFrame, new: DataFrame, day: str = "trade_date") -> DataFrame:
    """Whole days of ``old`` give way to those of ``new``."""
    return old.join(new.select(day).distinct(), day, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


#: Rows below which an answer for a day is taken for a failure.
MIN_ROWS = 20


def replace_whole_days(old: DataFrame, new: DataFrame, day: str = "trade_date", least: int = MIN_ROWS) -> DataFrame:
    """``replace_days`` for the days of which ``new`` has at least ``least`` rows; other days stay as they were."""
    enough = new.groupBy(day).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(day)
    return replace_days(old, new.join(enough, day, "left_semi"), day)


class WrongColumns(ValueError):
    """Rows for a table lack a column of it, or have one that it does not know."""


def checked_upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``upsert`` of rows that have exactly the table's columns."""
    if set(old.columns) != set(new.columns):
        raise WrongColumns(f"missing {sorted(set(old.columns) - set(new.columns))}, unknown {sorted(set(new.columns) - set(old.columns))}")
    return upsert(old, new, keys, order)


def write_days(rows: DataFrame, path: str, day: str = "trade_date") -> None:
    """Replace the partitions of the days in ``rows`` and leave all others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(day).parquet(path)


def split_tags(reason: Column) -> Column:
    """Tags of a reason: split at the separators, trimmed, without empties and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(reason, "[+、,，/|]"), lambda x: F.trim(x)), lambda x: x != ""))
