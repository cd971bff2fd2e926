"""History counted in sessions and in rows, never in calendar days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

#: Rows of a symbol that the factors of one day need: the longest window has 250, and a change needs one more.
HISTORY_ROWS = 251
#: Sessions of which every symbol's rows are needed: those of the market's longest return.
MARKET_SESSIONS = 61


def session_index(rows: DataFrame) -> DataFrame:
    """``trade_date, session``: the dates that have a row, numbered from 1; one row a day, so its window never sees symbols."""
    return rows.select("trade_date").where(F.col("trade_date").isNotNull()).distinct().withColumn("session", F.row_number().over(Window.orderBy("trade_date")))


def session_back(rows: DataFrame, day: Column, n: int) -> Column:
    """The date on which the last ``n`` sessions up to ``day`` begin, as a scalar; the first one where there are fewer.

    Sessions are the dates on which ``rows`` has any row. NULL where none is
    up to ``day``.
    """
    days = rows.select("trade_date").where(F.col("trade_date") <= day).distinct()
    return days.orderBy(F.desc("trade_date")).limit(n).agg(F.min("trade_date")).scalar()


def history_index(rows: DataFrame, base_day: Column | None = None) -> DataFrame:
    """``symbol, month, n, last_date, base``: rows of each symbol by month, and its last close up to ``base_day`` there.

    This is what tells how far back a symbol's last rows reach without reading
    its history in order: one partial aggregate over two or three columns.
    """
    at = F.col("trade_date")
    base = F.struct(at, "close") if base_day is not None else F.lit(None).cast("struct<trade_date: date, close: double>")
    held = F.when(at <= base_day, base) if base_day is not None else base
    return rows.groupBy("symbol", F.trunc("trade_date", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.max("trade_date").alias("last_date"), F.max(held).alias("base"))


def history_cuts(index: DataFrame, rows: int = HISTORY_ROWS) -> DataFrame:
    """``symbol, since, earlier, base_close, last_date``: where each symbol's last ``rows`` rows begin, to the month.

    ``earlier`` counts the rows before ``since``. A symbol that was suspended
    gets an earlier date than others, so that its windows are full as well.
    """
    newer = Window.partitionBy("symbol").orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)
    counted = index.withColumn("newer", F.coalesce(F.sum("n").over(newer), F.lit(0)))
    needed = F.col("newer") < rows
    return counted.groupBy("symbol").agg(
        F.min(F.when(needed, F.col("month"))).alias("since"),
        F.coalesce(F.sum(F.when(~needed, F.col("n"))), F.lit(0)).alias("earlier"),
        F.max("base")["close"].alias("base_close"),
        F.max("last_date").alias("last_date"),
    )


def recent(panel: DataFrame, day: Column, base_day: Column | None = None, rows: int = HISTORY_ROWS, sessions: int = MARKET_SESSIONS) -> DataFrame:
    """The part of the panel that the factors of ``day`` need, with ``earlier`` and ``base_close`` of each symbol.

    Of every symbol with a row in the last ``sessions`` sessions it holds at
    least the last ``rows`` rows up to ``day``; ``earlier`` counts those left
    out. The least of the symbols' first dates stands as a filter in the scan;
    each symbol's own one follows in a join with one row a symbol, before
    anything is shuffled.
    """
    at = F.col("trade_date")
    until = panel.where(at <= day)
    # Written: it is read for the scan's filter and for the symbols' own ones.
    cuts = history_cuts(history_index(until, base_day), rows).where(F.col("last_date") >= session_back(until, day, sessions))
    cuts = materialise(cuts.select("symbol", "since", "earlier", "base_close"), "history-cuts")
    first = cuts.agg(F.min("since")).scalar()
    return panel.where((at >= first) & (at <= day)).join(cuts, "symbol").where(at >= F.col("since")).drop("since")
