"""Readers for the Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import small_splits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows that a task gets where a table is dealt out by key, whatever the table's size.
TASK_ROWS = 200_000


def dealt_by(rows: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """``rows`` dealt out by ``keys`` to a number of tasks in proportion to the rows, so that a task's memory stays the same as a table grows.

    The rows are counted, or those of ``like``: a table as read, of which
    ``rows`` are made, is counted from the footers of its files. Where the
    cluster has a core for each such task anyway, the number is left to the
    engine. Tasks that read get small pieces of files for the same reason.
    """
    small_splits(rows.sparkSession)
    tasks = -(-(rows if like is None else like).count() // TASK_ROWS)
    return rows.repartition(tasks, *keys) if tasks > rows.sparkSession.sparkContext.defaultParallelism else rows.repartition(*keys)
