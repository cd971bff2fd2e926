"""All queries of the engine and their SQL.

A plan module registers each query with ``query``; dates leave a registered
query as ISO text, so that both engines print them alike.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODULES = ("archive", "factors", "screen", "daily", "network", "forward", "rolling", "formulas", "research", "replays", "streams", "vendor", "payloads", "audits", "models")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: str = "") -> Callable[[Query], Query]:
    """Register a query with its SQL; ``dates`` names the date columns of the SQL's result."""

    def add(f: Query) -> Query:
        @wraps(f)
        def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c, kind in df.dtypes if kind == "date"})

        QUERIES[name] = printed
        if sql:
            shown = ", ".join(f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates.split())
            ORACLES[name] = f"SELECT * REPLACE ({shown}) FROM ({sql})" if shown else sql
        return f

    return add


def load() -> None:
    for module in MODULES:
        import_module(f"tidemark.plans.{module}")
