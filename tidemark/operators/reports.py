"""Reports for people and machines: CSV with a byte order mark, Markdown, and the latest of several files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the mark by which spreadsheets know UTF-8.
BOM = "\ufeff"


#: The columns that a report of screened symbols shows first, in order: what it is, where it stands, how it moved, themes, capital, statements.
PREFERRED = (
    "symbol", "name", "industry", "close", "score", "score_coverage", "ret_since_base", "close_position_250", "dist_to_52w_high", "close_position_20", "history_days", "listed_days",
    "ret_20", "ret_60", "relative_ret_20", "relative_ret_60", "realized_vol_20", "downside_vol_20", "max_drawdown_60", "signed_amount_pressure_20", "volume_trend_20", "turnover_value_20",
    "theme_tags", "theme_heat_max", "theme_days_20", "lhb_count_20", "lhb_net_buy_rel", "main_net_inflow", "pe_ttm", "pe_industry_value", "revenue_yoy", "positive_growth_streak",
    "roe_avg", "gross_profit_margin", "cfo_to_np",
)


def in_preferred_order(rows: DataFrame, preferred: tuple[str, ...] = PREFERRED) -> DataFrame:
    """The columns of a report, the preferred ones that are there first; none is dropped."""
    return rows.select(*ordered(rows.columns, list(preferred)))


def ordered(columns: list[str], preferred: list[str]) -> list[str]:
    """The preferred columns that are there, in their order, and the others after them in theirs."""
    first = [c for c in preferred if c in columns]
    return first + [c for c in columns if c not in first]


def write_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """A CSV report whose header begins with a byte order mark, one file a partition.

    Rows are sorted within the partitions of a range over ``order``, so that
    the files in name order are the whole report in order; nothing is gathered.
    """
    marked = rows.select(*[F.col(c).alias(BOM + c if i == 0 else c) for i, c in enumerate(rows.columns)])
    keys = [BOM + c if c == rows.columns[0] else c for c in order]
    marked.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("header", True).option("compression", "none").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report with its types; the header, with or without a mark, is skipped."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST").csv(path)


def latest_report(spark: SparkSession, pattern: str, schema: str, date: str = "as_of") -> DataFrame:
    """The report with the latest date; of several for that date the one whose file was written last."""
    rows = read_csv(spark, pattern, schema).withColumn("_at", F.struct(F.col("_metadata.file_modification_time").alias("time"), F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/", 1).alias("folder")))
    folders = rows.groupBy("_at.folder").agg(F.max(F.struct(F.col(date), F.col("_at.time"))).alias("rank"))
    newest = folders.agg(F.max_by("folder", "rank")).scalar()
    return rows.where(F.col("_at.folder") == newest).drop("_at")


def markdown(rows: DataFrame, order: list[str], limit: int = 200) -> str:
    """The first ``limit`` rows in order as a Markdown table: a text for people, bounded by ``limit``."""
    shown = rows.orderBy(*order).limit(limit).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in shown]) + "\n"
