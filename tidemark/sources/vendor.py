"""Parsers of vendor payloads as column expressions: text in, typed rows or a rejection out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import missing
from tidemark.operators.asof import state_on  # noqa: F401  a membership is a state

#: Shares in a lot, and yuan in ten thousand yuan.
LOT, TEN_THOUSAND = 100, 10_000
#: Header names under which a code or an industry may stand.
SYMBOL_ALIASES, INDUSTRY_ALIASES = ("symbol", "code", "证券代码", "股票代码"), ("industry", "行业", "所属行业", "行业名称")


def kline_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``symbol, trade_date, open, close, high, low, volume, amount, pre_close`` from positional JSON arrays.

    The close before is that of the row before; volumes come in lots and amounts in ten thousands; a row that does not
    parse has NULL where it fails.
    """
    schema = "struct<code: string, rows: array<array<string>>>"
    rows = payloads.select(F.from_json(column, schema).alias("p")).select(F.lpad("p.code", 6, "0").alias("symbol"), F.posexplode("p.rows").alias("at", "r"))
    number = lambda i: F.get("r", i).try_cast("double")
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("trade_date"))
    typed = rows.select(
        "symbol", F.get("r", 0).try_cast("date").alias("trade_date"), number(1).alias("open"), number(2).alias("close"), number(3).alias("high"), number(4).alias("low"),
        (number(5) * LOT).cast("bigint").alias("volume"), (number(6) * TEN_THOUSAND).alias("amount"),
    )
    return typed.withColumn("pre_close", before)


def quote_rows(lines: DataFrame, as_of: Column, column: str = "line") -> DataFrame:
    """``symbol, name, open, close, pre_close, volume, stamp, status`` from lines of ``~``-separated fields.

    A quote is rejected if its stamp is malformed or of another day, and if it
    is from before the close, unless it says that the day had no trade.
    """
    f = F.split(column, "~")
    number = lambda i: F.get(f, i).try_cast("double")
    stamp = F.when(F.length(F.get(f, 6)) == 14, F.try_to_timestamp(F.get(f, 6), F.lit("yyyyMMddHHmmss")))
    rows = lines.select(F.get(f, 0).alias("symbol"), F.get(f, 1).alias("name"), number(2).alias("open"), number(3).alias("close"), number(4).alias("pre_close"), (number(5) * LOT).cast("bigint").alias("volume"), stamp.alias("stamp"))
    halted = (F.col("open") == 0) & (F.col("volume") == 0)
    status = (
        F.when(F.col("stamp").isNull(), "malformed stamp")
        .when(F.to_date("stamp") != as_of, "other day")
        .when((F.hour("stamp") < 15) & ~F.coalesce(halted, F.lit(False)), "before the close")
        .otherwise("accepted")
    )
    return rows.withColumn("status", status)


def resolve_alias(rows: DataFrame, aliases: tuple[str, ...], name: str) -> Column:
    """The value under the first of the aliases that has one; NULL, which drops the row, where the table has no such column."""
    found = [a for a in aliases if a in rows.columns]
    return F.coalesce(*[F.col(f"`{a}`").cast("string") for a in found]) if found else F.lit(None).cast("string")


def industry_rows(rows: DataFrame, order: str) -> DataFrame:
    """``symbol, industry``: codes taken out of text, blanks dropped, the last row of a symbol kept."""
    code = F.regexp_extract(resolve_alias(rows, SYMBOL_ALIASES, "symbol").cast("string"), r"(\d{6})", 1)
    industry = F.nullif(F.trim(resolve_alias(rows, INDUSTRY_ALIASES, "industry")), F.lit(""))
    clean = rows.select(code.alias("symbol"), industry.alias("industry"), F.col(order).alias("nth")).where((F.col("symbol") != "") & F.col("industry").isNotNull())
    return clean.groupBy("symbol").agg(F.max_by("industry", "nth").alias("industry"))


def industry_file(spark: SparkSession, path: str) -> DataFrame:
    """``symbol, industry`` from a CSV file with a header; empty where there is no file, or none that can be read as such."""
    from tidemark.operators.sinks import path_exists

    empty = spark.createDataFrame([], "symbol string, industry string")
    if not path_exists(spark, path):
        return empty
    rows = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", "true").csv(path)
    rows = rows.toDF(*[c.removeprefix("\ufeff").strip() for c in rows.columns]) if rows.columns else rows
    if not set(SYMBOL_ALIASES) & set(rows.columns):
        return empty
    return industry_rows(rows.withColumn("_nth", F.monotonically_increasing_id()), "_nth")


def table_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key, row_no, cells``: the cells of each table row or list item of a page, tags stripped."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<(?:p|li|h[1-6]|tr)\b[^>]*>(.*?)</(?:p|li|h[1-6]|tr)>"), 1)).alias("row_no", "inner"))
    return rows.select(key, "row_no", F.trim(F.regexp_replace(F.regexp_replace("inner", r"(?s)<[^>]*>", " "), r"\s+", " ")).alias("cells"))


def plain_number(column: Column) -> Column:
    """A number written with thousands separators; marks such as ``--`` and ``nan`` are NULL."""
    return missing(F.regexp_replace(column, "[,\\s]", "").try_cast("double"))


def theme_rows(payloads: DataFrame) -> DataFrame:
    """``asked, symbol, reason, change_pct, echoed`` from one JSON response a day."""
    schema = "struct<data: array<struct<code: string, reason: string, change_pct: string, date: string>>>"
    rows = payloads.select("asked", F.explode(F.from_json("payload", schema)["data"]).alias("r"))
    return rows.select("asked", F.lpad("r.code", 6, "0").alias("symbol"), F.col("r.reason").alias("reason"), plain_number(F.col("r.change_pct")).alias("change_pct"), F.try_to_date("r.date", "yyyyMMdd").alias("echoed"))


def theme_verdicts(payloads: DataFrame) -> DataFrame:
    """``asked, status, problem, n_rows``: a response counts only if all its rows are of the day and one has a change."""
    by = theme_rows(payloads).groupBy("asked").agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.every(F.col("echoed") == F.col("asked")), F.lit(False)).alias("own"), (F.count("change_pct") > 0).alias("moved"))
    problem = F.when(~F.col("own"), "other day").when(~F.col("moved"), "no change in any row")
    return by.select("asked", F.when(problem.isNull(), "OK").otherwise("REJECTED").alias("status"), problem.alias("problem"), "n_rows")


def unusual_rows(lines: DataFrame, day: str) -> DataFrame:
    """``day, symbol, explanation, net_buy`` from JSON lines under vendor names; rows of another date are refused."""
    schema = "struct<SECURITY_CODE: string, TRADE_DATE: string, BILLBOARD_NET_AMT: string, EXPLANATION: string>"
    rows = lines.select(day, F.from_json("line", schema).alias("r"))
    return rows.where(F.col("r.TRADE_DATE").try_cast("date") == F.col(day)).select(day, F.lpad("r.SECURITY_CODE", 6, "0").alias("symbol"), F.col("r.EXPLANATION").alias("explanation"), plain_number(F.col("r.BILLBOARD_NET_AMT")).alias("net_buy"))


def primary_or_fallback(lines: DataFrame, day: str, fallback: DataFrame) -> DataFrame:
    """Rows of the first source, and of the second for the days on which the first did not answer in its format.

    A day without rows is an answer; only one that does not parse is a failure.
    """
    failed = lines.groupBy(day).agg(F.bool_or(F.from_json("line", "struct<SECURITY_CODE: string>")["SECURITY_CODE"].isNull()).alias("bad")).where("bad").select(day)
    first = unusual_rows(lines, day).join(failed, day, "left_anti").withColumn("source", F.lit("primary"))
    return first.unionByName(fallback.join(failed, day, "left_semi").withColumn("source", F.lit("fallback")))


#: Header names of a page's table.
PAGE_SYMBOL, PAGE_EXPLANATION = ("代码", "证券代码", "股票代码"), ("解读", "上榜原因", "原因")


def page_events(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key, symbol, explanation, n_rows`` from a page's tables: a header row says which cell is which.

    Comments, scripts and styles go first. Tables that hold no other are read,
    so a table for layout around them does no harm; a table whose header names
    no code is passed over. Cells are read within rows, whatever attributes and
    tags they have. A symbol's distinct explanations are joined by ``|``.
    """
    clean = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>", "")
    inner = F.regexp_extract_all(clean, F.lit(r"(?is)<table\b[^>]*>((?:(?!</?table\b).)*+)</table>"), F.lit(1))
    cell = lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>|&nbsp;", " "), r"\s+", " ")))
    table = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1)), cell)
    place = lambda names: F.array_max(F.array(*[F.array_position("head", n) for n in names])).cast("int")
    tables = pages.select(key, F.explode(inner).alias("inner")).select(key, table(F.col("inner")).alias("rows"))
    rows = tables.select(key, F.get("rows", 0).alias("head"), F.explode(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))).alias("row")).where(place(PAGE_SYMBOL) > 0)
    read = rows.select(key, F.get("row", place(PAGE_SYMBOL) - 1).alias("symbol"), F.get("row", place(PAGE_EXPLANATION) - 1).alias("explanation"))
    read = read.where(F.col("symbol").rlike(r"^\d{6}$"))
    return read.groupBy(key, "symbol").agg(F.array_join(F.array_sort(F.collect_set("explanation")), "|").alias("explanation"), F.count(F.lit(1)).alias("n_rows"))


def margin_rows(raw: DataFrame) -> DataFrame:
    """``id, symbol, balance, volume`` under an exchange's names."""
    return raw.select("id", F.lpad("标的证券代码", 6, "0").alias("symbol"), plain_number(F.col("融资余额")).alias("balance"), plain_number(F.col("融券余量")).cast("bigint").alias("volume"))


def sector_rows(raw: DataFrame) -> DataFrame:
    """``sector, members, change_pct, leaders``; whole numbers may be missing."""
    whole = lambda c: plain_number(F.col(c)).cast("bigint")
    return raw.select(F.col("板块名称").alias("sector"), whole("公司家数").alias("members"), plain_number(F.col("涨跌幅")).alias("change_pct"), whole("上涨家数").alias("leaders"))


def valuation_rows(raw: DataFrame) -> DataFrame:
    """``trade_date, symbol, pe_ttm, market_cap`` of the rows whose own date is the one that was asked for."""
    same = F.col("date").try_cast("date") == F.col("asked")
    return raw.where(same).select(F.col("asked").alias("trade_date"), F.lpad("code", 6, "0").alias("symbol"), plain_number(F.col("peTTM")).alias("pe_ttm"), F.col("totalMarketCap").try_cast("bigint").alias("market_cap"))


def membership_status(rows: DataFrame, day: str, member: str, least: int) -> DataFrame:
    """``day, n_rows, n_members, status``: a list must have enough members, and each once."""
    by = rows.groupBy(day).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(member).alias("n_members"))
    return by.withColumn("status", F.when(F.col("n_members") < least, "too few").when(F.col("n_rows") > F.col("n_members"), "repeated").otherwise("OK"))


def merge_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both tables; where both have a key, each value of the new one wins if it is there."""
    values = [c for c in old.columns if c not in keys]
    a, b = old.select(*keys, F.struct(*values).alias("a")), new.select(*keys, F.struct(*values).alias("b"))
    return a.join(b, keys, "full_outer").select(*keys, *[F.coalesce(F.col(f"b.{v}"), F.col(f"a.{v}")).alias(v) for v in values])


def both_or_nothing(a: DataFrame, b: DataFrame, keys: list[str], day: str) -> DataFrame:
    """The union of two exchanges' rows on days on which both have some; the first of a key stays."""
    days = a.select(day).distinct().intersect(b.select(day).distinct())
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1))).join(days, day, "left_semi")
    values = [c for c in a.columns if c not in keys]
    first = both.groupBy(*keys).agg(F.min_by(F.struct(*values), "side").alias("v"))
    return first.select(*keys, *[F.col(f"v.{v}").alias(v) for v in values])
