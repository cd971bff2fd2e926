"""Gates at their edges, pages with tables in tables, files that are not what they should be, snapshots of other days."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import gates, reports, sinks
from tidemark.sources import vendor


@pytest.mark.parametrize(
    ("day", "now", "current", "closed", "forward", "blocked"),
    [
        ("2026-09-18", "2026-09-18 15:29:59", False, False, False, True),  # a Friday
        ("2026-09-18", "2026-09-18 15:30:00", True, True, True, False),
        ("2026-09-18", "2026-09-20 12:00:00", False, True, True, False),  # the Sunday after
        ("2026-09-18", "2026-09-21 09:29:59", False, True, True, False),
        ("2026-09-18", "2026-09-21 09:30:00", False, True, False, True),
        ("2026-09-19", "2026-09-21 09:29:59", False, True, True, False),
        ("2026-09-17", "2026-09-18 09:30:00", False, True, False, True),
        ("2026-09-21", "2026-09-18 16:00:00", False, False, False, False),
        ("2026-09-20", "2026-09-20 10:00:00", False, False, False, False),
    ],
)
def test_gates(spark, day, now, current, closed, forward, blocked):
    d, n = F.lit(day).cast("date"), F.to_timestamp(F.lit(now))
    found = spark.range(1).select(gates.current_ready(d, n), gates.closed_ready(d, n), gates.forward_ready(d, n), gates.fetch_blocked(n)).first()
    assert tuple(found) == (current, closed, forward, blocked)


def test_latest_complete(spark):
    days = F.array(*[F.lit(f"2026-09-{d}").cast("date") for d in (16, 17, 18)])
    at = lambda days, now: spark.range(1).select(gates.latest_complete(days, F.to_timestamp(F.lit(now)))).first()[0]
    assert [at(days, f"2026-09-18 {t}").day for t in ("15:29:00", "15:30:00")] == [17, 18]
    assert at(F.array(F.lit("2026-09-18").cast("date")), "2026-09-18 10:00:00") == dt.date(2026, 9, 18)


def test_pages_with_tables_in_tables(spark):
    data = "<table class=data><tr><th>代码</th><th>解读</th></tr><tr><td>000001</td><td>up <b>more</b></td></tr><tr><td><a href='x'>600002</a></td><td>down&nbsp;</td></tr></table>"
    other = "<table><tr><td>menu</td></tr><tr><td>000009</td></tr></table>"
    html = f"<TABLE><tr><td>{other}</td><td>text {data} text</td></tr><tr><td>000008</td><td>layout</td></tr></TABLE><script>var t = '<table><tr><td>代码</td></tr><tr><td>000007</td></tr></table>';</script>" + data.replace("up", "again")
    got = vendor.page_events(spark.createDataFrame([(1, html), (2, "<table><tr><td>代码</td>"), (3, data.replace("</table>", ""))], "p int, html string"), "p", "html").collect()
    assert {tuple(r) for r in got} == {(1, "000001", "again more|up more", 2), (1, "600002", "down", 2)}


def test_industry_files_that_are_not_there_or_not_tables(spark, tmp_path):
    (tmp_path / "good.csv").write_text("﻿证券代码,行业\nsh600001.x, Steel \n600002,\n600001,Metals\n")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bytes.csv").write_bytes(bytes(range(256)) * 4)
    read = lambda name: [tuple(r) for r in vendor.industry_file(spark, f"file://{tmp_path}/{name}.csv").collect()]
    assert read("good") == [("600001", "Metals")]
    assert read("missing") == read("other") == read("empty") == read("bytes") == []


def test_snapshots_of_other_days(spark):
    rows = [("2024-01-02", 1.0, "2024-01-02"), ("2024-01-02", None, "2024-01-02"), ("2024-01-03", None, "2024-01-03"), ("2024-01-04", 1.0, None), ("2024-01-05", 1.0, "2024-01-04"), ("2024-01-05", 1.0, "2024-01-05")]
    df = spark.createDataFrame([(dt.date.fromisoformat(a), b, c) for a, b, c in rows], "d date, v double, s string")
    assert {r["d"].day for r in sinks.stale_snapshots(df, "d", "v", "s").collect()} == {3, 4, 5}


def test_preferred_columns_come_first(spark):
    rows = spark.createDataFrame([(1, 2, 3, 4)], "extra int, score int, symbol int, ret_20 int")
    assert reports.in_preferred_order(rows).columns == ["symbol", "score", "ret_20", "extra"]
