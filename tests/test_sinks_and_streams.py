"""Writes that happen once, reports, guards, and streams that resume."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import iso_date
from tidemark.operators import reports, rolling, sinks
from tidemark.operators.asof import state_on
from tidemark.operators.keyed import WrongColumns, checked_upsert, replace_whole_days
from tidemark.operators.windows import choose_windows
from tidemark.sources import vendor
from tidemark.streaming import events


def test_frozen_evidence_is_written_once(spark, tmp_path):
    rows, root = spark.range(3), f"file://{tmp_path}/frozen"
    rules = {"version": "v2", "limit": 5}
    sinks.freeze(rows, root, "one", rules, "2024-01-05", ("2024-01-01", "2024-01-31"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.freeze(rows, root, "one", rules)
    with pytest.raises(sinks.NotFrozen, match="version v2"):
        sinks.freeze(rows, root, "two", rules | {"limit": 6})
    with pytest.raises(sinks.NotFrozen, match="outside"):
        sinks.freeze(rows, root, "three", rules, "2024-02-01", ("2024-01-01", "2024-01-31"))
    sinks.freeze(rows, root, "four", rules | {"as_of": "2024-01-06"})
    assert spark.read.parquet(f"{root}/four").count() == 3


def test_compressed_tables_and_ledgers(spark, tmp_path):
    rows, path = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string"), f"file://{tmp_path}/table"
    sinks.write_table(rows, path, "y")
    assert spark.read.parquet(path).count() == 2 and any(".zstd." in f.name for f in tmp_path.rglob("*.parquet"))
    ledger = f"file://{tmp_path}/ledger"
    assert sinks.read_ledger(spark, ledger, "record_id string, x int").count() == 0
    sinks.append_ledger(rows.select("x"), ledger)
    sinks.append_ledger(rows.select("x").withColumn("record_id", F.lit("own")), ledger)
    assert len({r["record_id"] for r in sinks.read_ledger(spark, ledger, "record_id string, x int").collect()}) == 3
    assert sinks.spec_hash({"a": 1, "as_of": "x"}) == sinks.spec_hash({"as_of": "y", "a": 1}) != sinks.spec_hash({"a": 2})


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"é{i}|", None if i == 3 else i / 2) for i in (3, 1, 2)], "n int, name string, x double")
    path = f"file://{tmp_path}/report"
    reports.write_csv(rows, path, ["n"])
    files = sorted((tmp_path / "report").glob("*.csv"))
    assert all(f.read_bytes().startswith(b"\xef\xbb\xbf") for f in files) and "\n".join(f.read_text() for f in files).count("é") == 3
    assert [r["n"] for f in files for r in reports.read_csv(spark, f"file://{f}", "n int, name string, x double").collect()] == [1, 2, 3]
    assert reports.ordered(["b", "a", "z"], ["z", "missing", "a"]) == ["z", "a", "b"]
    assert reports.markdown(rows, ["n"]).splitlines()[2:] == ["| 1 | é1\\| | 0.5 |", "| 2 | é2\\| | 1.0 |", "| 3 | é3\\| |  |"]


def test_guards(spark):
    old = spark.createDataFrame([(1, "a")], "k int, day string")
    with pytest.raises(WrongColumns, match="unknown"):
        checked_upsert(old, old.withColumn("more", F.lit(1)), ["k"], [F.asc("day")])
    assert replace_whole_days(old, old.withColumn("k", F.lit(9)), "day").collect()[0]["k"] == 1
    assert replace_whole_days(old, spark.range(20).select(F.col("id").cast("int").alias("k"), F.lit("a").alias("day")), "day").count() == 20
    twice = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="NotUnique"):
        sinks.validated_join(old, twice, ["k"]).collect()
    assert sinks.validated_join(old, twice.where("v = 2"), ["k"]).count() == 1
    for bad in ("2024-1-05", "2024-01-05' or 1=1", "2024-13-01", "x"):
        with pytest.raises(ValueError):
            iso_date(bad)


def test_windows_are_disjoint():
    days = [f"2024-{m:02d}-{d:02d}" for m in (1, 2, 3) for d in range(1, 29)]
    found = choose_windows(days, ("2024-01-01", "2024-01-10", "2024-02-20", "2024-03-20"), ("2024-02-25", "2024-02-26"), 10)
    held = [set(w["days"]) for w in found]
    assert len(found) == 3 and all(len(h) == 10 for h in held) and not any(a & b for i, a in enumerate(held) for b in held[:i])
    assert found[0]["before"] == "2024-01-01" and found[2]["days"][0] == "2024-02-27"


def test_states_hold_from_their_day(spark):
    rows = spark.createDataFrame([("a", d, d * 1.0) for d in (1, 2, 3, 4)] + [("b", 1, 9.0)], "s string, d int, x double")
    states = spark.createDataFrame([("a", 2, "in"), ("a", 4, "out")], "s string, since int, state string")
    got = sorted((r["s"], r["d"], r["x"], r["state"]) for r in state_on(rows, states, "s", "d", "since", "state").collect())
    assert got == [("a", 1, 1.0, None), ("a", 2, 2.0, "in"), ("a", 3, 3.0, "in"), ("a", 4, 4.0, "out"), ("b", 1, 9.0, None)]


def test_page_table_by_its_header(spark):
    html = "<table><TR><th>序</th><th>解读</th><th>代码</th></TR><!-- <tr><td>1</td><td>no</td><td>000009</td></tr> --><tr class='x'><td>1</td>\n<td><b>up</b> a</td><td> 000001 </td></tr><tr><td>2</td><td>down</td><td>000001</td></tr><tr><td>sum</td></tr></table>"
    got = vendor.page_events(spark.createDataFrame([(1, html), (2, ""), (3, None)], "p int, html string"), "p", "html").collect()
    assert [tuple(r) for r in got] == [(1, "000001", "down|up a", 2)]


def event_rows(spark, days):
    return spark.createDataFrame([(1000 * day + u, f"2024-01-{day:02d} 10:00:00", u, "view", float(day), "{}") for day in days for u in range(5)], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def source(spark, root):
    return spark.readStream.schema(events.SCHEMA).parquet(f"{root}/in/*").withColumn("ts", F.col("ts").cast("timestamp"))


def test_streams_go_on_from_their_checkpoint(spark, tmp_path):
    root = f"file://{tmp_path}/stream"
    for number, days in enumerate(((1, 2), (3,), (4, 5))):
        event_rows(spark, days).write.parquet(f"{root}/in/{number}")
        found = events.drain(source(spark, root), "append", root)
        assert found.count() == {0: 10, 1: 15, 2: 25}[number]
    assert events.drain(source(spark, root), "append", root).count() == 25  # nothing new, nothing twice
    assert len(list((tmp_path / "stream" / "out").glob("batch=*"))) == 3


def test_upserted_table_keeps_untouched_buckets(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    event_rows(spark, (1, 2)).write.parquet(f"{root}/in/0")
    run = lambda: events.latest_by_upsert(source(spark, root).select("user_id", "event_id", "value"), ["user_id"], "event_id", root)
    assert {r["user_id"]: r["value"] for r in run().collect()} == dict.fromkeys(range(5), 2.0)
    event_rows(spark, (7,)).where("user_id = 3").write.parquet(f"{root}/in/1")
    assert {r["user_id"]: r["value"] for r in run().collect()} == {**dict.fromkeys(range(5), 2.0), 3: 7.0}
    last = max((tmp_path / "table" / "table").glob("batch=*"))
    assert len(list(last.glob("bucket=*"))) == 1


def test_late_rows_are_kept_apart(spark, tmp_path):
    root = f"file://{tmp_path}/late"
    for number, days in enumerate(((10, 11), (5, 6, 7, 12))):
        event_rows(spark, days).write.parquet(f"{root}/in/{number}")
        in_time, late = events.split_late(source(spark, root), "ts", 5, root)
    assert in_time.count() == 25 and {r["value"] for r in late.collect()} == {5.0}


def test_rolling_sums_do_not_depend_on_the_chunks(spark, monkeypatch):
    """Features are the same whatever the chunk's length, and equal the definition on windows across chunk borders."""
    import numpy as np

    rng = np.random.default_rng(0)
    close = np.round(10 * np.exp(np.cumsum(rng.normal(0, 0.02, 700))), 4)
    rows = spark.createDataFrame([("a", i + 1, float(c * 0.99), float(c * 1.01), float(c * 0.98), float(c), int(1000 + 10 * (i % 7))) for i, c in enumerate(close)], "symbol string, n int, open double, high double, low double, close double, volume long")
    rows = rows.withColumn("trade_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("n")))
    take = lambda: rolling.features(rows, (rolling.stats, rolling.ols, rolling.extremes, rolling.ranks)).orderBy("trade_date").collect()
    whole = take()
    monkeypatch.setattr(rolling, "CHUNK", 100)
    cut = take()
    assert len(whole) == len(cut) == 700
    for a, b in zip(whole, cut, strict=True):
        assert all((x is None) == (y is None) and (x is None or isinstance(x, str) or x == pytest.approx(y, abs=1e-9)) for x, y in zip(a[2:], b[2:], strict=True))
    for t in (3, 99, 100, 256, 300, 699):
        w = close[max(0, t - 59) : t + 1]
        slope, level = np.polyfit(np.arange(len(w)), w, 1)
        assert whole[t]["MA60"] == pytest.approx(w.mean() / close[t]) and whole[t]["STD60"] == pytest.approx(w.std(ddof=1) / close[t])
        assert whole[t]["BETA60"] == pytest.approx(slope / close[t], abs=1e-9) and whole[t]["RESI60"] == pytest.approx((close[t] - level - slope * (len(w) - 1)) / close[t], abs=1e-9)
        assert whole[t]["IMAX60"] == pytest.approx((np.argmax(np.round(w * 1.01, 12)) + 1) / 60) and whole[t]["RANK60"] == pytest.approx(((w < close[t]).sum() + ((w == close[t]).sum() + 1) / 2) / len(w))
