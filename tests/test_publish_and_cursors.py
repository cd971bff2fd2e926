"""Writers that race, batches that come again, tables that stay small, pages that are not opened, cursors that go on."""

from __future__ import annotations

import datetime as dt
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidemark.operators import publish, sinks
from tidemark.operators.versioned import VersionedTable, cascade
from tidemark.sources import paged
from tidemark.streaming import events
from tidemark.streaming.late import split_late_by_key


def raced(n, work):
    with ThreadPoolExecutor(n) as pool:
        return list(pool.map(work, range(n)))


def test_of_racing_writers_one_wins(spark, tmp_path):
    root = f"file://{tmp_path}"
    for turn in range(5):
        won = raced(8, lambda k: publish.create_if_absent(spark, f"{root}/{turn}/claim.json", f'{{"writer": {k}}}'))  # noqa: B023
        assert sum(won) == 1 and json.loads(publish.read_text(spark, f"{root}/{turn}/claim.json")) == {"writer": won.index(True)}
        assert not [f for f in (tmp_path / str(turn)).iterdir() if f.name.startswith("_")]
    won = raced(4, lambda k: publish.publish(spark.range(k + 1).select(F.lit(k).alias("writer")), f"{root}/table"))
    assert sum(won) == 1 and {r["writer"] for r in spark.read.parquet(f"{root}/table").collect()} == {won.index(True)}
    assert spark.read.parquet(f"{root}/table").count() == won.index(True) + 1 and len([f for f in tmp_path.iterdir() if "table" in f.name]) == 1


def test_of_racing_protocols_one_is_bound(spark, tmp_path):
    def bind(k):
        try:
            return sinks.freeze(spark.range(1), f"file://{tmp_path}/frozen", f"run-{k}", {"version": "v1", "limit": k})
        except sinks.NotFrozen as wrong:
            return str(wrong)

    said = raced(4, bind)
    assert sum(x.startswith("file:") for x in said) == 1 and sum("version v1 was" in x for x in said) == 3
    assert len(list((tmp_path / "frozen").glob("run-*"))) == 1


def test_a_retried_append_adds_nothing(spark, tmp_path):
    path, rows = f"file://{tmp_path}/ledger", spark.createDataFrame([(1,), (2,)], "x int")
    assert [sinks.append_ledger(rows, path, "b1"), sinks.append_ledger(rows, path, "b1"), sinks.append_ledger(rows, path, "b2"), sinks.append_ledger(rows, path)] == [True, False, True, True]
    assert sinks.read_ledger(spark, path, "record_id string, x int").count() == 6
    (tmp_path / "ledger" / "_append-dead").mkdir()  # what a writer that died has left
    (tmp_path / "ledger" / "_append-dead" / "part-0.json").write_text('{"x": 9}\n')
    assert sinks.read_ledger(spark, path, "record_id string, x int").where("x = 9").count() == 0


def test_json_is_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/state.json"
    for value in ({"a": 1}, {"a": [2, "é"]}):
        publish.replace_json(spark, path, value)
        assert json.loads(publish.read_text(spark, path)) == value
    assert [f.name for f in tmp_path.iterdir() if not f.name.startswith(".")] == ["state.json"]


TABLE = "k long, day string, v long"


def test_versions_stay_bounded_over_many_batches(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", spark.createDataFrame([], TABLE).schema, ("k",), 4)
    for number in range(50):
        table.write(spark.createDataFrame([(number % 7, "d", number)], TABLE), number, [F.desc("v")])
        per = {b: [v for x, v in table.versions() if x == b] for b, _ in table.versions()}
        assert max(map(len, per.values())) <= 2
    assert {r["k"]: r["v"] for r in table.read().collect()} == {n % 7: n for n in range(43, 50)}
    before = table.read(49).collect()
    table.write(spark.createDataFrame([(0, "d", 49)], TABLE), 49, [F.desc("v")])  # the last batch again
    assert sorted(table.read(49).collect()) == sorted(before) and table.read().count() == 7
    assert len(list((tmp_path / "t" / "table").glob("batch=*"))) <= 8


def test_purge_cascades_and_later_rows_come_back(spark, tmp_path):
    main = VersionedTable(spark, f"file://{tmp_path}/main", spark.createDataFrame([], TABLE).schema, ("k", "day"), 2)
    tags = VersionedTable(spark, f"file://{tmp_path}/tags", spark.createDataFrame([], "day string, tag string, n long").schema, ("day", "tag"), 2)
    main.write(spark.createDataFrame([(k, f"d{k % 3}", k) for k in range(9)] + [(9, None, 9)], TABLE), 0, [F.desc("v")])
    tags.write(spark.createDataFrame([(f"d{k}", t, 1) for k in range(3) for t in "xy"], "day string, tag string, n long"), 0, [F.desc("n")])
    gone = spark.createDataFrame([("d1",), (None,)], "day string")
    for _ in range(2):
        cascade([main, tags], gone, 1)
        assert {r["day"] for r in main.read().collect()} == {"d0", "d2"} == {r["day"] for r in tags.read().collect()}
    assert main.read(1).count() == 10  # as it was before the purge
    main.write(spark.createDataFrame([(1, "d1", 100)], TABLE), 2, [F.desc("v")])
    assert {r["k"]: r["v"] for r in main.read().where("day = 'd1'").collect()} == {1: 100}
    main.write(spark.createDataFrame([(50 + k, "d0", 1) for k in range(8)], TABLE), 3, [F.desc("v")])
    assert main.read().where("day = 'd1'").count() == 1 and main.read().count() == 6 + 1 + 8
    ignored = VersionedTable(spark, f"file://{tmp_path}/first", main.schema, ("k",), 2)
    for number, v in enumerate((5, 6)):
        ignored.write(spark.createDataFrame([(1, "d", v), (number, "d", v + 10)], TABLE), number, [F.asc("v")], ignore=True)
    assert {r["k"]: r["v"] for r in ignored.read().collect()} == {0: 15, 1: 5}


def arrivals():
    """(arrival, key, day) with rows out of order within keys and over any cut."""
    days = [10, 11, 3, 12, 6, 20, 13, 14, 2, 21, 15, 16, 1, 30, 24, 25]
    return [(n, "ab"[n % 2], dt.datetime(2024, 1, d, 9)) for n, d in enumerate(days)] + [(16, None, dt.datetime(2024, 1, 9)), (17, None, dt.datetime(2024, 1, 2)), (18, "a", None), (19, "a", dt.datetime(2024, 1, 3))]


def late_brute(rows, delay):
    newest, late = {}, set()
    for n, key, ts in sorted(rows):
        if ts is not None:
            if key in newest and ts < newest[key] - dt.timedelta(days=delay):
                late.add(n)
            newest[key] = max(newest.get(key, ts), ts)
    return late


@pytest.mark.parametrize("cuts", [(20,), (3, 4, 11, 20), (10, 20)])
def test_late_rows_do_not_depend_on_the_batches(spark, tmp_path, cuts):
    root, rows, done = f"file://{tmp_path}", arrivals(), 0
    for end in cuts:  # each cut is a run of its own, so that every one but the first resumes
        spark.createDataFrame(rows[done:end], "n long, key string, ts timestamp").coalesce(1).write.parquet(f"{root}/in/{end}")
        stream = spark.readStream.schema("n long, key string, ts timestamp").parquet(f"{root}/in/*")
        in_time, late = split_late_by_key(stream, "key", "ts", "n", 5, root)
        done = end
    assert {r["n"] for r in late.collect()} == late_brute(rows, 5) and len(late_brute(rows, 5)) >= 5
    assert {r["n"] for r in in_time.collect()} == set(range(20)) - late_brute(rows, 5)


def write_pages(root, exchange, days, size=3, start=1):
    folder = root / f"exchange={exchange}"
    folder.mkdir(parents=True, exist_ok=True)
    for page in range(0, len(days), size):
        rows = [{"id": f"{exchange}-{d}", "day": d, "title": f"title {d}"} for d in days[page : page + size]]
        (folder / f"page-{start + page // size}.json").write_text(json.dumps({"data": rows}))
    return folder


def days_back(last, n):
    return [(dt.date.fromisoformat(last) - dt.timedelta(days=k)).isoformat() for k in range(n)]


def test_pages_that_are_too_old_are_not_opened(spark, tmp_path):
    paged.register(spark)
    a = write_pages(tmp_path / "p", "SSE", days_back("2024-03-30", 60))
    write_pages(tmp_path / "p", "SZSE", days_back("2024-03-20", 4))
    (a / "page-2.json").write_bytes((a / "page-2.json").read_text().replace("title 2024", "标题 2024").encode("gbk"))
    read = lambda: spark.read.format("paged_announcements").load(f"file://{tmp_path}/p")
    assert read().count() == 64
    for page in range(13, 21):
        if page != 15:  # the search for the last page halves, so it may look at one of these
            (a / f"page-{page}.json").write_text("not to be opened")
    (a / "page-10.json").write_text(json.dumps({"data": [{"id": "x", "day": "2024-03-03", "title": None}]}))
    wanted = read().where("exchange = 'SSE' and day >= date '2024-03-18'")
    got = wanted.collect()
    assert {r["day"].isoformat() for r in got} == set(days_back("2024-03-30", 13)) and {r["page"] for r in got} == {1, 2, 3, 4, 5}
    assert wanted.where("title like '标题%'").count() == 3
    assert wanted.rdd.getNumPartitions() == 5  # one task a page, and none for the others
    assert {r["exchange"] for r in spark.read.format("paged_announcements").option("since", "2024-03-19").load(f"file://{tmp_path}/p").collect()} == {"SSE", "SZSE"}
    with pytest.raises(Exception, match="(?i)json|expecting"):
        read().count()
    assert spark.read.format("paged_announcements").load(f"file://{tmp_path}/nothing").count() == 0


def test_cursors_go_on_and_read_the_overlap_only(spark, tmp_path):
    paged.register(spark)
    root, pages = f"file://{tmp_path}/out", tmp_path / "p"
    write_pages(pages, "SSE", days_back("2024-03-10", 30))
    write_pages(pages, "SZSE", days_back("2024-03-05", 9))
    fetched = []

    def run():
        stream = spark.readStream.format("paged_announcements").load(f"file://{pages}")
        table = VersionedTable(spark, root, stream.schema, ("exchange", "announcement_id"), 2)

        def each(batch, number):
            fetched.append({(r["exchange"], r["day"].isoformat()) for r in batch.collect()})
            table.write(batch, number, [F.asc("page")], ignore=True)

        events.run_batches(stream, root, "append", each)
        return table.read()

    assert run().count() == 39 and len(fetched) == 1
    write_pages(pages, "SSE", days_back("2024-03-12", 32))
    got = run()
    assert got.count() == 41 and len(fetched) == 2
    # From five days before the exchange's own cursor on; the exchange without news is not read.
    assert fetched[1] == {("SSE", d) for d in days_back("2024-03-12", 8)}
    assert got.where("exchange = 'SSE' and day = date '2024-03-10'").first()["page"] == 1
    assert run().count() == 41 and len(fetched) == 2
