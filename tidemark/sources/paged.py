"""Sources that give their rows page by page: a batch reader that stops early, and a stream with a cursor for each key."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator, Sequence

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

from tidemark.session import ship_package

#: Days before its cursor that a stream reads again.
OVERLAP_DAYS = 5
SCHEMA = "exchange string, page int, day date, announcement_id string, title string"


def register(spark: SparkSession) -> None:
    """Make the formats ``paged_announcements`` and its stream known; filters reach the reader."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedAnnouncements)


def write_pages(rows: DataFrame, root: str) -> None:
    """Rows (``exchange, page, day, id, title``) as the folder that the readers expect; a page's rows become one document."""
    fields = F.struct(F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("id").cast("string").alias("id"), "title")
    pages = rows.groupBy("exchange", "page").agg(F.sort_array(F.collect_list(fields), asc=False).alias("data"))
    pages.select("exchange", "page", F.to_json(F.struct("data")).alias("value")).repartition("exchange", "page").write.mode("overwrite").partitionBy("exchange", "page").text(root)


class Page(InputPartition):
    """One page that one task reads; ``first`` and ``last`` bound the days of its rows."""

    def __init__(self, exchange: str, number: int, path: str | None, first: str | None, last: str | None) -> None:
        self.exchange, self.number, self.path, self.first, self.last = exchange, number, path, first, last


#: What a plan without pages has, since a plan needs a partition.
NOTHING = Page("", 0, None, None, None)


class Folder:
    """Pages of JSON by exchange, newest rows on page 1, in any file system that Arrow opens.

    A page is ``exchange=<name>/page-<number>.json``, or the one file of the
    folder ``exchange=<name>/page=<number>``.
    """

    def __init__(self, root: str) -> None:
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(root)

    def pages(self) -> dict[str, dict[int, str]]:
        """The path of each page of each exchange; file names alone are read."""
        found: dict[str, dict[int, str]] = {}
        for info in self.fs.get_file_info(pyarrow.fs.FileSelector(self.path, recursive=True, allow_not_found=True)):
            if m := re.search(r"exchange=([^/]+)/page(?:-(\d+)\.json|=(\d+)/part-[^/]*)$", info.path):
                found.setdefault(m[1], {})[int(m[2] or m[3])] = info.path
        return found

    def rows(self, path: str) -> list[dict]:
        """A page's rows; its text is UTF-8 or, failing that, GBK."""
        with self.fs.open_input_stream(path) as source:
            raw = source.read()
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = raw.decode("gbk")
        return [r for r in json.loads(text)["data"] if isinstance(r, dict)]

    def span(self, path: str) -> tuple[str, str]:
        """The oldest and the newest day of a page; a page without days is newer than all."""
        days = [r["day"] for r in self.rows(path) if r.get("day")]
        return (min(days), max(days)) if days else ("9999-12-31", "9999-12-31")

    def plan(self, exchange: str, pages: dict[int, str], first: str | None, last: str | None = None) -> list[Page]:
        """The pages that may have rows from ``first`` on: days fall from page to page, so halving finds the last one."""
        numbers = sorted(pages)
        low, high = 0, len(numbers) - 1
        while first and low < high:
            middle = (low + high) // 2
            if self.span(pages[numbers[middle]])[0] < first:
                high = middle
            else:
                low = middle + 1
        return [Page(exchange, n, pages[n], first, last) for n in numbers[: low + 1 if first else None]]

    def read(self, page: Page) -> Iterator[tuple]:
        for row in self.rows(page.path) if page.path else []:
            day = row.get("day")
            if (page.first is None or day and day >= page.first) and (page.last is None or day and day <= page.last):
                yield (page.exchange, page.number, dt.date.fromisoformat(day) if day else None, row.get("id"), row.get("title"))


class PagedAnnouncements(DataSource):
    """``spark.read.format("paged_announcements").load(root)``; option ``since`` or a filter on ``day`` stops the paging early.

    As a stream (``spark.readStream``) each exchange has a cursor of its own,
    the newest day it has given; what comes next begins ``overlapDays`` before
    it, so a consumer ignores the keys it has.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_announcements"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:  # noqa: ARG002
        return PageReader(self.options["path"], self.options.get("since"))

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: ARG002, N802
        return CursorReader(self.options["path"], int(self.options.get("overlapdays", OVERLAP_DAYS)))


class PageReader(DataSourceReader):
    """One task a page; pages after the first whose oldest row is too old are not opened by any task."""

    def __init__(self, root: str, since: str | None) -> None:
        self.root, self.since, self.exchanges = root, since, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Lower bounds on the day and equality of the exchange plan the pages; Spark applies all filters to the rows again."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("day",):
                day = f.value.isoformat() if isinstance(f.value, dt.date) else str(f.value)
                self.since = max(self.since or day, day)
            if isinstance(f, EqualTo) and f.attribute == ("exchange",):
                self.exchanges = {f.value} if self.exchanges is None else self.exchanges & {f.value}
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        folder = Folder(self.root)
        found = {x: p for x, p in sorted(folder.pages().items()) if self.exchanges is None or x in self.exchanges}
        return [page for x, p in found.items() for page in folder.plan(x, p, self.since)] or [NOTHING]

    def read(self, partition: Page) -> Iterator[tuple]:
        return Folder(self.root).read(partition)


class CursorReader(DataSourceStreamReader):
    """A stream whose offset is the newest day of each exchange."""

    def __init__(self, root: str, overlap_days: int) -> None:
        self.root, self.overlap = root, dt.timedelta(days=overlap_days)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        folder = Folder(self.root)
        return {x: folder.span(p[min(p)])[1] for x, p in sorted(folder.pages().items())}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        folder, parts = Folder(self.root), []
        pages = folder.pages()
        for exchange, last in end.items():
            before = start.get(exchange)
            if before != last:  # else nothing is new there
                first = (dt.date.fromisoformat(before) - self.overlap).isoformat() if before else None
                parts += folder.plan(exchange, pages[exchange], first, last)
        return parts or [NOTHING]

    def read(self, partition: Page) -> Iterator[tuple]:
        return Folder(self.root).read(partition)

    def commit(self, end: dict) -> None:
        return
