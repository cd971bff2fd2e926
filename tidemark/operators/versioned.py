"""A keyed table in buckets whose versions are written by batch, purged by tombstones and compacted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.operators.keyed import insert_absent, latest_per_key
from tidemark.operators.sinks import path_exists
from tidemark.session import remove
from tidemark.sources.tables import dealt_by

#: Parts of a table; a batch rewrites those that its keys fall into.
BUCKETS = 16


@dataclass(frozen=True)
class VersionedTable:
    """A table with one row a key, in ``buckets`` by a hash of the key.

    A batch writes new versions of the buckets that it touches, under its
    number, and leaves the others; a bucket's newest version holds. A batch
    that runs again starts from the versions before it and writes the same
    ones. Before a batch writes, versions that no batch can need again are
    removed, so a bucket has two at most, however many batches there were.
    What the last batch was is seen from the folders, so a new driver goes on.
    """

    spark: SparkSession
    root: str
    schema: StructType
    keys: tuple[str, ...]
    buckets: int = BUCKETS

    def _stored(self, session: SparkSession) -> DataFrame:
        whole = StructType([*self.schema.fields, StructField("batch", LongType()), StructField("bucket", LongType())])
        if not path_exists(session, f"{self.root}/table"):
            return session.createDataFrame([], whole)
        return session.read.schema(whole).parquet(f"{self.root}/table")

    def versions(self) -> list[tuple[int, int]]:
        """(bucket, batch) of all versions there are, from the folders' names."""
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.root}/table/batch=*/bucket=*")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
        paths = [str(f.getPath().toString()).rstrip("/").split("/")[-2:] for f in found]
        return sorted((int(bucket.split("=")[1]), int(batch.split("=")[1])) for batch, bucket in paths)

    def _newest(self, before: int | None) -> dict[int, int]:
        """The newest version of each bucket among the batches before ``before``; versions are sorted, so the last one holds."""
        return {bucket: batch for bucket, batch in self.versions() if before is None or batch < before}

    def read(self, before: int | None = None, session: SparkSession | None = None) -> DataFrame:
        """The table as it is, or as the batches before number ``before`` left it, without what was purged since."""
        session, newest = session or self.spark, self._newest(before)
        rows = self._stored(session)
        held = F.lit(False)
        for batch in sorted(set(newest.values())):
            held = held | ((F.col("batch") == batch) & F.col("bucket").isin([k for k, b in newest.items() if b == batch]))
        return self._unpurged(rows.where(held), session, before)

    def _unpurged(self, rows: DataFrame, session: SparkSession, before: int | None) -> DataFrame:
        if not path_exists(session, f"{self.root}/tombstones"):
            return rows
        gone = session.read.parquet(f"{self.root}/tombstones")
        gone = gone if before is None else gone.where(F.col("batch") < before)
        column = gone.columns[0]
        last = gone.groupBy(F.col(column).alias("gone_value")).agg(F.max("batch").alias("gone_batch"))
        return rows.join(last, rows[column].eqNullSafe(F.col("gone_value")) & (rows["batch"] <= F.col("gone_batch")), "left_anti")

    def write(self, batch: DataFrame, number: int, order: list[Column], ignore: bool = False, like: DataFrame | None = None) -> None:
        """Merge a batch: of rows with one key, stored ones too, the first in ``order`` stays; with ``ignore`` a stored one does.

        With ``like``, rows about as many as the table's, the merge is dealt
        out by key to tasks in proportion to them.
        """
        session = batch.sparkSession
        self.compact(number)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets))
        new = batch.select(*self.schema.names).withColumn("bucket", bucket)
        dealt = lambda rows: rows if like is None else dealt_by(rows, *self.keys, like=like)
        if not self._newest(number):
            merged = latest_per_key(dealt(new), list(self.keys), order)
        else:
            old = self.read(number, session).join(new.select("bucket").distinct(), "bucket", "left_semi").select(*new.columns)
            merged = insert_absent(dealt(old), dealt(new), list(self.keys), order) if ignore else latest_per_key(dealt(old.unionByName(new)), list(self.keys), order)
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/table/batch={number}")

    def purge(self, values: DataFrame, number: int) -> None:
        """Purge all rows that have one of the values in the column that ``values`` has; a later batch may bring new ones.

        Only the values are written. Rows go where their bucket is next
        rewritten; until then they are left out when the table is read. Tables
        that hang on this one are purged with the same values (``cascade``).
        """
        values.select(values.columns[0]).distinct().write.mode("overwrite").parquet(f"{self.root}/tombstones/batch={number}")

    def compact(self, number: int) -> int:
        """Remove versions older than a bucket's newest one before batch ``number``; how many there were."""
        newest = self._newest(number)
        old = [(bucket, batch) for bucket, batch in self.versions() if batch < newest.get(bucket, batch)]
        for bucket, batch in old:
            remove(self.spark, f"{self.root}/table/batch={batch}/bucket={bucket}")
        left = {batch for _, batch in self.versions()}
        for batch in {batch for _, batch in old} - left:
            remove(self.spark, f"{self.root}/table/batch={batch}")
        return len(old)


def cascade(tables: list[VersionedTable], values: DataFrame, number: int) -> None:
    """Purge a table and those that hang on it; they have the column in common. Each purge can be repeated."""
    for table in tables:
        table.purge(values, number)
