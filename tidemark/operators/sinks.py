"""Writes: compressed tables, reports, ledgers, and evidence that is written once."""

from __future__ import annotations

import json
import uuid
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.publish import create_if_absent, publish, read_text

COVERAGE = 0.95


def unique_on(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with a check in the plan that each key stands once: it fails where the rows are read, and no job runs before."""
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    message = F.concat(F.lit("NotUnique: "), *[x for k in keys for x in (F.lit(f"{k} = "), F.coalesce(F.col(k).cast("string"), F.lit("null")), F.lit(" "))])
    checked = rows.withColumn("_once", F.when(n > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    return checked.where("_once").drop("_once")


def validated_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", one_to_one: bool = False) -> DataFrame:
    """A join whose right side, or both, must be unique on the keys."""
    return (unique_on(left, keys) if one_to_one else left).join(unique_on(right, keys), keys, how)


def write_table(rows: DataFrame, path: str, *partition: str) -> None:
    """A compressed table, in folders by the partition columns if there are any."""
    writer = rows.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def append_ledger(rows: DataFrame, path: str, batch: str | None = None) -> bool:
    """Append JSON lines to a ledger; False where the batch is in it already.

    A batch becomes a folder of the ledger in one step, under its name: readers
    see all of it or nothing, and one that is written again adds nothing. A
    batch without a name is always new.
    """
    return publish(rows, f"{path.rstrip('/')}/append-{batch or uuid.uuid4().hex}", "json")


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The ledger, or an empty typed table where there is none yet; ids that are missing follow from the row."""
    there = path_exists(spark, path)
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path) if there else spark.createDataFrame([], schema)
    return rows.withColumn("record_id", F.coalesce("record_id", fingerprint(*[c for c in rows.columns if c != "record_id"])))


def fingerprint(*columns: str) -> Column:
    """Sixteen digits of a hash over the named columns as text."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256), 1, 16)


def spec_hash(spec: dict) -> str:
    """The fingerprint of a screen without its date."""
    body = {k: v for k, v in spec.items() if k != "as_of"}
    return sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:16]


class NotFrozen(ValueError):
    """Evidence that may not be written: outside its window, or under rules that changed without a new version."""


def freeze(rows: DataFrame, root: str, name: str, protocol: dict | None = None, as_of: str | None = None, window: tuple[str, str] | None = None) -> str:
    """Write evidence once, under its name; a second write is an error.

    With a ``protocol`` its version is bound to the hash of its rules by the
    first write; other rules under the same version are refused. With a
    ``window`` the date must lie in it. Both the binding and the evidence get
    their names in one step of the file system, so that of two writers at the
    same time one wins and the other is refused.
    """
    if window and not window[0] <= as_of <= window[1]:
        raise NotFrozen(f"{as_of} is outside of {window[0]} to {window[1]}")
    spark = rows.sparkSession
    if protocol is not None:
        bound, digest = f"{root}/protocol-{protocol['version']}.json", spec_hash(protocol)
        if not create_if_absent(spark, bound, json.dumps({"digest": digest})):
            held = json.loads(read_text(spark, bound))["digest"]
            if held != digest:
                raise NotFrozen(f"version {protocol['version']} was {held} and is {digest}")
    path = f"{root}/{name}"
    if not publish(rows, path):
        raise NotFrozen(f"{name} exists")
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def first_complete(old: DataFrame, new: DataFrame, expected: int) -> DataFrame:
    """The earlier snapshot if it covers enough symbols, else the new one."""
    enough = old.agg(F.count_distinct("symbol") >= COVERAGE * expected).scalar()
    return old.where(enough).unionByName(new.where(~enough))


def stale_snapshots(rows: DataFrame, day: str, value: str, source_day: str) -> DataFrame:
    """``day, n_rows, n_values, source_day`` of the days whose snapshot was not taken on them.

    A real day has a value in some row, and the source names the day itself
    (as ISO text) in every row; an answer that fell back to another day does not.
    """
    by = rows.groupBy(day).agg(F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n_values"), F.min(source_day).alias(source_day))
    named = F.coalesce(F.col(source_day) == F.date_format(day, "yyyy-MM-dd"), F.lit(False))
    return by.where((F.col("n_values") == 0) | ~named)


def verified(documents: DataFrame, body: str, digest: str) -> DataFrame:
    """Documents whose body has the recorded hash."""
    return documents.where(F.sha2(F.col(body).cast("binary"), 256) == F.col(digest))
