"""Late rows by key: a row's own history decides, not the batch that it happens to come in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tidemark.session import ship_package
from tidemark.streaming.events import run_batches, written

#: Keyed state with a handle is kept by this store only.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LateRows(StatefulProcessor):
    """Flags rows that are older than the newest one of their key that came before, by more than a delay.

    The state is one number a key: its newest event time. Spark's event-time
    mode is not used, since it would drop late rows before they are seen.
    """

    def __init__(self, at: str, arrival: str, delay_us: int) -> None:
        self.at, self.arrival, self.delay_us = at, arrival, delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", StructType([StructField("us", LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: ARG002, N802, N803
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(self.arrival, kind="stable")
        us = pdf["event_us"].to_numpy(np.float64, na_value=np.nan)
        start = float(self.newest.get()[0]) if self.newest.exists() else -np.inf
        seen = np.fmax.accumulate(np.concatenate([[start], us]))
        pdf["is_late"] = us < seen[:-1] - self.delay_us
        if np.isfinite(seen[-1]):
            self.newest.update((int(seen[-1]),))
        yield pdf.drop(columns="event_us")

    def close(self) -> None:
        return


def flag_late(stream: DataFrame, key: str, at: str, arrival: str, delay_days: float) -> DataFrame:
    """The stream's rows with ``is_late``, judged key by key in the order of ``arrival``.

    A row is late if a row of its key with a lower arrival number, in this
    batch or any before, is newer by more than the delay. So the flags do not
    depend on how the rows are cut into batches, as long as the batches come in
    order of arrival. A row without a time is never late and sets no mark; a
    null key is a key. One batch's rows of a key meet in one task: the rate of
    the source (``maxFilesPerTrigger``) bounds them.
    """
    ship_package(stream.sparkSession)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    schema = StructType([*stream.schema.fields, StructField("is_late", BooleanType())])
    timed = stream.withColumn("event_us", F.unix_micros(F.col(at).cast("timestamp")))
    return timed.groupBy(key).transformWithStateInPandas(LateRows(at, arrival, int(delay_days * 86_400_000_000)), schema, "Append", "None")


def split_late_by_key(stream: DataFrame, key: str, at: str, arrival: str, delay_days: float, root: str) -> tuple[DataFrame, DataFrame]:
    """Rows in time and late rows of all batches so far; no row is lost, and a batch that runs again overwrites itself."""
    flagged = flag_late(stream, key, at, arrival, delay_days)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("is_late").parquet(f"{root}/out/batch={number}")

    run_batches(flagged, root, "append", each)
    spark: SparkSession = stream.sparkSession
    rows = written(spark, f"{root}/out", flagged.schema)
    return rows.where("not is_late").drop("is_late"), rows.where("is_late").drop("is_late")
