"""Vectors in blocks: how the exact and the approximate search deal out their work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of data, and of a block of queries. The data go to each query block once, so these are large.
DATA_ROWS = 4_096
QUERY_ROWS = 16_384


def clean_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", zero_ok: bool = True) -> DataFrame:
    """``vec_id, vec`` (array of double), one row per id.

    Rows with a null id, a null vector, or a null or non-finite component go;
    so do zero vectors unless ``zero_ok``. An id that stands in several rows
    keeps its least vector, so that results do not depend on row order.
    """
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite)
    if not zero_ok:
        rows = rows.where(F.exists("vec", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def numbered_blocks(rows: DataFrame, block_rows: int, cell: Column | None = None) -> tuple[DataFrame, int]:
    """``rows`` with columns ``block, cell, part``; blocks hold one dimension and about ``block_rows`` rows.

    A block is a part of a cell (by default of a dimension). The number of
    blocks is known from one count for each cell, and rows are dealt to the
    parts of their cell by a hash, so that a cell of any size is split.
    """
    rows = rows.withColumn("dim", F.size("vec")).withColumn("cell", F.lit(0) if cell is None else cell)
    per = rows.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    per = per.withColumn("first", F.coalesce(F.sum("parts").over(Window.orderBy("dim", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    total = per.agg(F.sum("parts")).first()[0] or 0
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    return rows.join(per, ["dim", "cell"]).withColumn("part", part).withColumn("block", F.col("first") + F.col("part")).drop("parts", "first"), total


def packed(rows: DataFrame, make: Callable[[np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """One row per block: ``make(ids, matrix)`` gives its columns, the others are those of its rows; ids are sorted.

    Blocks have a bounded number of rows, so a group is a bounded piece of work.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        made = make(pdf["vec_id"].to_numpy(np.int64), np.array(pdf["vec"].tolist(), np.float64).reshape(len(pdf), -1))
        return pd.DataFrame({n: [made[n] if n in made else int(pdf[n].iloc[0])] for n in names})

    return rows.groupBy("block").applyInPandas(work, schema)


def top_k(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best by score, ties to the smaller id, best first."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def best_of(found: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of each query's candidates."""
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def table_of(query_id: list, vec_id: list, score: list, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    if query_id:
        arrays = [pa.array(np.concatenate(x)) for x in (query_id, vec_id)] + [pa.array(np.concatenate(score)).cast(kind)]
        yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])
