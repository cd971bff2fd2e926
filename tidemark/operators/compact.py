"""Rows of many features in small: what a lasso needs of them as sums, what trees need of them as bins.

A lasso depends on its rows by their number, means and second moments only.
Trees depend on a feature by the bins between their candidate thresholds only.
So neither needs the features themselves on disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.fits import TooFewRows
from tidemark.session import ship_package

#: Bins of a feature, as many as the trees have by default, and the bits of one; bins that share a long.
BINS, BITS, SHARED = 32, 5, 12
#: Rows, by expectation and at most, from which thresholds are taken; a learner by itself draws 10,000 for that.
PICKED = 40_000


def matrix(features: pa.Array) -> np.ndarray:
    """A row of numbers for each list. A feature without a value, as where a window does not vary, is zero: no signal."""
    x = features.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(features), -1)
    x[np.isnan(x)] = 0.0
    return x


def thresholds(x: np.ndarray) -> list[list[float]]:
    """Upper ends of each column's bins but the last: quantiles, or all values where there are few."""
    found = []
    for column in x.T:
        seen = np.unique(column)
        found.append((seen[:-1] if len(seen) <= BINS else np.unique(np.quantile(column, np.arange(1, BINS) / BINS, method="lower"))).tolist())
    return found


def summed(rows: DataFrame, folds: dict[str, str], most: int) -> tuple[dict[str, np.ndarray], dict[str, list[list[float]]]]:
    """For each fold, over the rows whose label ends before its first day: sums of products, and the thresholds of each feature.

    ``rows`` has ``key, label_end, label, features``, in which ``key`` is a
    hash; ``most`` is a number of rows that they do not exceed. A task sums its
    rows, so what is sent on is one matrix of a task and fold. Products are
    those of one, the features and the label, in this order.
    """
    ship_package(rows.sparkSession)
    share = min(1.0, PICKED / max(most, 1))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            x, ends = matrix(batch.column("features")), batch.column("label_end").to_numpy(zero_copy_only=False).astype("datetime64[D]")
            z = np.column_stack([np.ones(len(x)), x, batch.column("label").to_numpy()])
            drawn = batch.column("key").to_numpy() < share * 2**31
            for fold, first in folds.items():
                train = ends < np.datetime64(first)
                sums[fold] = sums.get(fold, 0.0) + z[train].T @ z[train]
                if len(picked := x[train & drawn]):
                    yield listed(fold, -1, picked)
        for fold, found in sums.items():
            yield listed(fold, 0, found)

    def listed(fold: str, kind: int, values: np.ndarray) -> pa.RecordBatch:
        n = len(values)
        return pa.RecordBatch.from_pydict({"fold": [fold] * n, "at": [kind] * n if kind < 0 else list(range(n)), "x": list(values)}, schema=pa.schema([("fold", pa.string()), ("at", pa.int32()), ("x", pa.list_(pa.float64()))]))

    def whole(table: pa.Table) -> pa.Table:
        x = matrix(table.column("x").combine_chunks())
        if (at := table.column("at")[0].as_py()) >= 0:
            return pa.table({"fold": table.column("fold")[:1], "at": pa.array([at], pa.int32()), "x": pa.array([x.sum(axis=0).tolist()], pa.list_(pa.float64()))})
        cuts = thresholds(x)
        return pa.table({"fold": pa.array([table.column("fold")[0].as_py()] * len(cuts)), "at": pa.array([-1 - i for i in range(len(cuts))], pa.int32()), "x": pa.array(cuts, pa.list_(pa.float64()))})

    schema = "fold string, at int, x array<double>"
    found = rows.mapInArrow(parts, schema).groupBy("fold", "at").applyInArrow(whole, schema).collect()
    sums = {f: np.array([r["x"] for r in sorted((r for r in found if r["fold"] == f and r["at"] >= 0), key=lambda r: r["at"])]) for f in folds}
    if short := [f for f, s in sums.items() if not s.size or not s[0, 0]]:
        raise TooFewRows(f"no rows to train on: {short}")
    return sums, {f: [r["x"] for r in sorted((r for r in found if r["fold"] == f and r["at"] < 0), key=lambda r: -r["at"])] for f in folds}


def points(spark: SparkSession, sums: np.ndarray) -> DataFrame:
    """A few weighted rows ``features, label, weight`` with the number, means and second moments of those that were summed.

    They stand in pairs around the means, along the columns of a root of the
    covariances. What does not vary, but for rounding, does not vary in them.
    """
    n = sums[0, 0]
    means, square = sums[0, 1:] / n, sums[1:, 1:] / n
    spread = square - np.outer(means, means)
    flat = np.diag(spread) <= 1e-13 * np.diag(square)
    spread[flat], spread[:, flat] = 0.0, 0.0
    values, vectors = np.linalg.eigh(spread)
    root = vectors * np.sqrt(np.maximum(values, 0.0) * len(values))
    root[flat] = 0.0
    rows = [means + sign * column for column in root.T for sign in (1.0, -1.0)]
    return spark.createDataFrame([(Vectors.dense(r[:-1]), float(r[-1]), float(n / len(rows))) for r in rows], ["features", "label", "weight"])


def narrowed(rows: DataFrame, linear: dict[str, np.ndarray], cuts: dict[str, list[list[float]]]) -> DataFrame:
    """``rows`` with, in place of their features, the value of each linear model and for each fold the bins of all features, several in one long."""
    ship_package(rows.sparkSession)
    others = [c for c in rows.columns if c != "features"]
    ends = {fold: [np.array(c) for c in found] for fold, found in cuts.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column("features"))
            made = {c: batch.column(c) for c in others} | {f"linear_{fold}": x @ c for fold, c in linear.items()}
            for fold, found in ends.items():
                for at in range(0, len(found), SHARED):
                    packed = np.zeros(len(x), np.int64)
                    for i, c in enumerate(found[at : at + SHARED]):
                        packed |= np.searchsorted(c, x[:, at + i], side="left").astype(np.int64) << (BITS * i)
                    made[f"bins_{fold}_{at // SHARED}"] = packed
            yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in made.items()})

    kinds = dict(rows.dtypes)
    schema = [*(f"{c} {kinds[c]}" for c in others), *(f"linear_{f} double" for f in linear)]
    schema += [f"bins_{f}_{at} long" for f, found in cuts.items() for at in range(-(-len(found) // SHARED))]
    return rows.mapInArrow(work, ", ".join(schema))


def bins(fold: str, count: int) -> Column:
    """The bins of ``count`` features as a vector."""
    one = lambda i: F.shiftright(F.col(f"bins_{fold}_{i // SHARED}"), BITS * (i % SHARED)).bitwiseAND(F.lit(2**BITS - 1)).cast("double")
    return array_to_vector(F.array(*map(one, range(count))))
