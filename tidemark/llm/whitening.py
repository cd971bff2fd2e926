"""Embedding whitening by a tall-skinny QR: exact sums, R factors merged in a tree, SVD of the last R."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import arrow_map, in_slices, materialise
from tidemark.session import ship_package

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: Factors that one task merges into one.
FAN_IN = 16
#: Rows that a task holds above its factor.
STACK_ROWS = 2_048
#: Whole numbers below this are summed in 64 bits, slice by slice.
SMALL = 2**40


def finite_rows(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1) -> DataFrame:
    """``vec_id, vec, dim`` without vectors that are null, empty or hold an entry that is null or not finite once scaled; rows are not merged by id."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < F.lit(float("inf"))))
    return rows.where(F.col("vec").isNotNull() & finite & (F.size("vec") > 0)).withColumn("dim", F.size("vec"))


def by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, positions and matrix of the batch's vectors of each length."""
    column = batch.column(at)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for dim in np.unique(lengths):
        here = np.flatnonzero(lengths == dim)
        yield int(dim), here, flat[starts[here][:, None] + np.arange(dim)]


def whole(c: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """floor(scale * c) + shift as whole numbers of any length: 64 bits while they are small, else Python's own."""
    floors = np.floor(scale * c)
    if np.abs(floors).max(initial=0) < SMALL:
        return floors.astype(np.int64) + shift
    return np.array([[int(v) + shift for v in row] for row in floors.tolist()], dtype=object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: with S = n * q + r it is n * (x - q) - r, which stays in 64 bits for any usual n."""
    low = [divmod(s, n) for s in sums]
    if x.dtype != object and all(abs(q) < SMALL for q, _ in low):
        step = x - np.array([q for q, _ in low], np.int64)
        if n * (int(np.abs(step).max(initial=0)) + 1) < 2**62:
            return step * n - np.array([r for _, r in low], np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def deviations(y: np.ndarray) -> list[int | None]:
    """Sum of the squares of each row, exact; None where it needs more than 64 bits."""
    if y.dtype != object and (y.astype(np.float64) ** 2).sum(1).max(initial=0) < 2.0**62:
        return (y * y).sum(1).tolist()
    fits = (np.abs(y) < 2**32).all(1)
    sums = [sum(int(v) ** 2 for v in row) if short else 2**64 for short, row in zip(fits.tolist(), y.tolist(), strict=True)]
    return [s if s < 2**63 else None for s in sums]


def tree_merge(parts: DataFrame, key: str, value: str, merge: Callable[[list[bytes]], bytes], fan_in: int = FAN_IN) -> DataFrame:
    """One row for each ``key``: its parts merged ``fan_in`` at a time, in as many rounds as their number needs.

    A round is one shuffle of parts, never of rows, and its result is written,
    so that a lost executor costs at most one round.
    """
    ship_package(parts.sparkSession)
    kind = dict(parts.dtypes)[key]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [pdf[key].iloc[0]], "slot": [int(pdf["slot"].iloc[0]) // fan_in], value: [merge(list(pdf.sort_values("slot")[value]))]})

    most = parts.groupBy(key).agg(F.max("slot").alias("m")).agg(F.max("m")).first()[0] or 0
    while True:
        parts = parts.groupBy(key, F.floor(F.col("slot") / fan_in).alias("block")).applyInPandas(work, f"{key} {kind}, slot long, {value} binary")
        most //= fan_in
        if not most:
            return parts.select(key, value)
        parts = materialise(parts, "merged")


def _slots(parts: DataFrame) -> DataFrame:
    """The parts of each dimension, numbered by the task that made them."""
    return parts.select("dim", F.col("task").cast("long").alias("slot"), "part")


def _to_ints(part: bytes) -> list[int]:
    return [int(v) for v in part.decode().split()]


def _add(parts: list[bytes]) -> bytes:
    return " ".join(str(sum(v)) for v in zip(*map(_to_ints, parts), strict=True)).encode()


def exact_sums(rows: DataFrame, scale: int, shift: int) -> DataFrame:
    """``dim, sums``: the number of rows and each dimension's sum, as decimal text; whole numbers of any length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for batch in in_slices(batches, STACK_ROWS):
            for dim, here, c in by_length(batch, batch.schema.get_field_index("vec")):
                new = [len(here), *(int(v) for v in whole(c, scale, shift).sum(0))]
                sums[dim] = [a + b for a, b in zip(sums[dim], new, strict=True)] if dim in sums else new
        yield from _parts({d: " ".join(map(str, s)).encode() for d, s in sums.items()})

    return tree_merge(_slots(materialise(arrow_map(rows.select("vec"), work, "dim int, task int, part binary"), "sums")), "dim", "part", _add).withColumnRenamed("part", "sums")


def _parts(made: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([task] * len(made), pa.int32()), pa.array(list(made.values()), pa.binary())], names=["dim", "task", "part"])


def _factor(stack: np.ndarray) -> np.ndarray:
    """R of a QR factorisation; as many rows as columns at most."""
    return np.linalg.qr(stack, mode="r")


def _merge_factors(parts: list[bytes]) -> bytes:
    """A part is its number of columns, then its rows."""
    dim = int(np.frombuffer(parts[0][:8], np.int64)[0])
    stack = np.vstack([np.frombuffer(p[8:]).reshape(-1, dim) for p in parts])
    return parts[0][:8] + _factor(stack).tobytes()


def factors(rows: DataFrame, sums: dict[int, list[int]], scale: int, shift: int) -> DataFrame:
    """``dim, r``: the R factor of all centred rows.

    A task stacks centred rows under its factor and factors the stack anew,
    so it holds a bounded number of rows whatever it reads.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in in_slices(batches, STACK_ROWS):
            for dim, _, c in by_length(batch, 0):
                n, *total = sums[dim]
                x = (centred(whole(c, scale, shift), n, total) / n).astype(np.float64)
                held[dim] = _factor(np.vstack([held[dim], x]) if dim in held else x)
        yield from _parts({d: np.int64(d).tobytes() + r.tobytes() for d, r in held.items()})

    made = arrow_map(rows.select("vec"), work, "dim int, task int, part binary")
    return tree_merge(_slots(materialise(made, "factors")), "dim", "part", _merge_factors).withColumnRenamed("part", "r")


def _axes(r: bytes, n: int, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions as columns, standard deviations along them, and their shares of the trace.

    With X = QR and R = U D V', the covariance X'X / n is V D^2 V' / n. A
    direction's largest entry is positive, so that its sign does not depend
    on how the tree was built. A deviation below the rounding of the largest
    counts as 0.
    """
    dim = int(np.frombuffer(r[:8], np.int64)[0])
    k, upper = min(components, dim), np.frombuffer(r[8:]).reshape(-1, dim)
    if not np.isfinite(upper).all():
        return np.zeros((dim, k)), np.zeros(k), np.full(k, np.nan)
    _, d, vt = np.linalg.svd(upper, full_matrices=True)
    d = np.concatenate([d, np.zeros(dim - len(d))])
    d[d <= d[0] * max(dim, n**0.5) * np.finfo(float).eps] = 0
    vt = vt[:k] * np.sign(vt[np.arange(k), np.abs(vt[:k]).argmax(1)])[:, None]
    squares = (d / d[0]) ** 2 if d[0] else np.full(dim, np.nan)
    return vt.T, d[:k] / math.sqrt(n), (squares / squares.sum())[:k]


def fit(rows: DataFrame, scale: int = SCALE, shift: int = SHIFT, components: int = COMPONENTS) -> dict[int, tuple]:
    """For each length of vectors: counts and sums, directions, deviations and shares of the trace.

    The sums and the directions of the first components are what the driver
    gets: for each length as many numbers as ``components`` + 1 vectors have.
    """
    sums = {row.dim: _to_ints(row.sums) for row in exact_sums(rows, scale, shift).collect()}

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v, d, share = _axes(pdf["r"].iloc[0], sums[int(pdf["dim"].iloc[0])][0], components)
        return pd.DataFrame({"dim": pdf["dim"], "axes": [np.concatenate([d, share, v.ravel()]).tobytes()]})

    model = {}
    for row in factors(rows, sums, scale, shift).groupBy("dim").applyInPandas(work, "dim int, axes binary").collect():
        axes, k = np.frombuffer(bytes(row.axes)), min(components, row.dim)
        model[row.dim] = (sums[row.dim], axes[2 * k :].reshape(row.dim, k), axes[:k], axes[k : 2 * k])
    return model


def project(rows: DataFrame, model: dict[int, tuple], scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, dim, n, deviation, whitened, explained``; ``whitened`` is null in a component without variance."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, STACK_ROWS):
            for dim, here, c in by_length(batch, 1):
                (n, *sums), v, d, share = model[dim]
                y = centred(whole(c, scale, shift), n, sums)
                with np.errstate(divide="ignore", invalid="ignore"):
                    white = np.where(d > 0, (y / n).astype(np.float64) @ v / d, np.nan)
                ends = pa.array(np.arange(len(here) + 1) * len(d), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel(), mask=np.isnan(x.ravel()))) for x in (white, np.tile(share, (len(here), 1)))]
                numbers = [pa.array([dim] * len(here), pa.int32()), pa.array([n] * len(here), pa.int64()), pa.array(deviations(y), pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(here)), *numbers, *lists], names=["vec_id", "dim", "n", "deviation", "whitened", "explained"])

    return arrow_map(rows.select("vec_id", "vec"), work, "vec_id long, dim int, n long, deviation long, whitened array<double>, explained array<double>")


def _moments(n: int, mean: np.ndarray, m2: np.ndarray) -> bytes:
    return np.concatenate([[len(mean), n], mean, m2.ravel()]).tobytes()


def _merge_moments(parts: list[bytes]) -> bytes:
    """Counts, means and centred products of disjoint parts, joined pair by pair."""
    n, mean, m2 = 0, 0.0, 0.0
    for part in parts:
        a = np.frombuffer(part)
        k, m = int(a[0]), int(a[1])
        other, products = a[2 : 2 + k], a[2 + k :].reshape(k, k)
        step = other - mean
        m2 = m2 + products + np.outer(step, step) * (n * m / (n + m))
        mean, n = mean + step * (m / (n + m)), n + m
    return _moments(n, mean, m2)


def identity_error(white: DataFrame) -> DataFrame:
    """``dim, identity_error``: how far the covariance of the whitened rows is from the identity, measured on all rows.

    Products are of centred values, in tasks and where parts meet. Components
    without variance are left out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytes] = {}
        for batch in in_slices(batches, STACK_ROWS):
            dims = batch.column(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                w = np.array(batch.column(1).take(pa.array(np.flatnonzero(dims == dim))).to_pylist(), dtype=np.float64)
                w = w[:, ~np.isnan(w[0])]
                mean = w.mean(0) if w.size else np.zeros(0)
                part = _moments(len(w), mean, (w - mean).T @ (w - mean))
                held[int(dim)] = _merge_moments([held[int(dim)], part]) if int(dim) in held else part
        yield from _parts(held)

    ship_package(white.sparkSession)
    merged = tree_merge(_slots(materialise(arrow_map(white.select("dim", "whitened"), work, "dim int, task int, part binary"), "moments")), "dim", "part", _merge_moments)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for raw in batch.column(1).to_pylist():
                a = np.frombuffer(raw)
                k = int(a[0])
                errors.append(float(np.abs(a[2 + k :].reshape(k, k) / a[1] - np.eye(k)).max()) if k else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.float64())], names=["dim", "identity_error"])

    return arrow_map(merged, last, "dim int, identity_error double")


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT, components: int = COMPONENTS) -> DataFrame:
    """One row for each remaining row: ``vec_id, dim, n, deviation, whitened, explained, identity_error``.

    Rows become whole numbers, floor(scale * c) + shift, are centred by exact
    sums (n * x - S is a whole number), and the R factors of the tasks' centred
    rows are merged in a tree. The right singular vectors of the last R are the
    components; the covariance itself is never formed. What meets in a task
    or travels besides rows is of the size of the square of a vector's length.

    Defined cases: a vector that is null, empty or holds an entry that is null,
    not finite, or not finite once multiplied by ``scale`` takes no part; rows that share an id, or have none, all stay, each
    with its own values; vectors of each length are whitened by themselves; a
    component without variance (one row, equal rows, fewer rows than
    components) has null whitened values and is left out of the identity
    error; ``explained`` is null where nothing varies; a deviation that needs
    more than 64 bits is null; fewer entries than components give as many
    components as entries; an empty table gives an empty result; other columns
    are not read.
    """
    rows = materialise(finite_rows(embeddings, id_col, vector_col, scale), "vectors")
    white = materialise(project(rows, fit(rows, scale, shift, components), scale, shift), "whitened")
    return white.join(identity_error(white), "dim", "left")


def digest(result: DataFrame) -> DataFrame:
    """One row for each row and component, numbered from 1."""
    spread = result.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    number: Column = (F.col("at") + 1).cast("int")
    return spread.select("vec_id", number.alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")
