"""Order statistics of sliding windows: one ordered window is updated row by row, so a row costs the same whatever the window's length."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.session import ship_package


def slide(values: np.ndarray, n: int, shares: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each row, over its last ``n`` rows: the midrank of its value as a share, and interpolated quantiles.

    Missing values (NaN) are in no window; a row without a value has no rank,
    and a window without one no quantiles.
    """
    ranks, found = np.full(len(values), np.nan), np.full((len(shares), len(values)), np.nan)
    window: list[float] = []
    seen = values.tolist()
    for at, value in enumerate(seen):
        if at >= n and (old := seen[at - n]) == old:
            del window[bisect_left(window, old)]
        there = value == value
        if there:
            insort(window, value)
        size = len(window)
        if there:
            less = bisect_left(window, value)
            ranks[at] = (less + (bisect_right(window, value, less) - less + 1) / 2) / size
        if size:
            for k, share in enumerate(shares):
                place = (size - 1) * share
                low = int(place)
                below = window[low]
                found[k, at] = below + (window[min(low + 1, size - 1)] - below) * (place - low)
    return ranks, found


def with_order(rows: DataFrame, value: str, windows: tuple[int, ...], shares: tuple[float, ...]) -> DataFrame:
    """``rows``, in chunks by ``symbol, chunk`` and numbered by ``n``, with ``rank_<window>`` and ``share_<k>_<window>`` columns.

    A group is one chunk of one symbol's history, of a few hundred rows; a
    chunk's first rows lead in, so windows are whole.
    """
    ship_package(rows.sparkSession)
    names = [f"{k}_{n}" for n in windows for k in ("rank", *(f"share_{i}" for i in range(len(shares))))]

    def work(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("n").to_numpy())
        back = np.argsort(order)
        x = table.column(value).to_numpy(zero_copy_only=False).astype(np.float64)[order]
        made = []
        for n in windows:
            ranks, found = slide(x, n, shares)
            made += [ranks[back], *found[:, back]]
        for name, column in zip(names, made, strict=True):
            table = table.append_column(name, pa.array(column, from_pandas=True))
        return table

    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in rows.dtypes), *(f"{c} double" for c in names)])
    return rows.groupBy("symbol", "chunk").applyInArrow(work, schema)
