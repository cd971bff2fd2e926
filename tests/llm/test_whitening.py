"""Whitening against numpy on the whole matrix and Python's whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tidemark.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, dim int, n long, task string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, 1, 2, "clash") for i, v in rows], SCHEMA).repartition(parts)


def wanted(vectors: list[list[float]]):
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, centred, e[::-1], v[:, ::-1]


def test_whitening_against_the_covariance(spark):
    rng = np.random.default_rng(2)
    mixed = rng.normal(size=(12, 12)) / 10
    vectors = (rng.normal(size=(900, 12)) @ mixed).tolist()
    vectors += [vectors[0]] * 3
    rows = [(i, v) for i, v in enumerate(vectors)] + [(2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (2004, [])]
    rows[5] = (None, rows[5][1])
    rows[6] = (4, rows[6][1])
    result = wh.whiten(frame(spark, rows, 40))
    got = wh.digest(result).toPandas()
    n, deviation, centred, e, v = wanted([x for _, x in rows[:903]])
    assert len(got) == 903 * 8 and set(got["component"]) == set(range(1, 9)) and set(got["n"]) == {n}
    assert sorted(got[got.component == 1]["deviation"]) == sorted(deviation)
    assert got["identity_error"].nunique() == 1 and 0 <= got["identity_error"].iloc[0] < 1e-10
    by_id = {i: k for k, (i, _) in enumerate(rows[:903]) if i not in (None, 4)}
    for c in range(1, 9):
        part = got[(got.component == c) & got.vec_id.isin(list(by_id))]
        np.testing.assert_allclose(part["explained"].unique(), e[c - 1] / e.sum(), rtol=1e-9)
        want = centred[[by_id[i] for i in part["vec_id"]]] @ v[:, c - 1] / math.sqrt(e[c - 1])
        sign = np.sign(want @ part["whitened"].to_numpy())
        np.testing.assert_allclose(part["whitened"], sign * want, atol=1e-9)


def test_degenerate_tables(spark):
    assert wh.digest(wh.whiten(frame(spark, []))).count() == 0
    one = wh.digest(wh.whiten(frame(spark, [(1, [0.5, 0.25])]))).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(c, 1, 0, None, None, None) for c in (1, 2)]
    line = wh.whiten(frame(spark, [(i, [i / 8, i / 4, 0.0]) for i in range(9)])).collect()
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None, None] and abs(r.explained[0] - 1) < 1e-12 and r.identity_error < 1e-10 for r in line)
    # Vectors of different lengths are whitened by themselves.
    both = wh.digest(wh.whiten(frame(spark, [(i, [float(i), float(i % 3)]) for i in range(9)] + [(50 + i, [float(i * i)]) for i in range(4)]))).collect()
    assert {(r.vec_id >= 50, r.component, r.n) for r in both} == {(False, 1, 9), (False, 2, 9), (True, 1, 4)}


@pytest.mark.parametrize("size", [1e4, 1e12, 1e18, 1e160, 1e305])
def test_sums_and_deviations_stay_exact(spark, size):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(30, 3)) * size / 2).tolist()
    got = wh.whiten(frame(spark, list(enumerate(vectors)), 3)).collect()
    _, deviation, *_ = wanted(vectors) if size < 1e100 else (0, [2**70] * 30)
    assert {r.vec_id: r.deviation for r in got} == {i: d if d < 2**63 else None for i, d in enumerate(deviation)}
    if size < 1e150:
        assert max(r.identity_error for r in got) < 1e-9


def test_factor_tree_equals_one_factor(spark):
    rng = np.random.default_rng(6)
    parts = [rng.normal(size=(k % 9 + 1, 5)) for k in range(70)]
    made = [(5, k, np.int64(5).tobytes() + p.tobytes()) for k, p in enumerate(parts)]
    df = spark.createDataFrame(made, "dim int, slot long, part binary").repartition(6)
    r = wh.tree_merge(df, "dim", "part", wh._merge_factors, fan_in=4).first()["part"]
    r, x = np.frombuffer(bytes(r)[8:]).reshape(-1, 5), np.vstack(parts)
    np.testing.assert_allclose(r.T @ r, x.T @ x, atol=1e-9)
