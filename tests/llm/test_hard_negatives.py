"""Hard negatives against brute force in whole numbers; intervals against what they must keep."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tidemark.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, block int, lane string, positives int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], SCHEMA).repartition(3)


def brute(rows: list[tuple]) -> list[tuple]:
    kept = {}
    for i, v, label in rows:
        if None not in (i, v, label) and v and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v):
            new = (v, (label + 1) % 10 if i % 7 == 0 else label)
            kept[i] = min(kept.get(i, new), new)
    x = {i: ([math.floor(256 * c) for c in v], label) for i, (v, label) in kept.items()}
    out = []
    for a, (av, al) in x.items():
        if a % 50 == 0:
            scored = [(-sum(p * q for p, q in zip(av, v, strict=True)), i, label) for i, (v, label) in x.items() if i != a and len(v) == len(av)]
            for ps, pid, _ in sorted(s for s in scored if s[2] == al)[:5]:
                hard = sorted(s for s in scored if s[2] != al and 50 * -ps <= 100 * -s[0] <= 95 * -ps)[:3]
                out += [(a, pid, r, nid, -ps, -ns) for r, (ns, nid, _) in enumerate(hard, 1)]
    return sorted(out)


def vectors(n: int, dim: int, seed: int, spread: float = 0.15) -> list[tuple]:
    rng = np.random.default_rng(seed)
    labels = np.where(rng.random(n) < 0.35, 3, rng.integers(0, 10, n))
    centres = rng.normal(size=(10, dim)) * 0.1
    return [(i, (centres[k] + rng.normal(size=dim) * spread).tolist(), int(k)) for i, k in enumerate(labels)]


def test_mining_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "DATA_ROWS", 90)
    monkeypatch.setattr(hn, "ANCHOR_ROWS", 4)
    monkeypatch.setattr(hn, "TILE_ROWS", 3)
    rows = vectors(700, 12, 1)
    rows += [rows[8], (8, [0.5] * 12, 2), (900, None, 1), (950, [0.1] * 12, None), (1000, [None] * 12, 1), (1050, [float("nan")] * 12, 1), (1100, [0.2] * 5, 1), (1101, [0.3] * 5, 1), (1102, [0.15] * 5, 2), (None, [0.1] * 12, 1), (1150, [0.0] * 12, 4)]
    rows += [(1200 + i, rows[50][1], 5) for i in range(20)]  # ties
    got = sorted(tuple(r) for r in hn.digest(frame(spark, rows)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == brute(rows) and len(got) > 100


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(50, [1.0, 2.0], 1), (51, [1.0, 2.0], 2)], [(50, [-1.0], 1), (51, [1.0], 1), (52, [-0.5], 2)], [(0, [], 1), (1, [], 2), (2, [], 1)], [(50, [0.0], 1), (51, [1.0], 1), (52, [3.0], 2)]])
def test_small_tables(spark, rows):
    assert sorted(tuple(r) for r in hn.digest(frame(spark, rows)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == brute(rows)


@pytest.mark.parametrize("size", [1e6, 1e9, 1e20, 1e160, 1e300])
def test_scores_of_any_size(spark, size):
    rows = [(i, (np.array(v) * size).tolist(), k) for i, v, k in vectors(120, 3, 5)]
    noisy = hn.F.when(hn.F.col("vec_id") % 7 == 0, (hn.F.col("label") + 1) % 10).otherwise(hn.F.col("label"))
    got = hn.mine(frame(spark, rows), "vec_id % 50 = 0", label=noisy).collect()
    assert sorted((r[0], r[1], r[2], r[3], int(r[4]), int(r[5])) for r in got) == brute(rows)


def test_planes_and_intervals():
    rng = np.random.default_rng(7)
    x, a = rng.integers(-90, 90, (400, 16)), rng.integers(-90, 90, (9, 16))
    planes = hn.Planes(x)
    assert sum(w * planes.bits(j) for j, w in planes.weights()).astype(int).tolist() == x.tolist()
    exact, seen = a @ x.T, []

    class Watched(hn.BestMatches):
        def all_pairs(self, low, high, alive):
            assert (low <= exact).all() and (exact <= high).all()
            return super().all_pairs(low, high, alive)

        def of_list(self, i, low, high, anchors):
            seen.append(len(i))
            stays = super().of_list(i, low, high, anchors)
            assert stays.sum() >= 5 * anchors
            return stays

    i, c, scores = hn.intervals(a, planes, Watched(5), np.ones(exact.shape, bool))
    assert (exact[i, c] == scores).all() and len(seen) > 2 and seen == sorted(seen, reverse=True) and seen[-1] < exact.size / 4
    for row in range(len(a)):
        assert set(np.argsort(-exact[row])[:5]) <= set(c[i == row])


def test_ranges_keep_their_best():
    rng = np.random.default_rng(8)
    x, a = rng.integers(-90, 90, (500, 16)), rng.integers(-90, 90, (7, 16))
    exact, least = a @ x.T, rng.integers(0, 40_000, (7, 3)).astype(float)
    most = least * 1.9
    i, c, scores = hn.intervals(a, hn.Planes(x), hn.Within(least, most, 3), np.ones(exact.shape, bool))
    assert (exact[i, c] == scores).all() and len(i) < exact.size / 5
    for row in range(7):
        for p in range(3):
            inside = [col for col in np.argsort(-exact[row], kind="stable") if least[row, p] <= exact[row, col] <= most[row, p]]
            assert set(inside[:3]) <= set(c[i == row])


def test_labels_of_any_kind(spark):
    rows = vectors(200, 6, 9)
    text = frame(spark, rows).withColumn("label", hn.F.concat(hn.F.lit("class "), "label"))
    a = {tuple(r) for r in hn.mine(text, "vec_id % 20 = 0").collect()}
    assert a and a == {tuple(r) for r in hn.mine(frame(spark, rows), "vec_id % 20 = 0").collect()}
