"""Language ID, vector search and the pipeline."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import cover_tree, lang_id, tile_search
from tidemark.llm.shared import shared_dir


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(2)
    kinds = {"en": "the of and that with hand stone water think", "fr": "le la une étoile être avec château où garçon", "de": "der die und straße über mädchen groß nicht auch"}
    rows = [(i, " ".join(rng.choice(kinds[k].split()) for _ in range(rng.randint(20, 300))), k) for i, k in enumerate(rng.choices(list(kinds), k=240))]
    rows += [(500, None, "en"), (501, "", "en"), (502, "12345 !!!", "fr"), (503, rows[0][1], None), (None, rows[1][1], None), rows[3]]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_id(spoken, no_docs):
    rows, docs = spoken
    net = lang_id.fit(docs)
    found = lang_id.with_held_out(lang_id.identify(docs, net)).collect()
    assert len(found) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in found if r["held_out"] and r["doc_id"] < 500]
    assert len(held) > 20 and np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.95
    by = {r["doc_id"]: r for r in found}
    assert [by[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in found)
    assert lang_id.identify(no_docs, net).count() == 0 and lang_id.fit(no_docs) is None
    assert {r["lang_pred"] for r in lang_id.identify(docs, None).collect()} == {"und"}


def naive_logits(net, x):
    """One window by the definition of the network: every filter at every place, byte by byte."""
    h = []
    for w, kernel in net.kernels.items():
        for f in range(kernel.shape[2]):
            values = [sum(float(net.embed[x[at + o]] @ kernel[o, :, f]) for o in range(w)) for at in range(len(x) - w + 1)]
            h.append(max(max(values) + net.bias[w][f], 0.0))
    return np.array(h) @ net.out + net.out_bias


def test_network_equals_its_definition(monkeypatch):
    """The look-up convolution against naive sums, and the gradient steps against numeric differences of the loss."""
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 256, (6, 24)).astype(np.uint8), rng.integers(0, 3, 6)
    net = lang_id.train(x, y, ["a", "b", "c"], epochs=2)
    logits, _, _ = lang_id._forward(net, net.tables(), x)
    assert logits == pytest.approx(np.array([naive_logits(net, row) for row in x]), abs=1e-4)
    loss = lambda n: -np.log(lang_id._softmax(np.array([naive_logits(n, row) for row in x]))[np.arange(6), y]).mean()
    before = loss(net)
    # Adam's first step goes along the sign of each gradient: train from this net's own start, one batch, one epoch.
    start, moved = lang_id.train(x, y, ["a", "b", "c"], epochs=0), lang_id.train(x, y, ["a", "b", "c"], epochs=1)
    checked = 0
    for name in ("out_bias", "out", "embed"):
        flat, step = getattr(start, name).ravel(), getattr(moved, name).ravel() - getattr(start, name).ravel()
        for i in rng.choice(np.flatnonzero(step), min(6, np.count_nonzero(step)), replace=False):
            held, sides = flat[i], []
            for d in (1e-4, -1e-4):
                flat[i] = held + d
                sides.append(loss(start))
            flat[i] = held
            slope = (sides[0] - sides[1]) / 2e-4
            if abs(slope) > 1e-4:
                assert np.sign(step[i]) == -np.sign(slope), (name, i)
                checked += 1
    assert checked >= 8 and before < loss(start)


def test_prediction_reads_every_window(spoken):
    rows, docs = spoken
    net = lang_id.fit(docs)
    english, french = (next(r[1] for r in rows if r[2] == k) for k in ("en", "fr"))
    one, _ = lang_id.predict(net, net.tables(), [(english[:300] + " " + (french + " ") * 20).encode()])
    assert one == ["fr"]


def vectors():
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(700)]
    rows += [(700 + i, rows[3][1]) for i in range(300)]  # a hot vector
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2020, [float("inf")] + [0.0] * 7), (2040, [0.0] * 8), (2060, [1.0, 2.0]), (2061, [3.0, 1.0]), (None, [1.0] * 8), rows[40], rows[40], (2080, []), (2081, [])]
    return rows


def brute(rows, scale, zero_ok, k=20):
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        v = np.array(v, np.float32).astype(np.float64)
        good[i] = np.floor(v * scale) if scale else v
    if not zero_ok:
        good = {i: v for i, v in good.items() if (v != 0).any()}
    out = {}
    for q in (i for i in good if i % 20 == 0):
        scored = []
        for i, v in good.items():
            if i != q and len(v) == len(good[q]):
                total = 0.0
                for a, b in zip(good[q], v, strict=True):
                    total += a * b
                scored.append((-total, i))
        for rank, (score, i) in enumerate(sorted(scored)[:k], 1):
            out[q, rank] = (i, -score)
    return out


@pytest.mark.parametrize("search", ["exact", "near"])
def test_search_equals_brute_force(spark, search, monkeypatch):
    rows = vectors()
    monkeypatch.setattr(cover_tree, "DATA_ROWS", 150)
    monkeypatch.setattr(cover_tree, "QUERY_ROWS", 10)
    monkeypatch.setattr(tile_search, "DATA_ROWS", 150)
    monkeypatch.setattr(tile_search, "QUERY_ROWS", 20)
    table = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], "vec_id long, embedding array<float>, block int, near string, dim int")
    module, want = (cover_tree, brute(rows, 64, True)) if search == "exact" else (tile_search, brute(rows, None, False))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in module.digest(table).collect()}
    assert got == want
    empty = module.digest(table.limit(0))
    assert empty.count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, 16)), rng.normal(size=(60, 16)) * 3
    xq, xs, xn, xe = tile_search.quantise(x)
    yq, ys, yn, ye = tile_search.quantise(y)
    rough = (xq.astype(float) @ yq.astype(float).T) * xs[:, None] * ys[None]
    assert (np.abs(rough - x @ y.T) <= xe[:, None] * yn[None] + (xn + xe)[:, None] * ye[None] + 1e-12).all()


@pytest.mark.parametrize("kind", ["random", "clustered", "tight", "copies", "line"])
def test_cover_tree_keeps_its_invariants(kind):
    """Covering, separation and nesting at every node, ranges that divide their parent's, and bounds that hold."""
    rng = np.random.default_rng(3)
    x = {
        "random": rng.normal(size=(700, 12)), "clustered": rng.normal(size=(9, 12))[rng.integers(0, 9, 700)] + 0.05 * rng.normal(size=(700, 12)),
        "tight": 50 + 0.1 * rng.normal(size=(700, 12)), "copies": np.repeat(rng.normal(size=(7, 12)), 100, 0), "line": np.arange(700.0)[:, None] * np.ones(12),
    }[kind]
    x = np.floor(x * 64)
    tree = cover_tree.Tree(np.arange(700), x)
    points = tree.points.astype(float)
    assert sorted(tree.ids) == list(range(700)) and (x[tree.ids] == points).all()
    inner = 0
    for node, ((lo, hi), (first, last)) in enumerate(zip(tree.ranges, tree.kids, strict=True)):
        assert np.sqrt(((points[lo:hi] - points[tree.row[node]]) ** 2).sum(1)).max() <= tree.radius[node]
        if first == last:
            assert hi - lo <= cover_tree.LEAF or (points[lo:hi] == points[lo]).all()
            continue
        inner += 1
        assert [tree.ranges[first][0], *tree.ranges[first:last, 1]] == [lo, *tree.ranges[first + 1 : last, 0], hi]
        reach = tree.radius[node] / cover_tree.BASE
        assert (tree.radius[first:last] <= reach * (1 + 1e-6) + 1e-6).all()
        centres = points[tree.row[first:last]]
        away = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))[~np.eye(last - first, dtype=bool)]
        assert away.min() > reach * (1 - 1e-6) - 1e-6 and tree.row[node] == tree.row[first]
    assert inner > 0
    queries = cover_tree.Tree(np.arange(40), np.floor(rng.normal(size=(40, 12)) * 64), 4)
    nodes, others = np.arange(len(queries.radius)), np.arange(len(tree.radius))
    high, low = cover_tree.bounds(queries, nodes, queries.points.astype(float), tree, others, points)
    true = queries.points.astype(float) @ points.T
    for i, (a, b) in enumerate(queries.ranges):
        for j, (c, d) in enumerate(tree.ranges):
            assert low[i, j] <= true[a:b, c:d].min() and true[a:b, c:d].max() <= high[i, j]


def test_dual_trees_prune_clusters():
    """Of tight clusters most node pairs go; what is found is exact."""
    rng = np.random.default_rng(5)
    x = np.floor(64 * (rng.normal(size=(40, 24))[rng.integers(0, 40, 2000)] + 0.02 * rng.normal(size=(2000, 24))))
    ids = np.arange(2000)
    queries, data = cover_tree.Tree(ids[::20], x[::20], cover_tree.QUERY_LEAF), cover_tree.Tree(ids, x)
    search = cover_tree.Search(queries, 20)
    search.run(data)
    assert search.products < 0.1 * 100 * 2000
    at = {int(v): i for i, v in enumerate(queries.ids)}
    for q in ids[::20]:
        scores = x @ x[q]
        scores[q] = -np.inf
        assert search.held[at[q]][0].tolist() == np.lexsort((ids, -scores))[:20].tolist()


def test_scores_beyond_double_precision_are_exact(spark):
    """Ranks and scores as by whole numbers of any length: 2**53 is passed, and 2**63 as well."""
    rng = np.random.default_rng(6)
    rows = [(20, [1e8 + 1, 1.0]), (1, [1e8 + 3, 1.0]), (2, [1e8 + 3, 2.0]), (3, [-1e9, 7.0]), (40, [2e9, 1.0]), (4, [3e18, 0.0])]
    rows += [(100 + i, [float(v) for v in rng.integers(-(10**8), 10**8, 2)]) for i in range(120)]
    whole = {i: [int(c) for c in v] for i, v in rows}
    found = cover_tree.exact_top_k(spark.createDataFrame(rows, "vec_id long, vec array<double>"), 20).collect()
    got = {(r["query_id"], r["rank"]): (r["vec_id"], int(r["score"])) for r in found}
    want = {}
    for q in (i for i in whole if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)
        want |= {(q, rank): (i, -score) for rank, (score, i) in enumerate(scored[:20], 1)}
    assert got == want
    table = spark.createDataFrame([(i, [c / 64 for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    shown = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in cover_tree.digest(table).collect()}
    assert shown == {k: (i, s if abs(s) < 2**63 else None) for k, (i, s) in want.items()} and None in {s for _, s in shown.values()}


def test_pipeline_by_stages(spark, odd_rows, odd_docs, monkeypatch):
    import corpus_pipeline

    from pyspark.sql import functions as F

    clashes = ("text_was_null", "row_hash", "place", "copies", "nth", "doc", "kept", "score", "k0", "fp", "component_id", "size", "times")
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(i).alias(c) for i, c in enumerate(clashes)])
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, "")
        if name != "packing":
            assert after.columns == docs.columns
        path = f"{shared_dir(spark)}/test-pipeline-{name}"
        after.write.mode("overwrite").parquet(path)
        after = spark.read.parquet(path)
        old, new = (Counter(r["doc_id"] for r in x.select("doc_id").collect()) for x in (before, after))
        assert set(new) <= set(old)
        if name == "simhash_near_dedup":
            assert max(v for k, v in new.items() if k is not None) == 1
        if name == "line_dedup":
            assert new == old
        before = after
    assert before.count() > 0
