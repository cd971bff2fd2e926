"""Exact top-k by inner product: a dual-tree search over cover trees of queries and data."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import best_of, clean_vectors, numbered_blocks, packed, top_k
from tidemark.llm.shared import arrow_map, materialise
from tidemark.session import ship_package

TOP_K = 20
QUERY_EVERY = 20
SCALE = 64
#: A node's children cover its points at the node's radius divided by this, and their centres lie further apart.
BASE = 1.5
#: A node with so many points or fewer is not divided, in trees of data and of queries.
LEAF, QUERY_LEAF = 16, 4
#: Rows of a block of data, and of a block of queries.
DATA_ROWS, QUERY_ROWS = 8_192, 2_048
#: Data blocks that a task takes for one query block.
BLOCKS_A_TASK = 8
#: Points from which the cells of the top layer are grown, and the cells of one dimension.
SAMPLE, CELLS = 2_048, 64
#: Points compared at a time while a node is divided, and query nodes bounded at a time.
CHUNK, GROUP = 512, 64
#: Query groups are searched together where each wants at least this share of the nodes that any of them wants.
TOGETHER = 0.9
#: Scores of more digits than a decimal holds stand at its ends.
LIMIT = 10**38 - 1


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest signed type that holds them; they travel so, and are widened for products."""
    for kind in (np.int8, np.int16, np.int32):
        if not x.size or np.abs(x).max() <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T), 0)


def greedy_cover(x: np.ndarray, first: int, reach: float) -> np.ndarray:
    """Rows that are centres: every row lies within ``reach`` of one, and centres lie further apart than that."""
    centres, limit = [first], reach * reach
    for lo in range(0, len(x), CHUNK):
        part = np.arange(lo, min(lo + CHUNK, len(x)))
        bare = part[(apart(x[part], x[centres]) > limit).all(1)]
        between, left = apart(x[bare], x[bare]), np.ones(len(bare), bool)
        for i in range(len(bare)):
            if left[i]:
                centres.append(int(bare[i]))
                left &= between[i] > limit
    return np.array(centres)


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The angle of each row with its partner; half a turn if either is zero."""
    size = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))
    cos = np.divide((x * y).sum(1), size, out=np.full(len(x), -1.0), where=size > 0)
    return np.arccos(np.clip(cos, -1, 1))


class Tree:
    """A cover tree over rows of a matrix; each node covers one range of the reordered rows.

    A node has a centre (one of its points), its radius (the largest distance
    of its points from the centre), a range of rows, and its children in one
    range of nodes. Covering: a child's points lie within ``reach``, the
    parent's radius divided by ``BASE``, of the child's centre. Separation:
    centres of siblings lie further apart than that. Nesting: the parent's
    centre is the first child's. Levels on which nothing would change are left
    out, since a radius is measured, not halved. Nodes of at most ``leaf``
    points, and nodes of equal points, are leaves.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(ids))
        centre, radius, reach, ranges, kids = [], [], [], [], []

        def add(cs: list[int], lows: list[int], ends: list[int], radii: list[float], limit: float) -> None:
            centre.extend(cs)
            radius.extend(radii)
            reach.extend([limit] * len(cs))
            ranges.extend(zip(lows, ends, strict=True))
            kids.extend([(0, 0)] * len(cs))

        if len(ids):
            top = float(np.sqrt(((points - points[0]) ** 2).sum(1).max()))
            add([0], [0], [len(ids)], [top], top)
        at = 0
        while at < len(centre):
            lo, hi = ranges[at]
            if hi - lo > leaf and radius[at] > 0:
                rows = order[lo:hi].copy()
                x = points[rows] - points[centre[at]]  # near the node, so that squares lose nothing
                cs = greedy_cover(x, int(np.flatnonzero(rows == centre[at])[0]), radius[at] / BASE)
                owner = np.concatenate([apart(x[a : a + CHUNK], x[cs]).argmin(1) for a in range(0, len(x), CHUNK)]) if len(cs) < len(x) else np.zeros(len(x), int)
                owner[cs] = np.arange(len(cs))
                by = np.argsort(owner, kind="stable")
                order[lo:hi] = rows[by]
                counts = np.bincount(owner, minlength=len(cs))
                ends = lo + np.cumsum(counts)
                far = np.maximum.reduceat(np.sqrt(((x - x[cs[owner]]) ** 2).sum(1))[by], ends - counts - lo)
                kids[at] = (len(centre), len(centre) + len(cs))
                add(rows[cs].tolist(), (ends - counts).tolist(), ends.tolist(), far.tolist(), radius[at] / BASE)
            at += 1
        self.ids, self.points = ids[order], narrow(points[order])
        where = np.empty(len(order), int)
        where[order] = np.arange(len(order))
        self.row = where[np.array(centre, int)]
        self.radius, self.reach = np.array(radius) * (1 + 1e-9) + 1e-9, np.array(reach)  # above any rounding of the distances
        self.ranges, self.kids = np.array(ranges).reshape(-1, 2), np.array(kids).reshape(-1, 2)
        # Norms and angles of what a node holds, for the bound by angle.
        x = self.points.astype(np.float64)
        size, heads = np.sqrt((x * x).sum(1)), x[self.row]
        self.norm = size[self.row]
        self.least, self.most, self.turn = np.zeros(len(centre)), np.zeros(len(centre)), np.zeros(len(centre))
        for i, (a, b) in enumerate(self.ranges):
            self.least[i], self.most[i] = size[a:b].min(), size[a:b].max()
            if b - a > 1 and radius[i] > 0:
                self.turn[i] = angles(x[a:b], np.broadcast_to(heads[i], (b - a, x.shape[1]))).max() + 1e-7

    def __len__(self) -> int:
        return len(self.ids)


def bounds(q: Tree, q_nodes: np.ndarray, q_points: np.ndarray, d: Tree, d_nodes: np.ndarray, d_points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """No inner product between points of two nodes is above the first matrix or below the second.

    The covering radii give one bound; norms and angles give another, which is
    closer for nodes of nearly equal norms. The tighter one holds.
    """
    with np.errstate(all="ignore"):
        dot = q_points[q.row[q_nodes]] @ d_points[d.row[d_nodes]].T
        nq, rq, nd, rd = q.norm[q_nodes][:, None], q.radius[q_nodes][:, None], d.norm[d_nodes][None], d.radius[d_nodes][None]
        whole = (nq + rq) * (nd + rd)
        error = whole * 1e-9 + 1e-6
        room = whole - nq * nd + error
        high, low = dot + room, dot - room
        if (q.turn[q_nodes] > 0).any() or (d.turn[d_nodes] > 0).any():
            theta = np.arccos(np.clip(np.where(nq * nd > 0, dot / (nq * nd), 1.0), -1, 1))
            spread = q.turn[q_nodes][:, None] + d.turn[d_nodes][None] + 1e-7
            most, least = q.most[q_nodes][:, None] * d.most[d_nodes][None], q.least[q_nodes][:, None] * d.least[d_nodes][None]
            near, far = np.cos(np.maximum(theta - spread, 0)), np.cos(np.minimum(theta + spread, np.pi))
            known = nq * nd > 0
            high = np.where(known, np.minimum(high, np.where(near >= 0, most, least) * near + error), high)
            low = np.where(known, np.maximum(low, np.where(far >= 0, least, most) * far - error), low)
        return np.where(np.isnan(high), np.inf, high), np.where(np.isnan(low), -np.inf, low)


class Search:
    """The best ``k`` of every query of one query tree, over any number of data trees.

    Bounds are in double precision with room for its errors. Scores are whole
    numbers: exact in double precision while they are below 2**53, and numbers
    of any length where they may be larger (``wide``).
    """

    def __init__(self, queries: Tree, k: int, worst: np.ndarray | None = None, wide: bool = False) -> None:
        self.queries, self.k, self.wide = queries, k, wide
        self.q_points = queries.points.astype(np.float64)
        #: No kth score of a query can be below this: a kth score so far, or a bound from nodes.
        self.worst = np.full(len(queries), -np.inf) if worst is None else worst.copy()
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, object if wide else float))] * len(queries)
        #: Inner products taken, for bounds and for scores.
        self.products = 0

    def run(self, data: Tree) -> None:
        """Descend both trees together."""
        if not len(data) or not len(self.queries):
            return
        q, points, stack = self.queries, data.points.astype(np.float64), [(np.array([0]), np.array([0]))]
        while stack:
            siblings, others = stack.pop()
            for lo in range(0, len(siblings), GROUP):
                nodes = siblings[lo : lo + GROUP]
                high, low = bounds(q, nodes, self.q_points, data, others, points)
                self.products += high.size
                for (begin, end), least in zip(q.ranges[nodes], self._sure(low, data, others), strict=True):
                    np.maximum(self.worst[begin:end], least, out=self.worst[begin:end])
                kth = np.array([self.worst[begin:end].min() for begin, end in q.ranges[nodes]])
                keep = high >= kth[:, None]
                leaf = q.kids[nodes, 1] == q.kids[nodes, 0]
                for i in np.flatnonzero(~leaf & keep.any(1)):
                    stack.append((np.arange(*q.kids[nodes[i]]), self._opened(data, others[keep[i]])))
                ends = np.flatnonzero(leaf & keep.any(1))
                # Groups that want mostly the same nodes share their products; others go one by one.
                alike = len(ends) > 1 and keep[ends].mean() >= TOGETHER * keep[ends].any(0).mean()
                for some in [ends] if alike else ends[:, None]:
                    wanted = keep[some].any(0)
                    self._leaf(nodes[some], others[wanted], high[np.ix_(some, wanted)], data, points)

    def _sure(self, low: np.ndarray, data: Tree, others: np.ndarray) -> np.ndarray:
        """For each query node a score that ``k`` candidates have: nodes are disjoint, so ``k + 1`` points, of which one may be the query's own."""
        need, size = self.k + 1, np.subtract(*data.ranges[others].T[::-1])
        if size.sum() < need:
            return np.full(len(low), -np.inf)
        some = np.argpartition(low, len(others) - need, 1)[:, -need:] if len(others) > need else np.broadcast_to(np.arange(len(others)), low.shape)
        scores = np.take_along_axis(low, some, 1)
        order = np.argsort(-scores, 1)
        held = np.cumsum(np.take_along_axis(size[some], order, 1), 1) >= need
        return np.take_along_axis(np.take_along_axis(scores, order, 1), held.argmax(1)[:, None], 1)[:, 0]

    @staticmethod
    def _opened(data: Tree, nodes: np.ndarray) -> np.ndarray:
        """The children of the nodes, and the leaves among them as they are."""
        begin, end = data.kids[nodes].T
        inner = end > begin
        if not inner.any():
            return nodes
        size = (end - begin)[inner]
        return np.concatenate([nodes[~inner], np.repeat(begin[inner] - np.cumsum(size) + size, size) + np.arange(size.sum())])

    def _leaf(self, nodes: np.ndarray, others: np.ndarray, high: np.ndarray, data: Tree, points: np.ndarray) -> None:
        """Query groups against data nodes, the most promising first, in growing portions."""
        spans, portion = self.queries.ranges[nodes], 8
        size = spans[:, 1] - spans[:, 0]
        mine, first = np.concatenate([np.arange(a, b) for a, b in spans]), np.cumsum(size) - size
        while True:
            keep = (high >= np.minimum.reduceat(self.worst[mine], first)[:, None]).any(0)
            others, high = others[keep], high[:, keep]
            if not len(others):
                return
            best = np.argsort(-high.max(0), kind="stable")
            taken, rest = others[best[:portion]], best[portion:]
            others, high, portion = others[rest], high[:, rest], portion * 4
            inner = data.kids[taken, 1] > data.kids[taken, 0]
            if inner.any():
                new = self._opened(data, taken[inner])
                self.products += len(nodes) * len(new)
                others, high = np.concatenate([others, new]), np.concatenate([high, bounds(self.queries, nodes, self.q_points, data, new, points)[0]], 1)
            if not inner.all():
                begin, end = data.ranges[taken[~inner]].T
                rows = np.repeat(begin - np.cumsum(end - begin) + end - begin, end - begin) + np.arange((end - begin).sum())
                self._merge(mine, data.ids[rows], points[rows])

    def _merge(self, mine: np.ndarray, ids: np.ndarray, points: np.ndarray) -> None:
        self.products += len(mine) * len(ids)
        if self.wide:
            whole = np.frompyfunc(int, 1, 1)
            scores = whole(self.q_points[mine]) @ whole(points).T
        else:
            scores = self.q_points[mine] @ points.T
        for i, row in zip(mine.tolist(), scores, strict=True):
            some = np.arange(len(ids)) if self.wide else np.flatnonzero(row >= self.worst[i])
            some = some[ids[some] != self.queries.ids[i]]
            if not len(some):
                continue
            all_ids, all_scores = np.concatenate([self.held[i][0], ids[some]]), np.concatenate([self.held[i][1], row[some]])
            best = np.array(sorted(range(len(all_ids)), key=lambda j: (-all_scores[j], all_ids[j]))[: self.k]) if self.wide else top_k(all_ids, all_scores, self.k)
            self.held[i] = (all_ids[best], all_scores[best])
            if len(best) == self.k:
                kth = float(all_scores[best[-1]])
                self.worst[i] = max(self.worst[i], kth - abs(kth) * 1e-12 if self.wide else kth)

    def found(self) -> tuple[np.ndarray, np.ndarray, list]:
        """Query ids, ids and scores of all that is held."""
        ids = np.repeat(self.queries.ids, [len(v) for v, _ in self.held])
        vec = np.concatenate([v for v, _ in self.held]) if self.held else np.zeros(0, np.int64)
        score = np.concatenate([s for _, s in self.held]) if self.held else np.zeros(0)
        return ids, vec, [Decimal(max(-LIMIT, min(LIMIT, x))) for x in score] if self.wide else score.astype(np.int64).tolist()


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _balls(heads: DataFrame) -> DataFrame:
    """``dim, cell, centre, norm, radius`` around the blocks of each cell, and the least kth score, if any, of its queries."""
    lead = heads.groupBy("dim", "cell").agg(F.min_by(F.struct("centre", "norm"), "block").alias("lead"))
    away = F.sqrt(F.aggregate(F.zip_with("centre", "lead.centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    inside = heads.join(lead, ["dim", "cell"]).withColumn("away", away * (1 + 1e-9) + F.col("radius"))
    return inside.groupBy("dim", "cell").agg(F.any_value("lead.centre").alias("centre"), F.any_value("lead.norm").alias("norm"), F.max("away").alias("radius"), F.min("worst").alias("worst"))


def _may_meet(queries: DataFrame, data: DataFrame, on: list[str]) -> DataFrame:
    """Pairs whose covering radii allow a product that reaches the queries' worst kth score, with the bound ``high``."""
    d = data.select(*on, *[F.col(c).alias(f"d_{c}") for c in data.columns if c not in on])
    whole = (F.col("norm") + F.col("radius")) * (F.col("d_norm") + F.col("d_radius"))
    high = _dot("centre", "d_centre") + whole * (1 + 1e-9) - F.col("norm") * F.col("d_norm") + 1e-6
    return queries.join(d, on).withColumn("high", high).where(F.isnan("high") | (F.col("high") >= F.col("worst")))


def exact_top_k(vectors: DataFrame, every: int = 1, k: int = TOP_K) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` largest inner products; exact.

    ``vectors`` has ``vec_id`` and ``vec`` (whole numbers as double); queries are
    the rows whose id is divisible by ``every``. A query's own id is no
    candidate. Scores are exact whole numbers, of type long, or decimal where a
    product may reach 2**53; one of over 38 digits ranks as the largest (or
    least) number of 38.

    The top layers of both trees are distributed. Cells grow around centres from
    a bounded sample; a cell is split into blocks of bounded size, and each
    block of data and of queries has a cover tree. A query block is first
    searched in one data block of its own cell, which gives its groups kth
    scores. Then pairs of cells, of which a dimension has at most ``CELLS``, and
    pairs of blocks within the cells that are left, are pruned by their covering
    radii, before any vector moves. What is left goes to tasks by query block,
    the most promising data blocks first, so that a query's kth score rises from
    block to block; each pair is one dual-tree search. Per query and task ``k``
    candidates go on at most.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = materialise(vectors, "vectors")
    span = rows.agg(F.max(F.array_max(F.transform("vec", lambda x: F.abs(x)))).alias("most"), F.max(F.size("vec")).alias("dim")).first()
    wide = bool(span["most"]) and span["most"] ** 2 * span["dim"] >= 2**53
    kind, number = (pa.decimal128(38), "decimal(38,0)") if wide else (pa.int64(), "long")
    # Centres: farthest points of a sample bounded by SAMPLE rows.
    sample = rows.select("vec").orderBy(F.xxhash64("vec_id")).limit(SAMPLE).collect()
    by_dim: dict[int, np.ndarray] = {}
    for dim in {len(r["vec"]) for r in sample} - {0}:
        pts = np.array([r["vec"] for r in sample if len(r["vec"]) == dim]).reshape(-1, dim)
        chosen, near = [0], ((pts - pts[0]) ** 2).sum(1)
        while len(chosen) < min(CELLS, len(pts) // 48 + 1) and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, ((pts - pts[chosen[-1]]) ** 2).sum(1))
        by_dim[dim] = pts[chosen]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, out = batch.column(1).to_pylist(), np.zeros(len(batch), np.int32)
            size = np.array([len(v) for v in vecs])
            for dim, centres in by_dim.items():
                mine = np.flatnonzero(size == dim)
                if len(mine):
                    x = np.array([vecs[i] for i in mine])
                    out[mine] = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["vec_id", "vec", "near"])

    placed = materialise(arrow_map(rows.select("vec_id", "vec"), cells, "vec_id long, vec array<double>, near int"), "placed-vectors")
    # Cells below half a block share blocks with other small cells; a block then has a wider radius, nothing else.
    per = placed.groupBy(F.size("vec").alias("dim"), "near").count().orderBy("dim", "near").collect()
    merged, running = {}, {}
    for r in per:
        start, size = running.get(r["dim"], (r["near"], 0))
        if size + r["count"] > DATA_ROWS:
            start, size = r["near"], 0
        merged[(r["dim"], r["near"])], running[r["dim"]] = start, (start, size + r["count"])
    cell = F.create_map(*[F.lit(x) for (d, n), c in merged.items() for x in (d * 100_000 + n, c)])[F.size("vec") * 100_000 + F.col("near")] if merged else None
    data_rows, n_data = numbered_blocks(placed, DATA_ROWS, cell)
    query_rows, _ = numbered_blocks(placed.where(F.col("vec_id") % every == 0), QUERY_ROWS, cell)

    def make(ids: np.ndarray, points: np.ndarray, leaf: int) -> dict:
        tree = Tree(ids, points, leaf)
        return {"tree": pickle.dumps(tree), "centre": tree.points[tree.row[0]].astype(float).tolist(), "radius": float(tree.radius[0]), "norm": float(tree.norm[0])}

    shape = "block int, dim int, cell int, part int, tree binary, centre array<double>, radius double, norm double"
    data, queries = materialise(packed(data_rows, partial(make, leaf=LEAF), shape), "data-trees"), packed(query_rows, partial(make, leaf=QUERY_LEAF), shape)
    parts = data.groupBy("dim", "cell").agg((F.max("part") + 1).alias("parts"))
    seeded = queries.join(parts, ["dim", "cell"]).withColumn("part", F.pmod("part", "parts")).join(data.select("dim", "cell", "part", F.col("tree").alias("d_tree"), F.col("block").alias("d_block")), ["dim", "cell", "part"])
    passed = ["block", "dim", "cell", "tree", "centre", "radius", "norm", "d_block"]

    def first_search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                search = Search(pickle.loads(row.column("tree")[0].as_py()), k, None, wide)
                search.run(pickle.loads(row.column("d_tree")[0].as_py()))
                ids, vec, score = search.found()
                more = [pa.array([float(search.worst.min())]), pa.array([search.worst.tobytes()]), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([vec.tolist()], pa.list_(pa.int64())), pa.array([score], pa.list_(kind))]
                yield pa.RecordBatch.from_arrays([*[row.column(c) for c in passed], *more], names=[*passed, "worst", "floors", "query_id", "vec_id", "score"])

    schema = f"block int, dim int, cell int, tree binary, centre array<double>, radius double, norm double, d_block int, worst double, floors binary, query_id array<long>, vec_id array<long>, score array<{number}>"
    seeds = materialise(arrow_map(seeded, first_search, schema), "searched-trees")
    own = seeds.select(F.explode(F.arrays_zip("query_id", "vec_id", "score")).alias("x")).select("x.*")

    heads = seeds.select("block", "dim", "cell", "centre", "radius", "norm", "worst", F.col("d_block").alias("seed"))
    tails = data.select("block", "dim", "cell", "centre", "radius", "norm", F.lit(None).cast("double").alias("worst"))
    cell_pairs = _may_meet(_balls(heads), _balls(tails), ["dim"]).select("dim", "cell", "d_cell")
    pairs = _may_meet(heads.join(cell_pairs, ["dim", "cell"]).drop("cell").withColumnRenamed("d_cell", "cell"), tails.drop("worst"), ["dim", "cell"]).where("d_block <> seed").select("block", "d_block", "high")
    lanes = -(-max(1, n_data) // BLOCKS_A_TASK)
    work = pairs.join(data.select(F.col("block").alias("d_block"), F.col("tree").alias("d_tree")), "d_block").join(seeds.select("block", "tree", "floors"), "block")
    work = work.withColumn("lane", F.pmod(F.xxhash64("d_block"), F.lit(lanes))).repartition("block", "lane").sortWithinPartitions("block", "lane", F.desc("high"))

    def search_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, search = None, None

        def ready() -> Iterator[pa.RecordBatch]:
            if search:
                ids, vec, score = search.found()
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(vec), pa.array(score, kind)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(len(batch)):
                here = (batch.column("block")[i].as_py(), batch.column("lane")[i].as_py())
                if here != at:
                    yield from ready()
                    at, search = here, Search(pickle.loads(batch.column("tree")[i].as_py()), k, np.frombuffer(batch.column("floors")[i].as_py()), wide)
                high = batch.column("high")[i].as_py()
                if not high < search.worst.min():
                    search.run(pickle.loads(batch.column("d_tree")[i].as_py()))
        yield from ready()

    others = arrow_map(work.select("block", "lane", "high", "tree", "floors", "d_tree"), search_on, f"query_id long, vec_id long, score {number}")
    return best_of(own.unionByName(others), k)


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's search: components become floor(64 * x), scores are whole numbers.

    Defined cases: vectors that are null or hold a null or non-finite component
    take no part; an id in several rows counts once, with its least vector, so
    that "the query's own row" is well defined; vectors of different lengths
    never meet; a query with fewer candidates gets them all; scores are exact,
    and one beyond 64 bits is null at the rank it has; a vector that leaves the
    range of a double once scaled takes no part; an empty table gives an empty
    result; other columns are not read.
    """
    # From 2**52 on every double is whole; floor() would turn those beyond 64 bits into its greatest number.
    whole = F.transform("vec", lambda x: F.when(F.abs(x * SCALE) < 2.0**52, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    rows = clean_vectors(embeddings).withColumn("vec", whole).where(F.forall("vec", lambda x: F.abs(x) < F.lit(float("inf"))))
    found = exact_top_k(rows, QUERY_EVERY)
    return found.select("query_id", "rank", "vec_id", F.col("score").try_cast("long").alias("score"))


ORACLE_SQL = """
WITH one AS (
  SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id
), v AS (SELECT vec_id, list_transform(e, lambda x: floor(64 * x)::HUGEINT) AS w FROM one
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.w) = len(q.w) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
