"""Hard-negative mining by bit-sliced integer products: planes of bits, most significant first, and intervals of scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.blocks import numbered_blocks
from tidemark.llm.shared import arrow_map, materialise
from tidemark.session import ship_package

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these hundredths of its positive's.
LEAST_PERCENT, MOST_PERCENT = 50, 95
ANCHOR_EVERY = 50
DATA_ROWS = 4_096
#: Anchors of a block: their number bounds how often the data travel, their bytes how much stands in a task.
ANCHOR_ROWS = 16_384
#: Anchors of one product at a time.
TILE_ROWS = 128
#: Share of a tile's pairs under which the rest of the planes is worked off pair by pair.
SPARSE = 0.02
#: Intervals count as narrow once an anchor's scores spread over so many of their widths.
CLEAR = 4
#: Inner products of whole numbers below this are exact in doubles.
EXACT = 2.0**53


class Planes:
    """The components of a block of whole-number rows as bits, most significant first.

    x = -2**top * sign + the sum of 2**j * bit_j: the first plane is the sign
    of two's complement. After the planes down to j, what is still unknown of
    a component lies between 0 and 2**j - 1.
    """

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.top = x, int(np.abs(x).max(initial=0)).bit_length()
        self.made: dict[tuple, np.ndarray] = {}

    def weights(self) -> Iterator[tuple[int, int]]:
        """(shift of the plane, its weight)"""
        yield self.top, -(1 << self.top)
        for j in range(self.top - 1, -1, -1):
            yield j, 1 << j

    def bits(self, j: int, kind: type = np.float64) -> np.ndarray:
        """One plane as numbers, made once for all the tiles that meet the block."""
        if (j, kind) not in self.made:
            self.made[(j, kind)] = ((self.x >> j) & 1).astype(kind)
        return self.made[(j, kind)]


def kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """Each row's ``k``-th largest value; minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, 1)[:, -k]


def kth_of_groups(group: np.ndarray, values: np.ndarray, k: int, groups: int) -> np.ndarray:
    """The ``k``-th largest value of each group of a list; minus infinity where there are fewer."""
    order = np.lexsort((-values, group))
    last = _first(order, group, k)
    count = np.bincount(group[last], minlength=groups)
    out = np.full(groups, np.inf)
    np.minimum.at(out, group[last], values[last])
    return np.where(count == k, out, -np.inf)


class BestMatches:
    """A pair stays while its upper end reaches its anchor's ``k``-th largest lower end."""

    def __init__(self, k: int) -> None:
        self.k = k

    def all_pairs(self, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
        return high >= kth_largest(np.where(alive, low, -np.inf), self.k)[:, None]

    def of_list(self, i: np.ndarray, low: np.ndarray, high: np.ndarray, anchors: int) -> np.ndarray:
        return high >= kth_of_groups(i, low, self.k, anchors)[i]


class Within:
    """A pair stays while, for one of its anchor's ranges, its interval meets the range and is not beaten there.

    It is beaten where ``k`` other pairs lie wholly in the range with lower
    ends above its upper end. Over all pairs only the hull of the ranges counts.
    """

    def __init__(self, least: np.ndarray, most: np.ndarray, k: int) -> None:
        self.least, self.most, self.k = least, most, k

    def all_pairs(self, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:  # noqa: ARG002
        return (high >= self.least.min(1)[:, None]) & (low <= self.most.max(1)[:, None])

    def of_list(self, i: np.ndarray, low: np.ndarray, high: np.ndarray, anchors: int) -> np.ndarray:
        stays = np.zeros(len(i), bool)
        for p in range(self.least.shape[1]):
            floor, ceiling = self.least[i, p], self.most[i, p]
            meets = (high >= floor) & (low <= ceiling)
            inside = np.flatnonzero(meets & (low >= floor) & (high <= ceiling))
            if len(inside) >= self.k:
                meets &= high >= kth_of_groups(i[inside], low[inside], self.k, anchors)[i]
            stays |= meets
        return stays


def intervals(anchors: np.ndarray, planes: Planes, rule: BestMatches | Within, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column numbers, and exact scores, of the pairs that ``rule`` never drops.

    A plane's product with the anchors is added to what is known of the
    scores; the unknown rest of a score lies between (2**j - 1) times the sum
    of the anchor's negative and of its positive components. While the
    intervals are wide beside the spread of the scores, none can lie clear of
    another; from the first plane on where they may, pairs are dropped after
    every plane: first among all, then among those left, as a list. Once few
    are left, the remaining planes are worked off pair by pair.
    """
    a = anchors.astype(np.float64)
    down, up = np.minimum(a, 0).sum(1), np.maximum(a, 0).sum(1)
    kind = np.float32 if np.abs(a).sum(1).max(initial=0) < 2**24 else np.float64  # a plane's products stay exact
    left, known, i, c, scores = a.astype(kind), np.zeros(alive.shape), None, None, None
    for j, weight in planes.weights():
        rest = float((1 << j) - 1)
        if i is not None and len(i) <= SPARSE * alive.size:
            scores = scores + weight * np.einsum("pd,pd->p", a[i], planes.bits(j)[c])
        else:
            known += weight * (left @ planes.bits(j, kind).T)
            scores = known[i, c] if i is not None else None
        if i is None:
            if j and not (known.size and (np.ptp(known, 1) > CLEAR * rest * (up - down)).any()):
                continue
            i, c = np.nonzero(alive & rule.all_pairs(known + rest * down[:, None], known + rest * up[:, None], alive))
            scores = known[i, c]
        stays = rule.of_list(i, scores + rest * down[i], scores + rest * up[i], len(a))
        i, c, scores = i[stays], c[stays], scores[stays]
    return i, c, scores


def _first(order: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Positions in ``order`` (sorted by group) that are among their group's first ``k``."""
    sorted_group = group[order]
    starts = np.flatnonzero(np.r_[True, sorted_group[1:] != sorted_group[:-1]]) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def positives_of(anchors: np.ndarray, planes: Planes, row_ids: np.ndarray, may: np.ndarray, k: int) -> Found:
    """(anchor, slot, row id, score) of each anchor's ``k`` best rows among those it ``may`` take; the slot is 0."""
    i, c, scores = intervals(anchors, planes, BestMatches(k), may)
    best = _first(np.lexsort((row_ids[c], -scores, i)), i, k)
    return i[best], np.zeros(len(best), np.int64), row_ids[c[best]], scores[best]


def negatives_of(anchors: np.ndarray, planes: Planes, row_ids: np.ndarray, may: np.ndarray, k: int, least: np.ndarray, most: np.ndarray) -> Found:
    """(anchor, slot, row id, score): for each of an anchor's ranges the ``k`` best rows inside it."""
    i, c, scores = intervals(anchors, planes, Within(least, most, k), may)
    found = []
    for p in range(least.shape[1]):
        inside = np.flatnonzero((scores >= least[i, p]) & (scores <= most[i, p]))
        best = inside[_first(np.lexsort((row_ids[c[inside]], -scores[inside], i[inside])), i[inside], k)]
        found.append((i[best], np.full(len(best), p), row_ids[c[best]], scores[best]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def by_whole_numbers(anchors: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, may: np.ndarray, k: int, ranges: list[list[tuple]] | None) -> Found:
    """The same results for components whose products doubles cannot hold: Python's whole numbers, without planes."""
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)
    scores, found = whole(anchors) @ whole(rows).T, []
    for i in range(len(anchors)):
        there = [(-scores[i, c], int(row_ids[c])) for c in np.flatnonzero(may[i])]
        for p, (low, high) in enumerate(ranges[i] if ranges else [(None, None)]):
            fits = there if low is None else [x for x in there if low <= -x[0] <= high]
            found += [(i, p, v, -s) for s, v in sorted(fits)[:k]]
    columns = list(zip(*found, strict=True)) or [(), (), (), ()]
    return *(np.array(x, np.int64) for x in columns[:3]), np.array(columns[3], dtype=object)


def labelled_vectors(embeddings: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """``vec_id, vec, label``, one row for each id; components are floor(scale * x) as doubles that hold whole numbers."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"), label.alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < F.lit(float("inf"))))
    rows = rows.where("vec_id is not null and size(vec) > 0 and label is not null").where(finite)
    one = rows.groupBy("vec_id").agg(F.min(F.struct("vec", "label")).alias("row"))
    # From 2**52 on every double is whole; floor() would turn those beyond 64 bits into its greatest number.
    whole = F.transform("row.vec", lambda x: F.when(F.abs(x * scale) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return one.select("vec_id", whole.alias("vec"), F.col("row.label").alias("label"))


def _narrow(points: np.ndarray) -> np.ndarray:
    """The components in the fewest bytes that hold them."""
    most = np.abs(points).max(initial=0)
    return points.astype(np.int8 if most < 2**7 else np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)


def packed_blocks(rows: DataFrame) -> DataFrame:
    """One row for each block: its number, length of vectors, cell, ids, label codes, components, greatest norm, ``positives`` and least ``floor`` if there."""
    ranged = "positives" in rows.columns

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        points = np.array(pdf["vec"].tolist(), np.float64).reshape(len(pdf), -1)
        sent = _narrow(points)
        with np.errstate(over="ignore"):
            norm = float(np.sqrt((points**2).sum(1)).max()) * (1 + 1e-9)
        made = {"block": int(pdf["block"].iloc[0]), "dim": points.shape[1], "cell": int(pdf["cell"].iloc[0]), "ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "codes": pdf["code"].to_numpy(np.int64).tobytes(), "points": sent.tobytes(), "kind": sent.dtype.str, "norm": norm}
        made |= {"positives": [[str(s) for s in x] for x in pdf["positives"]], "floor": float(pdf["floor"].min())} if ranged else {}
        return pd.DataFrame({k: [v] for k, v in made.items()})

    return rows.groupBy("block").applyInPandas(work, "block int, dim int, cell int, ids binary, codes binary, points binary, kind string, norm double" + ", positives array<array<string>>, floor double" * ranged)


def edges(positive: int, least: int, most: int) -> tuple[int, int]:
    """The whole numbers s with least * positive <= 100 * s <= most * positive are those from the first to the second."""
    return -(-least * positive // 100), most * positive // 100


def meet(anchors: DataFrame, n_anchors: int, data: DataFrame, served: int, k: int, percents: tuple[int, int] | None) -> DataFrame:
    """``anchor_id, slot, vec_id, score``: what each pair of blocks gives for its anchors; scores are texts of whole numbers.

    Without ``percents`` anchors meet blocks of their cell, and their best rows
    of the same label are wanted. With them they meet every block that their
    least wanted score lets in by its greatest norm, and rows of other labels
    are wanted inside each range. Pairs of blocks are found from narrow
    columns. A block of data then goes to each block of anchors that it
    serves, into one of several lanes; a block of anchors goes to each lane
    once. A block of anchors meets about ``served`` blocks.
    """
    narrow = lambda df, s: df.select("dim", *[F.col(c).alias(f"{s}_{c}") for c in df.columns if c in ("block", "cell", "norm", "floor")])
    pairs = narrow(data, "d").join(narrow(anchors, "a"), "dim")
    pairs = pairs.where("a_cell = d_cell") if percents is None else pairs.where("a_norm * d_norm >= a_floor")
    lanes = max(1, min(served, 64))
    tasks = min(2 * lanes * n_anchors, 4_096)  # more than pairs of lanes and blocks, so that few of these share a task
    pairs = pairs.select("a_block", F.col("d_block").alias("block"), F.pmod(F.xxhash64("d_block"), F.lit(lanes)).alias("lane"))
    sent = data.join(pairs, "block").select("a_block", "lane", *[F.col(c).alias(f"d_{c}") for c in ("ids", "codes", "points", "kind")])
    here = anchors.withColumnRenamed("block", "a_block").withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    met = here.repartition(tasks, "a_block", "lane").join(sent.repartition(tasks, "a_block", "lane").hint("merge"), ["a_block", "lane"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                c = {n: batch.column(n)[at] for n in batch.schema.names}
                dim = c["dim"].as_py()
                read = lambda name, kind: np.frombuffer(c[name].as_buffer(), kind)  # noqa: B023, E731
                a, d = read("points", c["kind"].as_py()).reshape(-1, dim), read("d_points", c["d_kind"].as_py()).reshape(-1, dim)
                ids, codes, d_ids, d_codes = (read(x, np.int64) for x in ("ids", "codes", "d_ids", "d_codes"))
                ranges = None if percents is None else [[edges(int(s), *percents) for s in row] for row in c["positives"].as_py()]
                yield from pair_of_blocks(a, ids, codes, ranges, d, d_ids, d_codes, k)

    return arrow_map(met, work, "anchor_id long, slot int, vec_id long, score string")


def pair_of_blocks(a: np.ndarray, ids: np.ndarray, codes: np.ndarray, ranges: list[list[tuple]] | None, d: np.ndarray, d_ids: np.ndarray, d_codes: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The results of one pair of blocks, a tile of anchors at a time."""
    most_a, most_d = (float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (a, d))
    planes = Planes(d.astype(np.int64)) if 4 * most_a * (most_d + 1) * a.shape[1] < EXACT and most_d < EXACT else None
    for lo in range(0, len(a), TILE_ROWS):
        part = slice(lo, lo + TILE_ROWS)
        same = codes[part][:, None] == d_codes[None, :]
        may = ~same if ranges else same & (ids[part][:, None] != d_ids[None, :])
        if planes is None:
            found = by_whole_numbers(a[part], d, d_ids, may, k, ranges[part] if ranges else None)
        elif ranges is None:
            found = positives_of(a[part], planes, d_ids, may, k)
        else:
            slots = max(map(len, ranges))
            low, high = (np.array([[float(r[e]) for r in row] + [pad] * (slots - len(row)) for row in ranges[part]]) for e, pad in ((0, np.inf), (1, -np.inf)))
            found = negatives_of(a[part], planes, d_ids, may, k, low, high)
        i, slot, vec, score = found
        if len(i):
            texts = [str(int(s)) for s in score.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids[part][i]), pa.array(slot.astype(np.int32)), pa.array(vec), pa.array(texts)], names=["anchor_id", "slot", "vec_id", "score"])


def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` best rows of each group by score, ties to the smaller id; texts of whole numbers compare by sign, length and digits."""
    digits, below = F.regexp_replace("score", "^-", ""), F.col("score").startswith("-")
    length = F.char_length(digits)
    order = [below, F.when(below, length).otherwise(-length), F.when(below, digits), F.when(~below, digits).desc(), F.col("vec_id")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def mine(
    embeddings: DataFrame,
    is_anchor: str,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percents: tuple[int, int] = (LEAST_PERCENT, MOST_PERCENT),
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; scores are texts of whole numbers.

    Components become floor(scale * x); a score is the integer inner product
    with the anchor, higher first, ties by smaller id. An anchor's positives
    are its ``positives`` best other rows of its label. For each positive, the
    first ``negatives`` rows of other labels are given whose score lies
    between the two percentages of the positive's.

    Rows are blocked by cells of labels, as many as there are blocks, so that
    positives are looked for in the anchor's cell only; a label of any size is
    split into blocks. A pair of blocks works off the data's bits, most
    significant plane first (``intervals``), and gives a bounded number of rows
    for each anchor, which are merged.

    Defined cases: rows without an id, a label or components, or with a
    component that is null or not finite (or not once scaled) take no part; an
    id in several rows counts once, with its least vector and then label;
    vectors of different lengths never meet; fewer positives or negatives than
    asked for give those there are, an anchor without positives none; a
    positive with a negative score has no negatives, since nothing lies
    between 50 and 95 hundredths of it; scores are exact at any size, beyond
    doubles in Python's whole numbers and without planes; an empty table gives
    an empty result; other columns are not read.
    """
    spark = embeddings.sparkSession
    ship_package(spark)
    rows = labelled_vectors(embeddings, id_col, vector_col, F.col("label") if label is None else label, scale)
    whole_label = dict(rows.dtypes)["label"] in ("tinyint", "smallint", "int", "bigint")
    rows = materialise(rows.withColumn("code", F.col("label").cast("long") if whole_label else F.xxhash64("label")).drop("label"), "labelled-vectors")
    cells = max(1, rows.count() // DATA_ROWS)
    cell = F.pmod(F.xxhash64("code"), F.lit(cells)).cast("int")
    data_rows, n_data = numbered_blocks(rows, DATA_ROWS, cell)
    anchor_rows, n_anchors = numbered_blocks(rows.where(is_anchor), ANCHOR_ROWS, cell)
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score string, negative_score string")
    data = materialise(packed_blocks(data_rows), "data-blocks")
    best = ranked(meet(packed_blocks(anchor_rows), n_anchors, data, -(-n_data // cells), positives, None), ["anchor_id"], positives)
    best = materialise(best.select("anchor_id", F.col("vec_id").alias("positive_id"), "score", (F.col("rank") - 1).alias("slot")), "positives")

    above = best.where(~F.col("score").startswith("-"))
    lists = above.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("slot", "score"))).alias("all"), F.min(F.col("score").cast("double")).alias("least"))
    lists = lists.select(F.col("anchor_id").alias("vec_id"), F.col("all.score").alias("positives"), (F.col("least") * percents[0] / 100 * (1 - 1e-9)).alias("floor"))
    ranged, n_ranged = numbered_blocks(rows.where(is_anchor).join(lists, "vec_id"), ANCHOR_ROWS)
    found = ranked(meet(packed_blocks(ranged), max(1, n_ranged), data, n_data, negatives, percents), ["anchor_id", "slot"], negatives)
    # Scores that are not negative are an anchor's first ones, so their slots are their ranks.
    named = found.join(best.select("anchor_id", "slot", "positive_id", F.col("score").alias("positive_score")), ["anchor_id", "slot"])
    return named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: Rows whose id this divides get the next label first, as noise in the labels.
NOISE_EVERY = 7


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's mining, labels moved where it says so; a score beyond 64 bits is null."""
    noisy = F.when(F.col("vec_id") % NOISE_EVERY == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = mine(embeddings, f"vec_id % {ANCHOR_EVERY} = 0", label=noisy)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", *[F.expr(f"try_cast({c} AS bigint)").alias(c) for c in ("positive_score", "negative_score")])


ORACLE_SQL = """
WITH r AS (
  SELECT vec_id, min({'w': list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT), 'l': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END}) AS s
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id
), v AS (
  SELECT vec_id, list_transform(s.w, lambda x: x::DOUBLE) AS w, s.l AS l FROM r
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.l = c.l AS same, list_inner_product(a.w, c.w)::BIGINT AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id AND len(a.w) = len(c.w) WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 50 * positive_score AND 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
