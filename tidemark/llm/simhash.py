"""SimHash near-duplicates: fingerprints, a binary trie self-join, and components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import arrow_map, free_name, materialise

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
BITS = 64
#: Words hashed at a time; bounds the bit matrix of a very long text.
HASH_CHUNK = 65_536
#: A node pair with this many leaf pairs or fewer is compared directly.
LEAF_PAIRS = 32
#: Node pairs that a task advances at a time.
PORTION = 200_000
#: Fingerprints of a node beyond which its pairs are expanded further, and by how many bits.
NODE_ROWS, STEP = 32_768, 4
#: Node pairs of a task, each of at most two packed nodes.
PAIRS_A_TASK = 128


def fingerprint(raw: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of one UTF-8 text: a bit is set if over half of the shingle hashes have it."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, SEED)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))[: len(words) - shingle_words + 1].tolist()
    ends = np.concatenate((gaps, [len(joined)]))[shingle_words - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for lo in range(0, len(starts), HASH_CHUNK):
        cut = slice(lo, lo + HASH_CHUNK)
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[cut], ends[cut], strict=True)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * total > len(starts))
    return sum(1 << int(i) for i in set_bits)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` for each row; ``fp`` is the fingerprint's 64 bits as a signed long.

    A null or blank text has fingerprint zero.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([fingerprint(x.as_py() or b"", shingle_words) for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, work, "doc_id long, fp long")


def _split(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where each sorted range goes from bit 0 to bit 1; the bits above are equal within a range."""
    ones = np.concatenate(([0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
    return hi - (ones[hi] - ones[lo])


def _leaf_pairs(fps: np.ndarray, nodes: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries under small node pairs that differ in at most ``max_bits`` bits."""
    lo1, hi1, lo2, hi2 = nodes[:, :4].T
    many = (hi1 - lo1) * (hi2 - lo2)
    first = np.repeat(np.arange(len(nodes)), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    width = (hi2 - lo2)[first]
    i, j = lo1[first] + at // width, lo2[first] + at % width
    near = (i < j) & (np.bitwise_count(fps[i] ^ fps[j]) <= max_bits)
    return i[near], j[near]


def trie_self_join(fps: np.ndarray, nodes: np.ndarray, top_bit: int, max_bits: int = MAX_BITS, visited: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``fps`` within ``max_bits``, found by traversing a binary trie in node pairs.

    A node is a range of sorted fingerprints that agree above ``top_bit``; node
    pairs are rows ``lo1, hi1, lo2, hi2, errors`` (a node with itself, or two
    nodes). All node pairs of one depth advance together: each is split at the
    next bit, pairs of unequal children gain one differing bit, and a pair goes
    when it is empty or its differing bits exceed the budget. Small pairs are
    compared directly. A long frontier is taken in portions, depth first, which
    bounds memory. ``visited`` collects the sizes of the portions.
    """
    stack = [(top_bit, nodes)]
    while stack:
        bit, nodes = stack.pop()
        if len(nodes) > PORTION:
            stack += [(bit, nodes[i : i + PORTION]) for i in range(0, len(nodes), PORTION)]
            continue
        if visited is not None:
            visited.append(len(nodes))
        small = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2]) <= LEAF_PAIRS
        if bit < 0:
            small[:] = True
        if small.any():
            leaves = nodes[small]
            for i in range(0, len(leaves), PORTION // 4):
                yield _leaf_pairs(fps, leaves[i : i + PORTION // 4], max_bits)
            nodes = nodes[~small]
        if not len(nodes):
            continue
        lo1, hi1, lo2, hi2, errors = nodes.T
        mid1, mid2 = _split(fps, lo1, hi1, bit), _split(fps, lo2, hi2, bit)
        own = (lo1 == lo2) & (hi1 == hi2)
        equal0 = np.stack([lo1, mid1, lo2, mid2, errors], 1)
        equal1 = np.stack([mid1, hi1, mid2, hi2, errors], 1)
        cross01 = np.stack([lo1, mid1, mid2, hi2, errors + 1], 1)
        cross10 = np.stack([mid1, hi1, lo2, mid2, errors + 1], 1)[~own]
        nodes = np.concatenate([equal0, equal1, cross01, cross10])
        nodes = nodes[(nodes[:, 1] > nodes[:, 0]) & (nodes[:, 3] > nodes[:, 2]) & (nodes[:, 4] <= max_bits)]
        if len(nodes):
            stack.append((bit - 1, nodes))


def prefix(depth: int, column: str = "fp") -> Column:
    """The trie node of a fingerprint at a depth: its highest ``depth`` bits."""
    return F.shiftrightunsigned(column, BITS - depth)


def masks(width: int, max_bits: int) -> list[tuple[int, int]]:
    """All differences of ``width`` bits within the budget, with their number of bits."""
    return [(sum(1 << i for i in at), k) for k in range(max_bits + 1) for at in combinations(range(width), k)]


def expanded(pairs: DataFrame, nodes: DataFrame, step: int, max_bits: int) -> DataFrame:
    """Node pairs ``step`` bits deeper: ``a, b, errors, n_a, n_b``.

    Each existing child of ``a`` meets the children of ``b`` that differ from
    it within what is left of the budget; a semi-join keeps those that exist.
    Of a node with itself each pair of children comes once.
    """
    kids = nodes.select(F.shiftrightunsigned("node", step).alias("a"), F.col("node").alias("kid_a"), F.col("count").alias("n_a"))
    steps = F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(k).alias("bits")) for m, k in masks(step, max_bits)])).alias("d")
    met = pairs.join(kids, "a").select("a", "b", "errors", "kid_a", "n_a", steps).where(F.col("errors") + F.col("d.bits") <= max_bits)
    met = met.withColumn("kid_b", F.col("kid_a").bitwiseXOR(F.shiftleft(F.col("a").bitwiseXOR(F.col("b")), step)).bitwiseXOR(F.col("d.mask")))
    met = met.where((F.col("a") != F.col("b")) | (F.col("kid_a") <= F.col("kid_b")))
    other = nodes.select(F.col("node").alias("kid_b"), F.col("count").alias("n_b"))
    found = met.join(other, "kid_b").select(F.col("kid_a").alias("a"), F.col("kid_b").alias("b"), (F.col("errors") + F.col("d.bits")).alias("errors"), "n_a", "n_b")
    return found.where((F.col("a") != F.col("b")) | (F.col("n_a") > 1))


def node_pairs(distinct: DataFrame, max_bits: int = MAX_BITS, node_rows: int = NODE_ROWS) -> DataFrame | None:
    """The frontier of the distributed traversal: ``depth, a, b, errors``; None without fingerprints.

    The trie's root is paired with itself, and node pairs are expanded level by
    level with ``expanded``: every pair of fingerprints within the budget lies
    under exactly one pair of the result. The first step is as deep as evenly
    spread fingerprints need; after it only pairs with a node of more than
    ``node_rows`` fingerprints go deeper, ``STEP`` bits at a time, down to the
    last bit, at which a node is one fingerprint. Tables of nodes and pairs are
    written at each level, and fingerprints outside of open nodes drop out.
    """
    total = distinct.count()
    if not total:
        return None
    step = min(20, max(1, ceil(log2(max(1, 2 * total / node_rows)))))
    pairs = distinct.sparkSession.createDataFrame([(0, 0, 0)], "a long, b long, errors int")
    depth, fps, closed = 0, distinct.select("fp"), None
    while True:
        depth += step
        nodes = materialise(fps.groupBy(prefix(depth).alias("node")).count(), "trie-nodes")
        level = materialise(expanded(pairs, nodes, step, max_bits), "node-pairs")
        small = (F.col("n_a") <= node_rows) & (F.col("n_b") <= node_rows)
        done = level.where(small).select(F.lit(depth).alias("depth"), "a", "b", "errors")
        closed = done if closed is None else closed.unionByName(done)
        pairs = level.where(~small).select("a", "b", "errors")
        if pairs.isEmpty():
            return closed
        big = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        fps = fps.withColumn("node", prefix(depth)).join(big, "node", "left_semi").select("fp")
        step = min(STEP, BITS - depth)


def near_pairs(distinct: DataFrame, max_bits: int = MAX_BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """Pairs ``a, b`` of different fingerprints (column ``fp``, distinct) within ``max_bits`` bits, each once.

    A binary trie over the fingerprints is joined with itself: the upper part
    of the traversal is a frontier of node pairs, expanded by joins
    (``node_pairs``); below it each node pair is one bounded piece of work. A
    node's fingerprints, at most ``node_rows``, are packed into one row and go
    to the pairs that the node is in.
    """
    spark = distinct.sparkSession
    frontier = node_pairs(distinct, max_bits, node_rows)
    if frontier is None:
        return spark.createDataFrame([], "a long, b long")
    used = frontier.select("depth", F.explode(F.array("a", "b")).alias("node")).distinct()
    depths = sorted(r["depth"] for r in used.select("depth").distinct().collect())  # at most one for each level
    placed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), prefix(d).alias("node")) for d in depths])).alias("at")).select("fp", "at.*") if depths else distinct.selectExpr("fp", "0 AS depth", "fp AS node")
    packs = materialise(placed.join(used, ["depth", "node"]).groupBy("depth", "node").agg(F.collect_list("fp").alias("fps")), "trie-packs")
    side = lambda n: packs.select("depth", F.col("node").alias(n), F.col("fps").alias(f"{n}_fps"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(frontier.count() / PAIRS_A_TASK))
    work = frontier.join(side("a"), ["depth", "a"]).join(side("b"), ["depth", "b"]).repartition(parts, "depth", "a", "b")

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, a, b, errors = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("depth", "a", "b", "errors"))
            for i in range(len(batch)):
                one, two = (np.sort(batch.column(c)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)) for c in ("a_fps", "b_fps"))
                own = a[i] == b[i]
                fps = one if own else np.concatenate([one, two])
                start = [0, len(one), 0, len(one), errors[i]] if own else [0, len(one), len(one), len(fps), errors[i]]
                for x, y in trie_self_join(fps, np.array([start]), BITS - 1 - int(depth[i]), max_bits):
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(fps[x].view(np.int64)), pa.array(fps[y].view(np.int64))], names=["a", "b"])

    return arrow_map(work.select("depth", "a", "b", "errors", "a_fps", "b_fps"), traverse, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """``doc_id, fp, component_id, n_links`` for each row of ``docs``.

    Rows link if their fingerprints differ in at most ``max_bits`` bits;
    ``component_id`` is the smallest id reachable over links and ``n_links``
    counts the different fingerprints that the row's own one links to.
    Copies share a fingerprint and meet in one row before the join, so a
    group of any size costs no pairs.

    Defined cases: null, empty and blank texts have fingerprint zero, and are
    linked by it like any other; repeated rows each return their row; a row
    with a null id is linked by its text but never names a component, and its
    component is null if nothing else is reachable; an empty table gives an
    empty result; other columns are not read.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    pairs = materialise(near_pairs(distinct.select("fp"), max_bits), "fingerprint-pairs")
    links = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("fp").alias("n_links"))
    # Components run over fingerprints; their smallest document id follows.
    parts = connected_components(pairs, "a", "b")
    named = distinct.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left").join(links, "fp", "left")
    named = named.withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = named.join(least, "component").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id", "n_links")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def keep_one(_spark: SparkSession, docs: DataFrame, _sf_dir: str) -> DataFrame:
    """Pipeline stage: the document with the smallest id of each near-duplicate group stays.

    Rows that share an id are one document, of which the row with the smallest
    hash of its text stays, and of equal texts any one; rows without an id stay
    as they are. Only ids that stand in several rows are numbered by a window.
    """
    columns = docs.columns
    found = near_duplicates(docs)
    kept = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
    once = docs.join(kept.where("times = 1").select("doc_id"), "doc_id", "left_semi")
    place = free_name("place", columns)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    several = docs.join(kept.where("times > 1").select("doc_id"), "doc_id", "left_semi").withColumn(place, first).where(F.col(place) == 1).drop(place)
    return once.unionByName(several).unionByName(docs.where(F.col("doc_id").isNull())).select(*[F.col(f"`{c}`") for c in columns])
