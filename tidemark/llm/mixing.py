"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import materialise
from tidemark.session import ship_package

#: Fixed by the contract: weights repeat over the sources in order.
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Documents that one task rounds at a time, and residuals that one task combines.
CHUNK_ROWS = 2_000
FAN_IN = 500
#: Rows of a chunk that stay open up to the root, spread over the sizes, to take up what the last residual leaves.
SPARES = 32
SEED = 20_231


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, n_rows, target`` for each source.

    Sources are ordered by code point, null last, and weigh ``weights``
    repeated. They share the total of all sizes by weight; a target stops at
    ``max_repeats`` times its source's size, and the excess is shared by weight
    among the others until none is above. That end state is the water level
    ``l`` at which the sum of ``min(cap, l * weight)`` is the total, so it is
    found in one pass over the sources sorted by ``cap / weight``.

    This runs over one row for each source, never over documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("weight", F.get(table, (F.row_number().over(order) - 1) % len(weights)).cast("double"))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    everything = Window.partitionBy()
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("fill", F.col("cap") / F.col("weight")).withColumns(
        {
            "total": F.sum("source_size").over(everything).cast("double"),
            "all_weight": F.sum("weight").over(everything),
            "cap_before": F.coalesce(F.sum("cap").over(by_fill), F.lit(0.0)),
            "weight_before": F.coalesce(F.sum("weight").over(by_fill), F.lit(0.0)),
        }
    )
    # The level if exactly the sources before this one are full; the first such level that this one holds counts.
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    per = per.withColumn("level", F.when(level <= F.col("fill"), level))
    per = per.withColumn("level", F.max_by("level", F.when(F.col("level").isNotNull(), -F.col("fill"))).over(everything))
    return per.select("source", "source_size", "n_rows", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _uniform(keys: np.ndarray, round_no: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys; the same for the same key in every run."""
    x = keys.astype(np.uint64) ^ np.uint64((SEED + 0x9E3779B97F4A7C15 * (round_no + 1)) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53


def pivotal(prob: np.ndarray, size: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Round probabilities so that the sum of ``prob * size`` stays, but for one residual.

    Two fractional entries meet; mass moves between them, measured in
    ``size``, until one becomes 0 or 1. The direction is drawn so that each
    entry's expectation stays. At most one entry is fractional at the end.
    """
    p, held = prob.copy(), -1
    for i in range(len(p)):
        if not 1e-12 < p[i] < 1 - 1e-12:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b, j = size[held], size[i], held
        up = min((1 - p[j]) * a, p[i] * b)  # mass that can go from i to j
        down = min(p[j] * a, (1 - p[i]) * b)  # and from j to i
        move = up if u[i] * (up + down) < down else -down
        p[j] += move / a
        p[i] -= move / b
        held = -1
        for k in (j, i):
            if 1e-9 < p[k] < 1 - 1e-9:
                held = k
            else:
                p[k] = round(p[k])
    return p


def settle(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the one residual to the nearer whole number, then let spare rows take up what it leaves.

    Rows are sorted by falling size; one flips where that brings the sum of
    ``p * size`` nearer to what it was.
    """
    out = np.round(p)
    left = float(((p - out) * size).sum())
    for i in range(len(out)):
        change = size[i] * (1 - 2 * out[i])
        if abs(left - change) < abs(left):
            out[i], left = 1 - out[i], left - change
    return out


def _rounded(level: int, fan_in: int, spares: int):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "pick", "doc_id"], ascending=[False, True, True], kind="stable")
        size, u = pdf["size"].to_numpy(float), _uniform(pdf["pick"].to_numpy(), level)
        prob = pivotal(pdf["prob"].to_numpy(float), size, u)
        able = np.flatnonzero(pdf["able"].to_numpy(bool))
        kept = np.zeros(len(pdf), bool)
        kept[able[np.unique(np.linspace(0, len(able) - 1, spares).astype(int))] if len(able) else able] = True
        if -(-int(pdf["chunks"].iloc[0]) // fan_in**level) <= 1:
            mine = kept | ((prob > 0) & (prob < 1))
            prob[mine] = settle(prob[mine], size[mine])
            kept[:] = False
        pdf["prob"], pdf["open"] = prob, kept | ((prob > 0) & (prob < 1))
        return pdf

    return work


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, row_hash, size``; the size is the number of words between ASCII blanks."""
    text = F.col("text")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).select(
        "doc_id",
        "source",
        F.xxhash64("text").alias("row_hash"),
        F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long").alias("size"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, row_hash, size, source, source_size, target, copies, taken`` for each row.

    Every document of a source is wanted ``target / source_size`` times. The
    whole part is certain; the fraction is rounded by the pivotal method inside
    chunks of about ``CHUNK_ROWS`` rows, which are dealt by a hash within the
    source, so that a hot source has many chunks. Each chunk leaves one residual
    at most; residuals are combined ``FAN_IN`` at a time up a tree until a
    source has one, which goes to the nearer whole number. What that leaves,
    half a document at most, is taken up by up to ``SPARES`` rows of several
    sizes that stay open beside the residuals.

    Defined cases: a null or blank text has size 0 and is taken 0 times; a null
    source is a source of its own, the last; no row exceeds ``MAX_REPEATS``
    times its size; repeated rows are rounded one by one; draws depend on the
    id, the text and the chunk only, so that reruns agree; an empty table gives
    an empty result.
    """
    sized = materialise(sizes(docs, id_col, text_col, source_col), "sizes")
    targets = materialise(source_targets(sized), "targets")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select(
        "doc_id", "row_hash", sized["source"], "size", "source_size", "target", "n_rows", wanted.alias("wanted")
    )
    spread = F.pmod(F.xxhash64("doc_id", "row_hash"), F.ceil(F.col("n_rows") / CHUNK_ROWS))
    base = F.when(F.col("size") > 0, F.floor("wanted")).otherwise(0).cast("long")
    rows = rows.select(
        "doc_id", "row_hash", "source", "size", "source_size", "target",
        F.ceil(F.col("n_rows") / CHUNK_ROWS).cast("long").alias("chunks"),
        spread.cast("long").alias("chunk"),
        F.xxhash64("row_hash", "doc_id").alias("pick"),
        base.alias("base"),
        F.when(F.col("size") > 0, F.col("wanted") - F.floor("wanted")).otherwise(0.0).alias("prob"),
        ((F.col("size") > 0) & (F.col("wanted") < MAX_REPEATS)).alias("able"),
        F.lit(True).alias("open"),
    )
    schema = rows.schema
    ship_package(rows.sparkSession)
    rest, done, level, chunks = rows, None, 0, 1
    while level == 0 or chunks > 1:
        if level:
            chunks = -(-chunks // FAN_IN)
            rest = rest.withColumn("chunk", F.floor(F.col("chunk") / FAN_IN))
        rounded = materialise(rest.groupBy("source", "chunk").applyInPandas(_rounded(level, FAN_IN, SPARES), schema), f"mix-{level}")
        if not level:
            chunks = rounded.agg(F.max("chunks")).first()[0] or 0
        closed = rounded.where("not open")
        done, rest, level = closed if done is None else done.unionByName(closed), rounded.where("open"), level + 1
    copies = F.col("base") + F.col("prob").cast("long")
    return done.select("doc_id", "row_hash", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "size", "source_size", "target", "taken")


def take_mix(spark: SparkSession, docs: DataFrame, _sf_dir: str) -> DataFrame:
    """Pipeline stage: each document stands as often as the mix takes it."""
    columns = docs.columns
    mixed = materialise(mix(docs).select("doc_id", "row_hash", "copies"), "mix-copies")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"))
    same = Window.partitionBy("doc_id", "row_hash")
    # Rows of one id and text are numbered on both sides, so that each takes its own copies; others just meet.
    times = mixed.groupBy("doc_id", "row_hash").agg(F.count(F.lit(1)).alias("times"), F.sum("copies").alias("copies"))
    once = times.where("times = 1 and copies > 0").select("doc_id", "row_hash", "copies")
    several = materialise(times.where("times > 1").select("doc_id", "row_hash"), "mix-repeated")

    def on(a: DataFrame, b: DataFrame, *more: str):
        met = a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row_hash"] == b["row_hash"])
        for name in more:
            met &= a[name] == b[name]
        return met

    repeated = keyed.join(several, on(keyed, several), "left_semi").withColumn("nth", F.row_number().over(same.orderBy(F.lit(1))))
    counted = mixed.join(several, on(mixed, several), "left_semi").withColumn("nth", F.row_number().over(same.orderBy("copies"))).where("copies > 0")
    taken = keyed.join(once, on(keyed, once)).select("doc", "copies").unionByName(repeated.join(counted, on(repeated, counted, "nth")).select("doc", "copies"))
    return taken.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).select("doc.*")
