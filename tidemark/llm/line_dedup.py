"""Line deduplication over whole texts, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import BLANKS, ascii_lower, free_name, materialise

MIN_KEY_CHARS = 10
MIN_DOCUMENTS = 2


def line_key(line: Column) -> Column:
    """A line stripped of ASCII blanks at both ends, with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_key_chars: int = MIN_KEY_CHARS,
    min_documents: int = MIN_DOCUMENTS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Drop lines that ``min_documents`` or more documents hold, except in the smallest id.

    Returns ``doc_id, n_lines, n_dropped, text`` with one row per input row,
    and the input columns in ``keep`` as the fields of a struct ``kept``.

    Plan: explode the lines and hash their keys to 128 bits, write (document,
    position, hash) once, count documents per hash with map-side partial
    aggregates, join the hashes over the threshold back (skewed hashes are
    split by adaptive execution, since it is a plain join), collect the
    dropped positions per document, and join these to the texts, which cross
    the network once. A document's own positions are the only thing gathered.

    Defined cases: a null or empty text is one empty line; a key shorter than
    ``min_key_chars`` code points is never dropped; a line repeated inside its
    smallest document stays as often as it stands there; rows that share an id
    count as one document, and each of them is filtered by itself; a row whose
    id is null keeps all its lines and holds none for others; an empty table
    gives an empty result; columns besides the two named ones are not read.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("whole"),
        *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []),
    ).select(
        "doc_id",
        *(["kept"] if keep else []),
        F.xxhash64("whole").alias("row_hash"),
        F.split("whole", "\n", -1).alias("lines"),
    )
    key = line_key(F.col("line"))
    held = (
        base.where(F.col("doc_id").isNotNull())
        .select("doc_id", "row_hash", F.posexplode("lines").alias("pos", "line"))
        .where(F.char_length("line") >= min_key_chars)
        .select("doc_id", "row_hash", "pos", key.alias("line_key"))
        .where(F.char_length("line_key") >= min_key_chars)
        .select(
            "doc_id",
            "row_hash",
            "pos",
            F.xxhash64("line_key").alias("h1"),
            F.xxhash64(F.lit("second"), F.col("line_key")).alias("h2"),
        )
    )
    held = materialise(held, "line-hashes")
    first = F.min("doc_id").alias("first_id")
    if min_documents == 2:
        # Two or more documents hold a hash exactly if its least and greatest ids differ.
        common = held.groupBy("h1", "h2").agg(first, F.max("doc_id").alias("last_id")).where("first_id < last_id")
    else:
        by_doc = held.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        common = by_doc.groupBy("h1", "h2").agg(first, F.count("one").alias("n")).where(F.col("n") >= min_documents)
    # Written, so that the join's sides are plain exchanges, which adaptive execution can split at a hot hash.
    common = materialise(common.select("h1", "h2", "first_id"), "common-lines")
    dropped = (
        held.join(common, ["h1", "h2"])
        .where(F.col("doc_id") != F.col("first_id"))
        .groupBy("doc_id", "row_hash")
        .agg(F.collect_set("pos").alias("gone"))
    )
    joined = base.join(dropped, ["doc_id", "row_hash"], "left")
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(
        F.array_join(F.transform(stays, lambda i: F.get(F.col("lines"), i)), "\n")
    )
    return joined.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        text.alias("text"),
        *(["kept"] if keep else []),
    )


def digest(result: DataFrame) -> DataFrame:
    """The result with its text as a SHA-256 of the UTF-8 bytes."""
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def drop_lines(_spark: SparkSession, docs: DataFrame, _sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without the repeated lines; a null text stays null."""
    columns = docs.columns
    rest = [c for c in columns if c != "text"]
    flag = free_name("text_was_null", columns)
    found = dedup_lines(docs.withColumn(flag, F.col("text").isNull()), keep=(*rest, flag))
    text = F.when(~F.col(f"kept.{flag}"), F.col("text"))
    return found.select(*[(text if c == "text" else F.col(f"kept.`{c}`")).alias(c) for c in columns])


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), held AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM base
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM held
), common AS (
  SELECT line_key, min(doc_id) AS first_id FROM keyed WHERE length(line_key) >= 10
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.line_key IS NOT NULL AND k.doc_id <> c.first_id AS gone
  FROM keyed k LEFT JOIN common c USING (line_key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
