"""A training-corpus pipeline: five stages over the documents, each written and read again."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import lang_id, line_dedup, mixing, packing, simhash
from tidemark.session import remove, shared_dir
from tidemark.sources.tables import table

STAGES = [
    ("language_id", lang_id.keep_identified),
    ("line_dedup", line_dedup.drop_lines),
    ("simhash_near_dedup", simhash.keep_one),
    ("mixing", mixing.take_mix),
    ("packing", packing.pack_documents),
]

#: Language ID, mixing and packing have no SQL form.
ORACLE_SQL = None


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder; nothing happens where the session has ended and its folder with it."""
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001
        return


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written as Parquet and reread.

    A stage's folder goes when the next stage has been written, the last one
    when the driver's Python ends.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    root = f"{shared_dir(spark)}/tidemark/pipeline-{uuid.uuid4().hex}"
    atexit.register(discard, spark, root)
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
