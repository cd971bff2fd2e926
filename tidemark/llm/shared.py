"""Helpers that the operators of this subpackage have in common."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise, remove, shared_dir, ship_package  # noqa: F401  for the operators

#: ASCII white space of the word and line rules, x20 and x09 to x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def free_name(wanted: str, columns: list[str]) -> str:
    """``wanted``, with underscores before it until no column has it, whatever the case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is the fast way where all bytes are ASCII; other texts are
    translated, so that letters outside A-Z stay as they are.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def in_training(doc_id: Column) -> Column:
    """Rows from which labels may be learned: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def held_out(doc_id: Column) -> Column:
    """Rows kept for judging; a row without an id is neither learned from nor held out."""
    return F.coalesce(~in_training(doc_id), F.lit(False))


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` after making this package importable in the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(work, schema)


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices, so that what is made of one is small beside what holds it."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.slice(lo, rows)
