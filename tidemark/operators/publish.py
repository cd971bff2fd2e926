"""Atomic publication through the file system: what is published appears whole, once, or not at all."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import remove


def _place(spark: SparkSession, path: str):
    """The path, its file system, and whether that is the machine's own."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(target), fs, fs.getUri().getScheme() == "file"


def _is_taken(wrong: Py4JJavaError) -> bool:
    """Whether a call failed because the name is taken: by a file, or by a folder that is not empty."""
    said, cause = wrong.java_exception, wrong.java_exception.getCause()
    names = " ".join(x.getClass().getSimpleName() for x in (said, cause) if x is not None)
    return "AlreadyExists" in names or "NotEmpty" in names or "Directory not empty" in str(said.getMessage())


def move_if_absent(spark: SparkSession, source: str, target: str) -> bool:
    """Give a file or a folder with content its name, if nothing has it yet; one atomic step of the file system.

    Of several writers one gets True, whatever their timing. On a distributed
    file system the rename without overwriting is atomic. The local one's
    rename replaces a file, so a file gets its name there by a link, and a
    folder by a move, which fails where a folder with content stands.
    """
    jvm = spark.sparkContext._jvm
    (a, fs, local), (b, _, _) = _place(spark, source), _place(spark, target)
    fs.mkdirs(b.getParent())
    try:
        if not local:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(a, b, options)
            return True
        from_, to = (jvm.java.nio.file.Paths.get(x.toUri()) for x in (a, b))
        if fs.getFileStatus(a).isDirectory():
            options = spark.sparkContext._gateway.new_array(jvm.java.nio.file.CopyOption, 1)
            options[0] = jvm.java.nio.file.StandardCopyOption.ATOMIC_MOVE
            jvm.java.nio.file.Files.move(from_, to, options)
        else:
            jvm.java.nio.file.Files.createLink(to, from_)
            fs.delete(a, False)
        return True
    except Py4JJavaError as wrong:
        if _is_taken(wrong):
            return False
        raise


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in whatever file system; not atomic, for names that nobody else knows."""
    target, fs, _ = _place(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    target, fs, _ = _place(spark, path)
    source = fs.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def hidden(path: str) -> str:
    """A name beside ``path`` that readers of tables pass over."""
    head, _, tail = path.rstrip("/").rpartition("/")
    return f"{head}/_{tail}-{uuid.uuid4().hex}"


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole unless its name is taken; True for the one writer that did."""
    staged = hidden(path)
    write_text(spark, staged, text)
    won = move_if_absent(spark, staged, path)
    if not won:
        remove(spark, staged)
    return won


def replace_json(spark: SparkSession, path: str, value: object) -> None:
    """A small JSON file that readers see as it was or as it is, never in between."""
    jvm, staged = spark.sparkContext._jvm, hidden(path)
    write_text(spark, staged, json.dumps(value, ensure_ascii=False, indent=2))
    (a, fs, local), (b, _, _) = _place(spark, staged), _place(spark, path)
    if local:
        options = spark.sparkContext._gateway.new_array(jvm.java.nio.file.CopyOption, 2)
        options[0], options[1] = jvm.java.nio.file.StandardCopyOption.ATOMIC_MOVE, jvm.java.nio.file.StandardCopyOption.REPLACE_EXISTING
        jvm.java.nio.file.Files.move(*(jvm.java.nio.file.Paths.get(x.toUri()) for x in (a, b)), options)
        return
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "OVERWRITE")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(a, b, options)


def publish(rows: DataFrame, path: str, kind: str = "parquet") -> bool:
    """Write a table under a hidden name and give it its own name if nothing has it; True if this call did.

    A writer that dies leaves a hidden folder and no table; a job that is
    retried, or one of two that race, finds the name taken and changes nothing.
    """
    spark, staged = rows.sparkSession, hidden(path)
    rows.write.format(kind).option("compression", "zstd" if kind == "parquet" else "gzip").save(staged)
    won = move_if_absent(spark, staged, path)
    if not won:
        remove(spark, staged)
    return won
