"""What a reading task holds before a shuffle does not grow with the table's files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.sources import tables

KEY = "spark.sql.files.maxPartitionBytes"


def test_dealt_out_rows_are_read_in_small_pieces(spark, tmp_path):
    spark.conf.unset(KEY)
    path = f"file://{tmp_path}/wide.parquet"
    wide = spark.range(5_000).repartition(4).select("id", F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(i)), 512) for i in range(250)]).alias("text"))
    wide.write.option("parquet.block.size", 1 << 20).parquet(path)
    rows = spark.read.parquet(path)
    assert rows.rdd.getNumPartitions() <= 4  # the engine's own pieces
    tables.dealt_by(rows, "id")
    size = sum(f.stat().st_size for f in (tmp_path / "wide.parquet").glob("*.parquet"))
    assert size > 64 << 20 and spark.read.parquet(path).rdd.getNumPartitions() >= size >> 24


def test_a_limit_of_the_session_stays(spark):
    spark.conf.set(KEY, "99000000")
    tables.dealt_by(spark.range(10), "id")
    assert spark.conf.get(KEY) == "99000000"
    spark.conf.unset(KEY)
