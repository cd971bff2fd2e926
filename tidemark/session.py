"""Session defaults used by the benchmark, the tests and local runs."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the queries are written for.

    On a cluster the caller brings its own session; nothing in the library
    depends on the values chosen here except the UTC time zone.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def small_methods(spark: SparkSession) -> None:
    """Let steps with very many expressions run as compiled parts.

    The JVM never compiles a method of over 8,000 bytes, so that a generated
    one of that size is interpreted row by row. With this limit Spark generates
    such a step in parts. A limit that the session has set itself stays.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def small_splits(spark: SparkSession) -> None:
    """Let a task read 16 MB of a table's files at most.

    A shuffle to over 200 tasks sorts in memory what a reading task has, and
    128 MB of narrow, packed columns are some 16 million rows. A limit that
    the session has set itself stays.
    """
    if spark.conf.get("spark.sql.files.maxPartitionBytes", "134217728") == "134217728":
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(16 << 20))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once for each application.

    The package is zipped and added as a Python file, which Spark distributes
    to the executors; a caller who submits with ``--py-files`` loses nothing.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidemark-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the session names in ``spark.checkpoint.dir``. Only where
    that is unset, as in local tests, a folder is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, which goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"

    def tidy() -> None:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session has gone, and its folder with it
            return

    atexit.register(tidy)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage and lets several consumers use one computation; a
    lost executor loses nothing, since the files are in the shared folder.
    The table is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
