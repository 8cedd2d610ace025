"""Settings that operators read from the running session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can read and write.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset on a local master (tests
    on one machine) a temporary folder is made and remembered in the session; elsewhere it is an error.
    """
    folder = spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set(CHECKPOINT_KEY, folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """The part of the shared folder that is this application's."""
    return f"{shared_folder(spark)}/gridloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote into the shared folder: call it when all results are stored."""
    remove_path(spark, scratch_folder(spark))


def write_through(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` at a written table in the shared folder and read it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path that this package wrote, through the file system it lies on."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_rows(df: DataFrame, name: str) -> DataFrame:
    """Rows of a query with a limit, ready to be collected.

    Collecting an ordered limit directly would send the first rows of every partition to the
    driver; written first, they are merged by an executor and the driver reads the limit only.
    """
    return write_through(df, name)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, unless they find it through PYTHONPATH.

    Arrow UDFs name functions of the package, so each Python worker must be able to import it.
    """
    package = Path(__file__).resolve().parent
    context = spark.sparkContext
    on_path = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if package.parent in on_path or context.applicationId in _SHIPPED:
        return
    # the archive is read by the driver only, which serves it to the executors
    folder = urlparse(shared_folder(spark))
    place = Path(folder.path) if folder.scheme == "file" else Path(tempfile.mkdtemp(prefix="gridloom-"))
    place.mkdir(parents=True, exist_ok=True)
    archive = place / f"gridloom-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent).as_posix())
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
