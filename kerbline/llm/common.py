"""Shared folder, written intermediates and reading of tables."""

import os
import pathlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kerbline.session import cut_lineage

#: White space between words, as bytes: the words of every operator here are the runs of other bytes.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors reach; a folder of our own only on a local master without the setting."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        cut_lineage(spark.range(1))
    return context.getCheckpointDir()


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends there, columns and filters still reach the scan.

    The shuffles that made the frame are deleted once it is written, since nothing reads them again.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(frame.schema).parquet(path)
    out.written_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete written intermediates of which everything that is still wanted has been written elsewhere."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.written_at)
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def find_package(spark: SparkSession) -> None:
    """Python workers look for this package where the driver has it, as well; harmless if that folder isn't there."""
    here = str(pathlib.Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if here not in known:
        environment["PYTHONPATH"] = os.pathsep.join([here, *filter(None, known)])


def map_batches(frame: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function of this package."""
    find_package(frame.sparkSession)
    return frame.mapInArrow(function, schema)


#: A side of at most so many rows of a few numbers is broadcast: some 30 MB.
BROADCAST_ROWS = 500_000


def join_checked(left: DataFrame, right: DataFrame, on: str, how: str) -> DataFrame:
    """Join with a written, narrow ``right``: it is broadcast if its counted rows are few, else both sides are shuffled."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on, how)
