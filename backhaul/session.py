"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import zipfile
from contextlib import contextmanager
from functools import cache
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # All timestamps are zone-less wall-clock values; arithmetic on them must not meet DST.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}

# Where the session does not say otherwise: tasks stay small however large the tables, so that they sort
# and fold in memory (AQE merges partitions that turn out smaller), and files take little space.
SIZES = {
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.parquet.compression.codec": "zstd",
}
# Partitions a shuffle starts with, at least. Up to this many, rows go straight to files, unsorted.
PARTITIONS = 200


# Where the session does not say otherwise, for queries over tables: the JVM interprets methods of more than 8000
# bytes for good, such as those that clean many columns. Spark then generates several smaller ones instead.
METHODS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def configure(spark: SparkSession, sizes: dict[str, str] = SIZES) -> SparkSession:
    """Apply the settings every job here relies on, and sizes of tasks that the session leaves open."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    for key, value in sizes.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if spark.conf.get(first, None) is None:
        spark.conf.set(first, str(max(PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return spark


def configure_tables(spark: SparkSession) -> SparkSession:
    """`configure` for jobs and queries over tables, whose stages may clean many columns at once."""
    return configure(spark, SIZES | METHODS)


@cache
def _package_zip() -> str:
    """This package as a zip file on the driver, for `addPyFile`."""
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="backhaul-")) / "backhaul.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    return str(path)


def ship(spark: SparkSession) -> SparkSession:
    """Let executors import this package; needed once per context by Python code on executors."""
    context = spark.sparkContext
    if not any(file.endswith("/backhaul.zip") for file in context.listFiles):
        context.addPyFile(_package_zip())
    return spark


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="backhaul-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the cluster's shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that every executor can reach")
        base = _local_scratch()
    return f"{base.rstrip('/')}/{label}-{uuid4().hex}"


@contextmanager
def staged(df: DataFrame, label: str):
    """`df` written once to scratch and read back; its files go at the end."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to scratch and read it back: cuts lineage and survives executor loss."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
