"""Parquet tables: reading them, dealing small ones out to all cores, and tables in between that a plan reads again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df on all cores: a small file has few row groups, and regular expressions need time. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Characters of texts that one task works on together; fewer, down to the second, where cores would have nothing to do.
TOGETHER, APART = 2_000_000, 50_000


def parts_of(df: DataFrame, *text: str) -> int:
    """In how many parts rows made from df's text columns are worked on, so that what a task sorts doesn't grow with the table."""
    total = df.agg(F.sum(sum(F.coalesce(F.length(c), F.lit(0)).cast("long") for c in text))).first()[0] or 0
    return max(1, -(-total // TOGETHER), min(df.sparkSession.sparkContext.defaultParallelism, total // APART))


#: Rows that one task sorts together.
SORTED = 500_000


def dealt(df: DataFrame, *by: str, rows: int | None = None) -> DataFrame:
    """df by the columns `by` in parts of about SORTED rows, so that what a task sorts doesn't grow with the table, however
    small its files or shuffled rows are. The rows are counted unless their number is given."""
    rows = df.count() if rows is None else rows
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // SORTED)), *by)


def workspace(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir. In local mode one is made where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


@contextmanager
def shuffled(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles of what is planned meanwhile have parts of about SORTED of so many rows, if those of the session are larger."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, max(int(before), -(-rows // SORTED)))
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """df as a Parquet table in the shared folder: what reads it several times doesn't compute it again.

    `rows`, where it is given, is how many are shuffled on the way: what a task sorts doesn't grow with their number.
    """
    path = f"{workspace(df.sparkSession)}/tessera/{name}-{uuid.uuid4().hex}"
    with shuffled(df.sparkSession, rows):
        df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def removed(*tables: DataFrame | None) -> None:
    """Removes tables that written() made, once nothing reads them any more."""
    for table in tables:
        if path := getattr(table, "__dict__", {}).get("written_to"):
            spark = table.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
