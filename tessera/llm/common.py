"""Helpers that the training-text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import tables
from tessera.sources.tables import workspace


#: Rows of text that go to Python at a time: long texts are to fit in a worker's memory.
TEXT_ROWS = 1000


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs that run inside, and for no others of the session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if rows is not None and (int(before) > rows or int(before) <= 0):
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lost executors don't bring its computation back.

    batch_rows bounds the rows that go to Python at a time on the way.
    """
    with batches_of(df.sparkSession, batch_rows):
        return tables.written(df, name)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df as a table in the shared folder, dealt out and sorted by `key`, so that joins on it don't move its rows again."""
    spark = df.sparkSession
    parts, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"tessera_{name}_{uuid.uuid4().hex}"
    path = f"{workspace(spark)}/tessera/{table}"
    df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    out.written_to, out.written_as = path, table
    return out


def removed(*these: DataFrame | None) -> None:
    """Removes tables that written() and bucketed() made, once nothing reads them any more."""
    for df in these:
        if name := getattr(df, "__dict__", {}).get("written_as"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    tables.removed(*these)


def fresh(df: DataFrame, name: str) -> str:
    """name, or with as many underscores after it as make it no column of df."""
    there = {c.lower() for c in df.columns}
    while name in there:
        name += "_"
    return name


def named(name: str) -> Column:
    """The column of just this name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text"):
    """The text, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))
