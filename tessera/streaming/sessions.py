"""Structured Streaming: aliases and dictionary caches as keyed state, duplicate documents, and a graph that grows.

Aliases follow the order of arrival across batches and that of `seq` inside a batch, so that a stream whose batches keep
documents in order gives the numbers that a batch run over the same documents gives.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import entities

from .state import ALIASES, ROCKSDB, cached_lookups, numbered
from .store import GraphStore

__all__ = ["ALIASES", "ROCKSDB", "GraphStore", "cached_lookups", "file_stream", "numbered", "record_each", "with_alias", "without_copies"]


def with_alias(numbers: DataFrame) -> DataFrame:
    return numbers.withColumn("alias", entities.generic_alias(F.col("type"), F.col("n")))


def without_copies(docs: DataFrame, at: str, delay: str = "1 hour") -> DataFrame:
    """docs as a stream, each fingerprint once within `delay` of event time."""
    return docs.withColumn("fingerprint", T.fingerprint(F.coalesce("text", F.lit("")))).withWatermark(at, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def record_each(store: GraphStore, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: split gives a batch's new documents and the entities found in them."""

    def record(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            store.record(number, *split(batch))
        finally:
            batch.unpersist()

    return record


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(os.fspath(path))
