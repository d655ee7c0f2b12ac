"""The corpus pipeline: its stages, run one after another over documents.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns
of documents, with n_chars following the text; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rewritten(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs in these columns, n_chars counted anew where there is one."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long")))
    return docs.select(*["`" + c.replace("`", "``") + "`" for c in columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tessera.llm import quality

    return quality.good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tessera.llm import lines

    return rewritten(lines.dedup(docs), docs.columns)


def order_minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tessera.llm import near

    return near.one_of_each(docs, wordless=True)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tessera.llm import pii as module

    return rewritten(module.masked(docs), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm import packing

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("order_minhash", order_minhash),
    ("pii", pii),
    ("best_fit_packing", best_fit_packing),
]
#: Byte-pair encoding and alignment have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written and read again."""
    from tessera.llm import common

    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
