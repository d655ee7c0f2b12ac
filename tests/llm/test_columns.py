"""What operators do with columns whose names clash with their own, and with empty tables of such columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .data import SCHEMA, rows

NAMES = ["key", "KEY_", "__key", "__of", "__found", "__kept", "__gone", "of", "gone", "longest", "all", "row", "spans", "base", "more", "mark", "unit2", "label", "class_id", "kept", "c0", "c1", "own", "p", "a.b", "with `tick`", "text.x", "docs.key", "part", "n", "host"]


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("labelled"))
    texts = [f"document number {k} has some words of its own\nand a second line {k % 3} that others have too, mail a{k}@b.com" for k in range(12)]
    docs = spark.createDataFrame(rows(texts + texts[:2] + [None, ""]), SCHEMA)
    docs = docs.select("*", *[F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias(name) for name in NAMES])
    spark.createDataFrame([(k, k % 2, 0) for k in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, folder


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_keep_columns_of_any_name(spark, clashing, name, stage):
    docs, folder = clashing
    out = stage(spark, docs, folder)
    if name == "best_fit_packing":
        assert out.count() == docs.count()
        return
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r[n] == f"v{r['doc_id']}" for r in got for n in NAMES)
    assert stage(spark, docs.limit(0), folder).count() == 0


@pytest.mark.parametrize("name", ["bpe", "counts", "fingerprints", "language", "licences"])
def test_operators_ignore_columns_of_any_name(spark, clashing, name):
    import public_tokenizers

    from tessera.llm import bpe, counts, fingerprints, language, licences

    use = {
        "bpe": lambda d: bpe.encode(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
        "counts": lambda d: counts.token_counts(d, public_tokenizers.path("byte_bpe_50k.json")),
        "fingerprints": fingerprints.fingerprinted,
        "language": language.identify,
        "licences": licences.scan,
    }[name]
    docs, _ = clashing
    plain = use(docs.select("doc_id", "text", "lang"))
    got = use(docs).select(plain.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
