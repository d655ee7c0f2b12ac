"""The whole way from texts to anonymised texts: analysis and lookups once, each as a table, and plans over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lexicon import DEFAULT, Lexicon
from tessera.operators import detect, entities, lookups, rewrite
from tessera.sources import tables


@dataclass(frozen=True)
class Options:
    """jurisdictions: None for that of each document's language, empty for all; style: generic or realistic."""

    style: str = "generic"
    jurisdictions: list[str] | None = None
    lexicon: Lexicon = DEFAULT


@dataclass(frozen=True)
class Anonymized:
    """texts: docs with language and anonymized; entities: doc_id, session_id, text, start, end, type, confidence, sources, alias; aliases: session_id, original, alias, type."""

    texts: DataFrame
    entities: DataFrame
    aliases: DataFrame


def no_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], lookups.DICTIONARY)


def found_entities(
    docs: DataFrame, dictionary: DataFrame | None = None, options: Options = Options(), keep: list[str] | None = None, cache: DataFrame | None = None, now: Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(languages with the columns `keep`, entities of groups, entities after merging) of docs (doc_id, text).

    Documents are analysed once and groups are looked up once: both results are tables that all else reads.
    """
    keep = [] if keep is None else keep
    table = tables.written(detect.analysed(docs, keep, options.lexicon), "analysed")
    languages = table.select("doc_id", *keep, "language")
    dictionary = no_dictionary(docs.sparkSession) if dictionary is None else dictionary
    of = None
    if options.jurisdictions is None:
        of = table.select("doc_id", F.array("language").alias("jurisdictions"))
    elif options.jurisdictions:
        dictionary = dictionary.where(F.col("jurisdiction").isin(options.jurisdictions))
    asked = table.agg(F.sum(F.aggregate("groups", F.lit(0), lambda n, g: n + 1 + F.size(g["words"])).cast("long"))).first()[0] or 0
    found = tables.written(entities.typed(entities.classified(detect.groups(table), dictionary, of, cache, now)), "entities", asked)
    return languages, found, entities.merged(found)


def anonymize(
    docs: DataFrame, dictionary: DataFrame | None = None, options: Options = Options(), known: DataFrame | None = None, cache: DataFrame | None = None, now: Column | None = None
) -> Anonymized:
    """docs: doc_id (unique, not null), text, and optionally session_id and doc_ord; without them every document is its own session.

    Aliases are the same throughout a session and numbered in the order of doc_ord. known (session_id, original, alias)
    holds aliases of earlier runs; cache (term, results, expires_at) answers of earlier lookups, which count up to `now`.
    Null texts stay null.
    """
    if "session_id" not in docs.columns:
        docs = docs.withColumn("session_id", F.col("doc_id").cast("string"))
    if "doc_ord" not in docs.columns:
        docs = docs.withColumn("doc_ord", F.col("doc_id") if dict(docs.dtypes)["doc_id"] in ("bigint", "int") else F.lit(0))
    languages, first, final = found_entities(docs.select("doc_id", "text", "session_id", "doc_ord"), dictionary, options, ["session_id", "doc_ord"], cache, now)
    sessions = languages.select("doc_id", "session_id", "doc_ord")
    found = first.count()
    final = tables.written(final, "merged", found)
    aliases = tables.written(entities.alias_map(entities.requests(first, final, sessions), options.style, known), "aliases", found)
    final = entities.with_aliases(final, sessions, aliases)
    # Languages and spans of a document meet first, so that texts move once.
    spans = final.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "alias")).alias("spans"))
    beside = languages.select("doc_id", "language").join(spans, "doc_id", "left")
    texts = docs.join(beside, "doc_id", "left").withColumn("anonymized", F.when(F.col("spans").isNull(), F.col("text")).otherwise(rewrite.spliced(F.col("text"), F.col("spans"))))
    texts = texts.withColumn("language", F.coalesce("language", F.lit(next(iter(options.lexicon.stop_words))))).drop("spans")
    return Anonymized(texts, final, aliases)


def alias_rows(result: Anonymized) -> DataFrame:
    """session_id, original, alias, type, confidence: the alias table as it is exported, one row for each original."""
    return result.entities.groupBy("session_id", F.col("text").alias("original")).agg(F.first("alias").alias("alias"), F.min_by("type", F.struct("doc_id", "start")).alias("type"), F.min_by("confidence", F.struct("doc_id", "start")).alias("confidence"))
