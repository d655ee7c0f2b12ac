"""Dictionaries and what surrounds their lookups: decoys, a cache with expiry, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T

from .entities import DECOY_RATIO, MAX_BATCH

DICTIONARY = "term string, dict string, match boolean, type string, jurisdiction string, confidence string, metadata map<string,string>, ord int"
CACHE_HOURS = 24


def lookup(terms: DataFrame, dictionary: DataFrame, jurisdictions: list[str] | None = None) -> DataFrame:
    """The entries of each term; no jurisdictions means all of them."""
    entries = dictionary.where(F.col("jurisdiction").isin(jurisdictions)) if jurisdictions else dictionary
    return terms.join(entries, "term")


def dictionaries(dictionary: DataFrame) -> DataFrame:
    """dict, jurisdiction, type, entry_count, updated_at (null where the dictionary has no such column)."""
    updated = F.max("updated_at") if "updated_at" in dictionary.columns else F.lit(None).cast("timestamp")
    return dictionary.groupBy("dict", "jurisdiction", "type").agg(F.count("*").alias("entry_count"), updated.alias("updated_at"))


def decoy_counts(batches: DataFrame, ratio: float = DECOY_RATIO, max_batch: int = MAX_BATCH) -> DataFrame:
    """shard, batch, real, decoys: how many decoys each batch gets; real terms are never dropped."""
    sizes = batches.groupBy("shard", "batch").agg(F.count("*").alias("real"))
    wanted = F.ceil(F.col("real") * F.lit(ratio))
    return sizes.withColumn("decoys", F.least(wanted, F.greatest(F.lit(0), F.lit(max_batch) - F.col("real"))).cast("long"))


def decoy(*of: Column) -> Column:
    """A first name (40 %), surname (30 %) or company (30 %), the same for the same columns."""
    roll = F.pmod(F.xxhash64(*of, F.lit("roll")), F.lit(100))
    names = (L.FIRST_NAMES + L.NEUTRAL_NAMES).split()
    return F.when(roll < 40, T.picked(names, *of)).when(roll < 70, T.picked(L.SURNAMES.split(), *of)).otherwise(T.picked(L.COMPANY_NAMES.split(), *of))


def with_decoys(batches: DataFrame, seed: int, ratio: float = DECOY_RATIO, max_batch: int = MAX_BATCH) -> DataFrame:
    """shard, batch, term, real, place: each batch with its decoys, in an order that a hash of seed shuffles."""
    counts = decoy_counts(batches, ratio, max_batch).where("decoys > 0")
    made = counts.select("shard", "batch", F.explode(F.sequence(F.lit(1), F.col("decoys").cast("int"))).alias("nth"))
    made = made.select("shard", "batch", decoy(F.col("shard"), F.col("batch"), F.col("nth"), F.lit(seed)).alias("term"), F.lit(False).alias("real"), "nth")
    rows = batches.select("shard", "batch", "term", F.lit(True).alias("real"), F.lit(0).alias("nth")).unionByName(made)
    return rows.withColumn("place", F.xxhash64("term", "nth", F.lit(seed))).drop("nth")


def real_results(results: DataFrame, real: DataFrame) -> DataFrame:
    """Results of terms that were asked for, decoys' results left out; by batch where both have batches."""
    key = [c for c in ("shard", "batch", "term") if c in results.columns and c in real.columns]
    return results.join(real.select(*key), key, "left_semi")


def cache_put(cache: DataFrame, rows: DataFrame, hours: int = CACHE_HOURS) -> DataFrame:
    """cache with rows (term, results, at); the latest of a term counts. Entries expire hours after `at`."""
    fresh = rows.groupBy("term").agg(F.max_by("results", "at").alias("results"), F.max("at").alias("at"))
    fresh = fresh.select("term", "results", (F.col("at") + F.expr(f"INTERVAL {hours} HOURS")).alias("expires_at"))
    return cache.join(fresh.select("term"), "term", "left_anti").unionByName(fresh)


def cache_get(cache: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (term, at, ...) with results where the cache has them: an entry counts up to and at its expiry."""
    rows = cache.select("term", "results", "expires_at")
    return probes.join(rows, (probes["term"] == rows["term"]) & (probes["at"] <= rows["expires_at"]), "left").select(probes["*"], "results")


def cache_sweep(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > now)


def cache_misses(groups: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """The terms to look up: words of groups whose text isn't cached and that aren't cached themselves."""
    live = cache.where(F.col("expires_at") >= now).select("term")
    open_ = groups.where("not skip").join(live.withColumnRenamed("term", "text"), "text", "left_anti")
    return open_.select(F.explode("words").alias("term")).distinct().join(live, "term", "left_anti")
