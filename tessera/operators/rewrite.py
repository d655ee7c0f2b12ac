"""Substitution of entities in texts, restoration from alias tables, and what review does to entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

TO_END = 1 << 30


def spliced(text: Column, entities: Column) -> Column:
    """text with each entity's span replaced by its alias, the last span first. entities: (start, end, alias).

    Spans that overlap are spliced one after another, by positions in the original text. Without overlaps the result is
    the gaps and aliases in turn, which doesn't copy the text for each entity.
    """
    ordered = F.array_sort(F.transform(entities, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["alias"].alias("alias"))))

    def joined(of: Column) -> Column:
        gap = lambda e, k: F.when(k == 0, F.substring(text, 1, e["start"])).otherwise(F.substring(text, F.get(of, k - 1)["end"] + 1, e["start"] - F.get(of, k - 1)["end"]))
        last = F.coalesce(F.get(of, F.size(of) - 1)["end"], F.lit(0))
        return F.concat(F.array_join(F.transform(of, lambda e, k: F.concat(gap(e, k), e["alias"])), ""), F.substring(text, last + 1, F.lit(TO_END)))

    def folded(of: Column) -> Column:
        return F.aggregate(F.reverse(of), text, lambda acc, e: F.concat(F.substring(acc, F.lit(1), e["start"]), e["alias"], F.substring(acc, e["end"] + 1, F.lit(TO_END))))

    def either(of: Column) -> Column:
        crossed = F.exists(F.transform(of, lambda e, k: (k > 0) & (F.get(of, k - 1)["end"] > e["start"])), lambda x: F.coalesce(x, F.lit(False)))
        return F.when(crossed, folded(of)).otherwise(joined(of))

    return F.get(F.transform(F.array(ordered), either), F.lit(0))


def substituted(docs: DataFrame, entities: DataFrame, alias: str = "alias") -> DataFrame:
    """docs with `anonymized`; entities: doc_id, start, end and the alias column. Null texts stay null."""
    found = entities.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", F.col(alias).alias("alias"))).alias("entities"))
    rows = docs.join(found, "doc_id", "left")
    return rows.withColumn("anonymized", F.when(F.col("entities").isNull(), F.col("text")).otherwise(spliced(F.col("text"), F.col("entities")))).drop("entities")


def alias_tables(entities: DataFrame) -> DataFrame:
    """doc_id, aliases (map of text to alias); of entities with equal text the last one by position counts."""
    last = entities.groupBy("doc_id", "text").agg(F.max_by("alias", F.struct("start", "pass", "ord")).alias("alias"), F.min("start").alias("first"))
    pairs = F.array_sort(F.collect_list(F.struct("first", "text", "alias")))
    return last.groupBy("doc_id").agg(F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["text"], p["alias"]))).alias("aliases"))


def restored(text: Column, pairs: Column) -> Column:
    """text with aliases replaced by originals, longer aliases first, then in table order. pairs: array of (original, alias).

    Of pairs with one alias the last counts, in the place of the first. Empty aliases are left out.
    """

    def replaced(of: Column) -> Column:
        kept = F.filter(F.transform(of, lambda p, k: F.struct((-F.length(p["alias"])).alias("size"), k.alias("nth"), p["alias"].alias("alias"), p["original"].alias("original"))), lambda x: x["size"] < 0)
        # Equal aliases stand side by side in this order: each run gives its first row's place and its last row's original.
        runs = F.array_sort(F.transform(kept, lambda x: F.struct(x["alias"].alias("alias"), x["nth"].alias("nth"), x["size"].alias("size"), x["original"].alias("original"))))
        return F.get(F.transform(F.array(runs), once), F.lit(0))

    def once(runs: Column) -> Column:
        first = F.filter(runs, lambda x, k: ~F.coalesce(F.get(runs, k - 1)["alias"] == x["alias"], F.lit(False)))
        last = F.filter(runs, lambda x, k: ~F.coalesce(F.get(runs, k + 1)["alias"] == x["alias"], F.lit(False)))
        final = F.zip_with(first, last, lambda x, y: F.struct(x["size"].alias("size"), x["nth"].alias("nth"), x["alias"].alias("alias"), y["original"].alias("original")))
        return F.aggregate(F.array_sort(final), text, lambda acc, x: F.replace(acc, x["alias"], x["original"]))

    return F.get(F.transform(F.array(pairs), replaced), F.lit(0))


def restore(docs: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """docs with `restored`; table: key, original, alias, ord (the row's place in its table)."""
    pairs = table.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "original", "alias"))).alias("__pairs"))
    rows = docs.join(pairs, key, "left")
    return rows.withColumn("restored", F.when(F.col("__pairs").isNull(), F.col("text")).otherwise(restored(F.col("text"), F.col("__pairs")))).drop("__pairs")


def pattern_of(terms: Column) -> Column:
    """A case-insensitive alternation of literal terms, longer ones first."""
    longer = F.array_sort(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("size"), t.alias("term"))))
    quoted = F.transform(longer, lambda t: F.concat(F.lit("\\Q"), F.replace(t["term"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.concat(F.lit("(?iu)("), F.array_join(quoted, "|"), F.lit(")"))


def replaced_terms(text: Column, pairs: Column) -> Column:
    """Every occurrence of a term, in any case, replaced by its alias in one go. pairs: array of (text, alias).

    Longer terms win; of terms equal but for case the last one counts; pairs whose alias is the term are left out.
    """

    def cut(of: Column) -> Column:
        pattern = pattern_of(F.transform(of, lambda p: p["text"]))
        gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
        named = F.transform(found, lambda m: F.coalesce(F.get(F.reverse(F.filter(of, lambda p: F.lower(p["text"]) == F.lower(m))), F.lit(0))["alias"], m))
        return F.concat(F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), named.alias("n")), lambda x: F.array(x["g"], F.coalesce(x["n"], F.lit(""))))), ""))

    kept = F.filter(pairs, lambda p: p["alias"].isNotNull() & (p["alias"] != p["text"]) & (p["text"] != ""))
    return F.get(F.transform(F.array(kept), lambda of: F.when(F.size(of) > 0, cut(of)).otherwise(text)), F.lit(0))


def highlighted(text: Column, terms: Column) -> Column:
    """Terms in any case wrapped in <mark>. terms: array of strings."""
    return F.when(F.size(terms) > 0, F.regexp_replace(text, pattern_of(terms), F.lit("<mark>$1</mark>"))).otherwise(text)


def unhighlighted(text: Column) -> Column:
    return F.regexp_replace(text, r"</?mark(?:\s[^>]*)?>", "")


# Review ---------------------------------------------------------------------------------------------------------------


def review_groups(entities: DataFrame) -> DataFrame:
    """doc_id, key (lower-case text), text and type of the first entity, count."""
    order = F.struct("start", "pass", "ord")
    return entities.groupBy("doc_id", F.lower("text").alias("key")).agg(F.min_by("text", order).alias("text"), F.min_by("type", order).alias("type"), F.count("*").alias("count"))


def chosen(entities: DataFrame, choices: DataFrame) -> DataFrame:
    """entities with `accepted`: the choice (key, alias) for their lower-case text, else the proposed alias."""
    rows = entities.withColumn("key", F.lower("text")).join(choices.select("key", F.col("alias").alias("choice")), "key", "left")
    return rows.withColumn("accepted", F.coalesce("choice", "alias")).drop("choice", "key")


def redacted(entities: DataFrame) -> DataFrame:
    return entities.withColumn("accepted", F.lit("[REDACTED]"))


def accept_all(entities: DataFrame) -> DataFrame:
    return entities.withColumn("accepted", F.coalesce("accepted", "alias"))


def skip_unconfirmed(entities: DataFrame) -> DataFrame:
    """Entities of low confidence keep their text."""
    return entities.withColumn("accepted", F.when(F.col("confidence") == "low", F.col("text")).otherwise(F.col("accepted")))


def review_output(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """docs with `anonymized` by the accepted aliases, the proposed ones where nothing or an empty alias was accepted."""
    final = F.coalesce(F.nullif(F.col("accepted"), F.lit("")), F.col("alias"))
    return substituted(docs, entities.withColumn("final", final), "final")


def review_counts(entities: DataFrame) -> DataFrame:
    """total, accepted (alias other than the text), skipped (alias equal to it) over all entities."""
    same = F.col("accepted") == F.col("text")
    return entities.agg(F.count("*").alias("total"), F.count_if(~same).alias("accepted"), F.count_if(same).alias("skipped"))


def review_rendered(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """docs with `rendered`: escaped text with every entity in brackets of its type; for entities that don't overlap."""
    found = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "type"))).alias("found"))
    rows = docs.join(found, "doc_id", "left")

    def drawn(of: Column) -> Column:
        before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(of, k - 1)["end"])
        piece = lambda a, b: T.html_escaped(F.substring(F.col("text"), a + 1, b - a))
        part = lambda e, k: F.concat(piece(before(k), e["start"]), F.lit("<span class=\""), e["type"], F.lit("\">"), piece(e["start"], e["end"]), F.lit("</span>"))
        return F.concat(F.array_join(F.transform(of, part), ""), T.html_escaped(F.substring(F.col("text"), F.get(of, F.size(of) - 1)["end"] + 1, F.lit(TO_END))))

    done = F.get(F.transform(F.array("found"), drawn), F.lit(0))
    return rows.withColumn("rendered", F.when(F.col("found").isNull(), T.html_escaped(F.col("text"))).otherwise(done)).drop("found")
