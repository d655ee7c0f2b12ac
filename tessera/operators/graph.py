"""The entity graph: known entities, the documents they occur in, and what a new document has in common with old ones.

Tables: entities (entity_id, canonical, type, first_seen, last_seen, document_count), occurrences (entity_id, document_id,
original, alias, confirmed), documents (document_id, label, processed_at, entity_count, fingerprint). All are plain
DataFrames; writes return the new table, with the latest row for each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources import tables

CO_ENTITIES = 5
#: Texts of a batch, and entities of a document, that are held together in one row at most.
CROWD = 1000
PAGE = 20


def entity_id(kind: Column, canonical: Column) -> Column:
    """The same id for the same type and canonical text, whenever it is made."""
    return F.concat(F.lit("ent_"), F.substring(F.sha2(F.concat_ws("|", kind, canonical).cast("binary"), 256), 1, 16))


def upserted(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table with rows added; rows replace those of the same key. Keys in rows must be unique."""
    if table.isEmpty():
        return rows.select(*table.columns)
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows)


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key by order."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("__last"))
    return last.select(*key, *[F.col("__last")[c].alias(c) for c in rest]).select(*rows.columns)


def by_canonical(entities: DataFrame, text: str) -> DataFrame:
    return entities.where(F.col("canonical") == F.upper(F.lit(text)))


def by_type(entities: DataFrame, kind: str) -> DataFrame:
    return entities.where(F.col("type") == kind)


def search(entities: DataFrame, prefix: str, limit: int = PAGE) -> DataFrame:
    """Entities whose canonical text begins with prefix, in order of it."""
    return entities.where(F.col("canonical").startswith(prefix.upper())).orderBy("canonical", "entity_id").limit(limit)


def list_documents(documents: DataFrame, limit: int = PAGE, offset: int = 0) -> DataFrame:
    return documents.orderBy(F.desc("processed_at"), "document_id").offset(offset).limit(limit)


def by_fingerprint(documents: DataFrame) -> DataFrame:
    """fingerprint, document_id: the first document with each fingerprint, and how many have it."""
    return documents.groupBy("fingerprint").agg(F.min("document_id").alias("document_id"), F.count("*").alias("copies"))


def occurrences_of(occurrences: DataFrame, entity: str) -> DataFrame:
    return occurrences.where(F.col("entity_id") == entity)


def document_occurrences(occurrences: DataFrame, documents: DataFrame) -> DataFrame:
    """The occurrences in some documents (document_id, unique)."""
    return occurrences.join(documents.select("document_id"), "document_id", "left_semi")


def confirmed(occurrences: DataFrame, pairs: DataFrame) -> DataFrame:
    """occurrences with `confirmed` set for the pairs (entity_id, document_id)."""
    marks = pairs.select("entity_id", "document_id").distinct().withColumn("mark", F.lit(True))
    rows = occurrences.join(marks, ["entity_id", "document_id"], "left")
    return rows.withColumn("confirmed", F.col("confirmed") | F.col("mark").isNotNull()).drop("mark")


def counts(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """entities, documents: the numbers of rows, in one row."""
    both = entities.select(F.lit(1).alias("e"), F.lit(0).alias("d")).unionByName(documents.select(F.lit(0).alias("e"), F.lit(1).alias("d")))
    return both.agg(F.coalesce(F.sum("e"), F.lit(0)).cast("long").alias("entities"), F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("documents"))


def with_canonical(found: DataFrame) -> DataFrame:
    """found with canonical, and given: the id that was given for it, if any."""
    given = F.col("known_id") if "known_id" in found.columns else F.lit(None).cast("string")
    return found.withColumn("canonical", T.canonical(F.col("text"))).withColumn("given", given)


def resolved(entities: DataFrame, new: DataFrame, found: DataFrame) -> DataFrame:
    """One row for an entity in a document, from which occurrences, sums and dates all follow. found has with_canonical()'s columns.

    `times` is how often the document has it. Only entities that go by another id than their text gives are joined with
    found, whose rows then move once, by document, into parts of bounded size.
    """
    own = entity_id(F.col("type"), F.col("canonical"))
    odd = None
    if not entities.isEmpty():  # else nothing to meet
        known = entities.groupBy("canonical", "type").agg(F.min("entity_id").alias("there"))
        odd = tables.written(known.where(F.col("there") != own), "odd")
    if odd is None or odd.isEmpty():
        found = found.withColumn("there", F.lit(None).cast("string"))
    else:
        found = found.join(odd, ["canonical", "type"], "left")
    found = found.withColumn("entity_id", F.coalesce("given", "there", own))
    found = found.groupBy("document_id", "entity_id").agg(
        F.max(F.struct("ord", "text", "alias")).alias("last"), F.min("canonical").alias("canonical"), F.min("type").alias("type"), F.max(F.col("given").isNotNull()).alias("was_given"), F.count("*").alias("times")
    )
    return found.join(new.select("document_id", "processed_at"), "document_id")


def changes(entities: DataFrame, occurrences: DataFrame, new: DataFrame, in_documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of entities, occurrences and documents that recording adds or changes. in_documents comes from resolved()."""
    sizes = in_documents.groupBy("document_id").agg(F.sum("times").alias("entity_count"))
    rows = new.join(sizes, "document_id", "left")
    documents = rows.select("document_id", "label", "processed_at", F.coalesce("entity_count", F.lit(0)).cast("int").alias("entity_count"), T.fingerprint(F.col("text")).alias("fingerprint"))
    fresh = in_documents.select("entity_id", "document_id", F.col("last.text").alias("original"), F.col("last.alias").alias("alias"), F.lit(False).alias("confirmed"))
    # Texts are keys first, so that hashing sums up all rows, and are sorted only where an entity has several.
    seen = in_documents.groupBy("entity_id", "canonical", "type").agg(F.min("processed_at").alias("first_now"), F.max("processed_at").alias("last_now"), F.max("was_given").alias("was_given"), F.count("*").alias("now"))
    seen = seen.groupBy("entity_id").agg(
        F.min(F.struct("canonical", "type")).alias("named"), F.min("first_now").alias("first_now"), F.max("last_now").alias("last_now"), F.max("was_given").alias("was_given"), F.sum("now").alias("now")
    )
    seen = seen.select("entity_id", "named.canonical", "named.type", "first_now", "last_now", "was_given", "now")
    if occurrences.isEmpty():
        before = occurrences.select("entity_id", F.lit(0).cast("long").alias("before"))
    else:
        again = occurrences.join(fresh.select("entity_id", "document_id"), ["entity_id", "document_id"], "left_anti")
        before = again.join(seen.select("entity_id"), "entity_id", "left_semi").groupBy("entity_id").agg(F.countDistinct("document_id").alias("before"))
    old = entities.select("entity_id", F.col("canonical").alias("old_canonical"), F.col("type").alias("old_type"), "first_seen")
    now = seen.join(old, "entity_id", "left").where(F.col("first_seen").isNotNull() | ~F.col("was_given")).join(before, "entity_id", "left")
    now = now.select(
        "entity_id", F.coalesce("old_canonical", "canonical").alias("canonical"), F.coalesce("old_type", "type").alias("type"),
        F.coalesce("first_seen", "first_now").alias("first_seen"), F.col("last_now").alias("last_seen"), (F.col("now") + F.coalesce("before", F.lit(0))).cast("int").alias("document_count"),
    )
    return now, fresh, documents


def recorded(entities: DataFrame, occurrences: DataFrame, documents: DataFrame, new: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after recording documents.

    new: document_id, label, text, processed_at, one row for each document; found: document_id, text, type, alias, ord, and
    optionally known_id. An entity is that of known_id, else the known one with its canonical text and type, else a new
    one; known ids that the graph doesn't have get occurrences and no entity. Documents are counted once for each entity.
    """
    found = with_canonical(found)
    in_documents = tables.written(resolved(entities, new, found), "found")
    now, fresh, changed = changes(entities, occurrences, new, in_documents)
    occurrences = upserted(occurrences, fresh.select(*occurrences.columns), ["entity_id", "document_id"])
    return upserted(entities, now.select(*entities.columns), ["entity_id"]), occurrences, upserted(documents, changed.select(*documents.columns), ["document_id"])


def matches(detected: DataFrame, entities: DataFrame, occurrences: DataFrame, documents: DataFrame) -> DataFrame:
    """For each detected (batch, text, type) that the graph knows: what it was called last, and where.

    batch, text, entity_id, confidence, previous_alias, previous_document, co_entities. The best known entity has the same
    type and was seen last, else it is the one of least id (`possible`); its last occurrence is that in the greatest
    document id, which the graph must have. co_entities are up to CO_ENTITIES others of that document by entity id; one of
    them among the batch makes the match `exact`, else it is `likely`.
    """
    asked = tables.written(detected.select("batch", "text", "type").distinct(), "asked")
    # What is asked for is looked up once for all batches, and what then moves for each batch are numbers: those of the text
    # and type (name) and of its canonical text (nth).
    names = asked.select("text", "type").distinct().withColumn("canonical", T.canonical(F.col("text")))
    names = tables.written(names.withColumn("name", F.monotonically_increasing_id()), "names")
    spelled = names.groupBy("canonical").agg(F.min("name").alias("nth"))
    known = entities.select("entity_id", "canonical", F.col("type").alias("known_type"), "last_seen")
    same = F.col("type") == F.col("known_type")
    best = names.select("canonical", "type").distinct().join(known, "canonical").groupBy("canonical", "type").agg(
        F.min_by(F.struct("entity_id", same.alias("same")), F.struct(~same, F.when(same, -F.unix_micros("last_seen")), "entity_id")).alias("best")
    )
    best = best.select("canonical", "type", "best.entity_id", "best.same")
    last = tables.dealt(occurrences.select("entity_id", "document_id", "alias"), "entity_id").groupBy("entity_id").agg(F.max_by(F.struct("document_id", "alias"), "document_id").alias("last"))
    best = best.join(last, "entity_id").select("canonical", "type", "entity_id", "same", "last.document_id", "last.alias")
    best = tables.written(best.join(documents.select("document_id"), "document_id", "left_semi"), "last-occurrences")
    others = occurrences.select("document_id", F.col("entity_id").alias("other"), F.col("original").alias("other_text"))
    others = others.join(best.select("document_id").distinct(), "document_id", "left_semi").withColumn("canonical", T.canonical(F.col("other_text")))
    others = tables.written(others.join(spelled, "canonical", "left").drop("canonical"), "others")
    sizes = others.groupBy("document_id").agg((F.count("*") > CROWD).alias("crowded"))
    mates = best.join(sizes.where(~F.col("crowded")), "document_id").join(others.where("nth IS NOT NULL"), "document_id").where(F.col("other") != F.col("entity_id"))
    mates = mates.groupBy("canonical", "type").agg(F.collect_set("nth").alias("mates"))
    looked = names.join(spelled, "canonical").join(best.join(sizes, "document_id"), ["canonical", "type"], "left").join(mates, ["canonical", "type"], "left")
    looked = tables.written(looked.drop("canonical"), "looked-up")
    rows = asked.join(looked.select("text", "type", "name", "nth", "mates", "crowded"), ["text", "type"]).select("batch", "name", "nth", "mates", "crowded")
    large = tables.written(asked.groupBy("batch").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("batch"), "large-batches")
    is_large, is_crowded = not large.isEmpty(), not looked.where("crowded").isEmpty()
    # A row meets the rest of its batch in a window, unless batch or document is large.
    few = rows.join(large, "batch", "left_anti") if is_large else rows
    more = F.coalesce(F.arrays_overlap("mates", F.collect_set("nth").over(Window.partitionBy("batch"))), F.lit(False))
    few = few.withColumn("more", more).where("NOT crowded")
    matched = tables.written(few.select("batch", "name", "more"), "matched", asked.count())
    if is_large or is_crowded:
        many = rows.where("crowded")
        if is_large:
            many = many.unionByName(rows.where("NOT crowded").join(large, "batch", "left_semi"))
        many = many.select("batch", "name").join(looked.select("name", "document_id", "entity_id"), "name")
        wanted = rows.select("batch", "nth").distinct()
        matched = matched.unionByName(overlapping(tables.written(many, "crowded"), others, wanted))
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy("other"))
    first = others.withColumn("n", nth).where(F.col("n") <= CO_ENTITIES + 1)
    first = first.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("other", "other_text"))).alias("first"))
    co = F.slice(F.transform(F.filter("first", lambda x: x["other"] != F.col("entity_id")), lambda x: x["other_text"]), 1, CO_ENTITIES)
    shown = looked.drop("nth", "mates", "crowded").join(first, "document_id").withColumn("co_entities", co).drop("first")
    confidence = F.when(~F.col("same"), "possible").when(F.col("more"), "exact").otherwise("likely")
    out = matched.join(tables.written(shown, "shown"), "name")
    return out.select("batch", "text", "type", "entity_id", confidence.alias("confidence"), F.col("alias").alias("previous_alias"), F.col("document_id").alias("previous_document"), "co_entities")


def overlapping(rows: DataFrame, others: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows (batch, name, document_id, entity_id) with `more`: whether the batch has another of the document's entities.

    A document's entities that the batch has are looked for once for a pair of batch and document, not for each row.
    """
    pairs = rows.select("batch", "document_id").distinct().join(others.select("document_id", "other", "nth"), "document_id")
    here = tables.written(pairs.join(wanted, ["batch", "nth"]).select("batch", "document_id", "other"), "together")
    overlap = here.groupBy("batch", "document_id").agg(F.count("*").alias("overlap"))
    own = here.select("batch", "document_id", F.col("other").alias("entity_id"), F.lit(1).alias("own"))
    out = rows.join(overlap, ["batch", "document_id"], "left").join(own, ["batch", "document_id", "entity_id"], "left")
    return out.select("batch", "name", (F.coalesce("overlap", F.lit(0)) > F.coalesce("own", F.lit(0))).alias("more"))
