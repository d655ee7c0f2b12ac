"""Audit of how filters interact: what each filter keeps and removes in every order of five filters.

Which filters a document fails is a mask of five bits. Whatever an order does to a document follows from its mask, so a
part's documents are a histogram over the 32 masks, and every outcome of every order and step is that histogram times an
integer matrix of 32 rows and 600 columns (120 orders of 5 steps). Histograms of all documents, of good and of toxic ones
are stacked as rows and multiplied together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, k) for order in ORDERS for k in range(len(FILTERS))]
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
WORD, SIGNS = r"[^\x20\x09-\x0D]+", r"[#$%&*|]"
OUTCOMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def matrices() -> dict[str, np.ndarray]:
    """For each outcome, what a document of a mask (row) adds at an order's step (column)."""
    out = {name: np.zeros((MASKS, len(STEPS)), dtype=np.int64) for name in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    for column, (order, k) in enumerate(STEPS):
        own, before = 1 << FILTERS.index(order[k]), sum(1 << FILTERS.index(f) for f in order[:k])
        for mask in range(MASKS):
            fails, gone = bool(mask & own), bool(mask & before)
            out["kept"][mask, column] = not mask & (before | own)
            out["removed"][mask, column] = fails and not gone
            out["redundant"][mask, column] = fails and gone
            out["unique_fails"][mask, column] = mask == own
            # A filter removes a document in the orders that have it before the others that the document fails.
            out["shapley"][mask, column] = len(ORDERS) // mask.bit_count() if fails else 0
    return out


def text_mask() -> Column:
    """The bits of A to D, which follow from the text; codes of capitals take the place of the letters to be counted."""
    text = common.whole_text()
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def bits(found: Column) -> Column:
        n = F.size(found)
        capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
        fails = [n < LEAST_WORDS, 100 * F.size(F.array_distinct(found)) < LEAST_DISTINCT * n, 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text), text.rlike(SIGNS)]
        return sum((F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)), F.lit(0))

    # The one-element array binds the words to a name, so that texts are split once.
    return F.get(F.transform(F.array(words), bits), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part that fail just the filters of mask, and how many are labelled.

    Texts are shuffled as digests. Rows equal in all that counts are summed before they move, and copies of one text
    meet as one row for each task, so that no text or id is a hot key.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    text = common.whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), text_mask().alias("fails"))
    rows = rows.groupBy("doc_id", "part", "digest", "fails").agg(F.count("*").alias("n"))
    # Rows without an id have no label; they are dealt out by text and don't meet in one task.
    deal = F.when(F.col("doc_id").isNull(), F.col("digest")).otherwise("")
    rows = rows.withColumn("deal", deal).join(marks.withColumn("deal", F.lit("")), ["doc_id", "deal"], "left").select("doc_id", "part", "digest", "fails", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    # How many rows of a kind have its least id: these alone may be the first of their text. Null is no smaller id.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    kinds = rows.groupBy("digest", "part", "fails", "good", "toxic", "doc_id").agg(F.sum("n").alias("n"))
    kinds = kinds.groupBy("digest", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        first["doc_id"].alias("least"), F.min_by(F.when(F.col("doc_id").isNotNull(), F.col("n")), F.when(F.col("doc_id").isNotNull(), F.col("doc_id"))).alias("n_least"),
    )
    least = kinds.groupBy("digest").agg(F.min("least").alias("of_text"))
    kinds = kinds.join(least, "digest")
    passes = F.col("nameless") + F.when(F.col("least") == F.col("of_text"), F.col("n_least")).otherwise(0)
    copy = F.lit(1 << FILTERS.index("E"))
    each = F.array(F.struct(F.col("fails").alias("mask"), passes.alias("n")), F.struct((F.col("fails") + copy).alias("mask"), (F.col("n") - passes).alias("n")))
    kinds = kinds.select("part", "good", "toxic", F.explode(each).alias("x")).where("x.n > 0")
    some = lambda c: F.sum(F.when(F.col(c), F.col("x.n")).otherwise(0)).alias(c)
    return kinds.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), some("good"), some("toxic"))


def outcomes(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and OUTCOMES, from mask_counts(): 600 rows for each part."""
    row = lambda c: F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: F.coalesce(F.element_at("masks", m)[c], F.lit(0).cast("long"))).alias(c)
    stacked = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("masks")).select("part", *map(row, ("n", "good", "toxic")))

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by, orders, steps = matrices(), [o for o, _ in STEPS], np.array([k + 1 for _, k in STEPS], dtype=np.int32)
        for batch in batches:
            parts = len(batch)
            rows = np.concatenate([np.stack(batch[c].to_list()).astype(np.int64) for c in ("n", "good", "toxic")])
            got = {name: rows @ matrix for name, matrix in by.items()}
            table = {"part": np.repeat(batch["part"].to_numpy(dtype=object), len(STEPS)), "filter_order": orders * parts, "step": np.tile(steps, parts)}
            table |= {name: got[name][:parts].ravel() for name in by}
            table |= {"good_lost": got["removed"][parts : 2 * parts].ravel(), "toxic_lost": got["removed"][2 * parts :].ravel()}
            yield pd.DataFrame(table)

    return stacked.mapInPandas(multiply, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in OUTCOMES))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic. Filters: A, under 100 words; B, under 80 % distinct words; C,
    more than 10 % capitals; D, a sign of #$%&*|; E, a text that a smaller doc_id has too, in whatever part. A part is a
    value of lang (null: the empty string); there are 600 rows for each that docs have, none for an empty table. Null texts
    count as empty: they fail A, and E as copies of one another. Texts are read whole. Every row counts, repeated ones too:
    rows of the smallest id of a text all pass E, as do rows without an id, to which no id is smaller and which are none.
    A document has a label if any row of labels for its id says so. Further columns, whatever their names, play no part.
    """
    return outcomes(mask_counts(docs, labels))
