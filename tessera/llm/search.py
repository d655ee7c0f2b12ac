"""Ranked lexical search as a blocked product of sparse matrices.

Rows of the one matrix are items, rows of the other terms: an item's row says which terms it has, a term's row holds the
int64 impacts that it has in documents. Documents are cut into blocks, each a row of a written table: its documents, and
for each term that items have, the documents of the block that hold it with their frequencies, sorted by term. Document
frequencies are sums over blocks. Items are taken in blocks too, whose terms and weights go along with the plan. In a pair
of blocks an item's product row is merged from the rows of its terms, as Gustavson does it, in an accumulator as wide as
the block; of its entries the TOP highest stay. What the blocks keep is reduced in two rounds by item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

TOP = 50
#: Bytes of text and documents after which a block of documents ends; a longer text is a block of its own.
BLOCK_BYTES, BLOCK_DOCS = 8_000_000, 8_192
#: Bytes of a text that are split into terms at a time.
PIECE_BYTES = 4_000_000
#: Items and their entries (one for each item and term) that go along with a plan; an item with more is a block of its own.
BLOCK_ITEMS, BLOCK_ENTRIES = 20_000, 2_000_000
#: A term: the longest run of these (A-Z lower-cased); a byte outside of ASCII is always inside one.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCKS = "docs array<long>, lengths array<long>, terms array<string>, starts array<int>, at array<int>, tf array<int>"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text as UTF-8, in lists of bounded size: all bytes that end a term become spaces."""
    data = text.encode().translate(_LOWER)
    at = 0
    while at < len(data):
        end = at + PIECE_BYTES
        if end < len(data) and (end := data.find(b" ", end)) < 0:
            end = len(data)
        yield data[at:end].split()
        at = end


def term_column(text) -> F.Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(text, letters, letters.lower()), F.lit(TERM), F.lit(0))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: each once."""
    found = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), term_column(F.col("text")).alias("terms"))
    return found.select("item_id", F.explode("terms").alias("term")).distinct()


def item_blocks(terms: DataFrame) -> list[tuple[int, int]]:
    """Ranges of item_id (first and last) with BLOCK_ITEMS items and BLOCK_ENTRIES entries at most, or one item.

    Found by halving the range of ids: only counts reach the driver, two for each block of the end.
    """
    sizes = common.written(terms.groupBy("item_id").agg(F.count("*").alias("n")), "item-sizes")
    first, last = sizes.agg(F.min("item_id"), F.max("item_id")).first()
    open_, done = [(first, last)] if first is not None else [], []
    while open_:
        low, high = open_.pop()
        items, entries = sizes.where(F.col("item_id").between(low, high)).agg(F.count("*"), F.sum("n")).first()
        if items and (items == 1 or items <= BLOCK_ITEMS and entries <= BLOCK_ENTRIES):
            done.append((low, high))
        elif items:
            middle = (low + high) // 2
            open_ += [(low, middle), (middle + 1, high)]
    common.removed(sizes)
    return sorted(done)


class Block:
    """Documents, and the frequencies of wanted terms in them."""

    def __init__(self, wanted: set[bytes]):
        self.wanted, self.docs, self.lengths, self.bytes = wanted, [], [], 0
        self.rows: dict[bytes, tuple[list[int], list[int]]] = {}

    def add(self, doc_id, text: str) -> None:
        counts, n = Counter(), 0
        for terms in terms_of(text):
            counts.update(terms)
            n += len(terms)
            if len(counts) > 1_000_000:  # only what items have stays of a long text
                counts = Counter({t: counts[t] for t in self.wanted.intersection(counts)})
        self.bytes += len(text)
        if not n:
            return
        here = len(self.docs)
        self.docs.append(doc_id)
        self.lengths.append(n)
        for term in self.wanted.intersection(counts):
            at, tf = self.rows.setdefault(term, ([], []))
            at.append(here)
            tf.append(counts[term])

    def row(self) -> pd.DataFrame:
        names = sorted(self.rows)
        joined = lambda k: np.array([x for name in names for x in self.rows[name][k]], dtype=np.int32)
        starts = np.cumsum([0] + [len(self.rows[name][0]) for name in names]).astype(np.int32)
        docs = np.array(self.docs, dtype=object)
        return pd.DataFrame({"docs": [docs], "lengths": [np.array(self.lengths, dtype=np.int64)], "terms": [[n.decode() for n in names]], "starts": [starts], "at": [joined(0)], "tf": [joined(1)]})


def blocks(docs: DataFrame, terms: list[str]) -> DataFrame:
    """BLOCKS of docs for these terms. Documents without a term of any kind are left out; all others count."""
    shared = docs.sparkSession.sparkContext.broadcast({t.encode() for t in terms})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = Block(shared.value)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                block.add(None if pd.isna(doc_id) else int(doc_id), text)
                if block.bytes >= BLOCK_BYTES or len(block.docs) >= BLOCK_DOCS:
                    yield block.row()
                    block = Block(shared.value)
        if block.docs:
            yield block.row()

    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.written(rows.mapInPandas(cut, BLOCKS), "term-document-blocks", common.TEXT_ROWS)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def highest(scores: np.ndarray, top: int) -> np.ndarray:
    """Positions of the `top` highest positive scores, highest first, equal ones by position."""
    at = np.flatnonzero(scores > 0)
    if len(at) > top:
        least = np.partition(scores[at], len(at) - top)[len(at) - top]
        over = at[scores[at] > least]
        at = np.concatenate((over, at[scores[at] == least][: top - len(over)]))
    return at[np.lexsort((at, -scores[at]))]


def products(table: DataFrame, entries: dict[int, list[tuple[str, int]]], documents: int, length: int, top: int) -> DataFrame:
    """item_id, doc_id, score, deal: the top documents of each item in each block of table. entries: item -> (term, weight)."""
    shared = table.sparkSession.sparkContext.broadcast(entries)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples():
                ids = np.array([-1 if x is None or pd.isna(x) else int(x) for x in b.docs], dtype=np.int64)
                null = np.array([x is None or pd.isna(x) for x in b.docs], dtype=bool)
                # In order of doc_id, null first, so that of equal scores the first count.
                order = np.lexsort((ids, ~null))
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                ids, null = ids[order], null[order]
                m = np.array([100 - 50 + (50 * int(n) * documents) // length for n in b.lengths], dtype=np.int64)
                at, tf = np.asarray(b.at), np.asarray(b.tf).astype(np.int64)
                impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[at])
                at, rows = place[at], {t: (int(b.starts[k]), int(b.starts[k + 1])) for k, t in enumerate(b.terms)}
                out = []
                for item, terms in shared.value.items():
                    scores = np.zeros(len(ids), dtype=np.int64)
                    for term, w in terms:
                        if w and term in rows:
                            low, high = rows[term]
                            scores[at[low:high]] += w * impact[low:high]  # a document is in a row once
                    best = highest(scores, top)
                    if len(best):
                        out.append(pd.DataFrame({"item_id": item, "doc_id": pd.array(np.where(null[best], 0, ids[best]), dtype="Int64").copy(), "none": null[best], "score": scores[best]}))
                if out:
                    found = pd.concat(out, ignore_index=True)
                    found.loc[found["none"], "doc_id"] = pd.NA
                    yield found.drop(columns="none")

    rows = table.mapInPandas(multiply, "item_id long, doc_id long, score long")
    return rows


def reduced(rows: DataFrame, top: int, tasks: int) -> DataFrame:
    """The top rows of each item by score, then doc_id, with rank: first in as many groups as the root of `tasks`, then together."""
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), "nth"]
    deal = F.pmod(F.spark_partition_id(), F.lit(max(1, math.isqrt(tasks))))
    # `nth` settles the order of rows that are equal in all, which are different documents.
    rows = rows.withColumn("nth", F.monotonically_increasing_id()).withColumn("deal", deal)
    within = F.row_number().over(Window.partitionBy("item_id", "deal").orderBy(*order))
    rows = rows.withColumn("rank", within).where(F.col("rank") <= top).drop("rank", "deal")
    whole = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return rows.withColumn("rank", whole).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the `top` documents with the highest scores above 0 of each item, ties by doc_id.

    docs: doc_id, text; items: item_id, text. A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its impact in a
    document (10^9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L; a score sums their products over the distinct
    terms of the item. Null texts have no terms and empty ones neither; a document without terms isn't counted in N. Texts
    are read whole. Each row of docs is a document, repeated ones too; a null doc_id comes before all others. Rows of one
    item_id are one item with the terms of all its texts; rows without an id are no item. Items that no document answers,
    and empty tables, give no row. Further columns, whatever their names, play no part.
    """
    terms = common.written(item_terms(items), "item-terms")
    out = None
    for low, high in item_blocks(terms):
        own = terms.where(F.col("item_id").between(low, high))
        names = [r.term for r in own.select("term").distinct().toLocalIterator()]  # of one block of items
        table = blocks(docs, names)
        documents, length, tasks = table.agg(F.sum(F.size("docs")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.count("*")).first()
        if not documents:
            break
        sizes = F.transform("terms", lambda t, k: F.struct(t.alias("term"), (F.get("starts", k + 1) - F.get("starts", k)).cast("long").alias("n")))
        frequencies = table.select(F.explode(sizes).alias("x")).groupBy("x.term").agg(F.sum("x.n").alias("df"))
        entries: dict[int, list[tuple[str, int]]] = {}
        for r in own.join(frequencies, "term").select("item_id", "term", "df").toLocalIterator():
            entries.setdefault(r.item_id, []).append((r.term, weight(documents, r.df)))
        found = common.written(reduced(products(table, entries, documents, length, top), top, tasks), "found")
        common.removed(table)
        out = found if out is None else out.unionByName(found)
    common.removed(terms)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
