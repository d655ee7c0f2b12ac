"""Search against scoring every document for every item, one after another."""

import math
import random
import re
from collections import Counter, defaultdict

from tessera.llm import search

from .data import SCHEMA, odd, prose, rows

ITEMS = "item_id long, text string"


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(search.TERM, lower)


def brute(table, items, top):
    docs = [(d, Counter(terms(t))) for d, t, *_ in table if terms(t)]
    n_docs, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = defaultdict(set)
    for item, text in items:
        if item is not None:
            asked[item] |= set(terms(text))
    out = []
    for item, own in asked.items():
        scores = []
        for d, c in docs:
            m = 50 + (50 * sum(c.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scores.append((-score, d is not None, d or 0))
        out += [(item, rank, d if there else None, -score) for rank, (score, there, d) in enumerate(sorted(scores)[:top], 1)]
    return out


def data(rng):
    texts = odd() + [prose(rng, rng.randint(1, 60), 40) for _ in range(150)] + ["Été ÉTÉ été it's x1-X1_x1", "ÀB\x7fc d\x80e 日本 日本語", "same text here", "same text here", "!!! ...", "K"]
    table = rows(texts)
    table += table[20:24] + [(None, *table[30][1:]), (None, *table[31][1:])]
    items = [(k, prose(rng, rng.randint(1, 12), 40)) for k in range(30)]
    return table, items + [(30, None), (31, ""), (32, "nothinglikeit"), (33, "SAME text"), (33, "here x1 it"), (34, "été ét́é 日本 k"), (None, "same"), items[3]]


def test_against_brute_force(spark, monkeypatch):
    table, items = data(random.Random(11))
    docs, asked = spark.createDataFrame(table, SCHEMA), spark.createDataFrame(items, ITEMS)
    expected = brute(table, items, 7)
    key = lambda r: (r[0], r[1])
    got = search.search(docs, asked, 7)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)
    for name, value in (("BLOCK_DOCS", 3), ("BLOCK_ITEMS", 9), ("BLOCK_ENTRIES", 40)):
        monkeypatch.setattr(search, name, value)
    assert sorted(map(tuple, search.search(docs.repartition(5), asked, 7).collect()), key=key) == sorted(expected, key=key)


def test_ties_at_the_border_go_by_id(spark):
    table = rows([f"word {'filler ' * (k % 2)}" for k in range(200)])
    got = search.search(spark.createDataFrame(table, SCHEMA).repartition(7), spark.createDataFrame([(1, "word"), (2, "filler")], ITEMS)).collect()
    assert [(r.rank, r.doc_id) for r in sorted(got, key=lambda r: (r.item_id, r.rank)) if r.item_id == 2] == [(k + 1, 2 * k + 1) for k in range(50)]


def test_long_texts_are_split_between_terms(monkeypatch):
    text = prose(random.Random(2), 500) + "é" * 300 + " end"
    whole = [t for part in search.terms_of(text) for t in part]
    monkeypatch.setattr(search, "PIECE_BYTES", 50)
    assert [t for part in search.terms_of(text) for t in part] == whole and b"end" in whole


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(rows(["a b"]), SCHEMA), spark.createDataFrame([(1, "a")], ITEMS)
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
    assert search.search(docs, items.where("false")).columns == ["item_id", "rank", "doc_id", "score"]


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a", "x", 3), (2, "b", "y", 4)], "doc_id long, text string, item_id string, `rank.x` int")
    items = spark.createDataFrame([(5, "a", "q", 1)], ITEMS + ", term string, doc_id int")
    assert [tuple(r) for r in search.search(docs, items).select("item_id", "rank", "doc_id").collect()] == [(5, 1, 1)]
