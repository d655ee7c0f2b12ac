import math
import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import near

from .data import SCHEMA, odd, prose


def lcs(a, b, band):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = max(last[j + 1], row[j], last[j] + 1 if x == y and abs(i - j) <= band else 0)
    return row[-1]


def test_banded_alignment_is_exact():
    rng = random.Random(10)
    for _ in range(400):
        a = [rng.randrange(4) for _ in range(rng.randint(1, 30))]
        b = [rng.randrange(4) for _ in range(rng.randint(1, 30))]
        band = rng.randint(0, 31)
        assert near.banded(a, b, band) == lcs(a, b, band)


def copies(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def similarity(a, b):
    x, y = ([tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))] for t in (a, b))
    m = sum(block.size for block in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
    return m / (len(x) + len(y) - m)


def test_groups(spark):
    rng = random.Random(11)
    bases = [prose(rng, 200) for _ in range(12)]
    texts = [copies(rng, b, n) for b in bases for n in (0, 0, 1, 2, 30)] + odd(rng) + [bases[0].upper(), "two words", "two  words"]
    passage = prose(rng, 120)
    texts += [passage + " " + prose(rng, 120) for _ in range(8)]  # much in common, not near
    table = [(1000 - k, t, "en", "s", 0, 0.0, "x") for k, t in enumerate(texts)] + [(1000, texts[0], "en", "s", 0, 0.0, "x")] * 2 + [(None, texts[0], "en", "s", 0, 0.0, "x")]
    out = near.grouped(spark.createDataFrame(table, SCHEMA)).collect()
    assert len(out) == len(table)
    parent = {1000 - k: 1000 - k for k in range(len(texts))}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(texts):
        for j in range(i):
            b = texts[j]
            if not (a or "").split() or not (b or "").split():
                continue
            if a.lower().split() == b.lower().split() or (len(a) < 10_000 and len(b) < 10_000 and similarity(a, b) >= 0.8):
                x, y = root(1000 - i), root(1000 - j)
                parent[max(x, y)] = min(x, y)
    for r in out:
        assert r.class_id == root(1000 if r.doc_id is None else r.doc_id), (r.doc_id, r.class_id)
    for c in {r.class_id for r in out}:
        kept = [r.doc_id for r in out if r.class_id == c and r.kept]
        assert kept == [c]
    left = near.one_of_each(spark.createDataFrame(table, SCHEMA)).collect()
    assert sorted(r.doc_id for r in left) == sorted(r.doc_id for r in out if r.kept)


def test_large_group_of_near_copies_joins_without_all_pairs(spark):
    rng = random.Random(12)
    base = prose(rng, 150)
    table = [(k, copies(rng, base, 2), "en", "s", 0, 0.0, None) for k in range(300)]
    out = near.grouped(spark.createDataFrame(table, SCHEMA)).collect()
    assert {r.class_id for r in out} == {0} and sum(r.kept for r in out) == 1


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (8, 7), (3, 1), (12, 12), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)]
    out = near.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.label) for r in out} == {(1, 1), (3, 1), (4, 1), (5, 1), (7, 7), (8, 7), (9, 7), *((k, 20) for k in range(20, 26))}


def test_empty_table(spark):
    assert near.grouped(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketch_depends_on_order():
    rng = np.random.default_rng(1)
    values, seeds = rng.integers(0, 1 << 60, 50, dtype=np.uint64), rng.integers(0, 1 << 60, 64, dtype=np.uint64) | np.uint64(1)
    forward, back = near.sketch(values, seeds), near.sketch(values[::-1].copy(), seeds)
    assert (forward == near.sketch(values, seeds)).all() and (forward != back).mean() > 0.9


def test_texts_without_words_are_copies(spark):
    table = [(7, "", "en", "s", 0, 0.0, None), (5, None, "en", "s", 0, 0.0, None), (9, " \n\t", "en", "s", 0, 0.0, None), (5, None, "en", "s", 0, 0.0, None), (8, "words", "en", "s", 0, 0.0, None)]
    docs = spark.createDataFrame(table, SCHEMA)
    out = near.grouped(docs, wordless=True).collect()
    assert sorted((r.doc_id, r.class_id, r.kept) for r in out) == [(5, 5, False), (5, 5, True), (7, 5, False), (8, 8, True), (9, 5, False)]
    assert sorted(r.doc_id for r in near.one_of_each(docs, wordless=True).collect()) == [5, 8]
    stage = dict(corpus_pipeline.STAGES)["order_minhash"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == [5, 8]


def test_short_texts_meet(spark):
    rng = random.Random(13)
    texts, want = [], {}
    for n in range(8, 16):
        for k in range(12):
            words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            more = [*words, f"w{rng.randrange(10**9)}"] if k % 2 else [f"w{rng.randrange(10**9)}", *words]
            want[len(texts)] = want[len(texts) + 1] = len(texts)
            texts += [" ".join(words), " ".join(more)]
    for k, t in enumerate(list(texts[:16])):  # two other words at the end: too little in common
        want[len(texts)] = len(texts)
        texts.append(" ".join(t.split()[:-2] + [f"other{k}", f"word{k}"]))
    out = near.grouped(spark.createDataFrame([(k, t, "en", "s", 0, 0.0, None) for k, t in enumerate(texts)], SCHEMA)).collect()
    assert {r.doc_id: r.class_id for r in out} == want


def test_short_entries_are_shared():
    rng = random.Random(14)
    for _ in range(4000):
        pool = [rng.randrange(1 << 60) for _ in range(8)]
        a = [rng.choice(pool) for _ in range(rng.randint(1, near.SHORT))]
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            b.insert(rng.randint(0, len(b)), rng.choice(pool)) if rng.random() < 0.5 else b and b.pop(rng.randrange(len(b)))
        if not b or len(b) > near.SHORT:
            continue
        x, y = np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)
        if near.aligned(x, y) >= near.SIMILARITY:
            assert set(near.short_entries(x).tolist()) & set(near.short_entries(y).tolist()), (a, b)


def test_central_leaders_join_what_all_pairs_join(spark):
    """Copies of one text with up to six edits, some of them shared, with and without the text itself: against all pairs."""
    rng = random.Random(15)
    base = prose(rng, 150)
    edited = [copies(rng, base, rng.randint(1, 6)) for _ in range(90)]
    more = [copies(rng, t, rng.randint(1, 2)) for t in rng.sample(edited, 40)]
    for texts in (edited + more, [base, *edited, *more]):
        table = [(k, t, "en", "s", 0, 0.0, None) for k, t in enumerate(texts)]
        docs = spark.createDataFrame(table, SCHEMA)
        found = {r.doc_id: r.class_id for r in near.grouped(docs).collect()}
        whole = {r.doc_id: r.class_id for r in near.grouped(docs, exact=True).collect()}
        words = [[tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)] for t in texts]
        able = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words[:i]) if len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))]
        links = [(i, j) for i, j in able if similarity(texts[i], texts[j]) >= 0.8]
        assert len(links) > 200
        assert np.mean([whole[i] == whole[j] for i, j in links]) >= 0.995
        assert np.mean([found[i] == found[j] for i, j in links]) >= 0.97
        of = np.array([whole[k] for k in range(len(texts))])
        for i, j in rng.sample([(i, j) for i in found for j in found if i < j], 2000):
            assert found[i] != found[j] or of[i] == of[j]


def test_no_link_of_a_bucket_is_left_out(spark):
    """Forty pairs of near texts in one bucket, far more than it has leaders."""
    rng = random.Random(16)
    texts = [t for _ in range(40) for base in [prose(rng, 60)] for t in (base, copies(rng, base, 1))]
    docs = spark.createDataFrame([(k, t, "en", "s", 0, 0.0, None) for k, t in enumerate(texts)], SCHEMA)
    units = near.sketched(docs).localCheckpoint()
    of = {r.unit: r.doc_id for r in units.collect()}
    distinct = units.select("unit", "n", F.array(F.lit(7).cast("long")).alias("sketch"), "body")
    found: dict = {}
    for r in near.classes(distinct).collect():
        found.setdefault(r.label, set()).add(of[r.node])
    assert sorted(map(sorted, found.values())) == [[k, k + 1] for k in range(0, 80, 2)]


def test_near_pairs_miss_none():
    rng = random.Random(17)
    for _ in range(2000):
        pool = [rng.randrange(1 << 40) for _ in range(60)]
        sets = [set(rng.sample(pool, rng.randint(8, 60))) for _ in range(2)] if rng.random() < 0.3 else [set(pool[rng.randint(0, 8) : 60 - rng.randint(0, 8)]) for _ in range(2)]
        a, b = (sorted(s) for s in sets)
        if len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1]):
            continue
        first = min(sets[0] & sets[1])
        for x, y in ((a, b), (b, a)):
            assert x.index(first) < len(x) - math.ceil(0.8 * len(x) - 1e-9) + 1
        assert min(len(a) - a.index(first), len(b) - b.index(first)) >= 0.8 / 1.8 * (len(a) + len(b)) - 1e-9


def test_the_pipeline_leaves_no_pair_of_a_bucket_out(spark, monkeypatch):
    asked, whole = [], near.classes
    monkeypatch.setattr(near, "classes", lambda distinct, similarity, exact: asked.append(exact) or whole(distinct, similarity, exact))
    docs = spark.createDataFrame([(k, t, "en", "s", 0, 0.0, None) for k, t in enumerate(["one two three", "one two three", "four"])], SCHEMA)
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["order_minhash"](spark, docs, "").collect()) == [0, 2]
    assert asked == [True]
