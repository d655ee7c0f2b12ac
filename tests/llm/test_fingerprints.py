import hashlib
import random
import re

from tessera.llm import fingerprints

from .data import SCHEMA, odd, prose, rows


def cut(text):
    return set(re.findall(r"\S{1,200}(?:[^\S\n]+\S{1,200}){0,15}", text, re.ASCII))


def like(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_against_sets(spark):
    rng = random.Random(13)
    texts = ["\n".join(prose(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    texts += [t for t in odd(rng) if t is None or t.isascii()] + [texts[0], texts[0]]
    table = rows(texts, first=5)
    out = {r.doc_id: r for r in fingerprints.fingerprinted(spark.createDataFrame(table, SCHEMA)).collect()}
    order = sorted(((d, t or "") for d, t, *_ in table), reverse=True)
    assert len(out) == len(table)
    for k, (d, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = out[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - like(cut(text), cut(edited))) < 1e-12 and abs(r.near_next - like(cut(text), cut(after))) < 1e-12, d
    by_text = {}
    for d, text in order:
        assert by_text.setdefault(text, out[d].fingerprint) == out[d].fingerprint
    assert len(set(by_text.values())) >= len({frozenset(cut(t)) for t in by_text})


def test_parts_of_the_order_meet(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ORDERED", 7)
    table = [(d, f"text {d}", "en", "s", 0, 0.0, None) for d in random.Random(1).sample(range(-500, 500), 100)] + [(None, "none", "en", "s", 0, 0.0, None)]
    out = fingerprints.with_next(spark.createDataFrame(table, SCHEMA)).collect()
    order = sorted((r[0] for r in table if r[0] is not None), reverse=True) + [None]
    after = {a: b for a, b in zip(order, order[1:] + order[:1])}
    texts = {r[0]: r[1] for r in table}
    assert {r.doc_id: r.next_text for r in out} == {d: texts[after[d]] for d in order}


def test_frequent_and_missing_ids_are_dealt_out(spark, monkeypatch):
    for name, value in (("ORDERED", 5), ("SAME", 10), ("SAME_SHARE", 20)):
        monkeypatch.setattr(fingerprints, name, value)
    rng = random.Random(3)
    table = [(rng.choice((None, 4, 4, k)), f"text {rng.randrange(10**6)}", "en", "s", 0, 0.0, None) for k in range(200)]
    docs = spark.createDataFrame(table, SCHEMA)
    out = fingerprints.with_next(docs).collect()
    marks = {r.text: r.m for r in docs.selectExpr("text", "xxhash64(text) AS m").collect()}
    order = sorted(table, key=lambda r: (r[0] is None, -(r[0] or 0), marks[r[1]]))
    texts = [r[1] for r in order]
    assert {r.text: r.next_text for r in out} == dict(zip(texts, texts[1:] + texts[:1]))


def test_one_row_and_none(spark):
    r = fingerprints.fingerprinted(spark.createDataFrame([(3, "one two\nthree", None, None, 0, 0.0, None)], SCHEMA)).first()
    assert r.near_next == 1.0
    assert fingerprints.fingerprinted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_peeling_recovers_differences(spark):
    rng = random.Random(2)
    pairs = []
    for k in range(60):
        common = [rng.getrandbits(63) for _ in range(rng.randint(0, 60))]
        pairs.append((k, common + [rng.getrandbits(63) for _ in range(rng.randint(0, 40))], common + [rng.getrandbits(63) for _ in range(rng.randint(0, 40))]))
    out = fingerprints.likeness(spark.createDataFrame(pairs, "row long, a array<long>, b array<long>")).collect()
    assert {r.row: round(r.likeness, 12) for r in out} == {k: round(like(set(a), set(b)), 12) for k, a, b in pairs}
