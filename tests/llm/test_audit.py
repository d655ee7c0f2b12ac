"""The audit against running every order of filters over the documents one by one."""

import random
import re
from itertools import permutations

from tessera.llm import audit

from .data import SCHEMA, odd, prose

LABELS = "doc_id long, quality int, toxic int"


def brute(table, labels):
    docs = [(d, t or "", g or "") for d, t, g, *_ in table]
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}

    def fails(d, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = {"A"} if len(words) < 100 else set()
        if 100 * len(set(words)) < 80 * len(words):
            out.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            out.add("C")
        if re.search(r"[#$%&*|]", t):
            out.add("D")
        if d is not None and any(x is not None and x < d and y == t for x, y, _ in docs):
            out.add("E")
        return out

    found = [(d, g, fails(d, t)) for d, t, g in docs]
    orders, out = ["".join(p) for p in permutations("ABCDE")], {}
    for part in {g for _, g, _ in found}:
        own = [(d, f) for d, g, f in found if g == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in orders:
            left = own
            for step, name in enumerate(order):
                removed = [(d, f) for d, f in left if name in f]
                left = [(d, f) for d, f in left if name not in f]
                failing = [f for _, f in own if name in f]
                sums[name] += len(removed)
                lost = lambda marks: sum(d in marks for d, _ in removed)
                out[part, order, step + 1] = [len(left), len(removed), len(failing) - len(removed), sum(len(f) == 1 for f in failing), lost(good), lost(toxic)]
        for order in orders:
            for step, name in enumerate(order):
                out[part, order, step + 1].append(sums[name])
    return out


def test_against_every_order(spark):
    rng = random.Random(8)
    texts = odd() + [prose(rng, rng.choice((20, 99, 100, 150))) for _ in range(40)]
    texts += [" ".join(f"w{k}" for k in range(n)) for n in (99, 100, 101)] + ["A" * k + "b" * (100 - k) for k in (9, 10, 11)] + [c for c in "#$%&*|@"]
    texts += [" ".join([f"v{k}" for k in range(80)] + ["v0"] * n) for n in (19, 20, 21)] + ["a\x0bb\x0cc\x1cd\xa0e"] + rng.sample(texts[11:], 12)
    table = [(k, t, rng.choice(("en", "de", None)), "s", 0, 0.5, "x") for k, t in enumerate(texts)]
    table += table[3:6] + [(None, *r[1:]) for r in table[14:18]] + [(7, "other text", "fr", "s", 0, 0.5, "x"), (None, "x", "fr", "s", 0, 0.5, "x"), (None, "x", "fr", "s", 0, 0.5, "x")]
    labels = [(k, rng.randint(0, 1), rng.randint(0, 1)) for k in range(0, 60, 2)] + [(4, 1, None), (None, 1, 1), (9999, 1, 1)]
    out = audit.interactions(spark.createDataFrame(table, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    assert {(r.part, r.filter_order, r.step): [r[c] for c in audit.OUTCOMES] for r in out} == brute(table, labels)
    assert len(out) == 600 * 4


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], LABELS), [(1, "a", "en", "s", 0, 0.5, "x")]
    assert audit.interactions(spark.createDataFrame([], SCHEMA), none).count() == 0
    assert audit.interactions(spark.createDataFrame(docs, SCHEMA), none).where("removed = 1 and good_lost = 0").count() == 120


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a", "en", "n", 2, 3, 4)], "doc_id long, text string, lang string, part string, mask int, good int, `x.n` int")
    labels = spark.createDataFrame([(1, 1, 0, "a", "b")], LABELS + ", part string, text string")
    assert audit.interactions(docs, labels).where("good_lost = 1").count() == 120
