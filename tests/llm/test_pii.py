import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm import pii

from .data import SCHEMA, odd, prose

BASE = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    found = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), kind, m.end()))
    return sorted(found)


def noisy(rng):
    parts = ["a", "b.c", "@", "x-y", ".com", "1", "22", "300", ".", "..", "+1", " ", "-", "(555)", "4111 1111 1111 1111", "378282246310005", "10.0.0.1", "+1 (017) 555-7713", "mail7.example.com", "é"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))


def test_base_equals_the_patterns():
    rng = random.Random(7)
    for _ in range(30_000):
        text = noisy(rng)
        assert pii.base(text) == plain(text), repr(text)


def test_report(spark):
    rng = random.Random(8)
    texts = [noisy(rng) for _ in range(80)] + odd(rng) + [prose(rng, 30) + " jo.34@mail7.example.com"] * 2
    table = [(k, t, "en", "s", 0, 0.0, "x") for k, t in enumerate(texts)]
    out = {r.doc_id: r for r in pii.report(spark.createDataFrame(table, SCHEMA)).collect()}
    assert len(out) == len(texts)
    for k, t in enumerate(texts):
        spans = plain(t or "")
        listed = [f"{pii.KINDS[kind]}:{a}:{b}" for a, kind, b in spans]
        r = out[k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == n for x in spans) for n in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(filter(None, r.spans.split(",")))


def test_bootstrap_discovers_and_leaves_others(spark):
    rng = random.Random(9)
    texts = [f"{prose(rng, 8)} call hotline: +1 (2{k:02d}) 555-{1000 + k} now {prose(rng, 3)}" for k in range(24)]
    texts += [f"{prose(rng, 8)} call hotline: (217) 555-0{k}42 now {prose(rng, 3)}" for k in range(3)]
    texts += [f"{prose(rng, 8)} order number 5550{k}42 shipped" for k in range(3)]
    out = pii.report(spark.createDataFrame([(k, t, "en", "s", 0, 0.0, None) for k, t in enumerate(texts)], SCHEMA)).orderBy("doc_id").collect()
    assert [r.n_discovered for r in out] == [0] * 24 + [1] * 3 + [0] * 3
    kind, a, b = out[24].spans.split(":")
    assert kind == "phone" and texts[24][int(a) : int(b)].endswith("555-0042")


def test_bootstrap_finds_many_unseen(spark):
    rng = random.Random(19)
    texts, want = [], []
    for word, seeds, unseen, other in (("hotline", 60, 30, 0), ("dial", 60, 60, 0), ("serial", 60, 0, 40), ("batch", 4, 200, 0)):
        texts += [f"{prose(rng, 6)} our {word}: +1 (2{k:02d}) 555-{1000 + k} now" for k in range(seeds)]
        texts += [f"{prose(rng, 6)} our {word}: (317) {len(word)}55-{2000 + k} now" for k in range(unseen)]
        texts += [f"{prose(rng, 6)} our {word}: AX{3000 + k} now" for k in range(other)]
        want += [0] * seeds + [int(word in ("hotline", "dial"))] * unseen + [0] * other
    # Beside 40 that suit no phone, those that do are left alone.
    texts += [f"{prose(rng, 6)} our serial: (417) 655-{4000 + k} now" for k in range(3)]
    want += [0] * 3
    out = pii.report(spark.createDataFrame([(k, t, "en", "s", 0, 0.0, None) for k, t in enumerate(texts)], SCHEMA)).collect()
    assert {r.doc_id: r.n_discovered for r in out} == dict(enumerate(want))


def test_masked(spark):
    table = [(1, "to a@b.com and 10.0.0.1.", "en", "s", 3, 0.0, "x"), (2, None, None, None, None, None, None), (3, "clean", "en", "s", 5, 1.0, "y")]
    out = {r.doc_id: r for r in pii.masked(spark.createDataFrame(table, SCHEMA)).collect()}
    assert out[1].text == "to <email> and <ip>." and out[2].text is None and out[3].text == "clean" and out[3].unit == "y"
    assert pii.masked(spark.createDataFrame([], SCHEMA)).count() == 0


def test_contexts_and_instances_are_whole(spark):
    rng = random.Random(21)
    far = " " + "- " * 80
    texts = [f"{prose(rng, 4)} hotline{far}+1 (2{k:02d}) 555-{1000 + k} {far} now" for k in range(24)] + [f"{prose(rng, 4)} hotline{far}(317) 555-0142 {far} now"]
    texts += [f"inbox: u{k}@{'sub.' * 60}example.com ok" for k in range(24)] + [f"inbox: someone@{'sub.' * 60}intern_al ok"]
    out = {r.doc_id: r for r in pii.report(spark.createDataFrame([(k, t, "en", "s", 0, 0.0, None) for k, t in enumerate(texts)], SCHEMA)).collect()}
    assert out[24].n_discovered == 1
    found = list(pii.instances(texts[49], pii.base(texts[49])))
    assert [x[4][0] for x in found] == ["<inbox:"]


def test_long_runs_of_numbers_are_read(spark):
    """An instance may have any number of digits; forms of cards are those of 12 to 19 digits."""
    rng = random.Random(23)
    surfaces = ["".join(rng.choice("0123456789 .-") if rng.random() < 0.2 else rng.choice("0123456789") for _ in range(rng.randint(10, 26))) for _ in range(2000)]
    for surface in ["12 " * 20_000 + "3", "7" * 60_000]:
        assert spark.range(1).select(pii.suits(F.lit(2), F.lit(surface)).alias("card")).first().card is False
    got = spark.createDataFrame([(s,) for s in surfaces], "s string").select("s", pii.suits(F.lit(2), F.col("s")).alias("card")).collect()
    card = lambda s: bool(re.fullmatch("[0-9]([ .-]?[0-9])+", s)) and 12 <= len(re.sub("[^0-9]", "", s)) <= 19
    assert all(r.card == card(r.s) for r in got) and {r.card for r in got} == {True, False}
    # A run is one instance, read once, and takes none before it along.
    assert [x[3] for x in pii.instances("no a123 1 2 and --456 78", [])] == ["a123", "456 78"]
    texts = ["see table " + "12 " * 20_000 + "and so on", "x" + "7" * 60_000 + " y", "call +1 (217) 555-0142 now"]
    out = pii.report(spark.createDataFrame([(k, t, "en", "s", 0, 0.0, None) for k, t in enumerate(texts)], SCHEMA)).orderBy("doc_id").collect()
    assert [(r.n_card, r.n_phone, r.n_discovered) for r in out] == [(0, 0, 0), (0, 0, 0), (0, 1, 0)]


def test_rounds_against_brute_force(spark):
    """The graph of patterns and surfaces, scored with plain loops."""
    rng = random.Random(22)
    seen = []
    for _ in range(600):
        pattern, surface = f"p{rng.randrange(25)}", f"(3{rng.randrange(100):02d}) 555-{rng.randrange(40) + 1000}"
        surface = rng.choice((surface, surface, f"x{rng.randrange(30)}@mail", f"ab{rng.randrange(20)}9"))
        seen.append((pattern, surface, (3 if surface[0] == "(" and int(surface[2:4]) < 70 else 0 if surface[0] == "x" and int(surface[1:-5]) < 20 else -1)))
    table = spark.createDataFrame([([dict(start=0, end=1, kind=k, surface=s, patterns=[p])],) for p, s, k in seen], "instances array<struct<start:int,end:int,kind:int,surface:string,patterns:array<string>>>")
    got = {r.surface: r.kind for r in pii.discovered(table).collect()}

    def suits(kind, surface):
        digits = len(re.sub("[^0-9]", "", surface))
        if kind == 0:
            return bool(re.match(r"^[^@\s]+@[^@\s]+$", surface))
        return bool(re.match(r"^[+(]?[0-9][0-9()./ -]+$", surface)) and 7 <= digits <= 15

    seed = {}
    for p, s, k in seen:
        seed[p, s] = max(seed.get((p, s), -1), k)
    known = {(s, k): 1.0 for (p, s), k in seed.items() if k >= 0}
    start = dict(known)
    for _ in range(pii.ROUNDS):
        sure = {}
        for pattern in {p for p, _ in seed}:
            own = {s: k for (p, s), k in seed.items() if p == pattern}
            for kind in (0, 3):
                hits = [s for s in own if (s, kind) in known]
                open_ = sum(own[s] < 0 and suits(kind, s) and s not in hits for s in own)
                confidence = sum(known[s, kind] for s in hits) / (len(own) - (1 - pii.UNSEEN) * open_ + pii.SMOOTHING)
                if len(hits) >= pii.MIN_SUPPORT and confidence >= pii.PATTERN_CONFIDENCE:
                    sure[pattern, kind] = confidence
        fresh = {}
        for (p, s), k in seed.items():
            for kind in (0, 3):
                if k < 0 and (p, kind) in sure and suits(kind, s):
                    fresh[s, kind] = fresh.get((s, kind), 1.0) * max(1 - sure[p, kind], 1e-9)
        known = start | {x: 1 - miss for x, miss in fresh.items() if 1 - miss >= pii.INSTANCE_CONFIDENCE}
    seeded = {s for s, _ in start}
    want = {}
    for (s, kind), c in sorted(known.items()):
        if s not in seeded and (s not in want or c > want[s][1]):
            want[s] = kind, c
    assert got == {s: kind for s, (kind, _) in want.items()}
