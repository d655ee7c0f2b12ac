import math
import random
import textwrap

from tessera.llm import licences

from .data import SCHEMA, odd, prose


def brute(text):
    """(paragraph, family, predicted) of a text by the model, without Spark."""
    import re

    weights, intercepts, thresholds = licences.model()
    out = []
    for k, line in enumerate(text.split("\n")):
        if not re.search(licences.ANCHOR, line):
            continue
        own = sorted(set(licences.grams(licences.words(line))))
        p = {f: licences.sigmoid(intercepts[f] + sum(weights[f].get(g, 0.0) for g in own) / math.sqrt(len(own))) for f in weights if any(g in weights[f] for g in own)}
        passed = {f: v for f, v in p.items() if v > thresholds[f]}
        predicted = max(passed, key=passed.get) if passed else "unknown"
        share = max((len(set(own) & set(t)) / len(set(t)) for t in (licences.grams(licences.words(x)) for x in licences.TEMPLATES.get(predicted, []))), default=0)
        out.append((k, predicted if share >= licences.CONFIRMED else "unknown", predicted))
    return out


def test_against_brute_force(spark):
    rng = random.Random(15)
    notices = [t for texts in licences.TEMPLATES.values() for t in texts] + licences.ORDINARY + ["Licensed under the Foo License.", "license", "Lizenz mit Fisch"]
    texts = []
    for t in notices:
        words = t.split()
        texts += [t, prose(rng, 5) + " " + t, "\n".join([prose(rng, 8), t.upper(), prose(rng, 3)]), " ".join(w for w in words if rng.random() > 0.3)]
    texts += odd(rng)
    table = [(k, t, None, None, 0, 0.0, "x") for k, t in enumerate(texts)] + [(0, texts[0], None, None, 0, 0.0, "x"), (None, notices[0], None, None, 0, 0.0, None)]
    out = licences.scan(spark.createDataFrame(table, SCHEMA)).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.paragraph, r.family, r.predicted) for r in out)
    want = sorted((d, *x) for d, t in [*enumerate(texts), (-1, notices[0])] for x in brute(t or ""))
    assert got == want


def test_templates_are_found():
    for family, texts in licences.TEMPLATES.items():
        for t in texts:
            assert brute(t) == [(0, family, family)], t
    for t in licences.ORDINARY:
        assert all(x[1] == "unknown" for x in brute(t)), t


def test_notices_of_other_kinds_are_unknown():
    """Wordings left out of training set the thresholds; those in it and further ones are unknown as well."""
    assert len(set(licences.model()[2].values())) > 5
    for t in licences.NEAR_MISSES + ["Licensed under the Academic Free License 3.0.", "Released under the Sleepycat License."]:
        assert all(x[1] == "unknown" for x in brute(t)), t


def test_wrapped_notices_and_those_without_anchor(spark):
    rng = random.Random(18)
    texts, want = [], []
    for family, notice in ((f, t) for f in ("bsd", "gpl", "mit") for t in licences.TEMPLATES[f] if len(t.split()) > 20):
        wrapped = textwrap.wrap(notice, 60)
        texts += ["\n".join(wrapped), "\n".join([prose(rng, 8), "", *wrapped, prose(rng, 9)])]
        want += [{(family, 0)}, {(family, 2)}]
    texts += [licences.TEMPLATES["mit"][2].replace("Permission ", ""), licences.TEMPLATES["bsd"][1].replace("Redistribution ", "")]
    want += [{("mit", 0)}, {("bsd", 0)}]
    out = licences.scan(spark.createDataFrame([(k, t, None, None, 0, 0.0, "x") for k, t in enumerate(texts)], SCHEMA)).collect()
    for k, t in enumerate(texts):
        got = [r for r in out if r.doc_id == k and r.family != "unknown"]
        assert len(got) == 1 and got[0].family == min(want[k])[0], (t, got)
        first = min(want[k])[1]
        assert first <= got[0].paragraph < got[0].paragraph + got[0].lines <= len(t.split("\n")), (t, got)


def test_notices_anywhere_in_long_blocks(spark):
    """Blocks without blank lines, many times as long as a run may be; notices across the borders of windows too."""
    rng = random.Random(21)
    wrapped, half = textwrap.wrap(next(t for t in licences.TEMPLATES["mit"] if len(t.split()) > 20), 60), licences.longest()
    places = [0, 1, half - len(wrapped), half - 2, half - 1, half, half + 1, 2 * half - 1, 2 * half, 3 * half - 1, 5 * half - len(wrapped)]
    texts = []
    for at in places:
        lines = [prose(rng, 8) for _ in range(5 * half - len(wrapped))]
        texts.append("\n".join(lines[:at] + wrapped + lines[at:]))
    out = licences.scan(spark.createDataFrame([(k, t, None, None, 0, 0.0, "x") for k, t in enumerate(texts)], SCHEMA)).collect()
    for k, at in enumerate(places):
        got = [r for r in out if r.doc_id == k and r.family != "unknown"]
        assert len(got) == 1 and got[0].family == "mit" and at <= got[0].paragraph < got[0].paragraph + got[0].lines <= at + len(wrapped), (at, got)


def test_empty_table(spark):
    assert licences.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def tight_runs(text):
    """(paragraph, lines, family) of the runs that win in a text in which no line is a notice by itself, from every run there is."""
    templates = [(f, set(licences.grams(licences.words(t)))) for f in licences.TEMPLATES for t in licences.TEMPLATES[f]]
    lines, won = text.split("\n"), []
    weights, intercepts, thresholds = licences.model()
    for first in range(len(lines)):
        for n in range(2, min(licences.longest(), len(lines) - first) + 1):
            run = lines[first : first + n]
            if not all(x.strip(" ") for x in run):
                break
            held = [set(licences.grams(licences.words(" ".join(part)))) for part in (run, run[1:], run[:-1])]
            if not any(len(t & held[0]) >= licences.CONFIRMED * len(t) - 1e-9 and len(t & held[0]) > max(len(t & held[1]), len(t & held[2])) for _, t in templates):
                continue
            p = {f: licences.score(weights[f], intercepts[f], sorted(held[0])) for f in weights if held[0] & weights[f].keys()}
            passed = {f: v for f, v in p.items() if v > thresholds[f]}
            family = max(passed, key=passed.get) if passed else None
            share = max((len(t & held[0]) / len(t) for f, t in templates if f == family), default=0)
            if share >= licences.CONFIRMED:
                won.append((-share, n, first, family))
    kept = []
    for share, n, first, family in sorted(won):
        if all(f != family or first >= b + m or b >= first + n for b, m, f in kept):
            kept.append((first, n, family))
    return sorted(kept)


def test_runs_against_every_run(spark):
    """Notices of all families in short lines, broken off, twice in a row, one in another, with blank lines and prose between."""
    rng = random.Random(33)
    notices = [t for texts in licences.TEMPLATES.values() for t in texts if len(t.split()) > 9]
    texts = []
    for k in range(60):
        lines = []
        for _ in range(rng.randint(1, 3)):
            words = rng.choice(notices).split()
            words = [w for w in words if rng.random() > rng.choice((0, 0.1))]
            lines += textwrap.wrap(" ".join(words), rng.choice((12, 25, 40)))
            lines += [prose(rng, rng.randint(1, 6)) for _ in range(rng.randint(0, 2))] + [""] * (rng.random() < 0.2)
        if k % 5 == 0:
            lines = lines[: len(lines) // 2] + textwrap.wrap(rng.choice(notices), 30) + lines[len(lines) // 2 :]
        texts.append("\n".join(lines))
    out = licences.scan(spark.createDataFrame([(k, t, None, None, 0, 0.0, "x") for k, t in enumerate(texts)], SCHEMA)).collect()
    found = 0
    for k, t in enumerate(texts):
        single = [r for r in out if r.doc_id == k and r.lines == 1 and r.family != "unknown"]
        lines = ["" if any(r.paragraph == n for r in single) else x for n, x in enumerate(t.split("\n"))]
        want = tight_runs("\n".join(lines))
        assert sorted((r.paragraph, r.lines, r.family) for r in out if r.doc_id == k and r.lines > 1) == want, t
        found += len(want)
    assert found > 60
