import random
import zlib

from tessera.llm import language

from .data import SCHEMA, odd

SOUNDS = {"aa": "ba da ga lo mu", "bb": "schtr upf ölk ßen", "cc": "ñar ción llo qué"}


def text(rng, lang, n):
    parts = SOUNDS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def table(rng):
    out = []
    for k in range(240):
        lang = rng.choice(sorted(SOUNDS))
        out.append((k, text(rng, lang, rng.choice((3, 20, 200))), lang, "s", 0, 0.0, None))
    return out


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(5)
    rows = table(rng)
    extra = [(1000 + k, t, None, None, 0, 0.0, None) for k, t in enumerate([*odd(rng), "12 34 !!"])] + [(None, "ba da", "aa", "s", 0, 0.0, None)] * 2
    out = language.identify(spark.createDataFrame(rows + extra, SCHEMA)).collect()
    assert len(out) == len(rows) + len(extra)
    truth = {d: lang for d, _, lang, *_ in rows}
    texts = {d: t for d, t, *_ in rows + extra}
    judged = [r for r in out if r.doc_id in truth and r.held_out]
    assert len(judged) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in judged) / len(judged) >= 0.97
    for r in out:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, texts[r.doc_id] or "")))
        assert r.lang_pred in SOUNDS or r.lang_pred == "und"


def test_lang_is_no_input(spark):
    rows = table(random.Random(6))
    model = language.learn(spark.createDataFrame(rows, SCHEMA))
    first, again = ([(r.doc_id, r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(t, SCHEMA), model).orderBy("doc_id").collect()] for t in (rows, [(d, t, "zz", None, 0, 0.0, None) for d, t, *_ in rows]))
    assert first == again


def test_nothing_to_learn_from(spark):
    out = language.identify(spark.createDataFrame([(1, "ba da", None, None, 0, 0.0, None)], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)]
    assert language.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 300)
    rng = random.Random(8)
    names = [f"l{k:02d}" for k in range(70)]
    words = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(6)] for x in names}
    rows = [(k, " ".join(rng.choice(words[x]) for _ in range(40)), x, "s", 0, 0.0, None) for k, x in enumerate(names * 14)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.learn(docs)
    assert model.languages == names
    out = language.identify(docs, model).collect()
    truth = {r[0]: r[2] for r in rows}
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.9


def test_slices_change_nothing(monkeypatch):
    rng = random.Random(9)
    long = " ".join("".join(rng.choice("abcñß1-") for _ in range(rng.randint(1, 9))) for _ in range(400)) + "x" * 300
    whole = language.counts(long)
    for size in (1, 7, 64):
        monkeypatch.setattr(language, "SLICE", size)
        cut = language.counts(long)
        assert (cut[0] == whole[0]).all() and (cut[1] == whole[1]).all()
