import random
import re

from tessera.llm import lines

from .data import SCHEMA, odd, prose, rows


def brute(table):
    """Line numbers to delete for each (doc_id, text), by comparing every run with all earlier ones."""
    docs = sorted({(d, t or "") for d, t, *_ in table}, key=lambda x: (x[0] is not None, x[0] or 0))
    seen, gone = set(), {}
    for doc in docs:
        kept = [(k, x.strip(" ")) for k, x in enumerate(doc[1].split("\n")) if x.strip(" ")]
        out = set()
        for n in range(len(kept)):
            for size in range(1, lines.MIN_LINES + 1):
                run = tuple(x for _, x in kept[n : n + size])
                if len(run) == size:
                    words = sum(len(re.split(r"[ \t\n\x0b\f\r]+", x)) for x in run)
                    if run in seen and (words >= lines.MIN_WORDS or size == lines.MIN_LINES):
                        out |= {k for k, _ in kept[n : n + size]}
                    seen.add(run)
        gone[doc] = sorted(out)
    return gone


def test_against_brute_force(spark):
    rng = random.Random(4)
    pool = [prose(rng, rng.choice((1, 2, 3, 6, 60))) for _ in range(30)]
    texts = ["\n".join(rng.choice(pool + [""]) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    run = "\n".join(pool[:12])
    texts += [prose(rng, 5) + "\n" + run, run + "\n\n" + prose(rng, 9), "a b\nc\nd e", "k\na b\nc\nd e\nm", "é ü\nß\nñ 日本\n\té", "q\né ü\nß\nñ 日本", "a\nb\nc\nd", "x\na\nb\n\nc\nd", "\n".join(["z"] * 40)] + odd()
    table = rows(texts)
    table += table[3:5]
    out = lines.dedup(spark.createDataFrame(table, SCHEMA)).collect()
    assert len(out) == len(table)
    gone = brute(table)
    texts = {d: t for d, t, *_ in table}
    for r in out:
        own = texts[r.doc_id]
        expected = gone[r.doc_id, own or ""]
        assert r.deleted == ",".join(map(str, expected)), r.doc_id
        kept = None if own is None else "\n".join(x for k, x in enumerate(own.split("\n")) if k not in expected)
        assert r.text == kept and r.n_deleted == len(expected) and r.unit == "x"


def test_three_lines_that_have_five_words_together(spark):
    out = lines.dedup(spark.createDataFrame(rows(["a b\nc\nd e", "x\na b\nc\nd e\ny", "a b\nc\nz"]), SCHEMA)).collect()
    assert {r.doc_id: r.deleted for r in out} == {0: "", 1: "1,2,3", 2: ""}


def test_empty_table(spark):
    assert lines.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_frequent_lines_are_dealt_out(spark, monkeypatch):
    texts = [f"the same line in every text {k % 2}\nline {k} of its own with words" for k in range(120)]
    table = rows(texts)
    whole = sorted(map(tuple, lines.dedup(spark.createDataFrame(table, SCHEMA)).select("doc_id", "text", "deleted").collect()))
    monkeypatch.setattr(lines, "TOGETHER", 7)
    assert sorted(map(tuple, lines.dedup(spark.createDataFrame(table, SCHEMA)).select("doc_id", "text", "deleted").collect())) == whole
    assert sum(d == "0" for _, _, d in whole) == 118
