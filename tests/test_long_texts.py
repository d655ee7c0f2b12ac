"""Long texts: the same results in pieces as whole, in time that grows with the text."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import detect, tokenize

WORDS = ["the", "maison", "Dupont", "rue", "avenue", "SARL", "Acme", "M.", "Mme", "12", "06 12 34 56 78", "a@b.com", "https://x.org/a?b=1", "FR76 3000 6000 0112 3456 7890 189", "été", "Élan", ".", ",", "\n\n", "   ", "3 5", "NIR 1 85 12 75 108 042 36", "-", "(", "日本", "x'y", "A", "street"]


def texts(rng):
    some = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    some += [" ".join(["rue"] * 60), "Rue " * 50 + "de la Paix", "5 rue " * 40, "a" * 300, " " * 300 + "x", "1 2 3 " * 60, "x " + "\t\n " * 40 + "y", "", " ", None]
    return some + ["Le 4 rue " + "x " * 7 + "rue b " * 9 + "SARL Acme Dupont rue c d e f g h i j rue k", "nom. " + "mot " * 9 + ". Dupont " + "mot " * 12 + "M. Dupont"]


def found(spark, table):
    docs = spark.createDataFrame(list(enumerate(table)), "doc_id long, text string").repartition(3)
    groups = sorted(map(repr, detect.groups(detect.analysed(docs)).collect()))
    languages = sorted(map(repr, detect.analysed(docs).drop("groups").collect()))
    spans = sorted(map(repr, tokenize.spans(docs).collect()))
    same = sorted(map(repr, detect.with_language(docs).select("doc_id", "score_fr", "score_en", "score_de", "language").collect()))
    return [groups, languages, spans, same, sorted(map(repr, tokenize.tokens(docs).collect()))]


@pytest.mark.parametrize("chunk", [1, 23])
def test_pieces_give_what_the_whole_gives(spark, monkeypatch, chunk):
    table = texts(random.Random(chunk))
    monkeypatch.setattr(tokenize, "CHUNK", 1 << 20)
    whole = found(spark, table)
    monkeypatch.setattr(tokenize, "CHUNK", chunk)
    small = found(spark, table)
    for name, a, b in zip(("groups", "scores", "spans", "languages", "tokens"), whole, small):
        assert a == b, name


def test_pieces_cover_the_text(spark, monkeypatch):
    monkeypatch.setattr(tokenize, "CHUNK", 30)
    table = [t for t in texts(random.Random(9)) if t is not None]
    docs = spark.createDataFrame([(t,) for t in table], "text string")
    got = docs.select("text", tokenize.pieces(F.col("text")).alias("p")).collect()
    assert all("".join(r.p) == r.text for r in got) and max(len(r.p) for r in got) > 5


def test_greedy_scan_carries_over_batches(spark, monkeypatch):
    table = texts(random.Random(2)) * 3
    docs = spark.createDataFrame(list(enumerate(table)), "doc_id long, text string")
    whole = sorted(map(repr, detect.groups(detect.analysed(docs)).collect()))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 7)
        assert sorted(map(repr, detect.groups(detect.analysed(docs)).collect())) == whole
    finally:
        spark.conf.set(key, before)


def test_megabytes_of_streets_and_spans(spark):
    """What took time with the square of a text's street words, spans or length."""
    rng = random.Random(1)
    streets = " ".join(rng.choice(("rue", "Avenue", "de", "la", "Paix", "12")) for _ in range(250_000))
    mails = " ".join(f"mail a{k}@b.com or" for k in range(100_000))
    plain = " ".join(rng.choice(("le", "chat", "dort", "Dupont", "et", "mange.")) for _ in range(200_000))
    docs = spark.createDataFrame([(1, streets), (2, mails), (3, plain)], "doc_id long, text string").repartition(3)
    sizes = {r.doc_id: r.n for r in tokenize.spans(docs).select("doc_id", F.size("spans").alias("n")).collect()}
    assert sizes[2] == 100_000
    rows = {r.doc_id: r.groups for r in detect.analysed(docs).collect()}
    taken = [g for g in rows[1] if g["pass"] == 3]
    assert len(rows[2]) == 100_000 and len(taken) > 10_000 and all(a.end <= b.start for a, b in zip(taken, taken[1:]))


def test_what_a_task_sorts_does_not_grow_with_the_table(spark, monkeypatch):
    from tessera.functions.lexicon import DEFAULT
    from tessera.sources import tables

    docs = spark.createDataFrame([(k, f"Mme Dupont {k} et Acme SARL de Lyon. " * 40) for k in range(60)], "doc_id long, text string")
    whole = sorted(map(repr, detect.analysed(docs).collect()))
    total = docs.selectExpr("sum(length(text))").first()[0]
    monkeypatch.setattr(tables, "TOGETHER", 5_000)
    parts = tables.parts_of(docs, "text")
    assert parts == -(-total // 5_000)
    rows = detect.grouped_words(detect.kept_tokens(docs, [], DEFAULT), parts)
    assert rows.rdd.getNumPartitions() == parts
    assert sorted(map(repr, detect.analysed(docs).collect())) == whole
    longest = tokenize.chunked(docs).selectExpr("max(length(text))").first()[0]
    assert longest < 1_000  # the pieces that wait for Python


def test_pieces_do_not_become_pandas_objects(spark):
    """As pandas objects the token lengths of a batch of pieces took some 300 MB of a Python worker."""
    from pyspark.util import PythonEvalType

    from tessera.operators import tokenize

    plan = tokenize.placed(spark.createDataFrame([(1, "Some text")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in plan
    assert f", {PythonEvalType.SQL_SCALAR_PANDAS_ITER_UDF}" not in plan
