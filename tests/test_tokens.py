"""Tokens: the fast forms of the expressions against the plain ones, and what the steps hold while they work."""

import random
import re

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.lexicon import DEFAULT
from tessera.operators import detect, tokenize

SIGNS = list("aZéÀÿß×'-19.,@ \t\n(日_") + [" ", " ", "ſ", "ı", "😀", "://", "the", "LA"]


def samples(n):
    rng = random.Random(5)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_fast_tokens_are_the_basic_ones(spark):
    docs = spark.createDataFrame([(t,) for t in samples(400)], "text string")
    plain = F.regexp_extract_all("text", F.lit(T.unicode_space(T.BASIC)), F.lit(0))
    words = F.filter(plain, lambda t: t.rlike(T.WORD_START))
    rows = docs.select(plain.alias("a"), F.regexp_extract_all("text", F.lit(T.TOKENS), F.lit(0)).alias("b"), words.alias("c"), F.regexp_extract_all("text", F.lit(T.WORDS), F.lit(0)).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in rows)


def test_long_numbers_and_words_are_one_token(spark):
    """A group that may be tried again takes a frame of the stack for each repetition."""
    docs = spark.createDataFrame([(1, "1." * 200_000 + "1"), (2, "a-" * 200_000 + "a")], "doc_id long, text string")
    assert {r.doc_id: r.n for r in tokenize.tokens(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {1: 1, 2: 1}


def test_texts_without_identifiers_have_no_patterns(spark):
    docs = spark.createDataFrame([(1, "Le chat dort"), (2, "a@b.com dort")], "doc_id long, text string")
    rows = {r.doc_id: (r.texts, r.patterns) for r in tokenize.with_tokens(tokenize.chunked(docs)).collect()}
    assert rows == {1: (["Le", " ", "chat", " ", "dort"], None), 2: (["a@b.com", " ", "dort"], ["email", None, None])}


def test_kinds_are_counted_as_their_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(samples(100) + ["0123456789 0123456789", "a@b.com a@b.com", "", None])), "doc_id long, text string")
    each = {(r.text, r.kind): r["count"] for r in tokenize.tokens(docs).groupBy("text", "kind").count().collect()}
    assert {(r.text, r.kind): r.n for r in tokenize.token_kinds(docs).collect()} == each


def test_detection_leaves_no_rows_waiting_for_python(spark):
    """Pieces with all their tokens and flags waited in the JVM while Python had a batch."""
    docs = spark.createDataFrame([(1, "Mme Dupont")], "doc_id long, text string")
    plan = detect.kept_tokens(docs, [], DEFAULT)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_detection_carries_over_what_python_has_in_hand(spark, monkeypatch):
    table = samples(60) + ["5 rue " * 40, " ".join(["rue", "Dupont", "et", "M.", "12", "SARL"] * 30), "", " ", None, "nom . " * 30 + "Dupont"]
    docs = spark.createDataFrame(list(enumerate(table)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(tokenize, "CHUNK", 8)
    whole = sorted(map(repr, detect.kept_tokens(docs, [], DEFAULT).collect()))
    stops = {f"score_{x}": words for x, words in DEFAULT.stop_words.items()}
    asks = dict(zip(detect.ASKED, (DEFAULT.company_words, DEFAULT.street_words, DEFAULT.honorifics, DEFAULT.every_stop_word)))
    rows = tokenize.with_tokens(tokenize.chunked(docs)).select("doc_id", "chunk", "texts", "patterns", "after").toArrow()
    batch = rows.combine_chunks().to_batches()[0]
    one = [list(detect.marker([], asks, stops)(iter([batch.slice(k, size) for k in range(0, batch.num_rows, size)]))) for size in (1, 3, 1000)]
    one = [[r for b in batches for r in b.to_pylist()] for batches in one]
    assert one[0] == one[1] == one[2] and len(one[0]) == len(whole)


def test_what_aliases_sort_does_not_grow_with_the_table(spark, monkeypatch):
    """The shuffles of entities and aliases had the session's number of parts, however many rows there were."""
    from tessera.plans.anonymize import Options, anonymize
    from tessera.sources import tables

    docs = spark.createDataFrame([(k, "s", k, f"M. Dupont voit Mme Durand {k} et a{k}@b.com a Lyon") for k in range(60)], "doc_id long, session_id string, doc_ord long, text string")
    whole = sorted(map(repr, anonymize(docs, options=Options()).aliases.collect()))
    key, adaptive, asked, write = "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", {}, tables.written

    def noted(df, name, rows=0):
        with tables.shuffled(spark, rows):
            asked[name] = (int(spark.conf.get(key)), rows)
        return write(df, name, rows)

    monkeypatch.setattr(tables, "SORTED", 30)
    monkeypatch.setattr(tables, "written", noted)
    assert sorted(map(repr, anonymize(docs, options=Options()).aliases.collect())) == whole
    for name in ("entities", "merged", "aliases"):
        parts, rows = asked[name]
        assert rows >= 180 and parts == -(-rows // 30) > int(spark.conf.get(key)) == 4
    spark.conf.set(adaptive, "false")
    try:
        path = write(docs.groupBy("doc_id").count(), "counted", 60 * 30).written_to
    finally:
        spark.conf.unset(adaptive)
    assert spark.read.parquet(path).select(F.input_file_name()).distinct().count() > 4
